"""Log entries: layouts, continuation lines, blocks, dirty rows."""

from __future__ import annotations

from lumberline.operators import log_entries as le

FILES = "id bigint, virtual_path string, modified_time bigint, extra string"
LINES = "id bigint, file_path string, line_number bigint, content string, level string"
CASES = {
    "2024-02-04 22:33:01 [DEBUG] a.b - msg": (1707085981000, "debug", "a.b"),
    "2023-07-17 17:31:37,660 WARN  [pool-1-thread-6] net.x.Y - msg": (1689615097660, "warn", "net.x.Y"),
    "2025-04-25 13:34:56.893 \x1b[32mINFO\x1b[0m task.actor > msg": (1745588096893, "info", "task.actor"),
    "2023-01-23T18:55:32.688Z crit hash-checker: msg": (1674500132688, "fatal", "hash-checker"),
    "2025-02-15T04:21:10+02:00 <NOTICE> (search.plan) msg": (1739586070000, "info", "search.plan"),
    '{"ts": "2023-02-17T15:42:15.045Z", "level": "err", "logger": "n.P", "msg": "x"}': (1676648535045, "error", "n.P"),
    '{"v":0,"component":"g-c","level":20,"time":1705705755252,"message":"x"}': (1705705755252, "debug", "g-c"),
    '{"message": "x", "severity": "DEBUG", "@timestamp": "2024-08-18 11:00:35", "module": "m"}': (1723978835000, "debug", "m"),
    'time=2025-02-06T05:59:57.267Z level=info component=p.g msg="a \\"b\\" c" seq=1': (1738821597267, "info", "p.g"),
    "08-27 03:26:19.286  9422  9456 F RegexGate: msg": (1724729179286, "fatal", "RegexGate"),
    "2025/08/03 02:36:14.201 V/LineFeeder(7579): msg": (1754188574201, "trace", "LineFeeder"),
    "2025/09/05 12:04:23 [notice] 17173#2: path-shortener: msg": (1757073863000, "info", "path-shortener"),
    "31/03/2025 09:19:32 | DEBUG | export.csv | msg": (1743412772000, "debug", "export.csv"),
    "<163>1 2023-08-21T14:18:18.832Z node import-gate 26007 - - msg": (1692627498832, "error", "import-gate"),
    "Jan  6 11:39:10 node-g21 shard-keeper[20051]: emerg: msg": (1704541150000, "fatal", "shard-keeper"),
    "[Thu May 02 06:02:18.426849 2024] [cas_store:notice] [pid 1:tid 2] msg": (1714629738426, "info", "cas_store"),
    "W0618 02:34:28.575697 20162 tail_reader.cc:376] msg": (1718678068575, "warn", "tail_reader.cc"),
    "1674157568.224 line-splitter/FINEST :: msg": (1674157568224, "trace", "line-splitter"),
    "20240718 21:36:19 DEBUG (LineFeeder) msg": (1721338579000, "debug", "LineFeeder"),
}
NO_HEADERS = [" 2024-02-04 22:33:01 [DEBUG] a.b - quoted", "> 2023-02-03 11:06:12 ERROR relay session: no route", "2023-11-02 was the last day", "{", "ERROR rows: 29", "2024-02-04 22:33:01 [NOLEVEL] a - b", "", "\x01odd", "INFO: alone"]


def frames(spark, rows, modified=1720000000):
    paths = {r[1] for r in rows if r[1]}
    return spark.createDataFrame(rows, LINES), spark.createDataFrame([(i, p, modified, None) for i, p in enumerate(sorted(paths))], FILES)


def entries(spark, rows):
    return sorted(tuple(r) for r in le.log_entries(*frames(spark, rows)).drop("message").collect())


def test_layouts(spark):
    """Every layout, plain and after a byte-order mark in two forms."""
    marks = ["", "\ufeff", "ï»¿"]
    rows = [(i, f"f{k}-{i}", 1, mark + h, None) for k, mark in enumerate(marks) for i, h in enumerate(CASES)]
    want = sorted((f"f{k}-{i}", 1, 1, *v) for k in range(len(marks)) for i, v in enumerate(CASES.values()))
    assert entries(spark, rows) == want


def test_lines_that_start_nothing(spark):
    rows = [(0, "f", 1, "2024-02-04 22:33:01 [INFO] a - b", None)] + [(i + 1, "f", i + 2, c, None) for i, c in enumerate(NO_HEADERS)]
    assert [e[1:3] for e in entries(spark, rows)] == [(1, len(rows))]


def test_two_line_header(spark):
    rows = [(1, "f", 1, "Jul 17, 2024 12:01:52 AM net.x.Follower handle", None), (2, "f", 2, "SEVERE: down", None), (3, "f", 3, "Jul 17, 2024 12:01:52 PM net.x.Follower handle", None), (4, "f", 4, "FINE: up", None)]
    assert entries(spark, rows) == [("f", 1, 2, 1721174512000, "error", "net.x.Follower"), ("f", 3, 4, 1721217712000, "debug", "net.x.Follower")]


def test_dirty_rows(spark):
    head = "2024-02-04 22:33:01 [INFO] a - b"
    rows = [(1, "f", 2, head, None), (1, "f", 2, head, None), (2, "f", 1, "before", None), (3, "f", 3, None, None), (4, None, 1, head, None), (5, "f", None, head, None), (6, "f", 4, head + "\r", "debug"), (7, "g", 1, "no header", None)]
    assert [e[:3] for e in entries(spark, rows)] == [("f", 2, 3), ("f", 4, 4)]


def test_empty_tables(spark):
    lines, files = frames(spark, [(1, "f", 1, "x", None)])
    assert le.log_entries(lines.limit(0), files.limit(0)).collect() == []


def test_blocks_give_the_same(spark, monkeypatch):
    head = "2024-02-04 22:33:{:02d} [INFO] a - b"
    rows = [(i, "f", i + 1, head.format(i % 60) if i % 7 == 0 and not 20 < i < 60 else f"more {i}", None) for i in range(100)]
    rows.append((100, "f", 101, "last", None))
    whole = entries(spark, rows)
    messages = {(r.first_line): r.message for r in le.entry_messages(*frames(spark, rows)).collect()}
    for _, a, b, *_ in whole:
        assert messages[a] == "\n".join(["b", *[r[3] for r in rows if a < r[2] <= b]])
    monkeypatch.setattr(le, "BLOCK_BITS", 3)
    monkeypatch.setattr(le, "BLOCK", 8)
    assert entries(spark, rows) == whole and len(whole) > 5
    assert {(r.first_line): r.message for r in le.entry_messages(*frames(spark, rows)).collect()} == messages


def test_two_line_header_over_a_block_edge(spark, monkeypatch):
    """Headers begin at each line of a block in turn; some have lines ahead of or behind the second, some none."""
    head = "Jul 17, 2024 12:01:{:02d} AM net.x.Follower handle"
    texts = []
    for i in range(24):
        texts += [head.format(i), f"{('SEVERE', 'FINE')[i % 2]}: down {i}", *[f"more {k}" for k in range((0, 1, 0, 11, 0)[i % 5])]]
    texts += [head.format(30), "no second", "WARNING: too late"] * 9
    rows = [(i, "f", i + 1, c, None) for i, c in enumerate(texts)]
    rows += [r for r in rows if r[2] % 8 in (0, 7)]

    def got():
        return sorted(tuple(r) for r in le.log_entries(*frames(spark, rows)).select("first_line", "last_line", "ts_ms", "level", "component", "message").collect()), {(r.first_line): (r.level, r.message) for r in le.entry_messages(*frames(spark, rows)).collect()}

    whole = got()
    assert sum(r[0] % 8 == 7 and r[3] is not None for r in whole[0]) > 2 and len(whole[0]) == 33
    monkeypatch.setattr(le, "BLOCK_BITS", 3)
    monkeypatch.setattr(le, "BLOCK", 8)
    assert got() == whole

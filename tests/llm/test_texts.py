"""Shared spans, runs of events and garbled text against brute force."""

from __future__ import annotations

import random
import re

import pytest

from lumberline.llm import event_runs as er
from lumberline.llm import mojibake as mj
from lumberline.llm import shared_spans as ss
from lumberline.operators import log_entries as le


def brute(texts, span):
    where = {}
    for d, t in texts.items():
        for i in range(len(t) - span + 1):
            where.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in texts.items():
        hit = [False] * len(t)
        for i in range(len(t) - span + 1):
            if len(where[t[i : i + span]]) > 1:
                hit[i : i + span] = [True] * span
        if any(hit):
            out[d] = sum(hit)
    return out


def test_shared_spans(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé中\U0001f600") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = [text(200) for _ in range(6)]
    docs = {i: b for i, b in enumerate(base)}
    for i in range(6, 30):
        src = rnd.choice(base)
        a = rnd.randint(0, 500)
        docs[i] = text(rnd.randint(0, 30)) + src[a : a + rnd.choice([150, 199, 200, 201, 260, 400])] + text(rnd.randint(0, 30))
    docs |= {40: "-" * 500, 41: "x" + "-" * 300 + "y", 42: "ab" * 150, 43: "q" + "ab" * 140, 44: "-" * 199, 45: docs[0], 46: docs[0], 47: "same " * 100, 48: ""}
    docs[49] = docs[3] + docs[3]  # twice in one document
    rows = [(d, t, "clash") for d, t in docs.items()] + [(50, None, None), (45, docs[0], "again"), (None, docs[1], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, name string")
    got = {r.doc_id: r.shared_chars for r in ss.shared_spans(df).collect()}
    assert got == brute(docs, ss.SPAN)


def test_shared_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, "short"), (2, None)], "doc_id bigint, text string")
    assert ss.shared_spans(df).collect() == [] and ss.shared_spans(df.limit(0)).collect() == []


def plain_runs(rows):
    """Runs by walking the sorted lines of each file."""
    seen, out, cur = {}, [], None
    for _, f, n, c in rows:
        if f is not None and n is not None:
            seen[f, n] = c or ""
    events = []
    for f, n in sorted(seen):
        m = re.match(r"2024-02-04 22:33:\d\d \[([A-Z]+)\] (\S+) - (.*)$", seen[f, n], re.S)
        if m:
            events.append([f, n, n, m[1], m[2], m[3]])
        elif events and events[-1][0] == f:
            events[-1][2] = n
            events[-1][5] += " " + seen[f, n]
    for f, a, b, lv, co, msg in events:
        key = (f, lv, co, [t for t in msg.split() if not re.search("[0-9]", t)])
        key = (*key[:3], "".join(key[3]))
        if cur and cur[0] == key:
            cur[2], cur[3] = b, cur[3] + 1
        else:
            cur = [key, a, b, 1]
            out.append(cur)
    return sorted((k[0], a, b, n) for k, a, b, n in out)


@pytest.mark.parametrize("bits", [16, 3])
def test_event_runs(spark, monkeypatch, bits):
    rnd = random.Random(6)
    rows, i = [], 0
    for f in ("a", "b", "c"):
        for n in range(1, 90 if f != "c" else 5):
            kind = rnd.random()
            head = f"2024-02-04 22:33:{n % 60:02d} [{rnd.choice(['INFO', 'INFO', 'WARN'])}] x.y - "
            c = head + rnd.choice(["took 5ms", "took  9ms ", "took 7 done", "pool a1 free"]) if kind < 0.6 else rnd.choice(["  at 12", "  at 13 x", "7", "", None])
            rows.append((i, f, n, c))
            i += 1
    rows += [rows[3], (999, None, 4, "x"), (998, "a", None, "x")]
    rnd.shuffle(rows)
    for m in (le, er):
        monkeypatch.setattr(m, "BLOCK_BITS", bits)
        monkeypatch.setattr(m, "BLOCK", 1 << bits)
    df = spark.createDataFrame(rows, "id bigint, file_path string, line_number bigint, content string")
    got = sorted((r.file_path, r.first_line, r.last_line, r.n_events) for r in er.event_runs(df).collect())
    assert got == plain_runs(rows)


@pytest.mark.parametrize("bits", [16, 3])
def test_runs_of_two_line_headers(spark, monkeypatch, bits):
    """Alike entries whose second line is the first of a block stay one run."""
    texts = ["ahead"] + [t for i in range(40) for t in (f"Jul 17, 2024 12:01:{i:02d} AM net.x.Follower handle", f"{'SEVERE' if i < 25 else 'FINE'}: down {i}")]
    for m in (le, er):
        monkeypatch.setattr(m, "BLOCK_BITS", bits)
        monkeypatch.setattr(m, "BLOCK", 1 << bits)
    df = spark.createDataFrame([(i, f, i + f0, t) for f, f0 in (("a", 1), ("b", 0)) for i, t in enumerate(texts) if i + f0], "id bigint, file_path string, line_number bigint, content string")
    got = sorted((r.file_path, r.first_line, r.last_line, r.n_events, r.level) for r in er.event_runs(df).collect())
    assert got == [("a", 2, 51, 25, "error"), ("a", 52, 81, 15, "debug"), ("b", 1, 50, 25, "error"), ("b", 51, 80, 15, "debug")]


@pytest.mark.parametrize("bits", [16, 2])
def test_times_of_runs_without_year(spark, monkeypatch, bits):
    """Three layouts without a year over 29 February, in a leap year, another year and an unknown one."""
    texts = ["Feb 28 23:59:50 n x[1]: info: up 1", "Feb 29 00:00:00 n x[1]: info: up 2", "Mar  1 00:00:10 n x[1]: info: up 3", "W0618 02:34:28.500000 20162 t.cc:376] m", "08-27 03:26:19.286  9422  9456 F R: m", "2023-01-01 00:00:01 [INFO] a - b"]
    for m in (le, er):
        monkeypatch.setattr(m, "BLOCK_BITS", bits)
        monkeypatch.setattr(m, "BLOCK", 1 << bits)
    df = spark.createDataFrame([(i, f, i + 1, t) for f in ("leap", "other", "lost") for i, t in enumerate(texts)], "id bigint, file_path string, line_number bigint, content string")
    files = spark.createDataFrame([(1, "leap", 1720000000), (1, "leap", 1720000000), (2, "leap", 1620000000), (3, "other", 1680000000), (4, "lost", None)], "id bigint, virtual_path string, modified_time bigint")
    runs = er.event_runs(df, files).collect()
    starts = {(r.file_path, r.first_line): r.ts_ms for r in le.log_entries(df, files).collect()}
    assert len(runs) == 12 and all(r.first_ms == starts[r.file_path, r.first_line] for r in runs)
    got = {(r.file_path, r.first_line): (r.n_events, r.first_ms, r.duration_ms) for r in runs}
    assert got["leap", 1] == (3, 1709164790000, 86_420_000) and got["leap", 4][:2] == (1, 1718678068500)
    assert got["other", 1] == (3, 1677628790000, 20_000)


def test_event_runs_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, file_path string, line_number bigint, content string")
    assert er.event_runs(df).collect() == []


GOOD = ["Speicher für Größenprüfung fast erschöpft", "échec de la lecture du répertoire après essais", "NÃO FOI POSSÍVEL ABRIR A SEÇÃO", "очередь переполнена, отброшено строк", "解压完成，共 个文件", "次のページを準備中", "user’s draft “x” was dropped…", "plain ascii"]


def test_garbled(spark):
    good = [(i, f"{g} {i}") for i, g in enumerate(GOOD * 25)]
    wrong = {1000: (GOOD[0], "utf-8", "cp1252"), 1001: (GOOD[0], "utf-8", "cp437"), 1002: (GOOD[1], "utf-8", "mac_roman"), 1003: (GOOD[3], "utf-8", "latin-1"), 1004: (GOOD[4], "gbk", "latin-1"), 1005: (GOOD[0], "cp1252", "cp437"), 1006: (GOOD[3], "cp1251", "latin-1"), 1007: (GOOD[5], "utf-8", "latin-1")}
    bad = [(i, t.encode(a).decode(b)) for i, (t, a, b) in wrong.items()]
    lost = [(2000, GOOD[0].encode("cp1252").decode("utf-8", "replace"))]
    rows = [*good, *bad, *lost, bad[0], (None, "Ã¼"), (3000, None), (3001, ""), (3002, "y" * 50_000 + "ü")]
    log = spark.createDataFrame(rows, "id bigint, content string")
    files = spark.createDataFrame([(1, "größe.txt"), (2, "grÃ¶ÃŸe.txt")], "id bigint, original_name string")
    got = {(r.record_kind, r.record_id): r.restored for r in mj.garbled(log, files).collect()}
    assert {k: v for k, v in got.items() if k[0] == "log"} == {("log", i): t for i, (t, _, _) in wrong.items()} | {("log", 2000): None}
    assert got["file", 2] == "größe.txt" and ("file", 1) not in got


def test_garbled_of_nothing(spark):
    log = spark.createDataFrame([], "id bigint, content string")
    files = spark.createDataFrame([], "id bigint, original_name string")
    assert mj.garbled(log, files).collect() == []


def plain_segments(score):
    """The best stretch, then the best ones on either side of it, and so on."""
    best = max(((sum(score[i:j]), i - j, i, j) for i in range(len(score)) for j in range(i + 1, len(score) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = best[2:]
    return plain_segments(score[:i]) + [(i, j)] + [(a + j, b + j) for a, b in plain_segments(score[j:])]


def test_all_maximal_segments(monkeypatch):
    import numpy as np

    rnd = random.Random(8)
    m = mj.Model(*mj.empty_counts())
    for _ in range(60):
        texts = ["x" * rnd.randint(0, 14) for _ in range(5)]
        scores = [[rnd.choice([-2, -2, -1, 1.5, 3.25]) + rnd.random() / 64 for _ in range(len(t) + 1)] for t in texts]
        monkeypatch.setattr(m, "scores", lambda p, s=scores: np.array([v for x in s for v in (*x, -1e9)][:-1]))
        want = [[(max(0, a - 1), min(len(t), b)) for a, b in plain_segments(x)] for t, x in zip(texts, scores, strict=True)]
        assert m.segments(texts) == want


def test_garbled_more_than_three_times(spark):
    """Repairs go on as long as they help; characters outside the segments stay."""
    text = "señal débil"
    for _ in range(4):
        text = text.encode().decode("cp1252")
    log = spark.createDataFrame([(i, f"{GOOD[i % 7]} señal débil mañana {i}") for i in range(300)] + [(500, text + " größe")], "id bigint, content string")
    files = spark.createDataFrame([], "id bigint, original_name string")
    assert {r.record_id: r.restored for r in mj.garbled(log, files).collect()} == {500: "señal débil größe"}


def test_frequent_passages_are_joined_apart(spark, monkeypatch):
    """The same result where the most frequent names go by a broadcast."""
    rnd = random.Random(12)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    hot = text(120)
    docs = {i: text(rnd.randint(0, 60)) + hot[: 400 + i] + text(20) for i in range(20)} | {i: text(100) for i in range(20, 30)}
    monkeypatch.setattr(ss, "HOT_ROWS", 3)
    monkeypatch.setattr(ss, "HOT_KEYS", 2)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.shared_chars for r in ss.shared_spans(df).collect()} == brute(docs, ss.SPAN)

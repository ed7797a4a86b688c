"""Queries, their compilation, filters and what they give; set laws of the global operators."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumberline.functions import logfields as lf
from lumberline.operators import highlight, search
from lumberline.operators.line_filters import SearchFilters, glob_regex
from lumberline.plans import search_query as sq
from lumberline.sources import archives


def term(v, **k):
    return sq.SearchTerm(v, **k)


LINES = [
    ("a.log", 1, "2024-01-15T10:30:45.123 [INFO] rotate pass 7"),
    ("a.log", 2, "2024-01-15 10:30:45 [ERROR] lease table gone"),
    ("a.log", 3, "01/15/2024 10:30:45.456 [WARN] quota almost used"),
    ("b.log", 1, "stray log text after a crash"),
    ("b.log", 2, "Err 12 err 345 é err"),
    ("b.log", 3, None),
    ("b.log", 4, ""),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(*x, "cas://" + x[0]) for x in LINES], "virtual_path string, line bigint, content string, real_path string")


def ids(df):
    return [(r.file, r.line) for r in df.collect()]


def test_level_and_time(lines):
    got = {(r.virtual_path, r.line): (r.level, r.ts_text, str(r.ts)) for r in lf.with_fields(lines).collect()}
    assert got["a.log", 1] == ("info", "2024-01-15T10:30:45.123", "2024-01-15 10:30:45.123000")
    assert got["a.log", 3] == ("warn", "01/15/2024 10:30:45.456", "2024-01-15 10:30:45.456000")
    assert got["b.log", 1] == ("debug", "", "None")
    assert got["b.log", 3][0] == "debug"


def test_day_first(spark):
    assert str(spark.range(1).select(lf.parse_time(F.lit("01/02/2024 00:00:00")).alias("t")).first().t) == "2024-02-01 00:00:00"


def test_match_positions_count_code_points(lines):
    q = sq.SearchQuery((term("err"),))
    r = [x for x in search.search(lines, q).collect() if x.file == "b.log"][0]
    assert [(m.match_position.start, m.match_position.end) for m in r.match_details] == [(0, 3), (7, 10), (17, 20)]
    assert r.matched_keywords == ["err"]


def test_global_operators_are_sets(lines):
    terms = (term("log"), term("err"))
    n = {op: set(ids(search.search(lines, sq.SearchQuery(terms, op)))) for op in ("AND", "OR", "NOT")}
    one = [set(ids(search.search(lines, sq.SearchQuery((t,))))) for t in terms]
    assert n["AND"] == one[0] & one[1] and n["OR"] == one[0] | one[1]
    assert not n["NOT"] & n["OR"] and len(n["NOT"] | n["OR"]) == 6  # a null line matches nothing


def test_special_characters_stay_case_insensitive(lines):
    assert ids(search.search(lines, sq.SearchQuery((term("[info]"),)))) == [("a.log", 1)]


def test_time_filter_drops_lines_without_time(lines):
    f = SearchFilters(time_start="2024-01-15T10:30", time_end="2024-01-15T10:31")
    assert ids(search.search(lines, sq.SearchQuery((term("a"),)), f)) == [("a.log", 1), ("a.log", 2), ("a.log", 3)]
    with pytest.raises(sq.QueryError):
        search.search(lines, "a", SearchFilters(time_start="2025-01-01T00:00", time_end="2024-01-01T00:00"))


def test_limit_and_truncation(lines):
    assert ids(search.search(lines, "a", None, 2)) == [("a.log", 1), ("a.log", 2)]
    assert search.truncated(lines, "a", 2) and not search.truncated(lines, "a", 5)


def test_pages_join_to_the_whole(lines):
    r = search.numbered(search.search(lines, "a", details=False), "file", "line").cache()
    whole = [x.id for x in r.orderBy("id").collect()]
    got, at = [], 0
    while at is not None:
        p, info = search.page(r, at, 2)
        got += [x.id for x in p.collect()]
        at = info["next_offset"]
    assert got == whole == list(range(len(whole)))
    assert search.page(r, 99, 2)[0].count() == 0


def test_empty_table(spark, lines):
    assert search.search(lines.limit(0), "a").count() == 0


@given(st.text(alphabet="ab|()[]\\ ", max_size=12))
def test_split_keeps_no_empty_terms(q):
    assert all(t and t == t.strip() for t in sq.split_by_pipe(q))


def test_backtracking_and_backreferences():
    assert sq.backtracks("(a+)+") and sq.backtracks("(a|b)*") and not sq.backtracks("a+b*")
    assert sq.has_backreference("(a)\\1") and not sq.has_backreference("a\\\\1")


def test_glob():
    import re

    assert re.match(glob_regex("*.log"), "a/b.log") and not re.match(glob_regex("a?.log"), "abc.log")


def test_highlight_is_greedy_and_free_of_overlap(spark):
    d = spark.createDataFrame([("cache hit for cachehit",)], "t string")
    r = d.select(highlight.highlight_ranges([term("cache"), term("cache hit"), term("hit")], F.col("t")).alias("r")).first().r
    assert [(x.start, x.end) for x in r] == [(0, 9), (14, 19), (19, 22)]
    o = d.select(highlight.overlapping("aa", F.lit("aaaa")).alias("r")).first().r
    assert [x.start for x in o] == [0, 1, 2]


def test_snippets_merge(spark):
    text = "x" * 600 + "key" + "y" * 20 + "key" + "z" * 900
    d = spark.createDataFrame([(text,)], "t string")
    s = d.select(highlight.snippets(highlight.highlight_ranges([term("key")], F.col("t")), F.col("t")).alias("s")).first().s
    assert len(s) == 1 and s[0] == "x" * 50 + "key" + "y" * 20 + "key" + "z" * 50


def test_decode(spark):
    d = spark.createDataFrame([(bytearray("Hello 世界".encode()),), (bytearray(b"\xc4\xe3\xba\xc3"),), (bytearray(b""),), (bytearray(b"long enough text \xe3\x80"),), (None,)], "b binary")
    got = [tuple(r.x) if r.x else None for r in d.select(lf.decode_bytes(F.col("b")).alias("x")).collect()]
    assert got[:4] == [("Hello 世界", "UTF-8"), ("你好", "GBK"), ("", "UTF-8"), ("long enough text �", "UTF-8-Lossy")]


def test_decode_counts_only_replacements(spark):
    """A U+FFFD of the text itself doesn't speak for another encoding; bytes that are wrong beside it do."""
    own = "\ufffd" * 12
    d = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate((own.encode() + b".log\xff", own.encode(), own.encode() + b"\xe9\xff" * 9))], "i int, b binary")
    got = {r.i: tuple(r.x) for r in lf.decode_column(d, "b", "x").collect()}
    assert got == {0: (own + ".log\ufffd", "UTF-8-Lossy"), 1: (own, "UTF-8"), 2: ("ï¿½" * 12 + "éÿ" * 9, "Windows-1252")}


def test_safe_names():
    assert archives.safe_name("a/./b\\c.log") == "a/b/c.log" and archives.safe_name("a/../b") is None

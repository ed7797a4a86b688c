"""All registered core queries and their SQL: one for each operator, over the whole tables.

A query's function takes the session and the folder of the tables.  Where SQL can say the same, ``ORACLE`` has it;
what it can't say (archives, streams, sinks) is compared with brute force in the tests.
"""

from __future__ import annotations

import datetime as dt
import gzip
import io
import os
import tarfile
import threading
import time
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumberline.functions import logfields as lf
from lumberline.operators import file_catalogue as fc
from lumberline.operators import compaction, highlight, import_safety, text_index
from lumberline.operators import search as se
from lumberline.operators.token_index import TokenIndex, stemmed
from lumberline.operators.line_filters import SearchFilters, file_matches, glob_text, import_allowed, is_binary, line_predicate, path_problem, prune_files
from lumberline.plans import problems
from lumberline.plans import search_query as sq
from lumberline.plans.problems import table
from lumberline.session import cut, scratch_path
from lumberline.sources import archives, sinks
from lumberline.streaming import events, tail
from lumberline.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# ---- tables as the operators take them --------------------------------------------------------------------------

def lines(spark: SparkSession, d: str) -> DataFrame:
    """The log as lines; exact copies of a row are still there, ``unique`` takes them out after the filters."""
    return table(spark, d, "log_index").select("id", F.col("file_path").alias("virtual_path"), F.col("line_number").alias("line"), "content", "real_path")


def unique(df: DataFrame, key: str = "id") -> DataFrame:
    return df.dropDuplicates([key])


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.col("text") != "")
    return se.lines_of(t, F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")), F.col("text"), F.col("doc_id"))


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    word = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "DEBUG").when(F.col("event_type") == "view", "INFO").otherwise("WARN")
    content = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("["), word, F.lit("]")), F.col("event_type"), F.col("props"))
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("events/user-"), F.pmod("user_id", F.lit(100)).cast("string"), F.lit(".log")).alias("virtual_path"), F.col("event_id").alias("line"), content.alias("content"), F.lit("cas://events").alias("real_path"))


def distinct_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").dropDuplicates(["id"])


_L = "l AS (SELECT DISTINCT id, file_path AS virtual_path, line_number AS line, content, real_path FROM log_index)"
_F = "f AS (SELECT DISTINCT ON (id) * FROM files)"
_LV = r"coalesce(nullif(lower(regexp_extract(content, '\b(ERROR|WARN|INFO|DEBUG)\b', 1)), ''), 'debug')"
_EV = "e AS (SELECT event_id AS id, 'events/user-' || (user_id % 100) || '.log' AS virtual_path, event_id AS line, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'INFO' ELSE 'WARN' END || '] ' || event_type || coalesce(' ' || props, '') AS content FROM events)"
_MASK = "CASE {0} WHEN 'error' THEN 1 WHEN 'warn' THEN 2 WHEN 'warning' THEN 2 WHEN 'info' THEN 4 WHEN 'debug' THEN 8 WHEN 'trace' THEN 16 ELSE 0 END"


def _first_time(c: str = "content") -> str:
    """SQL of the time text: the first of the eight patterns whose first match is a time."""
    parts = []
    for p, fmts in zip(lf.TIME_PATTERNS, [("%Y-%m-%dT%H:%M:%S",)] * 2 + [("%Y-%m-%d %H:%M:%S",)] * 2 + [("%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S")] * 2 + [("%Y/%m/%d %H:%M:%S",)] * 2, strict=True):
        m = f"regexp_extract({c}, '({p})', 1)"
        ok = " OR ".join(f"try_strptime(left({m}, 19), '{x}') IS NOT NULL" for x in fmts)
        parts.append(f"CASE WHEN {m} <> '' AND ({ok}) THEN {m} END")
    return f"coalesce({', '.join(parts)}, '')"


def _as_time(t: str) -> str:
    tries = ", ".join(f"try_strptime(left({t}, 19), '{x}')" for x in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y/%m/%d %H:%M:%S"))
    return f"coalesce({tries}) + to_milliseconds(CASE WHEN length({t}) = 23 THEN CAST(right({t}, 3) AS BIGINT) ELSE 0 END)"


# ---- sources ----------------------------------------------------------------------------------------------------

@register("src_line_chunks", r"""SELECT coalesce(source || '/', '') || doc_id AS virtual_path, doc_id, CAST(pos AS BIGINT) AS line, regexp_replace(content, '\r$', '') AS content
FROM (SELECT doc_id, source, unnest(p) AS content, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, source, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS p FROM documents WHERE text <> ''))""")
def src_line_chunks(spark, d):
    return doc_lines(spark, d)


@register("src_catalog_all", f"WITH {_F} SELECT id, virtual_path, size FROM f")
def src_catalog_all(spark, d):
    return distinct_files(spark, d).select("id", "virtual_path", "size").orderBy("virtual_path")


@register("src_catalog_ready", f"WITH {_F} SELECT id, virtual_path FROM f WHERE analysis_status = 'READY'")
def src_catalog_ready(spark, d):
    return unique(table(spark, d, "files").where(F.col("analysis_status") == "READY").select("id", "virtual_path"))


@register("src_catalog_point", f"WITH {_F} SELECT id, virtual_path FROM f WHERE sha256_hash = (SELECT min(sha256_hash) FROM files WHERE sha256_hash ~ '^[0-9a-f]+$')")
def src_catalog_point(spark, d):
    f = table(spark, d, "files")
    one = f.where(F.col("sha256_hash").rlike("^[0-9a-f]+$")).agg(F.min("sha256_hash")).first()[0]
    return unique(f.where(F.col("sha256_hash") == one).select("id", "virtual_path"))


@register("src_dispatch", f"WITH {_F} SELECT id, CASE WHEN lower(original_name) SIMILAR TO '.*\\.(tar|tgz|tar\\.gz)' THEN 'tar' WHEN lower(original_name) LIKE '%.zip' THEN 'zip' WHEN lower(original_name) LIKE '%.gz' THEN 'gz' WHEN lower(original_name) LIKE '%.7z' THEN '7z' WHEN lower(original_name) LIKE '%.rar' THEN 'rar' END AS reader FROM (SELECT DISTINCT id, original_name FROM archives)")
def src_dispatch(spark, d):
    n = F.lower("original_name")
    kind = reduce(lambda a, s: F.when(F.endswith(n, F.lit(s)), archives.SUFFIXES[s]).otherwise(a), sorted(archives.SUFFIXES, key=len), F.lit(None).cast("string"))
    return table(spark, d, "archives").select("id", "original_name").distinct().select("id", kind.alias("reader"))


def _bundle(spark: SparkSession, d: str, name: str, make: Callable[[Path, list[tuple[str, bytes]]], None]) -> str:
    """A folder with archives made of some lines: the input of the archive readers' own queries."""
    at = scratch_path(spark, name).removeprefix("file:")
    at = "/" + at.lstrip("/")
    os.makedirs(at)
    rows = [(f"part-{i}.log", f"2024-01-0{i + 1} 10:00:00 [INFO] LEVEL{i}\n2024-01-0{i + 1} 10:01:00 [ERROR] down {i}\n".encode()) for i in range(5)]
    make(Path(at), rows)
    return f"file://{at}"


def _zip(rows) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n, c in rows:
            z.writestr(n, c)
    return b.getvalue()


def _tar(rows, mode="w:gz") -> bytes:
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode=mode) as t:
        for n, c in rows:
            i = tarfile.TarInfo(n)
            i.size = len(c)
            t.addfile(i, io.BytesIO(c))
    return b.getvalue()


def _packed(spark: SparkSession, d: str, suffix: str, make: Callable[[list], bytes]) -> DataFrame:
    """``path, content``: all documents as entries of archives of 200 document ids each, made by the executors."""
    docs = table(spark, d, "documents").select(F.expr("doc_id div 200").alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("t"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(f"{i}.txt", t.encode()) for i, t in zip(pdf["doc_id"], pdf["t"], strict=True)]
        return pd.DataFrame({"path": [f"{pdf['k'].iloc[0]}{suffix}"], "content": [make(rows)]})

    return docs.groupBy("k").applyInPandas(pack, "path string, content binary")


_ENTRY = ("virtual_path", "depth", "size", "sha256_hash", "problem")
_DOCS_AS = "SELECT {0} AS virtual_path, {1} AS depth, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256_hash, CAST(NULL AS VARCHAR) AS problem FROM documents"


@register("src_zip", _DOCS_AS.format("(doc_id // 200) || '.zip/' || doc_id || '.txt'", 1))
def src_zip(spark, d):
    return archives.expand_archives(_packed(spark, d, ".zip", _zip)).select(*_ENTRY)


@register("src_tar", _DOCS_AS.format("(doc_id // 200) || '.tar.gz/' || doc_id || '.txt'", 1))
def src_tar(spark, d):
    return archives.expand_archives(_packed(spark, d, ".tar.gz", _tar)).select(*_ENTRY)


@register("src_gz", _DOCS_AS.format("doc_id || '.txt.gz/' || doc_id || '.txt'", 1))
def src_gz(spark, d):
    def pack(frames):
        for f in frames:
            yield pd.DataFrame({"path": [f"{i}.txt.gz" for i in f["doc_id"]], "content": [gzip.compress((t or "").encode(), 1) for t in f["text"]]})

    return archives.expand_archives(table(spark, d, "documents").select("doc_id", "text").mapInPandas(pack, "path string, content binary")).select(*_ENTRY)


def _five(paths: str, depth: int | str) -> str:
    """SQL of the entries that hold the five made-up files, by their place ``i``."""
    return f"SELECT {paths} AS virtual_path, {depth} AS depth, CAST(strlen(c) AS BIGINT) AS size, sha256(c) AS sha256_hash, CAST(NULL AS VARCHAR) AS problem FROM five"


_FIVE = "WITH five AS (SELECT i, '2024-01-0' || (i + 1) || ' 10:00:00 [INFO] LEVEL' || i || chr(10) || '2024-01-0' || (i + 1) || ' 10:01:00 [ERROR] down ' || i || chr(10) AS c FROM range(5) t(i)) "


def _archive_query(name: str, file: str, make: Callable[[list], bytes], sql: str):
    def q(spark: SparkSession, d: str) -> DataFrame:
        at = _bundle(spark, d, name, lambda p, rows: (p / file).write_bytes(make(rows)))
        return archives.read_archives(spark, at).select(*_ENTRY)

    register(name, sql)(q)


def _unread(name: str, kind: str, head: str) -> str:
    return f"SELECT '{name}' AS virtual_path, 0 AS depth, CAST(octet_length(from_hex('{head}')) AS BIGINT) AS size, sha256(from_hex('{head}')) AS sha256_hash, '{kind} is not supported' AS problem"


_archive_query("src_7z", "a.7z", lambda rows: b"7z\xbc\xaf\x27\x1c", _unread("a.7z", "7z", "377ABCAF271C"))
_archive_query("src_rar", "a.rar", lambda rows: b"Rar!\x1a\x07", _unread("a.rar", "rar", "526172211A07"))
_archive_query(
    "src_nested", "outer.zip", lambda rows: _zip([("inner.zip", _zip(rows[:2])), ("logs/deep.tar.gz", _tar([("x/in.zip", _zip(rows[2:4]))])), rows[4], ("../evil.log", b"x")]),
    _FIVE + _five("'outer.zip/' || CASE WHEN i < 2 THEN 'inner.zip/' WHEN i < 4 THEN 'logs/deep.tar.gz/x/in.zip/' ELSE '' END || 'part-' || i || '.log'", "CASE WHEN i < 2 THEN 2 WHEN i < 4 THEN 3 ELSE 1 END") + " UNION ALL SELECT 'outer.zip/../evil.log', 1, NULL, NULL, 'unsafe name'",
)
_archive_query("src_nested_iter", "outer.tar", lambda rows: _tar([("a.zip", _zip([("b.zip", _zip(rows))]))], "w"), _FIVE + _five("'outer.tar/a.zip/b.zip/part-' || i || '.log'", 3))


@register("src_dir_walk", _FIVE + "SELECT 'sub/part-' || i || '.log' AS virtual_path, CAST(strlen(c) AS BIGINT) AS size, sha256(c) AS sha256_hash FROM five")
def src_dir_walk(spark, d):
    at = _bundle(spark, d, "walk", lambda p, rows: [((p / "sub").mkdir(exist_ok=True), (p / "sub" / n).write_bytes(c)) for n, c in rows])
    return archives.read_directory(spark, at).select("virtual_path", "size", "sha256_hash")


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their digests, and the objects these name, written once for each content."""
    t = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return t.select("doc_id", F.sha2("content", 256).alias("sha256_hash")), cut(spark, sinks.new_objects(t), "objects")


@register("src_cas_read", "SELECT doc_id, text AS content FROM documents WHERE text IS NOT NULL")
def src_cas_read(spark, d):
    names, objects = _stored(spark, d)
    return sinks.read_objects(names, objects).select("doc_id", F.decode("content", "UTF-8").alias("content"))


@register("src_mmap", "SELECT doc_id, hex(encode(left(text, 1))) AS first FROM documents WHERE text IS NOT NULL")
def src_mmap(spark, d):
    """A range of bytes of each object: here those of the first character."""
    names, objects = _stored(spark, d)
    n = F.octet_length(F.substring(F.decode("content", "UTF-8"), 1, 1))
    return sinks.read_objects(names, objects).select("doc_id", F.hex(F.substring("content", F.lit(1), n)).alias("first"))


@register("src_index_open", f"WITH {_L} SELECT count(*) AS n FROM l WHERE content IS NOT NULL")
def src_index_open(spark, d):
    return token_index(spark, d).docs.agg(F.count("*").alias("n"))


# ---- projections ------------------------------------------------------------------------------------------------

ORACLE_LINE = f"WITH {_L} SELECT id, "


@register("prj_lines", f"WITH {_L} SELECT virtual_path, line, regexp_replace(content, '\\r$', '') AS content FROM l")
def prj_lines(spark, d):
    return unique(lines(spark, d)).select("virtual_path", "line", F.regexp_replace("content", "\r$", "").alias("content"))


@register("prj_level", ORACLE_LINE + f"CASE WHEN content IS NOT NULL THEN {_LV} ELSE 'debug' END AS level FROM l")
def prj_level(spark, d):
    return unique(lines(spark, d).select("id", lf.level(F.col("content")).alias("level")))


@register("prj_level_mask", ORACLE_LINE + _MASK.format(_LV) + " AS mask FROM l")
def prj_level_mask(spark, d):
    return unique(lines(spark, d).select("id", lf.level_mask(lf.level(F.col("content"))).alias("mask")))


@register("prj_timestamp_text", ORACLE_LINE + f"{_first_time()} AS ts_text FROM l")
def prj_timestamp_text(spark, d):
    return unique(lines(spark, d).select("id", lf.time_text(F.col("content")).alias("ts_text")))


@register("prj_timestamp_parse", f"WITH {_L}, t AS (SELECT id, {_first_time()} AS t FROM l) SELECT id, {_as_time('t')} AS ts FROM t WHERE t <> ''")
def prj_timestamp_parse(spark, d):
    t = unique(lines(spark, d).select("id", lf.time_text(F.col("content")).alias("t")).where(F.col("t") != ""))
    return t.select("id", lf.parse_time(F.col("t")).alias("ts"))


@register("prj_timestamp_unix", f"WITH {_L}, t AS (SELECT id, {_first_time()} AS t FROM l) SELECT id, CAST(floor(epoch({_as_time('t')})) AS BIGINT) AS ts FROM t WHERE t <> ''")
def prj_timestamp_unix(spark, d):
    t = unique(lines(spark, d).select("id", lf.time_text(F.col("content")).alias("t")).where(F.col("t") != ""))
    return t.select("id", lf.time_unix(F.col("t")).alias("ts"))


@register("prj_parse_lines", f"WITH {_EV} SELECT id, virtual_path, line, {_LV} AS level, left(content, 19) AS timestamp, content FROM e")
def prj_parse_lines(spark, d):
    return event_lines(spark, d).select("id", "virtual_path", "line", lf.level(F.col("content")).alias("level"), lf.time_text(F.col("content")).alias("timestamp"), "content")


@register("prj_real_path", f"WITH {_F} SELECT id, 'cas://' || sha256_hash AS real_path FROM f")
def prj_real_path(spark, d):
    return distinct_files(spark, d).select("id", lf.real_path(F.col("sha256_hash")).alias("real_path"))


@register("prj_mime", f"WITH {_F} SELECT id, CASE regexp_extract(lower(original_name), '[^/.][^/]*\\.([^./]+)$', 1) WHEN 'log' THEN 'text/plain' WHEN 'txt' THEN 'text/plain' WHEN 'json' THEN 'application/json' WHEN 'xml' THEN 'application/xml' WHEN 'gz' THEN 'application/gzip' WHEN 'zip' THEN 'application/zip' END AS mime FROM f")
def prj_mime(spark, d):
    return distinct_files(spark, d).select("id", lf.mime_type(F.col("original_name")).alias("mime"))


@register("prj_virtual_path", "SELECT DISTINCT id, virtual_path || '/' || original_name AS path FROM archives WHERE virtual_path IS NOT NULL AND original_name IS NOT NULL")
def prj_virtual_path(spark, d):
    a = table(spark, d, "archives").where(F.col("virtual_path").isNotNull() & F.col("original_name").isNotNull())
    return a.select("id", lf.child_path(F.col("virtual_path"), F.col("original_name")).alias("path")).distinct()


@register("prj_iso", f"WITH {_F} SELECT id, CASE WHEN min_timestamp <> 0 THEN strftime(make_timestamp(min_timestamp * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS iso FROM f")
def prj_iso(spark, d):
    return distinct_files(spark, d).select("id", lf.iso(F.col("min_timestamp")).alias("iso"))


_BYTES = (("C4E3BAC3", "你好", "GBK"), ("E9FF", "éÿ", "Windows-1252"), ("616263FF", "abc�", "UTF-8-Lossy"), ("", "", "UTF-8"))


@register("prj_decode", "SELECT doc_id, text, CASE WHEN text IS NOT NULL THEN 'UTF-8' END AS encoding FROM documents UNION ALL SELECT -doc_id - 10, text || chr(65533), 'UTF-8-Lossy' FROM documents WHERE length(text) > 2 UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, '{t}', '{e}')" for i, (_, t, e) in enumerate(_BYTES)) + ") v(doc_id, text, encoding)")
def prj_decode(spark, d):
    """All texts as they are, those of over two characters with a stray byte, too, and bytes of other encodings."""
    t = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"), F.length("text").alias("n"))
    stray = t.where(F.col("n") > 2).select((-F.col("doc_id") - 10).alias("doc_id"), F.concat("b", F.lit(b"\xff")).alias("b"))
    other = spark.createDataFrame([(-1 - i, bytearray.fromhex(h)) for i, (h, _, _) in enumerate(_BYTES)], "doc_id bigint, b binary")
    return lf.decode_column(t.drop("n").unionByName(stray).unionByName(other), "b", "x").select("doc_id", "x.text", "x.encoding")


@register("prj_decode_name", f"WITH {_F} SELECT id, CASE WHEN length(original_name) > 2 THEN original_name || chr(65533) ELSE original_name END AS name FROM f")
def prj_decode_name(spark, d):
    raw = F.encode("original_name", "UTF-8")
    f = distinct_files(spark, d).select("id", F.when(F.length("original_name") > 2, F.concat(raw, F.lit(b"\xff"))).otherwise(raw).alias("b"))
    return lf.decode_column(f, "b", "x").select("id", F.col("x.text").alias("name"))


@register("prj_entry_id", f"WITH {_EV} SELECT virtual_path, line, row_number() OVER (ORDER BY virtual_path, line) - 1 AS id FROM e")
def prj_entry_id(spark, d):
    return se.numbered(event_lines(spark, d).select("virtual_path", "line"), "virtual_path", "line")


@register("prj_doc_to_entry", "SELECT DISTINCT id, CAST(timestamp AS VARCHAR) AS timestamp, level, file_path AS file, line_number AS line, content FROM log_index")
def prj_doc_to_entry(spark, d):
    t = table(spark, d, "log_index").select("id", F.col("timestamp").cast("string").alias("timestamp"), "level", F.col("file_path").alias("file"), F.col("line_number").alias("line"), "content")
    return unique(t)


# ---- search: matching, boolean logic, filters -----------------------------------------------------------------

def term(value: str, **more) -> sq.SearchTerm:
    return sq.SearchTerm(value, **more)


def query(*terms: sq.SearchTerm, op: str = "OR") -> sq.SearchQuery:
    named = tuple(sq.replace(t, id=f"term_{i}") for i, t in enumerate(terms))
    return sq.SearchQuery(named, op)


def _hits(name: str, q: sq.SearchQuery | str, where: str):
    """Ids of the matching lines; the predicate runs on the scan, only matches are made unique."""
    def f(spark: SparkSession, d: str) -> DataFrame:
        one = sq.resolve(q) if isinstance(q, str) else q
        return unique(lines(spark, d).where(sq.compile_query(one, F.col("content"))).select("id"))

    register(name, f"WITH {_L} SELECT id FROM l WHERE {where}")(f)


_hits("m_literal_cs", query(term("ERROR", case_sensitive=True)), "contains(content, 'ERROR')")
_hits("m_literal_ci", query(term("error")), "regexp_matches(content, '(?i)error')")
_hits("m_multi_literal", query(term("timeout"), term("damaged"), term("damaged")), "regexp_matches(content, '(?i)timeout|damaged|damaged')")
_hits("m_regex", query(term(r"retry \d+ for", is_regex=True, case_sensitive=True)), r"regexp_matches(content, 'retry \d+ for')")
_hits("m_lookaround", query(term(r"merge(?= of)", is_regex=True, case_sensitive=True)), "contains(content, 'merge of')")
_hits("m_select_engine", query(term("a.b"), term(r"cache (hit|miss)", is_regex=True), term("Heartbeat", case_sensitive=True)), r"regexp_matches(content, '(?i)a\.b|cache (hit|miss)') OR contains(content, 'Heartbeat')")
_hits("m_ci_wrap", query(term("SESSION [a-f0-9]+ opened", is_regex=True)), "regexp_matches(content, '(?i)session [a-f0-9]+ opened')")
_hits("b_and", query(term("cache"), term("archive"), op="AND"), "regexp_matches(content, '(?i)cache') AND regexp_matches(content, '(?i)archive')")
_hits("b_or", query(term("cache", case_sensitive=True), term("lease")), "contains(content, 'cache') OR regexp_matches(content, '(?i)lease')")
_hits("b_not", query(term("a"), term("e"), op="NOT"), "NOT regexp_matches(content, '(?i)a|e')")
_hits("b_fast_or", query(term("lock held"), term("giving up")), "regexp_matches(content, '(?i)lock held|giving up')")
_hits("b_order", query(term("queue", priority=1), term("slots", priority=5), op="AND"), "regexp_matches(content, '(?i)queue') AND regexp_matches(content, '(?i)slots')")
_hits("q_build_structured", "error | (timeout|damaged) | \\d+ms", r"regexp_matches(content, '(?i)error|(timeout|damaged)|\d+ms')")
_hits("q_resolve", "heartbeat|lease", "regexp_matches(content, '(?i)heartbeat|lease')")
_hits("e_plan", "depth limit|checksum", "regexp_matches(content, '(?i)depth limit|checksum')")
_hits("s_union_terms", query(term("rotated"), term("Flushed")), "regexp_matches(content, '(?i)rotated') OR regexp_matches(content, '(?i)flushed')")
_hits("s_intersect_terms", query(term("took"), term("scan"), op="AND"), "regexp_matches(content, '(?i)took') AND regexp_matches(content, '(?i)scan')")
_hits("s_except_terms", query(term("session"), op="NOT"), "NOT regexp_matches(content, '(?i)session')")


@register("m_overlapping", f"WITH {_L} SELECT id, CAST(len(list_filter(range(1, length(content) + 1), lambda i: lower(content[i:i+1]) = 'ee')) AS BIGINT) AS n FROM l WHERE regexp_matches(content, '(?i)ee')")
def m_overlapping(spark, d):
    t = lines(spark, d).where(F.col("content").rlike("(?i)ee"))
    return unique(t.select("id", F.size(highlight.overlapping("ee", F.col("content"))).cast("bigint").alias("n")))


def _queries_table(name: str, rows: Callable[[], list[tuple]], schema: str, sql: str):
    register(name, sql)(lambda spark, d: spark.createDataFrame(rows(), schema))


_SPLITS = ("error | timeout", "(error|timeout)", "a | (b|c) | d", "[foo|bar]", "foo\\|bar", "  ", "a) | b", "(a | b")
_queries_table("q_split_pipe", lambda: [(q, len(sq.split_by_pipe(q))) for q in _SPLITS], "query string, n int", "SELECT * FROM (VALUES ('error | timeout', 2), ('(error|timeout)', 1), ('a | (b|c) | d', 3), ('[foo|bar]', 1), ('foo\\|bar', 1), ('  ', 0), ('a) | b', 2), ('(a | b', 1)) t(query, n)")
_queries_table("q_looks_regex", lambda: [(q, sq.looks_regex(q)) for q in ("\\d+", "error.*timeout", "^start", "file{3}", "error", "file.log", "$PATH")], "value string, regex boolean", "SELECT * FROM (VALUES ('\\d+', true), ('error.*timeout', true), ('^start', true), ('file{3}', true), ('error', false), ('file.log', false), ('$PATH', false)) t(value, regex)")


def _problem(f: Callable[[], object]) -> str:
    try:
        f()
    except sq.QueryError:
        return "rejected"
    return "ok"


_queries_table("q_validate_params", lambda: [(n, _problem(lambda n=n: sq.validate_text("x" * n))) for n in (0, 1, 1000, 1001)], "size int, outcome string", "SELECT * FROM (VALUES (0, 'rejected'), (1, 'ok'), (1000, 'ok'), (1001, 'rejected')) t(size, outcome)")
_queries_table("q_validate_term", lambda: [(v, _problem(lambda v=v: sq.validate_term(term(v, is_regex=True)))) for v in ("a+", "(", "(a)\\1", "x" * 101, "")], "value string, outcome string", f"SELECT * FROM (VALUES ('a+', 'ok'), ('(', 'rejected'), ('(a)\\1', 'rejected'), ('{'x' * 101}', 'rejected'), ('', 'rejected')) t(value, outcome)")
_queries_table("q_redos", lambda: [(v, sq.backtracks(v) is not None) for v in ("(a+)+", "(a|aa)+", "(ab)+", "a+b", "(x*){2}")], "value string, risky boolean", "SELECT * FROM (VALUES ('(a+)+', true), ('(a|aa)+', true), ('(ab)+', false), ('a+b', false), ('(x*){2}', true)) t(value, risky)")
_queries_table("c_parse", lambda: [(t.value, t.priority, t.is_regex) for t in sq.from_text("a|b.*|c").terms], "value string, priority int, regex boolean", "SELECT * FROM (VALUES ('a', 3, false), ('b.*', 2, true), ('c', 1, false)) t(value, priority, regex)")
_queries_table("c_validate", lambda: [(i["code"], i["severity"]) for q in (sq.SearchQuery(()), query(term("x", enabled=False)), query(term(" ")), query(term("y" * 501)), query(term("(", is_regex=True)), query(term("z"), term("Z"))) for i in sq.issues(q)], "code string, severity string", "SELECT * FROM (VALUES ('EMPTY_QUERY', 'error'), ('NO_ENABLED_TERMS', 'error'), ('EMPTY_VALUE', 'error'), ('VALUE_TOO_LONG', 'warning'), ('INVALID_REGEX', 'error'), ('DUPLICATE_TERM', 'warning')) t(code, severity)")
_queries_table("c_builder", lambda: [(sq.QueryBuilder.from_string("a|b").add("c.*").toggle("term_0").remove_value("B").to_text(),)], "text string", "SELECT 'c.*' AS text")
_queries_table("c_optimized", lambda: [(o["duplicates"], o["disabled"]) for o in [sq.QueryBuilder(query(term("a"), term("A"), term("b", enabled=False))).optimized()]], "duplicates int, disabled int", "SELECT 1 AS duplicates, 1 AS disabled")
_queries_table("c_keyword_group", lambda: [(n, len(sq.keyword_group_issues({"name": n, "color": c, "patterns": [{"regex": r} for r in rs]}))) for n, c, rs in (("ok", "blue", ["a"]), ("x", "pink", []), ("dup", "red", ["a", "a"]), ("bad", "red", ["("]))], "name string, issues int", "SELECT * FROM (VALUES ('ok', 0), ('x', 3), ('dup', 1), ('bad', 1)) t(name, issues)")
_queries_table("x_query_store", lambda: [(sq.QueryBuilder.import_json(sq.QueryBuilder.from_string("a|b").export_json()).to_text(),)], "text string", "SELECT 'a|b' AS text")
_queries_table("x_toggle_rule", lambda: [(sq.QueryBuilder.from_string("a|b").toggle_rule("A", "g").toggle_rule("n", "g").to_text(),)], "text string", "SELECT 'b|n' AS text")
_queries_table("x_remove_term", lambda: [(sq.QueryBuilder.from_string("a|B").remove_value("b").to_text(),)], "text string", "SELECT 'a' AS text")
_queries_table("x_query_check", lambda: [(q, _problem(lambda q=q: sq.validate_text(q))) for q in ("", " ", "a")], "query string, outcome string", "SELECT * FROM (VALUES ('', 'rejected'), (' ', 'rejected'), ('a', 'ok')) t(query, outcome)")
_queries_table("x_arch_path", lambda: [(p, archives.safe_name(p)) for p in ("a/b.log", "a\\.\\b", "../x", "/abs", "C:\\x", "")], "path string, safe string", "SELECT * FROM (VALUES ('a/b.log', 'a/b.log'), ('a\\.\\b', 'a/b'), ('../x', NULL), ('/abs', NULL), ('C:\\x', NULL), ('', NULL)) t(path, safe)")
_queries_table("a_query_cost", lambda: [(text_index.query_cost([("must", 0.5), ("must", 0.1), ("should", 1.0), ("must_not", 0.0)]),)], "cost double", "SELECT ((100 + 1.5 / 0.5) + (100 + 1.5 / 0.1) + 101 + (100 + 0.5 / 0.001)) * 1.3 AS cost")
_queries_table("flt_file_glob_db", lambda: [(p, glob_text(p)) for p in ("*.log", "error", "a[1]")], "pattern string, catalogue_pattern string", "SELECT * FROM (VALUES ('*.log', '*.log'), ('error', '*error*'), ('a[1]', '*a[[]1[]]*')) t(pattern, catalogue_pattern)")


def _parsed_events(spark, d):
    return lf.with_fields(event_lines(spark, d))


@register("flt_level", f"WITH {_EV} SELECT id FROM e WHERE {_LV} IN ('error', 'warn')")
def flt_level(spark, d):
    return _parsed_events(spark, d).where(line_predicate(SearchFilters(levels=(" ERROR", "warn", "")))).select("id")


@register("flt_time", "SELECT event_id AS id FROM events WHERE date_trunc('second', ts) BETWEEN (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events) AND (SELECT date_trunc('day', max(ts)) FROM events)")
def flt_time(spark, d):
    a, b = table(spark, d, "events").agg(F.min("ts"), F.max("ts")).first()
    day = dt.timedelta(days=1)
    return _parsed_events(spark, d).where(line_predicate(SearchFilters(time_start=f"{a.date() + day}T00:00", time_end=f"{b.date()}T00:00"))).select("id")


@register("flt_file_glob", f"WITH {_L} SELECT id FROM l WHERE regexp_matches(virtual_path, '^.*/run/.*\\.log$') OR regexp_matches(real_path, '^.*/run/.*\\.log$')")
def flt_file_glob(spark, d):
    return unique(lines(spark, d).where(file_matches("*/run/*.log", F.col("virtual_path"), F.col("real_path"))).select("id"))


@register("flt_filter_parse", "SELECT * FROM (VALUES ('2024-01-15T10:30', TIMESTAMP '2024-01-15 10:30:00'), ('15/01/2024 10:30:00', TIMESTAMP '2024-01-15 10:30:00'), ('2024-01-15T10:30:00+02:00', TIMESTAMP '2024-01-15 08:30:00')) t(text, ts)")
def flt_filter_parse(spark, d):
    t = spark.createDataFrame([("2024-01-15T10:30",), ("15/01/2024 10:30:00",), ("2024-01-15T10:30:00+02:00",)], "text string")
    return t.select("text", lf.parse_time(F.col("text")).alias("ts"))


@register("flt_prune", f"WITH {_F} SELECT id FROM f WHERE analysis_status = 'READY' AND (max_timestamp IS NULL OR max_timestamp >= 1704067200) AND (min_timestamp IS NULL OR min_timestamp <= 1719792000) AND (level_mask IS NULL OR (level_mask & 3) <> 0) AND regexp_matches(virtual_path, '^.*\\.log$')")
def flt_prune(spark, d):
    f = prune_files(table(spark, d, "files"), SearchFilters(("error", "warn"), "2024-01-01T00:00", "2024-07-01T00:00", "*.log"))
    return unique(f.select("id"))


@register("flt_tantivy", "SELECT DISTINCT id FROM log_index WHERE list_contains(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), 'session') AND timestamp BETWEEN 1704067200 AND 1735689600 AND level IN ('info', 'error') AND regexp_matches(file_path, '^/watch/.*$')")
def flt_tantivy(spark, d):
    t = table(spark, d, "log_index").where(F.col("timestamp").between(1704067200, 1735689600) & F.col("level").isin("info", "error") & file_matches("/watch/*", F.col("file_path")))
    return unique(t.where(F.array_contains(text_index.tokenize(F.col("content")), "session")).select("id"))


_HEADS = ("", "FFD8FF", "504B0304", "00" * 64, "00" * 40, "00" * 4)


@register("flt_import_binary", "SELECT doc_id, i, i IN (1, 2, 3) OR i = 4 AND strlen(text) < 760 OR i = 5 AND strlen(text) < 76 OR i = 0 AND regexp_matches(text, '^(BM|GIF|MZ|ID3|RIFF)') AS binary FROM documents, range(6) t(i) WHERE text IS NOT NULL")
def flt_import_binary(spark, d):
    """Every text as it is, after two signatures, and after 64, 40 and 4 zero bytes."""
    heads = F.array(*[F.unhex(F.lit(h)) for h in _HEADS])
    t = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text", F.posexplode(heads).alias("i", "head"))
    return t.select("doc_id", F.col("i").cast("bigint").alias("i"), is_binary(F.concat("head", F.encode("text", "UTF-8"))).alias("binary"))


@register("flt_import_rules", f"WITH {_F} SELECT id, regexp_matches(n, 'syslog|messages|system|stdout|stderr|.*log.*|.*error.*|.*access.*|.*\\.20.*') OR regexp_extract(n, '(?s)^.+\\.([^.]*)$', 1) IN ('log', 'txt', 'json', 'xml', 'csv') AS allowed FROM (SELECT id, lower(regexp_extract(original_name, '([^/]*)$', 1)) AS n FROM f WHERE original_name IS NOT NULL)")
def flt_import_rules(spark, d):
    return distinct_files(spark, d).where(F.col("original_name").isNotNull()).select("id", import_allowed(F.col("original_name")).alias("allowed"))


@register("flt_path_safety", f"WITH {_F} SELECT id, CASE WHEN virtual_path IS NULL OR trim(virtual_path) = '' THEN 'empty' WHEN strlen(virtual_path) > 1024 THEN 'too_long' WHEN virtual_path LIKE '/%' OR virtual_path LIKE '\\%' THEN 'absolute' WHEN regexp_matches(virtual_path, '^[A-Za-z]:') THEN 'drive' WHEN regexp_matches(virtual_path, '(^|[/\\\\])\\.\\.([/\\\\]|$)') THEN 'traversal' END AS problem FROM f")
def flt_path_safety(spark, d):
    return distinct_files(spark, d).select("id", path_problem(F.col("virtual_path")).alias("problem"))


@register("flt_symlink", "SELECT * FROM (VALUES ('a.tar/a.log', NULL), ('l.tar/l.log', 'link')) t(virtual_path, problem)")
def flt_symlink(spark, d):
    b = _tar([("a.log", b"x\n")], "w")
    link = io.BytesIO()
    with tarfile.open(fileobj=link, mode="w") as t:
        i = tarfile.TarInfo("l.log")
        i.type, i.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(i)
    at = _bundle(spark, d, "links", lambda p, rows: ((p / "a.tar").write_bytes(b), (p / "l.tar").write_bytes(link.getvalue())))
    return archives.read_archives(spark, at).select("virtual_path", "problem")


# ---- search: results ---------------------------------------------------------------------------------------------

_Q = query(term("timeout", priority=2), term("damaged", priority=1))
_W = "regexp_matches(content, '(?i)timeout|damaged')"


@register("e_scan_filter", f"WITH {_L} SELECT id, virtual_path AS file, line, {_LV} AS level FROM l WHERE {_W} AND {_LV} = 'error'")
def e_scan_filter(spark, d):
    return se.search(lines(spark, d), _Q, SearchFilters(("error",)), details=False, key="id", ordered=False).select("id", "file", "line", "level")


@register("e_use_case", f"WITH {_EV} SELECT id, virtual_path AS file, line, content, left(content, 19) AS timestamp, {_LV} AS level FROM e WHERE regexp_matches(content, '(?i)error|timeout') AND {_LV} IN ('error', 'warn') ORDER BY virtual_path, line LIMIT 1000")
def e_use_case(spark, d):
    r = se.search(event_lines(spark, d), "error|timeout", SearchFilters(("error", "warn")), 1000, details=False)
    return r.select("id", "file", "line", "content", "timestamp", "level")


@register("prj_match_details", f"""WITH {_L}, m AS (SELECT id, string_split(lower(content), 'timeout') AS p FROM l WHERE regexp_matches(content, '(?i)timeout')),
n AS (SELECT id, p, unnest(range(1, len(p))) AS i FROM m)
SELECT id, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * 7 AS INTEGER) AS start FROM n""")
def prj_match_details(spark, d):
    q = query(term("timeout"))
    t = unique(lines(spark, d).where(sq.compile_query(q, F.col("content"))))
    return t.select("id", F.explode(sq.match_details(q, F.col("content"))).alias("m")).select("id", F.col("m.match_position.start").alias("start"))


@register("prj_matched_keywords", f"WITH {_L} SELECT id, array_to_string(list_filter([CASE WHEN regexp_matches(content, '(?i)damaged') THEN 'damaged' END, CASE WHEN regexp_matches(content, '(?i)timeout') THEN 'timeout' END], lambda x: x IS NOT NULL), ',') AS keywords FROM l WHERE {_W}")
def prj_matched_keywords(spark, d):
    t = unique(lines(spark, d).where(sq.compile_query(_Q, F.col("content"))))
    return t.select("id", F.concat_ws(",", sq.matched_keywords(sq.match_details(_Q, F.col("content")))).alias("keywords"))


@register("o_priority", f"WITH {_L} SELECT id, CASE WHEN regexp_matches(content, '(?i)timeout') THEN 'timeout' ELSE 'damaged' END AS first FROM l WHERE {_W}")
def o_priority(spark, d):
    t = unique(lines(spark, d).where(sq.compile_query(_Q, F.col("content"))))
    return t.select("id", F.element_at(sq.match_details(_Q, F.col("content")), 1)["term_value"].alias("first"))


_queries_table("o_terms", lambda: [(i, t.value) for i, t in enumerate(sq.execution_order(query(term("low"), term("rx+", is_regex=True, priority=9), term("longer"), term("cs", case_sensitive=True))))], "pos int, value string", "SELECT * FROM (VALUES (0, 'rx+'), (1, 'cs'), (2, 'longer'), (3, 'low')) t(pos, value)")


def _event_results(spark, d):
    return se.search(event_lines(spark, d), "error", details=False).select("id", "file", "line")


@register("o_path_line", f"WITH {_EV} SELECT row_number() OVER (ORDER BY virtual_path, line) - 1 AS pos, virtual_path AS file, line FROM e WHERE regexp_matches(content, '(?i)error')")
def o_path_line(spark, d):
    return se.numbered(_event_results(spark, d).drop("id"), "file", "line").withColumnRenamed("id", "pos")


@register("l_max_results", f"WITH {_EV} SELECT id FROM e WHERE regexp_matches(content, '(?i)error') ORDER BY virtual_path, line LIMIT 500")
def l_max_results(spark, d):
    return se.search(event_lines(spark, d), "error", None, 500, False).select("id")


def _page_sql(offset: int, limit: int) -> str:
    return f"WITH {_EV}, r AS (SELECT row_number() OVER (ORDER BY virtual_path, line) - 1 AS id, virtual_path AS file, line FROM e WHERE regexp_matches(content, '(?i)error')) SELECT * FROM r WHERE id >= {offset} AND id < {offset + limit}"


@register("l_page", _page_sql(100, 50))
def l_page(spark, d):
    return se.page(se.numbered(_event_results(spark, d).drop("id"), "file", "line"), 100, 50)[0]


@register("l_page_index", _page_sql(3 * 20, 20))
def l_page_index(spark, d):
    return se.page(se.numbered(_event_results(spark, d).drop("id"), "file", "line"), 3 * 20, 20)[0]


@register("c_page", _page_sql(0, 1000))
def c_page(spark, d):
    return se.page(se.numbered(_event_results(spark, d).drop("id"), "file", "line"), 0, 1000)[0]


@register("x_page_total", f"WITH {_EV} SELECT CAST(ceil(count(*) / 30.0) AS BIGINT) AS pages FROM e WHERE regexp_matches(content, '(?i)error')")
def x_page_total(spark, d):
    return _event_results(spark, d).agg(F.ceil(F.count("*") / 30).alias("pages"))


@register("a_total_matches", f"WITH {_L} SELECT count(*) AS n FROM l WHERE {_W}")
def a_total_matches(spark, d):
    return lines(spark, d).where(sq.compile_query(_Q, F.col("content"))).agg(F.count_distinct("id").alias("n"))


@register("a_keyword_stats", f"WITH {_L}, k AS (SELECT unnest(list_filter([CASE WHEN regexp_matches(content, '(?i)damaged') THEN 'damaged' END, CASE WHEN regexp_matches(content, '(?i)timeout') THEN 'timeout' END], lambda x: x IS NOT NULL)) AS keyword FROM l WHERE {_W}) SELECT keyword, count(*) AS match_count, round(100.0 * count(*) / (SELECT count(*) FROM l WHERE {_W}), 6) AS match_percentage FROM k GROUP BY 1")
def a_keyword_stats(spark, d):
    t = unique(lines(spark, d).where(sq.compile_query(_Q, F.col("content"))))
    return se.keyword_statistics(t.withColumn("matched_keywords", sq.matched_keywords(sq.match_details(_Q, F.col("content")))))


@register("c_highlight")
def c_highlight(spark, d):
    terms = [term("cache"), term("cache hit"), term("hit for")]
    t = unique(lines(spark, d).where(F.col("content").rlike("(?i)cache hit")))
    return t.select("id", F.to_json(highlight.highlight_ranges(terms, F.col("content"))).alias("ranges"))


@register("c_snippet")
def c_snippet(spark, d):
    t = table(spark, d, "documents").where(F.lower("text").contains("queue"))
    r = highlight.highlight_ranges([term("queue")], F.col("text"))
    return t.select("doc_id", F.to_json(highlight.snippets(r, F.col("text"))).alias("snippets"))


# ---- token index -------------------------------------------------------------------------------------------------

_TOK = "list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND length(t) <= 40)"
_STEMS = f"list_transform({_TOK}, lambda t: regexp_replace(regexp_replace(t, '([a-z]{{3}})ies$', '\\1y'), '([a-z]{{3}})(ing|ed|es|s)$', '\\1'))"
_indexes: dict[tuple[str, str], TokenIndex] = {}


def token_index(spark: SparkSession, d: str) -> TokenIndex:
    """The index of the log's lines, written once for a session and folder."""
    at = spark.sparkContext.applicationId, d
    if at not in _indexes:
        _indexes[at] = TokenIndex(spark, scratch_path(spark, "token-index")).add(lines(spark, d).where(F.col("content").isNotNull()))
    return _indexes[at]


@register("i_tokenize", f"WITH {_L} SELECT id, CAST(len({_STEMS}) AS INTEGER) AS n, {_STEMS}[1] AS first FROM l WHERE content IS NOT NULL")
def i_tokenize(spark, d):
    k = stemmed(F.col("content"))
    return unique(lines(spark, d).where(F.col("content").isNotNull()).select("id", F.size(k).alias("n"), F.try_element_at(k, F.lit(1)).alias("first")))


_queries_table("i_parse_query", lambda: [(q, ",".join(text_index.keywords(q))) for q in ('hello "world war" foo', "a  b", '"x y', "")], "query string, parts string", "SELECT * FROM (VALUES ('hello \"world war\" foo', 'hello,world war,foo'), ('a  b', 'a,b'), ('\"x y', 'x y'), ('', '')) t(query, parts)")


@register("i_search", f"WITH {_L} SELECT id FROM l WHERE list_contains({_STEMS}, 'session') AND NOT list_contains({_STEMS}, 'clos')")
def i_search(spark, d):
    return token_index(spark, d).search("+session -closed")


@register("i_multi_keyword", f"WITH {_L} SELECT id FROM l WHERE list_contains({_STEMS}, 'cache') AND list_contains({_STEMS}, 'key')")
def i_multi_keyword(spark, d):
    return token_index(spark, d).multi_keyword(["cache", "key"], True)


_BM = f"""WITH {_L}, t AS (SELECT id, {_STEMS} AS k FROM l WHERE content IS NOT NULL), x AS (SELECT id, len(k) AS n, len(list_filter(k, lambda w: w = 'queue')) AS a, len(list_filter(k, lambda w: w = 'slot')) AS b FROM t),
s AS (SELECT count(*) AS nn, avg(n) AS av, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM x)
SELECT id, round(ln(1 + (nn - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / av)) + ln(1 + (nn - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / av)), 6) AS score FROM x, s WHERE a > 0 OR b > 0"""


@register("i_score", _BM)
def i_score(spark, d):
    return token_index(spark, d).score(["queue", "slots"])


@register("l_topk", _BM + " ORDER BY score DESC, id LIMIT 100")
def l_topk(spark, d):
    return text_index.top_k(i_score(spark, d), "id", 100)


@register("a_index_count", f"WITH {_L} SELECT count(*) AS n FROM l WHERE list_contains({_STEMS}, 'queue')")
def a_index_count(spark, d):
    i = token_index(spark, d)
    return i.postings(i.stems(["queue"])).agg(F.count("*").alias("n"))


@register("a_term_selectivity", f"WITH {_L} SELECT w AS term, avg(CASE WHEN list_contains({_STEMS}, w) THEN 1.0 ELSE 0.0 END) AS selectivity FROM l, (VALUES ('cache'), ('queue')) t(w) WHERE content IS NOT NULL GROUP BY 1")
def a_term_selectivity(spark, d):
    return token_index(spark, d).selectivity(["cache", "queue"])


_ESC = "replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _marked(word: str, text: str = "content") -> str:
    """SQL of the part of a text around a word, escaped and marked."""
    part = f"(CASE WHEN length({text}) <= 500 THEN {text} ELSE substr({text}, greatest(1, strpos(lower({text}), '{word}') - 100), 500) END)"
    return f"regexp_replace({_ESC.replace('replace(content,', f'replace({part},')}, '(?i)({word})', '<b>\\1</b>', 'g')"


@register("i_highlight", f"WITH {_L} SELECT id, {_marked('queue')} AS html FROM l WHERE contains(lower(content), 'queue')")
def i_highlight(spark, d):
    t = lines(spark, d).where(F.lower("content").contains("queue"))
    return unique(t.select("id", text_index.snippet(F.col("content"), "queue").alias("html")))


@register("i_highlight_large", f"SELECT doc_id, {_marked('archive', 'text')} AS html FROM documents WHERE length(text) > 500 AND contains(lower(text), 'archive')")
def i_highlight_large(spark, d):
    t = table(spark, d, "documents").where((F.length("text") > 500) & F.lower("text").contains("archive"))
    return t.select("doc_id", text_index.snippet(F.col("text"), "archive").alias("html"))


@register("i_search_with_highlight", f"WITH {_L} SELECT id, {_marked('lease')} AS html FROM l WHERE list_contains({_STEMS}, 'lease')")
def i_search_with_highlight(spark, d):
    found = token_index(spark, d).multi_keyword(["lease"], True)
    t = unique(lines(spark, d).where(F.lower("content").contains("leas")).select("id", "content")).join(found, "id", "left_semi")
    return t.select("id", F.coalesce(text_index.snippet(F.col("content"), "lease"), lf.html_escape(F.col("content"))).alias("html"))


@register("i_suggest", "SELECT CAST(NULL AS VARCHAR) AS suggestion WHERE false")
def i_suggest(spark, d):
    """There are no suggestions in the interface this follows: always empty."""
    return spark.createDataFrame([], "suggestion string")


@register("i_fts_files", f"WITH {_F} SELECT id FROM f WHERE list_contains(string_split_regex(lower(concat_ws(' ', virtual_path, original_name)), '[^\\p{{L}}\\p{{N}}]+'), 'archive')")
def i_fts_files(spark, d):
    return fc.find_files(distinct_files(spark, d), "archive").select("id")


# ---- catalogue: joins, aggregates, upserts -------------------------------------------------------------------------

@register("j_fts_rowid", f"WITH {_F} SELECT f.id, a.original_name AS archive FROM f JOIN (SELECT DISTINCT id, original_name FROM archives) a ON a.id = f.parent_archive_id")
def j_fts_rowid(spark, d):
    a = table(spark, d, "archives").select(F.col("id").alias("parent_archive_id"), F.col("original_name").alias("archive")).distinct()
    return distinct_files(spark, d).select("id", "parent_archive_id").join(a, "parent_archive_id").select("id", "archive")


@register("j_tree", """WITH r AS (SELECT 'archive' AS k, id, max(parent_archive_id) AS p, max(original_name) AS n FROM archives GROUP BY id UNION ALL SELECT 'file', id, max(parent_archive_id), max(original_name) FROM files GROUP BY id),
c AS (SELECT p, count(*) AS n, string_agg(coalesce(n, '-'), '/' ORDER BY k, n NULLS FIRST, id) AS names FROM r WHERE p IS NOT NULL GROUP BY 1)
SELECT r.k AS node_kind, r.id AS node_id, coalesce(c.n, 0) AS child_count, sha256(coalesce(c.names, '')) AS children FROM r LEFT JOIN c ON c.p = r.id WHERE r.k = 'archive'""")
def j_tree(spark, d):
    """Each archive with its children in their order (their names by a digest)."""
    t = fc.tree_levels(fc.tree_rows(table(spark, d, "archives"), table(spark, d, "files")))
    names = F.array_join(F.transform("child_names", lambda n: F.coalesce(n, F.lit("-"))), "/")
    return t.select("node_kind", "node_id", "child_count", F.sha2(names, 256).alias("children"))


@register("j_children", f"WITH {_F} SELECT parent_archive_id, count(*) AS n, min(virtual_path) AS first_path FROM f WHERE parent_archive_id IS NOT NULL GROUP BY 1")
def j_children(spark, d):
    return distinct_files(spark, d).where(F.col("parent_archive_id").isNotNull()).groupBy("parent_archive_id").agg(F.count("*").alias("n"), F.min("virtual_path").alias("first_path"))


@register("j_semi_hash", "SELECT DISTINCT sha256_hash FROM files WHERE sha256_hash IN (SELECT sha256_hash FROM files WHERE size > 1000)")
def j_semi_hash(spark, d):
    f = table(spark, d, "files")
    return f.select("sha256_hash").distinct().join(f.where(F.col("size") > 1000).select("sha256_hash"), "sha256_hash", "left_semi")


@register("j_anti_missing", f"WITH {_F} SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM log_index l WHERE l.real_path = 'cas://' || f.sha256_hash)")
def j_anti_missing(spark, d):
    o = table(spark, d, "log_index").select("real_path").distinct()
    return distinct_files(spark, d).withColumn("real_path", lf.real_path(F.col("sha256_hash"))).join(o, "real_path", "left_anti").select("id")


@register("j_dedup_ignore", f"WITH {_F}, old AS (SELECT sha256_hash FROM f WHERE analysis_status = 'READY') SELECT sha256_hash, min(virtual_path) AS virtual_path FROM f WHERE sha256_hash IS NOT NULL AND virtual_path IS NOT NULL AND sha256_hash NOT IN (SELECT sha256_hash FROM old WHERE sha256_hash IS NOT NULL) GROUP BY 1")
def j_dedup_ignore(spark, d):
    f = distinct_files(spark, d).select("sha256_hash", "virtual_path", "analysis_status")
    new = f.where(F.col("sha256_hash").isNotNull() & F.col("virtual_path").isNotNull()).select("sha256_hash", "virtual_path")
    return fc.insert_new(f.where(F.col("analysis_status") == "READY").select("sha256_hash", "virtual_path"), new, "sha256_hash")


def _insert(spark: SparkSession, at: str, rows: DataFrame) -> None:
    """Append the rows whose digest the table at ``at`` hasn't."""
    fc.insert_new(spark.read.parquet(at), rows, "sha256_hash").write.mode("append").parquet(at)


def _catalogue_rows(spark, d) -> DataFrame:
    f = distinct_files(spark, d).where(F.col("sha256_hash").isNotNull() & F.col("virtual_path").isNotNull())
    return f.select("sha256_hash", "virtual_path", "analysis_status")


_FIRST_PATHS = f"WITH {_F} SELECT sha256_hash, min(virtual_path) AS virtual_path FROM f WHERE sha256_hash IS NOT NULL AND virtual_path IS NOT NULL GROUP BY 1"


@register("sink_catalog_insert", _FIRST_PATHS)
def sink_catalog_insert(spark, d):
    """A table of catalogue rows, filled once and once more: the second time nothing is new."""
    at, rows = scratch_path(spark, "catalogue"), _catalogue_rows(spark, d).drop("analysis_status")
    rows.limit(0).write.parquet(at)
    _insert(spark, at, rows)
    _insert(spark, at, rows)
    return spark.read.parquet(at)


@register("sink_catalog_batch", f"WITH {_F}, c AS (SELECT sha256_hash, virtual_path, coalesce(analysis_status = 'READY', false) AS r FROM f WHERE sha256_hash IS NOT NULL AND virtual_path IS NOT NULL) SELECT sha256_hash, CASE WHEN bool_or(r) THEN min(CASE WHEN r THEN virtual_path END) ELSE min(virtual_path) END AS virtual_path FROM c GROUP BY 1")
def sink_catalog_batch(spark, d):
    """The same in two batches, READY rows ahead of the rest: what is there stays."""
    at, rows = scratch_path(spark, "catalogue"), _catalogue_rows(spark, d)
    ready = F.coalesce(F.col("analysis_status") == "READY", F.lit(False))
    rows.drop("analysis_status").limit(0).write.parquet(at)
    for batch in (rows.where(ready), rows.where(~ready)):
        _insert(spark, at, batch.drop("analysis_status"))
    return spark.read.parquet(at)


@register("j_details_terms", f"WITH {_L} SELECT id, t.keyword FROM l, (VALUES ('timeout', 1), ('damaged', 2)) t(keyword, term_id) WHERE regexp_matches(content, '(?i)' || t.keyword)")
def j_details_terms(spark, d):
    t = unique(lines(spark, d).where(sq.compile_query(_Q, F.col("content"))))
    return t.select("id", F.explode(sq.match_details(_Q, F.col("content"))).alias("m")).select("id", F.col("m.term_value").alias("keyword")).distinct()


@register("j_line_pattern", f"WITH {_L} SELECT id, g.name AS tag FROM l, (VALUES ('cache', 'cache (hit|miss)'), ('net', 'connection|peer')) g(name, pattern) WHERE regexp_matches(content, g.pattern)")
def j_line_pattern(spark, d):
    groups = {"cache": "cache (hit|miss)", "net": "connection|peer"}
    tags = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), n) for n, p in groups.items()]))
    return unique(lines(spark, d).select("id", tags.alias("tags")).where(F.size("tags") > 0)).select("id", F.explode("tags").alias("tag"))


@register("a_count_files", "SELECT count(DISTINCT id) AS n FROM files")
def a_count_files(spark, d):
    return table(spark, d, "files").agg(F.count_distinct("id").alias("n"))


@register("a_count_archives", "SELECT count(DISTINCT id) AS n FROM archives")
def a_count_archives(spark, d):
    return table(spark, d, "archives").agg(F.count_distinct("id").alias("n"))


@register("a_sum_size", f"WITH {_F} SELECT count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size, CAST(coalesce(max(depth_level), 0) AS BIGINT) AS max_depth FROM f")
def a_sum_size(spark, d):
    return fc.totals(distinct_files(spark, d))


@register("a_max_depth", "SELECT workspace_id, CAST(max(depth_level) AS BIGINT) AS max_depth FROM (SELECT workspace_id, depth_level FROM files UNION ALL SELECT workspace_id, depth_level FROM archives) GROUP BY 1")
def a_max_depth(spark, d):
    both = table(spark, d, "files").select("workspace_id", "depth_level").unionByName(table(spark, d, "archives").select("workspace_id", "depth_level"))
    return both.groupBy("workspace_id").agg(F.max("depth_level").cast("bigint").alias("max_depth"))


_STATS = f"SELECT virtual_path, CAST(min(epoch(date_trunc('second', strptime(left(content, 19), '%Y-%m-%d %H:%M:%S')))) AS BIGINT) AS min_timestamp, CAST(max(epoch(strptime(left(content, 19), '%Y-%m-%d %H:%M:%S'))) AS BIGINT) AS max_timestamp, bit_or({_MASK.format(_LV)}) AS level_mask FROM e GROUP BY 1"


@register("a_file_stats", f"WITH {_EV} {_STATS}")
def a_file_stats(spark, d):
    return fc.file_statistics(_parsed_events(spark, d))


@register("sink_update_stats", f"WITH {_EV}, s AS ({_STATS}) SELECT virtual_path, min_timestamp, level_mask, 'READY' AS analysis_status FROM s")
def sink_update_stats(spark, d):
    e = _parsed_events(spark, d)
    f = e.select("virtual_path").distinct().select("virtual_path", F.lit(0).alias("min_timestamp"), F.lit(0).alias("max_timestamp"), F.lit(0).alias("level_mask"), F.lit("PENDING").alias("analysis_status"))
    return fc.with_statistics(f, fc.file_statistics(e)).select("virtual_path", "min_timestamp", "level_mask", "analysis_status")


@register("a_time_range", f"SELECT min(nullif(timestamp, 0)) AS min_ts, max(nullif(timestamp, 0)) AS max_ts, count(*) AS n_lines FROM (SELECT DISTINCT id, timestamp FROM log_index)")
def a_time_range(spark, d):
    return fc.time_range(unique(table(spark, d, "log_index").select("id", "timestamp")))


def _digits(x):
    """Powers to thirteen digits, as far as libraries agree on them."""
    return F.when(x.isNotNull(), F.format_string("%.12e", x).cast("double"))


@register("a_compression", f"WITH {_F} SELECT id, CASE WHEN size = 0 THEN 0.0 ELSE size / 1000.0 END AS ratio, CASE WHEN size = 0 THEN 0.0 WHEN depth_level IS NULL THEN NULL ELSE CAST(printf('%.12e', CASE WHEN depth_level = 0 THEN size / 1000.0 ELSE pow(size / 1000.0, depth_level) END) AS DOUBLE) END AS risk FROM f WHERE size >= 0")
def a_compression(spark, d):
    """All files of known size, risks to thirteen digits; without a depth the risk is null unless the ratio is 0."""
    f = distinct_files(spark, d).where(F.col("size") >= 0)
    r = import_safety.ratio(F.lit(1000), F.col("size"))
    return f.select("id", r.alias("ratio"), _digits(import_safety.risk(r, F.col("depth_level"))).alias("risk"))


@register("a_storage_size", "SELECT CAST(sum(s) AS BIGINT) AS bytes FROM (SELECT sha256(text), max(strlen(text)) AS s FROM documents WHERE text IS NOT NULL GROUP BY 1)")
def a_storage_size(spark, d):
    t = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.encode("text", "UTF-8").alias("content"))
    return sinks.new_objects(t).agg(F.sum(F.length("content")).cast("bigint").alias("bytes"))


@register("sink_cas", "SELECT DISTINCT sha256(text) AS sha256_hash, 'objects/' || left(sha256(text), 2) || '/' || substr(sha256(text), 3) AS object FROM documents WHERE text IS NOT NULL")
def sink_cas(spark, d):
    t = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.encode("text", "UTF-8").alias("content"))
    return sinks.new_objects(t).select("sha256_hash", "object")


@register("a_validation_report", "WITH o AS (SELECT doc_id, sha256(text) AS h, doc_id % 7 = 0 AS gone, doc_id % 11 = 0 AS bad FROM documents WHERE text IS NOT NULL AND text <> '') SELECT CASE WHEN gone THEN 'missing' WHEN bad THEN 'corrupt' ELSE 'valid' END AS status, count(*) AS n FROM o GROUP BY 1")
def a_validation_report(spark, d):
    t = table(spark, d, "documents").where(F.col("text").isNotNull() & (F.col("text") != ""))
    t = t.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text")).alias("t"))
    f = t.select("doc_id", F.sha2("t", 256).alias("sha256_hash"))
    o = t.where(F.pmod("doc_id", F.lit(7)) != 0).select(F.sha2("t", 256).alias("sha256_hash"), F.when(F.pmod("doc_id", F.lit(11)) == 0, F.encode(F.concat("t", F.lit("!")), "UTF-8")).otherwise(F.encode("t", "UTF-8")).alias("content"))
    return fc.integrity(f, o).groupBy("status").agg(F.count("*").alias("n"))


@register("a_task_metrics", "SELECT extraction_status AS status, count(*) AS n FROM archives GROUP BY 1")
def a_task_metrics(spark, d):
    return table(spark, d, "archives").groupBy(F.col("extraction_status").alias("status")).agg(F.count("*").alias("n"))


@register("a_progress", f"WITH {_F} SELECT workspace_id, count(*) AS total, count(*) FILTER (WHERE analysis_status = 'READY') AS done, round(100.0 * count(*) FILTER (WHERE analysis_status = 'READY') / count(*), 6) AS percentage FROM f GROUP BY 1")
def a_progress(spark, d):
    done = F.count(F.when(F.col("analysis_status") == "READY", 1))
    return distinct_files(spark, d).groupBy("workspace_id").agg(F.count("*").alias("total"), done.alias("done"), F.round(100.0 * done / F.count("*"), 6).alias("percentage"))


@register("a_distinct", "SELECT DISTINCT sha256_hash FROM files")
def a_distinct(spark, d):
    return table(spark, d, "files").select("sha256_hash").distinct()


@register("s_dedup_hash", "SELECT sha256_hash FROM files WHERE sha256_hash IS NOT NULL UNION SELECT sha256_hash FROM archives WHERE sha256_hash IS NOT NULL")
def s_dedup_hash(spark, d):
    """The digests of files and archives, each once."""
    both = table(spark, d, "files").select("sha256_hash").unionByName(table(spark, d, "archives").select("sha256_hash"))
    return both.where(F.col("sha256_hash").isNotNull()).distinct()


@register("s_concat_results", f"WITH {_L}, {_EV} SELECT id, virtual_path FROM l WHERE contains(content, 'ERROR') UNION ALL SELECT id, virtual_path FROM e WHERE contains(content, 'ERROR')")
def s_concat_results(spark, d):
    q = query(term("ERROR", case_sensitive=True))
    a = unique(lines(spark, d).where(sq.compile_query(q, F.col("content"))).select("id", "virtual_path"))
    return a.unionByName(event_lines(spark, d).where(sq.compile_query(q, F.col("content"))).select("id", "virtual_path"))


@register("sink_upsert", f"WITH {_F}, a AS (SELECT id, max(created_at) AS created_at FROM archives GROUP BY id) SELECT coalesce(a.id, f.id) AS id, coalesce(a.created_at, f.created_at) AS created_at FROM a FULL JOIN f ON f.id = a.id")
def sink_upsert(spark, d):
    """A table of files by id, into which the last row of each archive of the same id goes."""
    at = cut(spark, distinct_files(spark, d).select("id", "created_at"), "upserted")
    a = table(spark, d, "archives").select("id", "created_at")
    stage, path = scratch_path(spark, "upsert"), scratch_path(spark, "upserts")
    fc.merge_rows(at, a, ["id"], [F.col("created_at").alias("_o")]).write.parquet(stage)
    compaction.replace_path(spark, stage, path)
    return spark.read.parquet(path)


@register("sink_archive_status", "SELECT id, CASE max(CASE extraction_status WHEN 'pending' THEN 0 WHEN 'extracting' THEN 1 WHEN 'failed' THEN 2 WHEN 'completed' THEN 3 END) WHEN 0 THEN 'pending' WHEN 1 THEN 'extracting' WHEN 2 THEN 'failed' WHEN 3 THEN 'completed' END AS status FROM archives GROUP BY id")
def sink_archive_status(spark, d):
    order = F.when(F.col("extraction_status") == "pending", 0).when(F.col("extraction_status") == "extracting", 1).when(F.col("extraction_status") == "failed", 2).when(F.col("extraction_status") == "completed", 3)
    a = table(spark, d, "archives").select("id", F.when(order.isNotNull(), F.col("extraction_status")).alias("status"), order.alias("rank"))
    return fc.latest(a, ["id"], [F.coalesce("rank", F.lit(-1)).alias("_o")]).select("id", "status")


@register("sink_delete", f"WITH {_F} SELECT id FROM f WHERE virtual_path IS NULL OR virtual_path NOT LIKE '/watch/%'")
def sink_delete(spark, d):
    """A table of files, and what is left of it once the rows under a path are deleted."""
    path = scratch_path(spark, "catalogue")
    unique(table(spark, d, "files").select("id", "virtual_path")).write.parquet(path)
    fc.delete_rows(spark, path, F.startswith("virtual_path", F.lit("/watch/")))
    return spark.read.parquet(path).select("id")


@register("sink_index_add", f"WITH {_L}, t AS (SELECT id, unnest({_STEMS}) AS token FROM l WHERE content IS NOT NULL) SELECT token, count(*) AS tf, count(DISTINCT id) AS df FROM t GROUP BY 1")
def sink_index_add(spark, d):
    """The postings of the index, added up by token."""
    p = spark.read.parquet(f"{token_index(spark, d).path}/postings")
    return p.groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@register("sink_result_session", _page_sql(0, 100))
def sink_result_session(spark, d):
    s = sinks.ResultSessions(spark)
    s.store("q", _event_results(spark, d).drop("id"))
    return s.page("q", 0, 100)[0]


@register("sink_session_evict", f"WITH {_EV} SELECT s AS search_id, (SELECT count(*) FROM e WHERE regexp_matches(content, '(?i)error')) AS n FROM (VALUES ('b'), ('c')) t(s)")
def sink_session_evict(spark, d):
    s = sinks.ResultSessions(spark, capacity=2)
    r = _event_results(spark, d).drop("id")
    for k in ("a", "b", "c"):
        s.store(k, r)
    return spark.createDataFrame([(k, s.results(k).count()) for k in s.paths], "search_id string, n bigint")


@register("sink_csv", f"WITH {_EV} SELECT chr(65279) || 'ID,Timestamp,Level,File,Line,Content' AS value UNION ALL SELECT id || ',' || left(content, 19) || ',' || {_LV} || ',\"' || virtual_path || '\",' || line || ',\"' || replace(content, '\"', '\"\"') || '\"' AS value FROM e WHERE regexp_matches(content, '(?i)error')")
def sink_csv(spark, d):
    """The lines of the written document."""
    at = scratch_path(spark, "csv")
    sinks.write_csv(se.search(event_lines(spark, d), "error", details=False), at)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(at)  # a text reader takes a mark away
    return raw.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("value")).where(F.col("value") != "")


@register("sink_json", f"WITH {_EV}, r AS (SELECT row_number() OVER (ORDER BY virtual_path, line) AS pos, id, virtual_path AS file, line FROM e WHERE regexp_matches(content, '(?i)error')) SELECT pos, id, file, line, (SELECT count(*) FROM r) AS total FROM r")
def sink_json(spark, d):
    """The document as it is written: its head's count, and its rows in their order."""
    at = scratch_path(spark, "json")
    sinks.write_json(_event_results(spark, d).orderBy("file", "line"), at, "2024-01-01T00:00:00Z")
    rows = sinks.document_lines(spark, at)
    head = rows.where(F.col("pos") == 0).select(F.from_json(F.concat("value", F.lit("]}")), "metadata struct<exportTime: string, totalCount: bigint>").alias("h"))
    r = rows.where((F.col("pos") > 0) & (F.col("value") != "]}")).select("pos", F.from_json(F.ltrim("value", F.lit(",")), "id bigint, file string, line bigint").alias("x"))
    return r.crossJoin(F.broadcast(head)).select("pos", "x.*", F.col("h.metadata.totalCount").alias("total"))


# ---- safety, workspace and small operators ----------------------------------------------------------------------

@register("g_ratio", f"WITH {_F} SELECT id, CASE WHEN c = 0 AND size = 0 THEN 0.0 WHEN c = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(size AS DOUBLE) / c END AS ratio FROM (SELECT id, size, id % 50 AS c FROM f WHERE size >= 0)")
def g_ratio(spark, d):
    f = distinct_files(spark, d).where(F.col("size") >= 0)
    return f.select("id", import_safety.ratio(F.pmod("id", F.lit(50)), F.col("size")).alias("ratio"))


@register("g_risk", f"WITH {_F} SELECT id, CASE WHEN size = 0 THEN 0.0 WHEN depth_level IS NULL THEN NULL ELSE CAST(printf('%.12e', CASE WHEN depth_level = 0 THEN size / 500.0 ELSE pow(size / 500.0, depth_level) END) AS DOUBLE) END AS risk FROM f WHERE size >= 0")
def g_risk(spark, d):
    """All files of known size, risks to thirteen digits; without a depth the risk is null unless the ratio is 0."""
    f = distinct_files(spark, d).where(F.col("size") >= 0)
    return f.select("id", _digits(import_safety.risk(import_safety.ratio(F.lit(500), F.col("size")), F.col("depth_level"))).alias("risk"))


@register("g_halt", f"WITH {_F} SELECT id, CASE WHEN size / 500.0 > 100 THEN 'ratio' WHEN pow(size / 500.0, 3) > 1e6 THEN 'risk' END AS reason FROM f WHERE size > 0")
def g_halt(spark, d):
    r = import_safety.ratio(F.lit(500), F.col("size"))
    return distinct_files(spark, d).where(F.col("size") > 0).select("id", import_safety.halt_reason(r, F.pow(r, F.lit(3)), F.lit(0)).alias("reason"))


@register("g_workspace", f"WITH {_F} SELECT workspace_id, CAST(sum(size) AS BIGINT) AS bytes, sum(size) > {50 << 30} AS over FROM f WHERE size > 0 GROUP BY 1")
def g_workspace(spark, d):
    f = distinct_files(spark, d).where(F.col("size") > 0)
    return f.groupBy("workspace_id").agg(F.sum("size").alias("bytes"), (F.sum("size") > import_safety.Policy().max_workspace).alias("over"))


@register("g_suspicious", f"WITH {_F}, e AS (SELECT parent_archive_id AS archive, 100 + id % 900 AS c, size AS u FROM f WHERE size > 0 AND parent_archive_id IS NOT NULL) SELECT archive, round(CAST(sum(u) AS DOUBLE) / sum(c), 6) AS overall_ratio, count(*) AS n_files, count(*) FILTER (WHERE CAST(u AS DOUBLE) / c > 80) AS n_extreme, CAST(CASE WHEN CAST(sum(u) AS DOUBLE) / sum(c) > 50 THEN 1 ELSE 0 END + CASE WHEN count(*) > 10000 THEN 1 ELSE 0 END + count(*) FILTER (WHERE CAST(u AS DOUBLE) / c > 80) AS BIGINT) AS warnings FROM e GROUP BY 1")
def g_suspicious(spark, d):
    f = distinct_files(spark, d).where((F.col("size") > 0) & F.col("parent_archive_id").isNotNull())
    return import_safety.suspicious(f.select(F.col("parent_archive_id").alias("archive"), (100 + F.pmod("id", F.lit(900))).alias("compressed"), F.col("size").alias("uncompressed")))


_queries_table("g_policy", lambda: [(n, _policy_ok(n)) for n in (0, 1, 20, 21)], "depth int, ok boolean", "SELECT * FROM (VALUES (0, false), (1, true), (20, true), (21, false)) t(depth, ok)")


def _policy_ok(depth: int) -> bool:
    try:
        import_safety.Policy(max_depth=depth)
    except ValueError:
        return False
    return True


@register("g_shorten", f"WITH {_F} SELECT id, CASE WHEN length(n) > 20 THEN regexp_extract(virtual_path, '^(.*/)?[^/]*$', 1) || left(sha256(n), 16) ELSE virtual_path END AS path FROM (SELECT id, virtual_path, regexp_extract(virtual_path, '([^/]*)$', 1) AS n FROM f WHERE virtual_path IS NOT NULL)")
def g_shorten(spark, d):
    return distinct_files(spark, d).where(F.col("virtual_path").isNotNull()).select("id", import_safety.shortened(F.col("virtual_path"), 20).alias("path"))


@register("g_inflight", "SELECT 5 AS calls, 1 AS runs, (SELECT count(DISTINCT virtual_path) FROM archives) AS result")
def g_inflight(spark, d):
    """Five calls at once for one key are one job, whose result all get."""
    flight, runs, gate = events.SingleFlight(), [], threading.Barrier(5)

    def job():
        runs.append(1)
        time.sleep(1)
        return table(spark, d, "archives").agg(F.count_distinct("virtual_path")).first()[0]

    def call():
        gate.wait()
        return flight.run("paths", job)

    with ThreadPoolExecutor(5) as ex:
        got = [f.result() for f in [ex.submit(call) for _ in range(5)]]
    return spark.createDataFrame([(len(got), len(runs), n) for n in set(got)], "calls int, runs int, result bigint")


def _retried() -> list[tuple]:
    """Calls that fail some times before they succeed: outcome, calls and milliseconds waited."""
    out = []
    for fails, kind in ((0, OSError), (2, OSError), (9, OSError), (1, KeyError)):
        calls, waits = [], []

        def f(fails=fails, kind=kind, calls=calls):
            calls.append(1)
            if len(calls) <= fails:
                raise kind("busy")
            return "done"

        try:
            got = events.retry(f, 7, sleep=lambda s, waits=waits: waits.append(round(s * 1000)))
        except Exception as e:  # noqa: BLE001
            got = type(e).__name__
        out.append((got, len(calls), sum(waits)))
    return out


_queries_table("g_retry", _retried, "outcome string, calls int, waited_ms int", "SELECT * FROM (VALUES ('done', 1, 0), ('done', 3, 300), ('OSError', 8, 11300), ('KeyError', 1, 0)) t(outcome, calls, waited_ms)")


@register("x_ws_status", f"WITH {_F}, s AS (SELECT workspace_id, count(*) AS n, CAST(floor(sum(size) / 1048576) AS BIGINT) AS mb FROM f WHERE size > 0 GROUP BY 1) SELECT workspace_id, n, CASE WHEN mb >= 1024 THEN printf('%.1fGB', mb / 1024) ELSE mb || 'MB' END AS size FROM s")
def x_ws_status(spark, d):
    f = distinct_files(spark, d).where(F.col("size") > 0)
    return f.groupBy("workspace_id").agg(F.count("*").alias("n"), F.sum("size").alias("s")).select("workspace_id", "n", lf.human_size(F.col("s")).alias("size"))


@register("x_event_dedup", "WITH t AS (SELECT user_id AS task, event_id AS seq, CAST(floor(value) AS BIGINT) AS version FROM events WHERE value IS NOT NULL) SELECT task, seq, version FROM (SELECT *, max(version) OVER (PARTITION BY task ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM t) WHERE m IS NULL OR version > m")
def x_event_dedup(spark, d):
    t = table(spark, d, "events").where(F.col("value").isNotNull()).select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.floor("value").alias("version"))
    return fc.last_versions(t, "task", "version")


@register("x_task_version", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events")
def x_task_version(spark, d):
    return table(spark, d, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("version"))


@register("x_task_ttl", "SELECT event_id FROM events WHERE date_diff('second', ts, (SELECT max(ts) FROM events)) < CASE WHEN event_type = 'error' THEN 1800 ELSE 300 END")
def x_task_ttl(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("now"))
    age = F.unix_seconds(F.date_trunc("second", F.col("now").cast("timestamp"))) - F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    return e.crossJoin(F.broadcast(last)).where(age < F.when(F.col("event_type") == "error", 1800).otherwise(300)).select("event_id")


@register("x_ws_refresh", f"WITH {_F}, o AS (SELECT virtual_path, max(sha256_hash) AS h FROM f WHERE analysis_status = 'READY' AND virtual_path IS NOT NULL GROUP BY 1), n AS (SELECT virtual_path, max(sha256_hash) AS h FROM f WHERE virtual_path IS NOT NULL GROUP BY 1) SELECT CASE WHEN o.virtual_path IS NULL THEN 'new' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n FROM n LEFT JOIN o ON o.virtual_path = n.virtual_path GROUP BY 1")
def x_ws_refresh(spark, d):
    """What a refresh finds: paths that are new, changed or unchanged against the READY ones."""
    f = distinct_files(spark, d).where(F.col("virtual_path").isNotNull())
    return fc.refreshed(f.where(F.col("analysis_status") == "READY"), f).groupBy("state").agg(F.count("*").alias("n"))


@register("x_time_default", "SELECT date_trunc('minute', min(ts)) AS a, date_trunc('minute', max(ts)) AS b FROM events")
def x_time_default(spark, d):
    e = table(spark, d, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select(*[F.date_trunc("minute", F.col(c)).cast("timestamp_ntz").alias(c) for c in ("a", "b")])


@register("x_ws_id", "SELECT workspace_id, regexp_matches(workspace_id, '^[A-Za-z0-9_-]{1,50}$') AS ok FROM workspaces")
def x_ws_id(spark, d):
    return table(spark, d, "workspaces").select("workspace_id", F.col("workspace_id").rlike("^[A-Za-z0-9_-]{1,50}$").alias("ok"))


@register("x_slug", "SELECT workspace_id, left(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 38) AS slug FROM workspaces")
def x_slug(spark, d):
    return table(spark, d, "workspaces").select("workspace_id", lf.slug(F.col("name")).alias("slug"))


# ---- streaming ---------------------------------------------------------------------------------------------------

def _tailed(spark: SparkSession, steps: list[dict[str, tuple[str, str] | None]]) -> DataFrame:
    """What a tail hands out when files are written in steps, with a restart on its checkpoint after each: of each file
    a mode (``w`` anew, ``a`` appended) and text, or None where it is removed."""
    at = "/" + scratch_path(spark, "tail").removeprefix("file:").lstrip("/")
    out, marks = scratch_path(spark, "tailed"), scratch_path(spark, "tail-marks")
    os.makedirs(at)
    for step in steps:
        for name, change in step.items():
            if change is None:
                os.remove(f"{at}/{name}")
            else:
                with open(f"{at}/{name}", change[0]) as f:
                    f.write(change[1])
        q = tail.append_to(tail.tail(spark, at), out, marks, {"availableNow": True})
        q.awaitTermination()
    return spark.read.parquet(out).select(F.element_at(F.split("virtual_path", "/"), -1).alias("file"), "line", "content", "level", "ts_text")


def _steps(name: str, steps: list[dict], want: list[tuple]) -> None:
    """A query over what a tail makes of the steps, and the rows it must give."""
    rows = ", ".join("(" + ", ".join("'" + v + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in want)
    register(name, f"SELECT * FROM (VALUES {rows}) t(file, line, content)")(lambda spark, d: _tailed(spark, steps).select("file", "line", "content"))


@register("st_tail", "SELECT * FROM (VALUES (1, '2024-01-01 10:00:00 [INFO] one', 'info', '2024-01-01 10:00:00'), (2, 'two', 'debug', ''), (3, 'partly three', 'debug', ''), (4, '[ERROR] four', 'error', '')) t(line, content, level, ts_text)")
def st_tail(spark, d):
    return _tailed(spark, [{"app.log": ("w", "2024-01-01 10:00:00 [INFO] one\ntwo\npart")}, {"app.log": ("a", "ly three\n[ERROR] four\n")}]).drop("file")


@register("st_process", "SELECT * FROM (VALUES (1, '2024-01-01 10:00:00 [WARN] one', 'warn', '2024-01-01 10:00:00'), (2, 'two', 'debug', '')) t(line, content, level, ts_text)")
def st_process(spark, d):
    return _tailed(spark, [{"app.log": ("w", "2024-01-01 10:00:00 [WARN] one\ntwo\nunfinished")}]).drop("file")


_steps("src_tail", [{"a": ("w", "one\ntwo\nthree\n")}, {"a": ("w", "new\n")}], [("a", 1, "one"), ("a", 2, "two"), ("a", 3, "three"), ("a", 1, "new")])
_steps("st_watch", [{"a": ("w", "one\n"), "b": ("w", "x\n")}, {"c": ("w", "late\n"), "a": ("a", "two\n")}], [("a", 1, "one"), ("b", 1, "x"), ("c", 1, "late"), ("a", 2, "two")])
_steps("st_state", [{"a": ("w", "1\n2\n")}, {"a": ("a", "3\n")}, {"a": ("a", "4\n5\n")}], [("a", i, str(i)) for i in range(1, 6)])
_steps("st_offsets", [{"a": ("w", "1\n2\n")}, {}, {}, {"a": ("a", "3\n")}, {}], [("a", i, str(i)) for i in range(1, 4)])
_steps("st_remove", [{"a": ("w", "1\n"), "b": ("w", "x\ny\n")}, {"b": None, "a": ("a", "2\n")}, {"a": ("a", "3\n")}], [("a", 1, "1"), ("b", 1, "x"), ("b", 2, "y"), ("a", 2, "2"), ("a", 3, "3")])


@register("st_stop", "SELECT false AS active, 2 AS n_lines, 0 AS watches")
def st_stop(spark, d):
    """A watch that is stopped: what it has read stays, what comes after isn't read."""
    at = "/" + scratch_path(spark, "watched").removeprefix("file:").lstrip("/")
    os.makedirs(at)
    Path(at, "a.log").write_text("one\ntwo\n")
    ws = Workspace(spark, scratch_path(spark, "workspace"))
    w = ws.start_watch(at, processingTime="1 second")
    q = ws.watches[w]
    q.processAllAvailable()
    ws.stop_watch(w)
    Path(at, "b.log").write_text("three\n")
    return spark.createDataFrame([(q.isActive, ws.lines.count(), len(ws.watches))], "active boolean, n_lines int, watches int")


@register("st_checkpoint", "SELECT * FROM (VALUES ('broken off', 4, 2), ('gone on', 8, 4)) t(step, n_lines, n_files)")
def st_checkpoint(spark, d):
    """An import that fails in its second step, and the one that goes on from there."""
    at = "/" + scratch_path(spark, "source").removeprefix("file:").lstrip("/")
    os.makedirs(at)
    for i in range(4):
        Path(at, f"{i}.log").write_text(f"line {i}\nmore\n")
    ws, out = Workspace(spark, scratch_path(spark, "workspace")), []
    for step in ("broken off", "gone on"):
        put, ws._put = ws._put, (lambda name, df, i, left=iter((1, 1, 1, 1) if step == "broken off" else (1,) * 99): next(left) and Workspace._put(ws, name, df, i))
        try:
            ws.import_path(f"file://{at}", step_bytes=20)
        except StopIteration:
            pass
        out.append((step, ws.lines.count(), ws.files.count()))
    return spark.createDataFrame(out, "step string, n_lines int, n_files int")


@register("sink_events", "SELECT * FROM (VALUES ('started', 0), ('updated', 3), ('ended', 0), ('search', 7)) t(kind, n_rows)")
def sink_events(spark, d):
    """What a subscriber is told of a stream over three rows, and of a search."""
    told, publisher = [], events.EventPublisher(spark)
    publisher.subscribe(lambda kind, about, rows: told.append((kind, about, rows)))
    at = scratch_path(spark, "events")
    spark.range(3).coalesce(1).write.parquet(at)
    q = spark.readStream.schema("id bigint").parquet(at).writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "events-marks")).trigger(availableNow=True).start()
    q.awaitTermination()
    until = time.time() + 30
    while time.time() < until and ("ended", str(q.id)) not in [t[:2] for t in told]:
        time.sleep(0.1)
    publisher.publish("search", "s", 7)
    publisher.close()
    mine = [(k, n) for k, about, n in told if about in (str(q.id), "s")]
    return spark.createDataFrame(mine, "kind string, n_rows int")


@register("st_debounce", "SELECT time_bucket(INTERVAL 5 SECOND, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def st_debounce(spark, d):
    s = spark.readStream.schema(table(spark, d, "events").schema).parquet(_as_folder(spark, d, "events")).select(F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "3650 days")
    q = events.debounced(s).writeStream.format("memory").queryName("lumberline_updates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("lumberline_updates").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("st_window")
def st_window(spark, d):
    s = spark.readStream.schema(table(spark, d, "events").schema).parquet(_as_folder(spark, d, "events"))
    e = s.select(F.col("ts").alias("ts"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"))
    q = tail.level_counts(e, "1 day", "365 days").writeStream.format("memory").queryName("lumberline_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("lumberline_windows").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "level", "n")


ORACLE["st_window"] = "SELECT date_trunc('day', ts) AS start, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, count(*) AS n FROM events GROUP BY 1, 2"


def _as_folder(spark: SparkSession, d: str, name: str) -> str:
    at = scratch_path(spark, f"stream-{name}")
    table(spark, d, name).write.parquet(at)
    return at


@register("a_search_stats", f"WITH {_L}, q AS (SELECT 'cache' AS query, count(*) AS n FROM l WHERE regexp_matches(content, '(?i)cache') UNION ALL SELECT 'queue', count(*) FROM l WHERE regexp_matches(content, '(?i)queue')) SELECT count(*) AS searches, CAST(sum(n) AS BIGINT) AS results, avg(n) AS mean FROM q")
def a_search_stats(spark, d):
    hits = F.array_compact(F.array(*[F.when(sq.compile_query(query(term(w)), F.col("content")), w) for w in ("cache", "queue")]))
    n = unique(lines(spark, d).select("id", hits.alias("q")).where(F.size("q") > 0)).select(F.explode("q").alias("query")).groupBy("query").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("searches"), F.sum("n").alias("results"), F.avg("n").alias("mean"))


@register("a_highlight_stats", f"WITH {_L} SELECT count(*) AS n_lines, CAST(sum(len(string_split(lower(content), 'queue')) - 1) AS BIGINT) AS n_ranges FROM l WHERE regexp_matches(content, '(?i)queue')")
def a_highlight_stats(spark, d):
    t = unique(lines(spark, d).where(F.col("content").rlike("(?i)queue")))
    return t.agg(F.count("*").alias("n_lines"), F.sum(F.size(highlight.highlight_ranges([term("queue")], F.col("content")))).alias("n_ranges"))


QUERIES |= problems.QUERIES
ORACLE |= problems.ORACLE

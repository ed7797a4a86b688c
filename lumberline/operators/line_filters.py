"""Predicates over lines and files: level, time, file pattern, pruning, import filters and path safety."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions.logfields import LEVEL_BITS
from lumberline.plans.search_query import QueryError

# Leading bytes of binary files, names and extensions that an import takes or leaves.
MAGIC = ("FFD8FF", "89504E47", "474946", "424D", "49492A00", "0000001866747970", "1A45DFA3", "494433", "FFFB", "52494646", "4D5A", "7F454C46", "FEEDFACF", "504B0304", "1F8B")
NAME_PATTERNS = ("syslog", "messages", "system", "stdout", "stderr", "*log*", "*error*", "*access*", "*.20*")
ALLOWED, FORBIDDEN = ("log", "txt", "json", "xml", "csv"), ("exe", "bat", "sh", "dll", "so")
_TIMES = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S.%f", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M")


def parse_filter_time(text: str | None) -> dt.datetime | None:
    if text is None or not text.strip():
        return None
    for f in _TIMES:
        try:
            return dt.datetime.strptime(text.strip(), f)
        except ValueError:
            continue
    try:
        t = dt.datetime.fromisoformat(text.strip())
    except ValueError as e:
        raise QueryError(f"VALIDATION_ERROR: not a time: {text}") from e
    return t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t


@dataclass(frozen=True)
class SearchFilters:
    levels: tuple[str, ...] = ()
    time_start: str | None = None
    time_end: str | None = None
    file_pattern: str | None = None

    def level_set(self) -> list[str]:
        return sorted({x.strip().lower() for x in self.levels if x.strip()})

    def range(self) -> tuple[dt.datetime | None, dt.datetime | None]:
        a, b = parse_filter_time(self.time_start), parse_filter_time(self.time_end)
        if a and b and a > b:
            raise QueryError("VALIDATION_ERROR: start is after end")
        return a, b

    def mask(self) -> int:
        return reduce(lambda m, x: m | LEVEL_BITS.get(x, 0), self.level_set(), 0)


def glob_regex(pattern: str) -> str:
    """A pattern with ``*`` and ``?`` as an anchored expression; both cross ``/``."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.strip()) + "$"


def file_matches(pattern: str, *paths: Column) -> Column:
    p = pattern.strip()
    one = (lambda c: c.rlike(glob_regex(p))) if set(p) & set("*?") else (lambda c: c.contains(F.lit(p)))
    return reduce(lambda a, b: a | b, [F.coalesce(one(c), F.lit(False)) for c in paths])


def glob_text(pattern: str) -> str:
    """The pattern as a catalogue GLOB: a bare text may stand anywhere, its special characters stand for themselves."""
    p = pattern.strip()
    return p if set(p) & set("*?") else "*" + "".join(f"[{c}]" if c in "*?[]" else c for c in p) + "*"


def line_predicate(filters: SearchFilters, path: str = "virtual_path", real: str | None = "real_path") -> Column:
    """Cheap conditions first: level, then time (a line without a time fails), then the file's name."""
    out = F.lit(True)
    if levels := filters.level_set():
        out = out & F.col("level").isin(*levels)
    a, b = filters.range()
    if a is not None:
        out = out & (F.col("ts") >= F.lit(a).cast("timestamp_ntz"))
    if b is not None:
        out = out & (F.col("ts") <= F.lit(b).cast("timestamp_ntz"))
    if filters.file_pattern and filters.file_pattern.strip():
        out = out & file_matches(filters.file_pattern, *[F.col(c) for c in (path, real) if c])
    return out


def prune_files(files: DataFrame, filters: SearchFilters) -> DataFrame:
    """Files that may have a match: READY ones if time or level is asked for; unknown statistics pass."""
    a, b = filters.range()
    mask, d = filters.mask(), files
    if a or b or mask:
        d = d.where(F.col("analysis_status") == "READY")
    if a is not None:
        d = d.where(F.col("max_timestamp").isNull() | (F.col("max_timestamp") >= int(a.replace(tzinfo=dt.timezone.utc).timestamp())))
    if b is not None:
        d = d.where(F.col("min_timestamp").isNull() | (F.col("min_timestamp") <= int(b.replace(tzinfo=dt.timezone.utc).timestamp())))
    if mask:
        d = d.where(F.col("level_mask").isNull() | (F.col("level_mask").bitwiseAND(mask) != 0))
    if filters.file_pattern and filters.file_pattern.strip():
        d = d.where(file_matches(filters.file_pattern, F.col("virtual_path")))
    return d


def is_binary(content: Column) -> Column:
    """By the leading bytes, or by more than 5 % zero bytes in the first 1024."""
    head = F.substring(content, 1, 1024)
    hexed = F.hex(head)
    magic = reduce(lambda a, b: a | b, [F.startswith(hexed, F.lit(m)) for m in MAGIC])
    # Pairs of hex digits that are 00, at even places only.
    zeros = F.size(F.filter(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1)), lambda x: x == "00"))
    return F.when(F.length(head) == 0, False).otherwise(magic | (zeros / F.length(head) > 0.05))


def import_allowed(path: Column, mode: str = "whitelist") -> Column:
    """Name patterns (unanchored expressions, as the filter has them), or the extension's list."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    globs = reduce(lambda a, b: a | b, [name.rlike(re.escape(p).replace("\\*", ".*").replace("\\?", ".")) for p in NAME_PATTERNS])
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    listed = ext.isin(*ALLOWED) if mode == "whitelist" else (~ext.isin(*FORBIDDEN) | (ext == ""))
    return globs | listed


def path_problem(path: Column) -> Column:
    """The first reason a path inside an archive is unsafe, or null."""
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "empty")
        .when(F.octet_length(path) > 1024, "too_long")
        .when(F.startswith(path, F.lit("/")) | F.startswith(path, F.lit("\\")), "absolute")
        .when(path.rlike("^[A-Za-z]:"), "drive")
        .when(path.rlike(r"(^|[/\\])\.\.([/\\]|$)"), "traversal")
        .when(path.contains("\x00"), "null_byte")
    )

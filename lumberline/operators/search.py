"""Search over lines: scan, filter, match, enrich, order, limit, page and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.functions import logfields as lf
from lumberline.operators.line_filters import SearchFilters, line_predicate
from lumberline.plans.search_query import SearchQuery, compile_query, match_details, matched_keywords, resolve
from lumberline.session import cut

#: How many results and rows a page have where the caller asks for no number.
DEFAULT_RESULTS, DEFAULT_PAGE = 100_000, 1000


def lines_of(texts: DataFrame, path: Column, text: Column, *more: Column) -> DataFrame:
    """Texts to numbered lines: ``virtual_path, line, content``; one trailing CR goes, no line after a last newline."""
    d = texts.select(path.alias("virtual_path"), *more, F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("pos", "content"))
    return d.select("virtual_path", *[c for c in d.columns if c not in ("virtual_path", "pos", "content")], (F.col("pos") + 1).cast("bigint").alias("line"), F.regexp_replace("content", "\r$", "").alias("content"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with a global ``id`` from 0 in the order: counts of range partitions added up, no single-partition window."""
    d = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    d = cut(df.sparkSession, d.withColumn("_p", F.shiftright("_m", 33)), "numbered")
    sizes = d.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    return d.join(F.broadcast(base), "_p").select((F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("id"), *df.columns)


def search(lines: DataFrame, query: str | SearchQuery, filters: SearchFilters | None = None, max_results: int | None = None, details: bool = True, key: str | None = None, ordered: bool = True) -> DataFrame:
    """Entries ``file, line, content, timestamp, level, real_path[, match_details, matched_keywords]`` in path and line order.

    ``lines``: ``virtual_path, line, content, real_path``.  A limit keeps the first results in that order.  With ``key``
    matching rows of one key count once, ahead of the order; without ``ordered`` there is no sort.  Times are worked out
    for the matches alone, and on the scan only if they are filtered by.
    """
    q = resolve(query) if isinstance(query, str) else resolve(None, query)
    f = filters or SearchFilters()
    d = lines.where(compile_query(q, F.col("content")))
    timed = any(f.range())
    if timed:
        d = lf.with_fields(d).where(line_predicate(f)).drop("ts", "level_mask")
    else:
        d = d.withColumn("level", lf.level(F.col("content"))).where(line_predicate(f))
    if key is not None:
        d = d.dropDuplicates([key])
    if not timed:
        d = d.withColumn("ts_text", lf.time_text(F.col("content")))
    if details and q.global_operator != "NOT":
        d = d.withColumn("match_details", match_details(q, F.col("content")))
        d = d.withColumn("matched_keywords", matched_keywords(F.col("match_details")))
    elif details:
        d = d.withColumn("match_details", F.lit(None)).withColumn("matched_keywords", F.lit(None).cast("array<string>"))
    d = d.withColumnRenamed("virtual_path", "file").withColumnRenamed("ts_text", "timestamp")
    if ordered or max_results is not None:
        d = d.orderBy("file", "line")
    return d.limit(max_results) if max_results is not None else d


def truncated(lines: DataFrame, query: str | SearchQuery, max_results: int, filters: SearchFilters | None = None) -> bool:
    """Whether more results exist than the limit."""
    return search(lines, query, filters, None, False, ordered=False).limit(max_results + 1).count() > max_results


def page(results: DataFrame, offset: int, limit: int = DEFAULT_PAGE) -> tuple[DataFrame, dict]:
    """One page of numbered results (``id`` from 0) by a range of ids, and where it stands."""
    n = results.count()
    end = min(n, offset + limit)
    return results.where((F.col("id") >= offset) & (F.col("id") < offset + limit)).orderBy("id"), {"total_count": n, "has_more": end < n, "next_offset": end if end < n else None, "total_pages": -(-n // limit) if limit else 0}


def keyword_statistics(results: DataFrame) -> DataFrame:
    """``keyword, match_count, match_percentage`` of the results."""
    total = results.agg(F.count("*").alias("total"))
    c = results.select(F.explode("matched_keywords").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("match_count"))
    return c.crossJoin(F.broadcast(total)).select("keyword", "match_count", F.when(F.col("total") > 0, F.round(100.0 * F.col("match_count") / F.col("total"), 6)).otherwise(0.0).alias("match_percentage"))

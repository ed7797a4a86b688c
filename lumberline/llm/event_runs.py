"""Runs of alike log entries collapsed to one event with its count and duration.

Boundary-only rows: of the ordered entries of a file only those that differ from their predecessor are kept; a lead
over these starts gives, as a difference of positions, the count, and from the entry before the next start the last
line and the duration.  Entries are alike if level, component and message (continuation lines included) agree once
white space and every blank-separated token with a digit are set aside.

A file is handled in blocks of line numbers (see ``operators.log_entries``).  All in-block work is one shuffle on
(file, block).  Files longer than a block also go, by themselves, through a second path that works out what crosses a
block's edge: the tail of an entry (the level of a two-line header with it), the key before, the next start after.  It ends in one row for each of their blocks.

Defined cases: as for entries; a null component or level equals another null one; repeated rows of a line count once;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.operators.log_entries import BLOCK, BLOCK_BITS, _timed, block_years, is_head, parse_lines
from lumberline.session import BROADCAST_BYTES, cut

_ASCII_WS = "\\t-\\r\\x1c-\\x20"
_WS = _ASCII_WS + "\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _set_aside(ws: str) -> str:
    """White space, a token without a digit (group 1, which stays), or any other token: one step for each, linear."""
    return f"[{ws}]++|([^{ws}0-9]++)(?![^{ws}])|[^{ws}]++"


_FB = ("file_path", "blk")


def message_core(message: Column) -> Column:
    """The message without white space and without tokens that hold a digit."""
    m = F.coalesce(message, F.lit(""))
    wide = F.regexp_replace(m, _set_aside(_WS), "$1")
    return F.when(F.length(m) == F.octet_length(m), F.regexp_replace(m, _set_aside(_ASCII_WS), "$1")).otherwise(wide)


def _keyed(lines: DataFrame) -> DataFrame:
    """Rows of lines in (file, block) partitions: ``head`` (line of their entry's header in this block, or null),
    ``n`` (how many non-empty cores the entry has had so far, or the block, ahead of its first header)."""
    d = parse_lines(lines)
    head = is_head(F.col("layout"))
    text = F.when(F.col("layout").isNotNull(), F.col("message")).otherwise(F.col("content"))
    d = d.select(*_FB, "line_number", F.when(head, F.col("line_number")).alias("_hl"), "layout", F.when(head, F.struct("ts_ms", "month", "day")).alias("at"), "level", "component", message_core(text).alias("core"))
    d = d.repartition(*_FB)
    w = Window.partitionBy(*_FB).orderBy("line_number")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_p", F.lag("line_number").over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col("line_number")))
    some = (F.col("core") != "").cast("int")
    d = d.withColumn("_c", F.sum(some).over(run))
    base = F.last(F.when(F.col("_hl").isNotNull(), F.col("_c") - some), ignorenulls=True).over(run)
    d = d.withColumn("head", F.last("_hl", ignorenulls=True).over(run)).withColumn("n", F.col("_c") - F.coalesce(base, F.lit(0)))
    return d.drop("_p", "_c")


def _mark(core: Column, n: Column) -> Column:
    return F.when(core != "", F.xxhash64(core, n.cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def _block_entries(keyed: DataFrame, years: DataFrame | None) -> DataFrame:
    """The entries that begin in each block, as far as the block has them."""
    d = keyed.where(F.col("head").isNotNull())
    at = F.col("line_number") == F.col("head")
    second = (F.col("layout") == "second") & (F.col("line_number") == F.col("head") + 1)
    g = d.groupBy(*_FB, "head").agg(
        F.max("line_number").alias("last_line"),
        F.max(F.when(at, F.col("layout"))).alias("_lay"),
        F.max(F.when(at, F.col("level"))).alias("_l1"),
        F.max(F.when(second, F.col("level"))).alias("_l2"),
        F.max(F.when(at, F.col("component"))).alias("component"),
        F.max(F.when(at, F.col("at"))).alias("at"),
        F.bit_xor(_mark(F.col("core"), F.col("n"))).alias("sig"),
        F.max(F.when(F.col("core") != "", F.col("n"))).alias("_n"),
    )
    level = F.when(F.col("_lay") == "twoline", F.col("_l2")).otherwise(F.col("_l1"))
    g = g.withColumn("year", F.lit(None).cast("int")) if years is None else g.join(years, [*_FB], "left")
    g = g.select("*", "at.*")
    return g.select(*_FB, F.col("head").alias("first_line"), "last_line", level.alias("level"), "component", _timed(g).alias("ts"), "sig", F.coalesce("_n", F.lit(0)).alias("cores"))


def _key(d: DataFrame) -> Column:
    return F.struct("level", "component", "sig", "cores")


def _small(df: DataFrame) -> DataFrame:
    """A written table of a row for each block of the long files: broadcast while its rows as text are within
    ``BROADCAST_BYTES``, joined by an exchange beyond."""
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first().n
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def _crossings(lines: DataFrame, long_files: DataFrame, years: DataFrame | None) -> DataFrame:
    """For each block of the long files what its neighbours have: ``tail`` (of its last entry), ``seq0`` (entries in
    earlier blocks), ``before`` (the entry ahead of the block), ``after`` (the next start in a later block or the end)."""
    spark = lines.sparkSession
    keyed = cut(spark, _keyed(lines.join(_small(long_files), "file_path", "left_semi")), "runs-keyed")
    # 1. Lines ahead of a block's first header belong to the last entry of an earlier block.
    per = keyed.groupBy(*_FB).agg(F.max("head").alias("h"), F.max_by("n", "line_number").alias("e"), F.sum((F.col("core") != "").cast("bigint")).alias("t"))
    ahead = Window.partitionBy("file_path").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file_path").orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("s", F.sum("t").over(upto))
    per = per.withColumn("owner", F.last("h", ignorenulls=True).over(ahead)).withColumn("_o", F.last(F.when(F.col("h").isNotNull(), F.col("e") - F.col("s")), ignorenulls=True).over(ahead))
    owners = per.select(*_FB, "owner", (F.col("_o") + F.col("s") - F.col("t")).alias("n0")).where(F.col("owner").isNotNull())
    carried = keyed.where(F.col("head").isNull() & (F.col("blk") > 0)).join(_small(cut(spark, owners, "runs-owners")), [*_FB])
    tails = carried.groupBy("file_path", F.shiftright("owner", BLOCK_BITS).alias("blk")).agg(
        F.bit_xor(_mark(F.col("core"), F.col("n0") + F.col("n"))).alias("t_sig"),
        F.max("line_number").alias("t_last"),
        F.max(F.when((F.col("layout") == "second") & (F.col("line_number") == F.col("owner") + 1), F.col("level"))).alias("t_level"),
        F.max(F.when(F.col("core") != "", F.col("n0") + F.col("n"))).alias("t_cores"),
    )
    # 2. Their whole entries, and which of them start a run.
    w = Window.partitionBy(*_FB).orderBy("first_line")
    e = cut(spark, _with_tail(_block_entries(keyed, years).join(tails, [*_FB], "left"), w), "runs-entries")
    e = e.withColumn("key", _key(e))
    ends = e.groupBy(*_FB).agg(F.count("*").alias("k"), F.max_by(F.struct("key", "last_line", "ts"), "first_line").alias("z"))
    by_file = Window.partitionBy("file_path").orderBy("blk")
    whole = by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.withColumn("before", F.lag("z").over(by_file)).withColumn("seq0", F.sum("k").over(upto) - F.col("k"))
    ends = ends.withColumn("end", F.struct((F.sum("k").over(whole) + 1).alias("seq"), F.last("z.last_line").over(whole).alias("last_line"), F.last("z.ts").over(whole).alias("ts")))
    # A long entry may leave blocks without any entry of their own; these have no row, and need none.
    s = e.join(ends.select(*_FB, "before", "seq0"), [*_FB]).withColumn("rn", F.row_number().over(w))
    s = s.withColumn("_z", F.coalesce(F.lag(F.struct("key", "last_line", "ts")).over(w), F.col("before")))
    s = s.where(F.col("_z").isNull() | ~F.col("_z.key").eqNullSafe(F.col("key")))
    firsts = s.groupBy(*_FB).agg(F.min_by(F.struct((F.col("seq0") + F.col("rn")).alias("seq"), F.col("_z.last_line").alias("last_line"), F.col("_z.ts").alias("ts")), "first_line").alias("first"))
    info = ends.join(firsts, [*_FB], "left").join(tails, [*_FB], "left")
    later = Window.partitionBy("file_path").orderBy("blk").rowsBetween(1, Window.unboundedFollowing)
    return info.select(*_FB, "t_sig", "t_last", "t_level", "t_cores", "seq0", "before", F.coalesce(F.first("first", ignorenulls=True).over(later), F.col("end")).alias("after"))


def _with_tail(d: DataFrame, w) -> DataFrame:
    """Entries with the tail that later blocks hold of a block's last entry."""
    last = F.lead("first_line").over(w).isNull() & F.col("t_sig").isNotNull()
    d = d.withColumn("_last", last)
    d = d.withColumn("sig", F.when(F.col("_last"), F.col("sig").bitwiseXOR(F.col("t_sig"))).otherwise(F.col("sig")))
    d = d.withColumn("last_line", F.when(F.col("_last"), F.col("t_last")).otherwise(F.col("last_line")))
    # Only a two-line header whose second line is yet to come has no level.
    d = d.withColumn("level", F.when(F.col("_last"), F.coalesce("level", "t_level")).otherwise(F.col("level")))
    d = d.withColumn("cores", F.when(F.col("_last"), F.coalesce("t_cores", "cores")).otherwise(F.col("cores")))
    return d.drop("_last", "t_sig", "t_last", "t_level", "t_cores")


def event_runs(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row for each run: ``file_path, first_line, last_line, n_events, level, component, first_ms, duration_ms``.

    A run of one entry has ``n_events`` 1.  A missing year is that of the file's ``modified_time`` in ``files``, as for
    entries; without ``files``, where no times are wanted, it is 1970.
    """
    ends = lines.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.max("line_number").alias("_m"))
    long_files = cut(lines.sparkSession, ends.where(F.col("_m") >= BLOCK).select("file_path"), "runs-long")
    years = None if files is None else block_years(lines, files)
    e = _block_entries(_keyed(lines), years)
    w = Window.partitionBy(*_FB).orderBy("first_line")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if long_files.isEmpty():
        before, after, seq0 = F.lit(None), F.lit(None), F.lit(0)
    else:
        info = _small(cut(lines.sparkSession, _crossings(lines, long_files, years), "runs-blocks"))
        e = _with_tail(e.join(info, [*_FB], "left"), w)
        before, after, seq0 = F.col("before"), F.col("after"), F.coalesce(F.col("seq0"), F.lit(0))
    e = e.withColumn("key", _key(e))
    e = e.withColumn("rn", seq0 + F.row_number().over(w)).withColumn("_z", F.coalesce(F.lag(F.struct("key", "last_line", "ts")).over(w), before))
    e = e.withColumn("_end", F.struct((F.max("rn").over(whole) + 1).alias("seq"), F.last("last_line").over(whole).alias("last_line"), F.last("ts").over(whole).alias("ts")))
    s = e.where(F.col("_z").isNull() | ~F.col("_z.key").eqNullSafe(F.col("key")))
    s = s.withColumn("_s", F.struct(F.col("rn").alias("seq"), F.col("_z.last_line").alias("last_line"), F.col("_z.ts").alias("ts")))
    s = s.withColumn("_x", F.coalesce(F.lead("_s").over(w), after, F.col("_end")))
    return s.select("file_path", "first_line", F.col("_x.last_line").alias("last_line"), (F.col("_x.seq") - F.col("rn")).alias("n_events"), "level", "component", F.col("ts").alias("first_ms"), (F.col("_x.ts") - F.col("ts")).alias("duration_ms"))

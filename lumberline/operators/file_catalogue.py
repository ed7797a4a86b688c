"""The catalogue of files and archives: statistics, look-ups, inserts, upserts, integrity and the tree."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumberline.operators.compaction import replace_path


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an aggregate with map-side combine, no window."""
    rest = F.struct(*order, *[F.col(c) for c in df.columns if c not in keys])
    d = df.groupBy(*keys).agg(F.max(rest).alias("_r"))
    return d.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, key: str, path: str = "virtual_path") -> DataFrame:
    """The rows to append: of ``new``, one for each key that ``old`` hasn't (the smallest path of equal ones).

    Keys and paths alone are aggregated; wide columns such as a content cross no sort.
    """
    first = new.groupBy(key).agg(F.min(path).alias(path)).join(old.select(key).distinct(), key, "left_anti")
    return new.join(first, [key, path], "left_semi").dropDuplicates([key])


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``old`` with the last row of each key of ``new`` in place of its own."""
    return upsert(old, latest(new, keys, order), keys)


def delete_rows(spark: SparkSession, path: str, gone: Column) -> None:
    """Rewrite a stored table without the rows ``gone`` holds for; it stays as it was if that fails."""
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    spark.read.parquet(path).where(~F.coalesce(gone, F.lit(False))).write.parquet(stage)
    replace_path(spark, stage, path)


def refreshed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``virtual_path, state`` of each path of ``new`` against ``old``: new, changed (another digest) or unchanged."""
    of = lambda d: d.groupBy("virtual_path").agg(F.max("sha256_hash").alias("h"))
    d = of(new).join(of(old).withColumnRenamed("h", "_h").withColumn("_old", F.lit(True)), "virtual_path", "left")
    return d.select("virtual_path", F.when(F.col("_old").isNull(), "new").when(F.col("h").eqNullSafe(F.col("_h")), "unchanged").otherwise("changed").alias("state"))


def file_statistics(lines: DataFrame) -> DataFrame:
    """``virtual_path, min_timestamp, max_timestamp, level_mask`` of parsed lines: exact, from all of them."""
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    return lines.groupBy("virtual_path").agg(F.min(ts).alias("min_timestamp"), F.max(ts).alias("max_timestamp"), F.bit_or("level_mask").alias("level_mask"))


def with_statistics(files: DataFrame, stats: DataFrame) -> DataFrame:
    """Files with their lines' statistics, READY where there are some."""
    d = files.drop("min_timestamp", "max_timestamp", "level_mask").join(stats, "virtual_path", "left")
    return d.withColumn("analysis_status", F.when(F.col("level_mask").isNotNull(), "READY").otherwise(F.col("analysis_status")))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_size"), F.coalesce(F.max("depth_level"), F.lit(0)).cast("bigint").alias("max_depth"))


def time_range(lines: DataFrame) -> DataFrame:
    """First and last time and the number of lines; lines without a time don't count for the range."""
    ts = F.when(F.col("timestamp") != 0, F.col("timestamp"))
    return lines.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count("*").alias("n_lines"))


def tokens_of_path(path: Column) -> Column:
    """Words of a path or name, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(path), "[^\\p{L}\\p{N}]+"), lambda t: t != ""))


def find_files(files: DataFrame, words: str) -> DataFrame:
    """Files whose path or name has all the words, in the order of paths."""
    have = tokens_of_path(F.concat_ws(" ", "virtual_path", "original_name"))
    d = files
    for w in words.lower().split():
        d = d.where(F.array_contains(have, w))
    return d.orderBy("virtual_path")


def integrity(files: DataFrame, objects: DataFrame) -> DataFrame:
    """``status`` of each file against the objects ``sha256_hash, content``: valid, missing or corrupt."""
    o = objects.select("sha256_hash", (F.sha2("content", 256) == F.col("sha256_hash")).alias("_ok"))
    d = files.join(o, "sha256_hash", "left")
    return d.withColumn("status", F.when(F.col("_ok").isNull(), "missing").when(F.col("_ok"), "valid").otherwise("corrupt")).drop("_ok")


def tree_rows(archives: DataFrame, files: DataFrame) -> DataFrame:
    """The virtual tree as rows ``node_kind, node_id, parent_id, name, path``: assembled by whoever shows a part of it."""
    a = archives.groupBy("id").agg(F.max("parent_archive_id").alias("parent_id"), F.max("original_name").alias("name"), F.max("virtual_path").alias("path"))
    f = files.groupBy("id").agg(F.max("parent_archive_id").alias("parent_id"), F.max("original_name").alias("name"), F.max("virtual_path").alias("path"))
    of = lambda d, k: d.select(F.lit(k).alias("node_kind"), F.col("id").alias("node_id"), "parent_id", "name", "path")
    return of(a, "archive").unionByName(of(f, "file"))


def tree_children(rows: DataFrame, parent: int | None, offset: int = 0, limit: int = 1000) -> DataFrame:
    """One page of the children of a node of ``tree_rows``, archives first, then by name: what a view of the tree opens."""
    d = rows.where(F.col("parent_id").eqNullSafe(F.lit(parent)))
    return d.orderBy("node_kind", "name", "node_id").offset(offset).limit(limit)


def tree_levels(rows: DataFrame) -> DataFrame:
    """``node_kind, node_id, child_count, child_names`` of each archive: its children in their order, as a tree has them."""
    kids = rows.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("node_kind", "name", "node_id"))).alias("c"))
    d = rows.where(F.col("node_kind") == "archive").join(kids.withColumnRenamed("parent_id", "node_id"), "node_id", "left")
    return d.select("node_kind", "node_id", F.coalesce("n", F.lit(0)).alias("child_count"), F.transform(F.coalesce("c", F.array()), lambda x: x["name"]).alias("child_names"))


def last_versions(events: DataFrame, task: str, version: str) -> DataFrame:
    """Updates of a task that are newer than all before them: equal and older versions are skipped."""
    w = Window.partitionBy(task).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_m", F.max(version).over(w)).where(F.col("_m").isNull() | (F.col(version) > F.col("_m"))).drop("_m")

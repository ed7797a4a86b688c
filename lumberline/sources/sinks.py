"""Sinks: result sessions, CSV and JSON exports, content-addressed objects."""

from __future__ import annotations

import json
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.operators.search import numbered, page
from lumberline.session import cut, delete_path, drop_cut, scratch_path, stored_bytes

#: Bytes of stored rows for each file of a JSON export.
EXPORT_BYTES = 128 << 20
CSV_COLUMNS = ("id", "timestamp", "level", "file", "line", "content")
#: The byte-order mark and header of a CSV export.
CSV_HEAD = "\ufeffID,Timestamp,Level,File,Line,Content"


class ResultSessions:
    """Stored results by search id; the oldest go when there are more than ``capacity``."""

    def __init__(self, spark: SparkSession, capacity: int = 50) -> None:
        self.spark, self.capacity, self.paths = spark, capacity, OrderedDict()

    def store(self, search_id: str, results: DataFrame, most: int | None = None) -> bool:
        """Keep the results, the first ``most`` if asked; whether there were more."""
        at = scratch_path(self.spark, f"results-{search_id}")
        d = numbered(results, "file", "line")
        (d if most is None else d.where(F.col("id") < most)).write.parquet(at)
        self.drop(search_id)
        self.paths[search_id] = at
        while len(self.paths) > self.capacity:
            self.drop(next(iter(self.paths)))
        return most is not None and not d.where(F.col("id") >= most).isEmpty()

    def results(self, search_id: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[search_id])

    def page(self, search_id: str, offset: int, limit: int) -> tuple[DataFrame, dict]:
        return page(self.results(search_id), offset, limit)

    def drop(self, search_id: str) -> None:
        if (at := self.paths.pop(search_id, None)) is not None:
            delete_path(self.spark, at)


def csv_line(results: DataFrame) -> Column:
    """A result as a line of CSV: file and content in quotes, their quotes doubled."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[q(c) if c in ("file", "content") else F.col(c).cast("string") for c in CSV_COLUMNS])


def _rename_parts(spark: SparkSession, path: str, suffix: str) -> None:
    """Give the files of a written text the suffix of what they hold."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(at, name.removesuffix(".txt") + suffix))


def _write_document(results: DataFrame, value: Column, head: str, end: str | None, path: str, suffix: str) -> None:
    """Rows of text as one document, whose parts are the files of ``path`` in the order of their names.

    ``value`` may ask by ``_first`` whether a row is the first.  Rows keep their order; none goes through the driver.
    """
    spark = results.sparkSession
    d = cut(spark, results.withColumn("_m", F.monotonically_increasing_id()), "export")
    first = d.agg(F.min("_m")).first()[0]
    edges = spark.createDataFrame([(-1, head), *([] if end is None else [((1 << 63) - 1, end)])], "_m bigint, value string")
    every = d.withColumn("_first", F.col("_m") == F.lit(first or 0)).select("_m", value.alias("value")).unionByName(edges)
    parts = max(1, -(-stored_bytes(spark, d._lumberline_path) // EXPORT_BYTES))
    every.repartitionByRange(parts, "_m").sortWithinPartitions("_m").select("value").write.mode("overwrite").text(path)
    _rename_parts(spark, path, suffix)
    drop_cut(d)


def write_csv(results: DataFrame, path: str) -> None:
    """One CSV document: a byte-order mark and the header, then the rows."""
    _write_document(results, csv_line(results), CSV_HEAD, None, path, ".csv")


def json_rows(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))


def write_json(results: DataFrame, path: str, export_time: str) -> dict:
    """One JSON document, ``{"metadata": {"exportTime", "totalCount"}, "results": [...]}``."""
    row = F.concat(F.when(F.col("_first"), F.lit("")).otherwise(F.lit(",")), F.to_json(F.struct(*results.columns)))
    meta = {"exportTime": export_time, "totalCount": results.count()}
    _write_document(results, row, f'{{"metadata": {json.dumps(meta, ensure_ascii=False)}, "results": [', "]}", path, ".json")
    return meta


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """``pos, value``: the lines of an exported document in their order."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    return numbered(rows, "file", "line").select(F.col("id").alias("pos"), "value")


def object_path(digest: Column) -> Column:
    return F.concat_ws("/", F.lit("objects"), F.substring(digest, 1, 2), F.substring(digest, 3, 62))


def new_objects(contents: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``sha256_hash, object, content`` of contents that aren't stored yet, each once."""
    d = contents.select(F.sha2("content", 256).alias("sha256_hash"), "content").dropDuplicates(["sha256_hash"])
    d = d.withColumn("object", object_path(F.col("sha256_hash")))
    return d if stored is None else d.join(stored.select("sha256_hash"), "sha256_hash", "left_anti")


def read_objects(names: DataFrame, objects: DataFrame) -> DataFrame:
    """``names`` (with ``sha256_hash``) with the ``content`` of the objects they name."""
    return names.join(objects.select("sha256_hash", "content"), "sha256_hash")

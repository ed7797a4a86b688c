"""Many small files to few of good size, without losing or doubling a row.

Contents are laid end to end in the order of their file ids; prefix sums of ``files.size`` in range partitions say where
each begins, and what begins within one stretch of ``TARGET_BYTES`` is one container.  The rows then go through an
adaptive REBALANCE: one shuffle, after which the measured sizes of the map outputs decide how partitions are merged or
split, so each written file comes near the target whatever the skew and however many cores there are.  Where the format
packs rows much tighter than the shuffle did, the staged files are merged once more, without a shuffle.  A multiset
checksum (count, sum and exclusive or of row hashes), observed on the way in, is compared with the staged rows; only
then the old data is moved aside, the stage renamed to its place, and the old data deleted.  A job that fails at any
step leaves the old data in its place.

Defined cases: an empty table becomes one with a schema and no rows; repeated rows are kept as they are (contents of
the catalogue are made distinct before, by ``contents``); nulls are values like others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lumberline.session import cut, delete_path, scratch_path, shared_dir, stored_bytes

#: Bytes of a small file, exclusive.
SMALL = 65_536
#: Bytes a consolidated file should have.
TARGET_BYTES = 128 << 20


def row_hash(df: DataFrame) -> Column:
    """Hash of a whole row; every column as text with its nullness, so any type counts."""
    parts = [F.to_json(F.struct(F.col(f"`{c}`"))) if k.startswith(("map", "variant")) else F.col(f"`{c}`") for c, k in df.dtypes]
    return F.xxhash64(*parts, *[F.col(f"`{c}`").isNull() for c in df.columns])


def checksums(df: DataFrame) -> list[Column]:
    h = row_hash(df)
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"), F.coalesce(F.bit_xor(h), F.lit(0).cast("bigint")).alias("xor")]


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for the time of one write."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _sizing(target_bytes: int) -> dict[str, str]:
    """Partitions near the target, even if that leaves cores without one."""
    a = "spark.sql.adaptive."
    return {f"{a}enabled": "true", f"{a}advisoryPartitionSizeInBytes": str(target_bytes), f"{a}coalescePartitions.enabled": "true", f"{a}coalescePartitions.parallelismFirst": "false", f"{a}optimizeSkewsInRebalancePartitions.enabled": "true"}


def replace_path(spark: SparkSession, stage: str, path: str) -> None:
    """Put ``stage`` in the place of ``path``; the old data is back in its place if that fails."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    src, dst, aside = (jvm.org.apache.hadoop.fs.Path(x) for x in (stage, path, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"))
    fs = dst.getFileSystem(conf)
    had = fs.exists(dst)
    if had and not fs.rename(dst, aside):
        raise OSError(f"{path} could not be moved aside")
    done = False
    try:
        done = fs.rename(src, dst)
        if not done:
            raise OSError(f"{stage} could not be renamed to {path}")
    finally:
        if had and not done:
            fs.rename(aside, dst)
    if had:
        fs.delete(aside, True)


def compact(df: DataFrame, path: str, target_bytes: int = TARGET_BYTES, fmt: str = "parquet", by: tuple[str, ...] = ()) -> dict[str, int]:
    """Write ``df`` to ``path`` as few files of about ``target_bytes``, rows alike in ``by`` together; returns the checksum's parts.

    Raises ``ValueError``, and leaves ``path`` alone, if the staged rows aren't the rows that went in.
    """
    spark, seen, sums = df.sparkSession, Observation(), checksums(df)
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    try:
        with _settings(spark, **_sizing(target_bytes)):
            df.observe(seen, *sums).hint("rebalance", *by).write.mode("error").format(fmt).save(stage)
        staged, fit = spark.read.schema(df.schema).format(fmt).load(stage), -(-stored_bytes(spark, stage) // target_bytes)
        if len(staged.inputFiles()) > 2 * max(1, fit):
            staged.coalesce(max(1, fit)).write.mode("error").format(fmt).save(f"{stage}-merged")
            delete_path(spark, stage)
            stage = f"{stage}-merged"
            staged = spark.read.schema(df.schema).format(fmt).load(stage)
        got, want = staged.agg(*checksums(staged)).first().asDict(), seen.get
        if got != want:  # tasks that ran twice, as after the loss of an executor, are observed twice
            want = df.agg(*sums).first().asDict()
        if got != want:
            raise ValueError(f"staged rows differ from those read: {got} for {want}")
        replace_path(spark, stage, path)
    except BaseException:
        delete_path(spark, stage)
        raise
    return want


def digest(column: Column) -> Column:
    """A SHA-256 digest in one form: 64 lower-case hex digits; null if there is none."""
    d = F.regexp_replace(F.lower(column), "^[^0-9a-z]*(?:sha-?_?256)?[^0-9a-z]*(?:0x)?|[^0-9a-z]", "")
    return F.when(d != "", d)


def contents(files: DataFrame) -> DataFrame:
    """``digest, file_id, size, n_files``: each distinct content that is to be merged, with its smallest file id."""
    d = files.where(F.col("id").isNotNull()).select("id", digest(F.col("sha256_hash")).alias("digest"), "size")
    d = d.where(F.col("digest").isNotNull())
    size = F.max(F.when(F.col("size").between(1, SMALL - 1), F.col("size")))
    return d.groupBy("digest").agg(F.min("id").alias("file_id"), size.alias("size"), F.count_distinct("id").alias("n_files")).where(F.col("size").isNotNull())


def in_containers(items: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Items ``file_id, size`` with ``container`` and ``begin``: where each lies if they are laid end to end by id."""
    d = cut(items.sparkSession, items.repartitionByRange("file_id").withColumn("_p", F.spark_partition_id()), "containers")
    base = d.groupBy("_p").agg(F.sum("size").alias("_s")).select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_b"))
    d = d.withColumn("_in", F.sum("size").over(Window.partitionBy("_p").orderBy("file_id")) - F.col("size"))
    d = d.join(base, "_p").withColumn("at", F.col("_b") + F.col("_in"))
    return d.withColumn("container", F.floor(F.col("at") / target_bytes)).withColumn("begin", F.col("at") - F.col("container") * target_bytes).drop("_p", "_b", "_in", "at")


def consolidate(files: DataFrame, path: str | None = None, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The contents to be merged, each once, out of the consolidated files: ``digest, file_id, size, n_files, container,
    begin``."""
    spark: SparkSession = files.sparkSession
    shared_dir(spark)
    at = path or scratch_path(spark, "consolidated")
    compact(in_containers(contents(files), target_bytes), at, target_bytes, by=("container",))
    return spark.read.parquet(at)


def containers(consolidated: DataFrame) -> DataFrame:
    """``container, n_contents, bytes`` of the consolidated contents."""
    return consolidated.groupBy("container").agg(F.count("*").alias("n_contents"), F.sum("size").cast("bigint").alias("bytes"))


def trace(files: DataFrame, consolidated: DataFrame) -> DataFrame:
    """``file_id, virtual_path, digest, container, begin, content_id``: where the content of every path of a merged content is."""
    f = files.where(F.col("id").isNotNull()).select(F.col("id").alias("file_id"), "virtual_path", digest(F.col("sha256_hash")).alias("digest")).distinct()
    c = consolidated.select("digest", "container", "begin", F.col("file_id").alias("content_id"))
    return f.join(c, "digest")


def compact_directory(spark: SparkSession, source: str, path: str, target_bytes: int = TARGET_BYTES, glob: str = "*") -> DataFrame:
    """Files of a directory, however many and small, into consolidated files of ``path, modified, digest, content``."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(source)
    d = d.select(F.col("path"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"), "content")
    compact(d, path, target_bytes)
    return spark.read.parquet(path)

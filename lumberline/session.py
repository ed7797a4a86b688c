"""Session helpers: the shared folder, written tables that cut lineage, and a local session for tests."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join below this many bytes (by the optimizer's or a counted size) may be broadcast.
BROADCAST_BYTES = 8 << 20


def local_session(cpus: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Folders made here because the session names none, by application; tests and single machines only.
_own: dict[str, str] = {}
#: Folders of written tables that this process made, by application.
_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session on one machine gets a folder of its own; a cluster raises ``ValueError``, as no folder
    of the driver's machine would do there.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="lumberline-")
        at = _own[sc.applicationId]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's written tables, within the shared one; it goes when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/lumberline-{uuid.uuid4().hex}"
        atexit.register(clear_run, spark)
    return _runs[app]


def clear_run(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` has written for this application: once nothing made of them is read any more."""
    if spark.sparkContext._jsc is not None and (at := _runs.pop(spark.sparkContext.applicationId, None)):
        delete_path(spark, at)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    at = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._lumberline_path = at
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written and that nothing reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df._lumberline_path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read in far fewer partitions than there are (a small table in one file).

    Inputs with about as many splits as cores, as any large one has, are left as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() < cores else df


def cut_counting(spark: SparkSession, df: DataFrame, name: str, what: Column) -> tuple[DataFrame, int]:
    """``cut``, and how many of the rows ``what`` holds for, counted on the way."""
    seen = Observation()
    out = cut(spark, df.observe(seen, F.count(F.when(what, 1)).alias("n")), name)
    return out, seen.get["n"]


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

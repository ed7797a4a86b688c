"""A workspace: imported files, their objects, catalogue and lines in one folder, and all that is asked of them.

Tables under the folder: ``objects`` (sha256_hash, content), ``files`` (the catalogue, a row for each content),
``paths`` (every path of every content, so a second copy is found under its own name), ``lines`` (parsed, with the path
they come from) and ``imports``.  What an import or a batch of a watch writes lies in folders named by its id; a row in
``imports``, written last, makes all of it appear at once.  A failed import leaves nothing that is seen, the same import
or batch again takes the place of its own rows, and importing what is there changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumberline.functions import logfields as lf
from lumberline.operators import file_catalogue as fc
from lumberline.operators import search as se
from lumberline.operators.line_filters import SearchFilters, import_allowed, is_binary, prune_files
from lumberline.plans.search_query import SearchQuery, resolve
from lumberline.session import cut, delete_path
from lumberline.sources import archives, sinks
from lumberline.streaming import tail

FILES = "id bigint, sha256_hash string, virtual_path string, original_name string, size bigint, mime_type string, depth_level int, min_timestamp bigint, max_timestamp bigint, level_mask int, analysis_status string"
LINES = "virtual_path string, sha256_hash string, real_path string, line bigint, content string"
OBJECTS = "sha256_hash string, content binary"
PATHS = "virtual_path string, sha256_hash string, size bigint"
IMPORTS = "import_id string, source string"
#: Bytes of source files that one step of an import commits together.
STEP_BYTES = 64 << 30


def file_id(path, digest):
    """One id space for imported and watched files: from path and content alone, so a repeated write has the same."""
    return F.xxhash64(path, digest).bitwiseAND((1 << 63) - 1)


class Workspace:
    """All operations of one workspace; ``path`` is a folder every executor sees."""

    def __init__(self, spark: SparkSession, path: str, workspace_id: str | None = None, filter_imports: bool = False) -> None:
        self.spark, self.path, self.filter_imports = spark, path.rstrip("/"), filter_imports
        self.workspace_id = workspace_id or f"ws-{uuid.uuid4().hex[:8]}"
        self.sessions, self.watches, self.truncated = sinks.ResultSessions(spark), {}, {}

    # -- tables

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    @property
    def imports(self) -> DataFrame:
        return self.spark.read.schema(IMPORTS).parquet(f"{self.path}/imports/*") if self._exists("imports") else self.spark.createDataFrame([], IMPORTS)

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        d = self.spark.read.schema(f"{schema}, import_id string").parquet(f"{self.path}/{name}")
        return d.join(self.imports.select("import_id"), "import_id", "left_semi").drop("import_id")

    @property
    def files(self) -> DataFrame:
        return self._table("files", FILES)

    @property
    def lines(self) -> DataFrame:
        return self._table("lines", LINES)

    @property
    def objects(self) -> DataFrame:
        return self._table("objects", OBJECTS)

    @property
    def paths(self) -> DataFrame:
        return self._table("paths", PATHS)

    def _put(self, name: str, df: DataFrame, import_id: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/import_id={import_id}")

    def _commit(self, import_id: str, sources: DataFrame | None = None) -> None:
        d = self.spark.createDataFrame([(import_id, None)], IMPORTS) if sources is None else sources.select(F.lit(import_id).alias("import_id"), "source")
        d.write.mode("overwrite").parquet(f"{self.path}/imports/{import_id}")

    # -- import

    def import_path(self, source: str, limits: archives.Limits = archives.Limits(), step_bytes: int = STEP_BYTES) -> DataFrame:
        """Add every file under ``source``, archives expanded; returns the entries with a problem.

        Source files go in steps of ``step_bytes``, each committed by itself; an import that was broken off goes on with
        the files that no step has committed.
        """
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
        stat = raw.select("path", "length", F.concat_ws("|", "path", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")).alias("source"))
        todo = cut(self.spark, stat.join(self.imports.select("source"), "source", "left_anti").repartitionByRange("path").withColumn("_p", F.spark_partition_id()), "import-todo")
        base = todo.groupBy("_p").agg(F.sum("length").alias("_s")).select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_b"))
        at = F.col("_b") + F.sum("length").over(Window.partitionBy("_p").orderBy("path")) - F.col("length")
        todo = cut(self.spark, todo.join(base, "_p").select("path", "source", F.floor(at / step_bytes).alias("step")), "import-steps")
        found = []
        for step in sorted(r.step for r in todo.select("step").distinct().toLocalIterator()):
            mine = todo.where(F.col("step") == step)
            found.append(self._import(raw.join(mine, "path", "left_semi"), mine, limits))
        none = self.spark.createDataFrame([], "virtual_path string, depth int, problem string")
        for d in found:
            none = none.unionByName(d)
        return none

    def _import(self, raw: DataFrame, sources: DataFrame, limits: archives.Limits) -> DataFrame:
        import_id = uuid.uuid4().hex
        entries = cut(self.spark, archives.expand_archives(raw, limits), "import")
        good = entries.where(F.col("content").isNotNull() & F.col("problem").isNull())
        if self.filter_imports:
            good = good.where(import_allowed(F.col("virtual_path")) & ~is_binary(F.col("content")))
        new = good.select("sha256_hash", "virtual_path", "size", F.col("depth").alias("depth_level"), "content")
        self._put("paths", new.select("virtual_path", "sha256_hash", "size").distinct().join(self.paths.select("virtual_path", "sha256_hash"), ["virtual_path", "sha256_hash"], "left_anti"), import_id)
        new = cut(self.spark, fc.insert_new(self.files, new, "sha256_hash"), "import-new")
        self._put("objects", new.select("sha256_hash", "content").join(self.objects.select("sha256_hash"), "sha256_hash", "left_anti"), import_id)
        text = lf.decode_column(new.select("virtual_path", "sha256_hash", "content"), "content", "x").select("virtual_path", "sha256_hash", F.col("x.text").alias("text")).where(F.col("text") != "")
        lines = se.lines_of(text, F.col("virtual_path"), F.col("text"), F.col("sha256_hash"))
        lines = lines.select("virtual_path", "sha256_hash", lf.real_path(F.col("sha256_hash")).alias("real_path"), "line", "content")
        self._put("lines", lines, import_id)
        stored = self.spark.read.schema(LINES).parquet(f"{self.path}/lines/import_id={import_id}")
        rows = new.drop("content").withColumn("id", file_id("virtual_path", "sha256_hash"))
        rows = rows.withColumn("original_name", F.element_at(F.split("virtual_path", "/"), -1)).withColumn("mime_type", lf.mime_type(F.col("virtual_path")))
        rows = rows.withColumns({c: F.lit(None) for c in ("min_timestamp", "max_timestamp", "level_mask")}).withColumn("analysis_status", F.lit("READY"))
        self._put("files", self.spark.createDataFrame([], FILES).unionByName(fc.with_statistics(rows, fc.file_statistics(lf.with_fields(stored)))), import_id)
        self._commit(import_id, sources)
        return entries.where(F.col("problem").isNotNull()).select("virtual_path", "depth", "problem")

    refresh = import_path

    def delete(self) -> None:
        for name in ("imports", "objects", "files", "paths", "lines"):
            delete_path(self.spark, f"{self.path}/{name}")

    # -- search

    def search(self, query: str | SearchQuery, filters: SearchFilters | None = None, max_results: int | None = se.DEFAULT_RESULTS) -> str:
        """Run a search, store its results, and return their id.  Files that can't match aren't read any further.

        ``truncated[id]`` says whether there are more than ``max_results`` (None: all are stored).
        """
        f = filters or SearchFilters()
        q = resolve(query) if isinstance(query, str) else resolve(None, query)
        keep = prune_files(self.files, f).select("virtual_path")
        found = se.search(self.lines.join(keep, "virtual_path", "left_semi"), q, f, None if max_results is None else max_results + 1)
        search_id = q.id or uuid.uuid4().hex
        sc = self.spark.sparkContext
        sc.addJobTag(search_id)
        try:
            self.truncated[search_id] = self.sessions.store(search_id, found, max_results)
        finally:
            sc.removeJobTag(search_id)
        return search_id

    def cancel(self, search_id: str) -> None:
        self.spark.sparkContext.cancelJobsWithTag(search_id)

    def page(self, search_id: str, offset: int = 0, limit: int = 1000) -> tuple[DataFrame, dict]:
        return self.sessions.page(search_id, offset, limit)

    def statistics(self, search_id: str) -> DataFrame:
        return se.keyword_statistics(self.sessions.results(search_id))

    def export(self, search_id: str, path: str, fmt: str = "csv", export_time: str = "") -> None:
        r = self.sessions.results(search_id)
        if fmt == "csv":
            sinks.write_csv(r, path)
        elif fmt == "json":
            sinks.write_json(r, path, export_time)
        else:
            raise ValueError(f"no such format: {fmt}")

    # -- catalogue

    def status(self) -> dict:
        n, size = self.files.agg(F.count("*"), lf.human_size(F.coalesce(F.sum("size"), F.lit(0)))).first()
        return {"id": self.workspace_id, "files": n, "size": size}

    def time_range(self) -> dict:
        a, b, n = self.files.agg(lf.iso(F.min("min_timestamp")), lf.iso(F.max("max_timestamp")), F.count("*")).first()
        return {"min": a, "max": b, "files": n}

    def read_by_hash(self, digest: str) -> bytes | None:
        row = self.objects.where(F.col("sha256_hash") == digest).select("content").first()
        return bytes(row[0]) if row else None

    def find_files(self, words: str) -> DataFrame:
        """Every path that has all the words, those of further copies of a content, too."""
        return fc.find_files(self.paths.withColumn("original_name", F.element_at(F.split("virtual_path", "/"), -1)), words)

    def integrity(self) -> DataFrame:
        return fc.integrity(self.files, self.objects).groupBy("status").agg(F.count("*").alias("n"))

    # -- watching

    def start_watch(self, directory: str, **trigger) -> str:
        """Follow the files of a directory; their new lines become part of ``lines``."""
        watch_id = uuid.uuid4().hex
        d = tail.tail(self.spark, directory).select("virtual_path", F.lit(None).cast("string").alias("sha256_hash"), F.lit(None).cast("string").alias("real_path"), "line", "content")

        def append(batch: DataFrame, number: int) -> None:
            import_id = f"watch-{watch_id}-{number}"
            self._put("lines", batch, import_id)
            seen = self.spark.read.schema(LINES).parquet(f"{self.path}/lines/import_id={import_id}").select("virtual_path").distinct().join(self.files.select("virtual_path"), "virtual_path", "left_anti")
            name = F.element_at(F.split("virtual_path", "/"), -1)
            new = seen.select(file_id("virtual_path", F.lit(None).cast("string")).alias("id"), "virtual_path", name.alias("original_name"), F.lit("READY").alias("analysis_status"))
            self._put("files", self.spark.createDataFrame([], FILES).unionByName(new, allowMissingColumns=True), import_id)
            self._put("paths", self.spark.createDataFrame([], PATHS).unionByName(new.select("virtual_path"), allowMissingColumns=True), import_id)
            self._commit(import_id)

        self.watches[watch_id] = d.writeStream.foreachBatch(append).option("checkpointLocation", f"{self.path}/watch-{watch_id}").trigger(**(trigger or {"processingTime": "5 seconds"})).start()
        return watch_id

    def stop_watch(self, watch_id: str) -> None:
        self.watches.pop(watch_id).stop()

"""Queries of the core problems (pN_...) over a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.operators import compaction, hierarchy
from lumberline.operators.log_entries import entry_messages, log_entries
from lumberline.session import cut, scratch_path, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "archives"), table(spark, sf_dir, "files"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and files whose chain of parents or depth is wrong."""
    return hierarchy.findings(hierarchy.hierarchy(table(spark, sf_dir, "archives"), table(spark, sf_dir, "files"), paths=False))


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archive and file with its path, true depth, root, range and number of descendants."""
    return _nodes(spark, sf_dir).drop("ring_at", "top_rgt")


def p1_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, depth, root and number of descendants of each archive."""
    n = _nodes(spark, sf_dir).where(F.col("node_kind") == "archive")
    return n.where(F.col("state") == "tree").select("node_id", F.col("depth").cast("bigint").alias("depth"), "root_id", F.col("n_descendants").cast("bigint").alias("n_descendants"), "path")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All archives and files below each archive, with their distance, on and below cycles, too."""
    return hierarchy.all_descendants(cut(spark, _nodes(spark, sf_dir), "nodes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct content to be merged, out of the consolidated files."""
    return compaction.consolidate(table(spark, sf_dir, "files")).select("file_id")


def p3_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content each path of a merged content leads to."""
    files = table(spark, sf_dir, "files")
    return compaction.trace(files, compaction.consolidate(files)).drop("container", "begin")


def p3_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many contents and bytes each container holds."""
    return compaction.containers(compaction.consolidate(table(spark, sf_dir, "files")))


def p3_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as small files of about 64 KB, out of the few files these were consolidated to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    small = scratch_path(spark, "small-files")
    docs.select(F.to_json(F.struct("doc_id", "text")).alias("value")).repartition(1 + n_bytes // compaction.SMALL).write.text(small)
    few = compaction.compact_directory(spark, small, scratch_path(spark, "few-files"), glob="*.txt")
    line = few.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("value")).where(F.col("value") != "")
    return line.select(F.from_json("value", "doc_id bigint, text string").alias("x")).select("x.doc_id", F.sha2("x.text", 256).alias("digest"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log entry with its lines, time, level and component."""
    log = table(spark, sf_dir, "log_index").select("file_path", "line_number", "content")
    return log_entries(spread(log), table(spark, sf_dir, "files"), message=False)


def p4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log entry with its whole message."""
    log = table(spark, sf_dir, "log_index").select("file_path", "line_number", "content")
    return entry_messages(spread(log), table(spark, sf_dir, "files"))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_depths, p1_descendants, p3_found, p3_trace, p3_containers, p3_directory, p4_found, p4_messages)}

_ARCHIVES = "a AS (SELECT id, max(parent_archive_id) AS parent, max(depth_level) AS depth_level, max(original_name) AS name FROM archives WHERE id IS NOT NULL GROUP BY id)"
_REACH = f"{_ARCHIVES}, reach(id, up) AS (SELECT id, parent FROM a WHERE parent IS NOT NULL UNION SELECT r.id, a.parent FROM reach r JOIN a ON a.id = r.up WHERE a.parent IS NOT NULL)"
_FILES = "f AS (SELECT id, max(parent_archive_id) AS parent, max(depth_level) AS depth_level FROM files WHERE id IS NOT NULL GROUP BY id)"
_STATE = """ring AS (SELECT id FROM reach WHERE id = up),
state AS (
  SELECT a.id, a.depth_level,
    CASE WHEN a.id IN (SELECT id FROM ring) THEN 'cycle' WHEN EXISTS (SELECT 1 FROM reach r WHERE r.id = a.id AND r.up IN (SELECT id FROM ring)) THEN 'under_cycle'
         WHEN EXISTS (SELECT 1 FROM reach r WHERE r.id = a.id AND r.up NOT IN (SELECT id FROM a)) THEN 'orphan' ELSE 'tree' END AS state,
    (SELECT count(*) FROM reach r WHERE r.id = a.id) AS depth,
    (SELECT min(r.up) FROM reach r WHERE r.id = a.id AND r.up IN (SELECT id FROM ring)) AS ring_root,
    (SELECT max(r.up) FROM reach r WHERE r.id = a.id AND r.up NOT IN (SELECT id FROM a)) AS lost,
    coalesce((SELECT max(r.up) FROM reach r JOIN a t ON t.id = r.up AND t.parent IS NULL WHERE r.id = a.id), a.id) AS top
  FROM a)"""
_DIGEST = "regexp_replace(regexp_replace(lower(sha256_hash), '^[^0-9a-z]*(sha-?_?256)?[^0-9a-z]*(0x)?', ''), '[^0-9a-z]', '', 'g')"
_CONTENTS = f"SELECT {_DIGEST} AS digest, min(id) AS file_id FROM files WHERE id IS NOT NULL AND sha256_hash IS NOT NULL AND {_DIGEST} <> '' GROUP BY 1 HAVING count(CASE WHEN size BETWEEN 1 AND 65535 THEN 1 END) > 0"
ORACLE = {
    "p1_found": f"""WITH RECURSIVE {_REACH}, {_FILES}, {_STATE},
every AS (
  SELECT 'archive' AS node_kind, id AS node_id, state, depth_level, depth, CASE state WHEN 'orphan' THEN lost WHEN 'tree' THEN top ELSE ring_root END AS root_id FROM state
  UNION ALL
  SELECT 'file', f.id, CASE WHEN f.parent IS NULL THEN 'tree' WHEN s.id IS NULL THEN 'orphan' WHEN s.state = 'cycle' THEN 'under_cycle' ELSE s.state END, f.depth_level,
    CASE WHEN f.parent IS NULL THEN 0 ELSE s.depth + 1 END,
    CASE WHEN f.parent IS NULL THEN NULL WHEN s.id IS NULL THEN f.parent WHEN s.state = 'orphan' THEN s.lost WHEN s.state = 'tree' THEN s.top ELSE s.ring_root END
  FROM f LEFT JOIN state s ON s.id = f.parent)
SELECT node_kind, node_id, CASE WHEN state <> 'tree' THEN state ELSE 'depth' END AS finding, root_id FROM every WHERE state <> 'tree' OR (depth_level IS NOT NULL AND depth_level <> depth)""",
    "p1_depths": f"""WITH RECURSIVE {_REACH}, {_FILES}, {_STATE},
walk(id, depth, root_id, path) AS (SELECT id, CAST(0 AS BIGINT), id, '/' || coalesce(name, '#' || id) FROM a WHERE parent IS NULL UNION ALL SELECT a.id, w.depth + 1, w.root_id, w.path || '/' || coalesce(a.name, '#' || a.id) FROM walk w JOIN a ON a.parent = w.id),
up AS (SELECT id AS node, id AS over FROM a UNION ALL SELECT id, up FROM reach),
below AS (SELECT u.over AS id, count(*) AS n FROM up u JOIN f ON f.parent = u.node GROUP BY 1),
under AS (SELECT up AS id, count(*) AS n FROM reach GROUP BY 1)
SELECT w.id AS node_id, w.depth, w.root_id, coalesce(b.n, 0) + coalesce(u.n, 0) AS n_descendants, w.path FROM walk w LEFT JOIN below b ON b.id = w.id LEFT JOIN under u ON u.id = w.id""",
    "p1_descendants": f"""WITH RECURSIVE {_ARCHIVES}, {_FILES},
pairs(kind, id, anc, distance, seen) AS (
  SELECT 'archive', id, parent, CAST(1 AS BIGINT), [id] FROM a WHERE parent IN (SELECT id FROM a) AND parent <> id
  UNION ALL SELECT 'file', f.id, f.parent, 1, CAST([] AS BIGINT[]) FROM f WHERE f.parent IN (SELECT id FROM a)
  UNION ALL SELECT p.kind, p.id, a.parent, p.distance + 1, list_append(p.seen, p.anc) FROM pairs p JOIN a ON a.id = p.anc
  WHERE a.parent IN (SELECT id FROM a) AND NOT list_contains(p.seen, a.parent) AND a.parent <> p.anc)
SELECT anc AS ancestor_id, kind AS node_kind, id AS node_id, distance FROM pairs""",
    "p1_hierarchy": f"""WITH RECURSIVE {_REACH}, {_FILES.replace("max(depth_level) AS depth_level", "max(depth_level) AS depth_level, max(original_name) AS name")}, {_STATE},
t AS (
  SELECT a.id, CASE WHEN s.state = 'cycle' OR a.parent NOT IN (SELECT id FROM a) THEN NULL ELSE a.parent END AS up, '/' || coalesce(a.name, '#' || a.id) AS name, s.state, s.ring_root, s.lost, a.depth_level,
    (SELECT count(*) FROM f WHERE f.parent = a.id) AS leaves
  FROM a JOIN state s ON s.id = a.id),
under(id, over) AS (SELECT id, id FROM t UNION ALL SELECT u.id, t.up FROM under u JOIN t ON t.id = u.over WHERE t.up IS NOT NULL),
sizes AS (SELECT u.over AS id, CAST(sum(1 + t.leaves) AS BIGINT) AS size FROM under u JOIN t ON t.id = u.id GROUP BY 1),
ranks AS (SELECT t.*, z.size, CAST(sum(z.size) OVER (PARTITION BY t.up ORDER BY t.id) AS BIGINT) - z.size AS ahead FROM t JOIN sizes z ON z.id = t.id),
walk(id, path, depth, top_id, lft) AS (
  SELECT id, name, CAST(0 AS BIGINT), id, CAST(1 AS BIGINT) FROM ranks WHERE up IS NULL
  UNION ALL SELECT r.id, w.path || r.name, w.depth + 1, w.top_id, w.lft + 1 + p.leaves + r.ahead FROM walk w JOIN ranks p ON p.id = w.id JOIN ranks r ON r.up = w.id),
rings AS (SELECT ring_root, CAST(sum(size) AS BIGINT) AS ring_size FROM ranks WHERE state = 'cycle' GROUP BY 1),
arch AS (
  SELECT w.*, r.state, r.depth_level, r.size, CASE r.state WHEN 'orphan' THEN r.lost WHEN 'tree' THEN w.top_id ELSE r.ring_root END AS root_id, CASE r.state WHEN 'cycle' THEN g.ring_size ELSE r.size END - 1 AS n_descendants
  FROM walk w JOIN ranks r ON r.id = w.id LEFT JOIN rings g ON g.ring_root = r.ring_root)
SELECT 'archive' AS node_kind, id AS node_id, path, depth_level, state, depth, root_id, top_id, lft, lft + size AS rgt, n_descendants FROM arch
UNION ALL SELECT 'file', f.id, coalesce(w.path, '') || '/' || coalesce(f.name, '#' || f.id), f.depth_level, CASE WHEN f.parent IS NULL THEN 'tree' WHEN w.id IS NULL THEN 'orphan' WHEN w.state = 'cycle' THEN 'under_cycle' ELSE w.state END,
  coalesce(w.depth + 1, 0), CASE WHEN f.parent IS NULL THEN NULL WHEN w.id IS NULL THEN f.parent ELSE w.root_id END, w.top_id,
  coalesce(w.lft + row_number() OVER (PARTITION BY f.parent ORDER BY f.id), 1), coalesce(w.lft + row_number() OVER (PARTITION BY f.parent ORDER BY f.id), 1) + 1, 0
FROM f LEFT JOIN arch w ON w.id = f.parent""",
    "p3_found": f"SELECT file_id FROM ({_CONTENTS})",
    "p3_containers": f"WITH c AS (SELECT *, sum(size) OVER (ORDER BY file_id) - size AS b FROM ({_CONTENTS.replace('AS file_id', 'AS file_id, max(CASE WHEN size BETWEEN 1 AND 65535 THEN size END) AS size')})) SELECT CAST(b // {compaction.TARGET_BYTES} AS BIGINT) AS container, count(*) AS n_contents, CAST(sum(size) AS BIGINT) AS bytes FROM c GROUP BY 1",
    "p3_directory": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "p3_trace": f"WITH c AS ({_CONTENTS}), f AS (SELECT DISTINCT id AS file_id, virtual_path, {_DIGEST} AS digest FROM files WHERE id IS NOT NULL AND sha256_hash IS NOT NULL) SELECT f.digest, f.file_id, f.virtual_path, c.file_id AS content_id FROM f JOIN c ON c.digest = f.digest",
}

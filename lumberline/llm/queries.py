"""Queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.llm.event_runs import event_runs
from lumberline.llm.mojibake import garbled
from lumberline.llm.packing import pack, packing_report
from lumberline.llm.shared_spans import shared_spans
from lumberline.llm.tokens import count_tokens, decode_part, encode
from lumberline.session import cut, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "log_index").select("file_path", "line_number", "content")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with characters that a wrong decoding produced."""
    return p2_restored(spark, sf_dir).select("record_kind", "record_id")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled records, each with its original text where that can still be had."""
    return garbled(table(spark, sf_dir, "log_index"), table(spark, sf_dir, "files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each longest run of two or more alike entries."""
    runs = event_runs(spread(_log(spark, sf_dir))).where(F.col("n_events") >= 2)
    return runs.select("file_path", "first_line", "last_line", "n_events")


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log with every run collapsed to one event: its count and duration."""
    return event_runs(spread(_log(spark, sf_dir)), table(spark, sf_dir, "files"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p6_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the middle of every document, decoded from the ids of its slices by their offsets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    d = encode(spread(docs), offsets=True).join(n, "doc_id").withColumn("begin", F.expr("n div 4")).withColumn("stop", F.expr("n - n div 4"))
    return decode_part(d).select("doc_id", F.sha2("text", 256).alias("digest"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each kind."""
    counts = cut(spark, count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), "pack-counts")
    return pack(counts, table(spark, sf_dir, "pack_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, containers, fill and spread of cost of each kind, and whether the promises hold."""
    return packing_report(p7_packed(spark, sf_dir), table(spark, sf_dir, "pack_targets"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promises of packing alone: every document once, whole, in no container beyond its capacity, little unused."""
    return p7_report(spark, sf_dir).select("target_id", "n_documents", "most", "whole", (F.col("fill") > 0.97).alias("filled"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document also occurs in another, in spans of at least 200 code points."""
    return shared_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored, "p5_found": p5_found, "p5_runs": p5_runs, "p6_ids": p6_ids, "p6_parts": p6_parts, "p7_packed": p7_packed, "p7_report": p7_report, "p7_checks": p7_checks, "p8_found": p8_found}
ORACLE: dict[str, str] = {
    "p7_checks": "SELECT target_id, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, true AS most, true AS whole, true AS filled FROM pack_targets",
    "p6_parts": "SELECT doc_id, sha256(substr(t, n // 4 + 1, n - n // 4 - n // 4)) AS digest FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)",
}

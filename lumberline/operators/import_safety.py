"""Safety of imports: compression ratios, risk, limits and suspicious archives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GIB = 1 << 30


@dataclass(frozen=True)
class Policy:
    """Limits of an import."""

    max_ratio: float = 100.0
    max_risk: float = 1e6
    max_total: int = 10 * _GIB
    max_workspace: int = 50 * _GIB
    max_depth: int = 10
    max_files: int = 10_000

    def __post_init__(self) -> None:
        if not 1 <= self.max_depth <= 20:
            raise ValueError("depth must be from 1 to 20")


def ratio(compressed: Column, uncompressed: Column) -> Column:
    """Uncompressed by compressed size; 0 of nothing, infinite of something out of nothing."""
    inf = F.lit(float("inf"))
    return F.when((compressed == 0) & (uncompressed == 0), 0.0).when(compressed == 0, inf).otherwise(F.try_divide(uncompressed.cast("double"), compressed.cast("double")))


def risk(r: Column, depth: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(F.isnan(r) | (r == inf), inf).when(r <= 0, 0.0).when(depth == 0, r).otherwise(F.pow(r, depth))


def halt_reason(r: Column, risk_score: Column, cumulative: Column, policy: Policy = Policy()) -> Column:
    return F.when(r > policy.max_ratio, "ratio").when(risk_score > policy.max_risk, "risk").when(cumulative > policy.max_total, "total")


def suspicious(entries: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``archive, overall_ratio, n_files, n_extreme, warnings`` of entries ``archive, compressed, uncompressed``."""
    d = entries.groupBy("archive").agg(
        F.sum("compressed").alias("c"), F.sum("uncompressed").alias("u"), F.count("*").alias("n_files"),
        F.count(F.when(ratio(F.col("compressed"), F.col("uncompressed")) > policy.max_ratio * 0.8, 1)).alias("n_extreme"),
    )
    d = d.withColumn("overall_ratio", ratio(F.col("c"), F.col("u")))
    warnings = (F.col("overall_ratio") > policy.max_ratio * 0.5).cast("bigint") + (F.col("n_files") > policy.max_files).cast("bigint") + F.col("n_extreme")
    return d.select("archive", F.round("overall_ratio", 6).alias("overall_ratio"), "n_files", "n_extreme", warnings.alias("warnings"))


def shortened(path: Column, limit: int = 255) -> Column:
    """A path whose last part is replaced by a digest where it is too long."""
    name = F.element_at(F.split(path, "/"), -1)
    head = F.regexp_extract(path, "^(.*/)?[^/]*$", 1)
    return F.when(F.length(name) > limit, F.concat(head, F.substring(F.sha2(name, 256), 1, 16))).otherwise(path)

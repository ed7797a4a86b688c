"""Helpers for columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that is computed a single time.

    A plain column would be inlined into each of its uses by the optimizer; a generator with one element is not.
    """
    return df.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias("_once")).withColumn(name, F.col("_once.v")).drop("_once")

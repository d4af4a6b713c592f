"""Load reports by nearest-rank percentiles, and verified reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.functions.encoding import load_key, load_value


def report(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, p50, p99 and max of a value by groups."""
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), rank(0.5).alias("p50"), rank(0.99).alias("p99"), F.max(value).alias("most"))


def verified(view: DataFrame, prefix: str, numbers: DataFrame, size: int) -> DataFrame:
    """(reads, mismatches) of a load that was written before: every number's key is read from a view and its value compared with what it must be."""
    wanted = numbers.select(load_key(prefix, F.col("number")).alias("key"), load_value(prefix, F.col("number"), size).alias("wanted"))
    wrong = F.sum(F.when(F.col("value").eqNullSafe(F.col("wanted")), 0).otherwise(1)).cast("long")
    return wanted.join(view, "key", "left").agg(F.count("*").alias("reads"), F.coalesce(wrong, F.lit(0)).alias("mismatches"))


def mismatches(reads: DataFrame, expected: DataFrame) -> DataFrame:
    """Keys whose value is not the expected one, or is missing on either side."""
    x, y = reads.select("key", F.col("value").alias("got")), expected.select("key", F.col("value").alias("wanted"))
    return x.join(y, "key", "full").where(~F.col("got").eqNullSafe(F.col("wanted")))

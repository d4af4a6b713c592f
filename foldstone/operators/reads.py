"""Reads of a folded view (key, value): single and many keys, half-open ranges, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.functions.limits import EngineError


def get(view: DataFrame, key) -> DataFrame:
    return view.where(F.col("key") == F.lit(key))


def multi_get(view: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, code) for each row of keys; Spark chooses broadcast or merge by the sizes."""
    found = view.withColumn("_there", F.lit(True))
    code = F.when(F.col("_there").isNull(), "NOT_FOUND")
    return keys.select("key").join(found, "key", "left").select("key", "value", code.alias("code"))


def scan(view: DataFrame, start, end, limit: int | None = None) -> DataFrame:
    """Pairs of start <= key < end, ascending; a bound that is not below the other is refused."""
    if start >= end:
        raise EngineError("INVALID_ARGUMENT", "scan: start must be < end")
    pairs = view.where((F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end))).orderBy("key")
    return pairs if limit is None else pairs.limit(limit)


def page(view: DataFrame, after, end, size: int) -> DataFrame:
    """The next pairs after a page's last key."""
    return view.where((F.col("key") > F.lit(after)) & (F.col("key") < F.lit(end))).orderBy("key").limit(size)


def range_join(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, bucket: Column, first: Column, last: Column) -> DataFrame:
    """Rows with start <= point < end, by equal buckets instead of all pairs.

    bucket is a monotone long of the point; first and last are the same of a range's bounds."""
    dealt = ranges.withColumn("_bucket", F.explode(F.sequence(first, last)))
    return points.withColumn("_bucket", bucket).join(dealt, "_bucket").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bucket")

"""Byte limits, stable error codes and their checks as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the data model.
MAX_KEY_BYTES = 65_536
MAX_VALUE_BYTES = 4 * 1024 * 1024
MAX_REQUEST_BYTES = 32 * 1024 * 1024
SCAN_LIMIT, SCAN_LIMIT_MOST = 1000, 10_000

#: Stable codes, and whether a caller may try again.
CODES: tuple[tuple[str, bool], ...] = (
    ("INVALID_ARGUMENT", False),
    ("NOT_FOUND", False),
    ("TIMEOUT", True),
    ("NOT_LEADER", True),
    ("STALE_ROUTE", True),
    ("CONFLICT", False),
    ("CORRUPTION", False),
    ("IO", False),
    ("CODEC", False),
    ("INTERNAL", False),
)


class EngineError(Exception):
    """An error with a stable code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.retryable = code, dict(CODES)[code]


def error_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODES), "code string, retryable boolean")


def violation(key: Column, value: Column | None = None, max_key: int = MAX_KEY_BYTES, max_value: int = MAX_VALUE_BYTES) -> Column:
    """Why a write is refused, or null: keys have 1 to max_key bytes, values at most max_value."""
    size = F.octet_length(key)
    rule = F.when(key.isNull() | (size == 0), "key must not be empty").when(size > max_key, "key is too long")
    if value is not None:
        rule = rule.when(F.octet_length(value) > max_value, "value is too long")
    return rule


def admitted(writes: DataFrame, max_key: int = MAX_KEY_BYTES, max_value: int = MAX_VALUE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The writes that keep the limits, and the refused ones with code and message; a refused write leaves no trace."""
    told = writes.withColumn("message", violation(F.col("key"), F.col("value"), max_key, max_value))
    good = told.where("message is null").drop("message")
    return good, told.where("message is not null").withColumn("code", F.lit("INVALID_ARGUMENT"))


def clamped_limit(limit: Column) -> Column:
    return F.least(F.greatest(F.coalesce(limit, F.lit(SCAN_LIMIT)), F.lit(1)), F.lit(SCAN_LIMIT_MOST))

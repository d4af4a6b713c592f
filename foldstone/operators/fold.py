"""Folds of the mutation log: the newest mutation of a key wins; deletes stay until the fold is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers in a block of the two-level scan.
BLOCK = 1 << 20


def newest(rows: DataFrame, order: str = "seq") -> DataFrame:
    """(key, order, op, value): each key's newest mutation, deletes included. Combines before the shuffle, so hot keys are cheap."""
    return rows.groupBy("key").agg(F.max(F.struct(F.col(order), "op", "value")).alias("m")).select("key", f"m.{order}", "m.op", "m.value")


def live(rows: DataFrame, order: str = "seq") -> DataFrame:
    """(key, value) of the keys that are there; the filter comes after the fold, or older versions would rise again."""
    return newest(rows, order).where("op = 'put'").select("key", "value")


def state_at(rows: DataFrame, seq: int) -> DataFrame:
    return live(rows.where(F.col("seq") <= seq))


def with_previous(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows(seq, op, key, value, ...) with prev, the newest mutation of the key before each row, or null.

    A window in blocks of sequence numbers, and one over each key's blocks for what comes into them,
    so that a key with a third of all rows is spread over many tasks."""
    mutation = F.when(F.col("op").isin("put", "delete"), F.struct("seq", "op", "value"))
    marked = rows.withColumn("_m", mutation).withColumn("_block", F.floor(F.col("seq") / block))
    inside = Window.partitionBy("key", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("key", "_block").agg(F.max("_m").alias("_last"))
    carried = carried.select("key", "_block", F.last("_last", ignorenulls=True).over(across).alias("_into"))
    seen = marked.withColumn("_own", F.last("_m", ignorenulls=True).over(inside))
    return seen.join(carried, ["key", "_block"]).withColumn("prev", F.coalesce("_own", "_into")).drop("_m", "_block", "_own", "_into")


def versions(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, op, value, since, until): how long each mutation was the newest; until is null for the last.

    A version ends where the one that has it as its previous begins."""
    told = with_previous(rows, block).select("key", "seq", F.col("prev.seq").alias("before"))
    ends = told.where("before is not null").select("key", F.col("before").alias("seq"), F.col("seq").alias("until"))
    return rows.join(ends, ["key", "seq"], "left").select("key", "op", "value", F.col("seq").alias("since"), "until")


def size_of() -> Column:
    """Bytes of a mutation: a pair counts its key and value, a delete its key and one."""
    return F.octet_length("key") + F.when(F.col("op") == "put", F.coalesce(F.octet_length("value"), F.lit(0))).otherwise(1)


def pending_bytes(rows: DataFrame) -> DataFrame:
    """(keys, bytes) of a folded tail."""
    return newest(rows).agg(F.count("*").alias("keys"), F.coalesce(F.sum(size_of()), F.lit(0)).cast("long").alias("bytes"))

"""The operation log: ops(seq, op, key, value, start, end), its adapters and its recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstone.functions.encoding import from_base64
from foldstone.functions.limits import MAX_REQUEST_BYTES

#: Users that a scan of the events adapter spans.
SPAN = 10
REQUEST = "seq long, op string, key_b64 string, value_b64 string, start_b64 string, end_b64 string, limit long"


def user_key(user: Column) -> Column:
    return F.concat(F.lit("u"), F.lpad(user.cast("string"), 8, "0"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: signup and purchase put, error deletes, view gets, click scans the next SPAN users."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "props")
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "purchase"), "put").when(kind == "error", "delete").when(kind == "view", "get").otherwise("scan")
    key = user_key(F.col("user_id"))
    ops = events.select(F.col("event_id").alias("seq"), op.alias("op"), key.alias("key"), F.col("props").alias("props"), "user_id")
    return ops.select(
        "seq", "op", F.when(F.col("op") != "scan", F.col("key")).alias("key"), F.when(F.col("op") == "put", F.col("props")).alias("value"),
        F.when(F.col("op") == "scan", F.col("key")).alias("start"), F.when(F.col("op") == "scan", user_key(F.col("user_id") + SPAN)).alias("end"),
    )


def mutations(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("op").isin("put", "delete")).select("seq", "op", "key", "value")


def generated(spark: SparkSession, n: int, seed: int, keys: int = 8, most: int = 3) -> DataFrame:
    """A seeded stream of 45 % puts, 20 % deletes, 20 % gets and 15 % scans; values of 1 to most bytes, scans of two equal bounds left out.

    Keys are big-endian numbers of one byte, or of two above 256 keys (a wide stream has 65,536)."""
    draw = lambda salt, m: F.pmod(F.xxhash64("seq", F.lit(seed), F.lit(salt)), F.lit(m))
    share, a, b = draw(0, 100), draw(1, keys), draw(3, keys)
    op = F.when(share < 45, "put").when(share < 65, "delete").when(share < 85, "get").otherwise("scan")
    key = lambda c: F.unhex(F.lpad(F.hex(c), 2 if keys <= 256 else 4, "0"))
    digits = F.sha2(F.concat_ws("/", "seq", F.lit(seed)).cast("binary"), 256)
    ops = spark.range(n).select(F.col("id").alias("seq")).select("seq", op.alias("op"), a.alias("a"), b.alias("b"), F.substring(digits, F.lit(1), 2 * (draw(4, most).cast("int") + 1)).alias("v"))
    scan = F.col("op") == "scan"
    return ops.where(~scan | (F.col("a") != F.col("b"))).select(
        "seq", "op", F.when(~scan, key(F.col("a"))).alias("key"), F.when(F.col("op") == "put", F.unhex("v")).alias("value"),
        F.when(scan, key(F.least("a", "b"))).alias("start"), F.when(scan, key(F.greatest("a", "b"))).alias("end"),
    )


def summed_before(rows: DataFrame, order: str, of: dict[str, Column], ranges: int = 64) -> DataFrame:
    """rows with, under each name of of, the sum of that column over all rows before, in the order of a column, without one task for all rows.

    Rows are dealt to ranges of values, whose bounds are the values of least hash; each range's sums
    give the ones above it their offsets. A row's range depends on its value alone, so a retried task
    or another plan gives the same sums. Rows of equal values stand in any order."""
    some = rows.select(order).where(F.col(order).isNotNull()).distinct().orderBy(F.xxhash64(order)).limit(ranges - 1)
    bounds = [r[0] for r in some.orderBy(order).collect()]  # fewer than ranges
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    placed = rows.withColumns({f"_n_{c}": v for c, v in of.items()}).withColumn("_range", F.coalesce(at, F.lit(0)))
    above, own = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.orderBy("_range"), Window.partitionBy("_range").orderBy(order)))
    until = lambda c, w: F.coalesce(F.sum(f"_n_{c}").over(w), F.lit(0))
    offsets = placed.groupBy("_range").agg(*(F.sum(f"_n_{c}").alias(f"_n_{c}") for c in of)).select("_range", *(until(c, above).alias(f"_offset_{c}") for c in of))
    told = placed.withColumns({f"_own_{c}": until(c, own) for c in of}).join(F.broadcast(offsets), "_range")
    return told.withColumns({c: F.col(f"_offset_{c}") + F.col(f"_own_{c}") for c in of}).drop("_range", *(f"_{k}_{c}" for k in ("n", "own", "offset") for c in of))


def numbered(writes: DataFrame, order: str, base: int = 0, ranges: int = 64) -> DataFrame:
    """Dense sequence numbers from base in the order of a column; rows of equal values are numbered in any order."""
    return summed_before(writes, order, {"seq": F.lit(1)}, ranges).withColumn("seq", F.lit(base) + F.col("seq"))


def first_gap(ops: DataFrame) -> DataFrame:
    """One row, gap: the least number that is missing; the recovered log is what lies below it.

    A number above 0 begins a run if its predecessor is missing, so the first run ends at the least
    number whose successor is missing, if 0 is there: a join by number, no global order."""
    seqs = ops.select("seq").distinct()
    following = seqs.select((F.col("seq") - 1).alias("seq"), F.lit(True).alias("followed"))
    runs = seqs.join(following, "seq", "left").agg(F.min("seq").alias("least"), F.min(F.when(F.col("followed").isNull(), F.col("seq"))).alias("last"))
    return runs.select(F.when(F.col("least") == 0, F.col("last") + 1).otherwise(0).cast("long").alias("gap"))


def dense_prefix(ops: DataFrame) -> DataFrame:
    """The longest prefix 0, 1, 2, ... of a log that may have lost rows."""
    return ops.join(F.broadcast(first_gap(ops)), F.col("seq") < F.col("gap"), "left_semi")


def acknowledged(ops: DataFrame, every: int) -> DataFrame:
    """The rows up to the last commit, one after each every operations."""
    last = ops.agg(((F.floor((F.max("seq") + 1) / every)) * every - 1).alias("acked"))
    return ops.join(F.broadcast(last), F.col("seq") <= F.col("acked"), "left_semi")


def from_requests(lines: DataFrame) -> DataFrame:
    """Request lines as operations, with code and message for those that are refused.

    lines has seq_in (their order) and line. Strict: what from_json takes but a typed reader would not
    (other quotes, negative limits, non-canonical base64) is refused."""
    parsed = F.from_json("line", REQUEST, {"allowSingleQuotes": "false"})
    rows = lines.withColumn("r", parsed).select("seq_in", F.octet_length("line").alias("size"), "r.*")
    data = {c: from_base64(F.col(f"{c}_b64")) for c in ("key", "value", "start", "end")}
    rows = rows.withColumns(data)
    known = F.col("op").isin("put", "delete", "get", "scan", "sync", "flush", "compact", "stats")
    needs = {"key": F.col("op").isin("put", "delete", "get"), "value": F.col("op") == "put", "start": F.col("op") == "scan", "end": F.col("op") == "scan"}
    message = F.when(F.col("size") > MAX_REQUEST_BYTES, "request is too long").when(F.col("seq").isNull() | F.col("op").isNull() | (F.col("limit") < 0), "request can't be read").when(~known, "unknown op")
    for c, needed in needs.items():
        message = message.when(needed & F.col(f"{c}_b64").isNull(), f"{c}_b64 is missing").when(needed & F.col(c).isNull(), f"{c}_b64 is not base64")
    message = message.when((F.col("op") == "scan") & (F.col("start") >= F.col("end")), "invalid argument: scan: start must be < end")
    rows = rows.withColumn("message", message).withColumn("code", F.when(F.col("message").isNotNull(), "INVALID_ARGUMENT"))
    return rows.select("seq_in", F.coalesce("seq", F.lit(0)).alias("seq"), "op", "key", "value", "start", "end", "limit", "code", "message")

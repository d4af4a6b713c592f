"""Batches of request lines against a view: every line gets its response, reads see earlier writes of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldstone.functions.encoding import to_base64
from foldstone.functions.limits import clamped_limit, violation
from foldstone.sources.oplog import from_requests

from .fold import BLOCK
from .layers import kept, scratch
from .replay import first_pairs, point_results

PAIRS = "array<struct<key_b64: string, value_b64: string>>"


def accepted(lines: DataFrame) -> DataFrame:
    """Requests in order, refused ones with their code; limits count as refusals too."""
    told = from_requests(lines)
    message = F.coalesce("message", F.when(F.col("op").isin("put", "delete"), violation(F.col("key"), F.col("value"))))
    told = told.withColumn("message", message).withColumn("code", F.when(F.col("message").isNotNull(), "INVALID_ARGUMENT"))
    return told.withColumn("_row", F.monotonically_increasing_id())


def good(requests: DataFrame) -> DataFrame:
    """The accepted ones. The row number keeps the filter above the parser: pushed down, it would parse a line many times over."""
    return requests.where("code is null and _row >= 0")


def as_operations(requests: DataFrame) -> DataFrame:
    """Accepted requests as a log, numbered by their place in the batch; request numbers are the clients' own and may repeat."""
    return good(requests).select(F.col("seq_in").alias("seq"), "op", "key", "value", "start", "end", "limit")


STATS = ("flushes", "flushed_records", "flushed_bytes", "compactions", "compacted_records", "tables")
ADMIN = ("sync", "flush", "compact", "stats")


def responses(view: DataFrame, lines: DataFrame, block: int = BLOCK, merged: bool = False, stats: dict[str, int] | None = None, folder: str | None = None) -> DataFrame:
    """(seq_in, response) for each of lines(seq_in, line); view(key, value) is the state before, in binary.

    The view counts as puts before the first line. A scan meets no more of the view's keys than its limit.
    merged and stats are what the caller did for the batch and how it stands then: the first compact
    of a batch is answered with merged, later ones with false, stats with stats (none: no answer of
    that kind is given, the request is refused). The requests and the counted keys are written into folder
    (none: a new scratch folder), so each line is read and parsed once, not by each step."""
    folder = folder or scratch(view.sparkSession)
    requests = kept(accepted(lines), folder, "requests")
    if stats is None:
        refused = F.col("op").isin(*ADMIN) & F.col("code").isNull()
        requests = requests.withColumns({"message": F.when(refused, "not served here").otherwise(F.col("message")), "code": F.when(refused, "INVALID_ARGUMENT").otherwise(F.col("code"))})
        stats = {}
    ops = as_operations(requests)
    null = F.lit(None).cast("binary")
    before = view.select(F.lit(-1).cast("long").alias("seq"), F.lit("put").alias("op"), "key", "value", null.alias("start"), null.alias("end"), F.lit(None).cast("long").alias("most"))
    ops = ops.where(F.col("op").isin("put", "delete", "get", "scan")).withColumn("most", clamped_limit(F.col("limit")).cast("long")).drop("limit")
    log = before.unionByName(ops)
    points = point_results(log, block).where("seq >= 0").select(F.col("seq").alias("seq_in"), "observed", "was_live")
    limits = ops.where("op = 'scan'").select(F.col("seq").alias("scan"), "most")
    pair = F.struct("key", to_base64(F.col("key")).alias("key_b64"), to_base64(F.col("value")).alias("value_b64"))
    place = F.row_number().over(Window.partitionBy("scan").orderBy("key"))
    seen = first_pairs(log, 0, block, folder).withColumn("place", place).join(limits, "scan")
    seen = seen.where(F.col("place") <= F.col("most")).groupBy(F.col("scan").alias("seq_in"))
    found = F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.struct(p["key_b64"].alias("key_b64"), p["value_b64"].alias("value_b64")))
    pairs = seen.agg(found.alias("found"))
    # The place of the batch's first compact: one row.
    first = good(requests).where("op = 'compact' and _row >= 0").agg(F.min("seq_in").alias("first_compact"))
    told = requests.join(points, "seq_in", "left").join(pairs, "seq_in", "left").join(F.broadcast(first))
    missing = F.col("code").isNull() & (F.col("op") == "get") & ~F.col("was_live")
    ok = F.col("code").isNull() & ~missing
    line = F.struct(
        "seq", ok.alias("ok"), F.when(missing, "NOT_FOUND").otherwise(F.col("code")).alias("code"), F.when(missing, "key not found").otherwise(F.col("message")).alias("message"),
        F.when(ok & (F.col("op") == "get"), to_base64(F.col("observed"))).alias("value_b64"), F.when(ok & (F.col("op") == "delete"), F.col("was_live")).alias("removed"),
        F.when(ok & (F.col("op") == "scan"), F.coalesce("found", F.array().cast(PAIRS))).alias("pairs"),
        F.when(ok & (F.col("op") == "compact"), F.lit(merged) & (F.col("seq_in") == F.col("first_compact"))).alias("merged"),
        F.when(ok & (F.col("op") == "stats"), F.struct(*(F.lit(stats.get(k, 0)).cast("long").alias(k) for k in STATS))).alias("stats"),
    )
    return told.select("seq_in", F.to_json(line).alias("response"))

"""The result of every operation of a mixed stream: point operations by a window, scans by a range join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.functions.encoding import to_base64
from foldstone.sources.oplog import summed_before

from .fold import BLOCK, with_previous
from .layers import kept, scratch
from .reads import range_join

#: Places of a scan that are listed at once.
STRETCH = 1024


def point_results(ops: DataFrame, block: int = BLOCK) -> DataFrame:
    """(seq, op, key, observed, was_live) for each put, delete and get: the value just before, and whether there was one."""
    told = with_previous(ops.where("op <> 'scan'").select("seq", "op", "key", "value"), block)
    was = F.coalesce(F.col("prev.op") == "put", F.lit(False))
    return told.select("seq", "op", "key", F.when(was, F.col("prev.value")).alias("observed"), was.alias("was_live"))


def _seen(changes: DataFrame, met: DataFrame, block: int) -> DataFrame:
    """(scan, key, value) of those met(scan, key) whose newest mutation before the scan is a put."""
    asked = met.select(F.col("scan").alias("seq"), F.lit("see").alias("op"), "key", F.lit(None).cast(dict(changes.dtypes)["value"]).alias("value"))
    told = with_previous(changes.unionByName(asked), block).where("op = 'see' and prev.op = 'put'")
    return told.select(F.col("seq").alias("scan"), "key", F.col("prev.value").alias("value"))


def scan_pairs(ops: DataFrame, bucket: Callable[[Column], Column], block: int = BLOCK) -> DataFrame:
    """(scan, key, value) for each pair that each scan saw; bucket is a monotone long of a key.

    A scan meets the distinct keys of its range, then each such pair the newest mutation before it:
    work grows with the pairs that are seen, not with versions times scans."""
    changes = ops.where(F.col("op").isin("put", "delete")).select("seq", "op", "key", "value")
    scans = ops.where("op = 'scan' and start < end").select(F.col("seq").alias("scan"), "start", "end")
    keys = changes.select("key").distinct()
    met = range_join(keys, "key", scans, "start", "end", bucket(F.col("key")), bucket(F.col("start")), bucket(F.col("end")))
    return _seen(changes, met, block)


def first_pairs(ops: DataFrame, since: int = 0, block: int = BLOCK, folder: str | None = None) -> DataFrame:
    """(scan, key, value) of what each scan saw, at least its first pairs up to its column most; ops has that column too.

    Keys are counted in their order, so a scan is a stretch of places, and it is joined with the keys by
    each of its places: it reads no key but those it meets, whatever their prefixes. A key that was put
    before since and is never deleted is sure to be seen, so a scan ends at the sure key after its first
    most ones: it meets so many, and keys that the operations from since on have touched. The keys, and
    then their places, are written into folder (none: a new scratch folder), as several steps read them."""
    changes = ops.where(F.col("op").isin("put", "delete")).select("seq", "op", "key", "value")
    scans = ops.where("op = 'scan' and start < end").select(F.col("seq").alias("scan"), "start", "end", "most")
    sure = (F.min("seq") < since) & ~F.bool_or(F.col("op") == "delete")
    keys = changes.groupBy("key").agg(F.lit(1).alias("real"), sure.cast("int").alias("sure"))
    bounds = scans.select("scan", "most", F.explode(F.array("start", "end")).alias("key"))
    values = keys.unionByName(bounds.select("key", F.lit(0).alias("real"), F.lit(0).alias("sure"))).groupBy("key").agg(F.max("real").alias("real"), F.max("sure").alias("sure"))
    folder = folder or scratch(ops.sparkSession)
    placed = summed_before(kept(values, folder, "keys"), "key", {"place": F.col("real"), "passed": F.col("sure")})
    placed = kept(placed, folder, "placed")
    stops = placed.where("sure = 1").select(F.col("passed").alias("stop"), F.col("place").alias("stop_at"))
    stop = (F.min("passed") + F.col("most")).alias("stop")
    asked = bounds.join(placed, "key").groupBy("scan", "most").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), stop).join(stops, "stop", "left")
    asked = asked.select("scan", "lo", F.least("hi", "stop_at").alias("hi")).where("lo < hi")
    # In two levels, so that no row holds all places of a wide scan.
    dealt = asked.select("scan", "hi", F.explode(F.expr(f"sequence(lo, hi - 1, {STRETCH}L)")).alias("first"))
    dealt = dealt.select("scan", F.explode(F.expr(f"sequence(first, least(hi, first + {STRETCH}) - 1)")).alias("place"))
    met = placed.where("real = 1").select("key", "place").join(dealt, "place")
    return _seen(changes, met, block)


def scan_results(ops: DataFrame, bucket: Callable[[Column], Column], block: int = BLOCK) -> DataFrame:
    """(seq, n, first_key, last_key, error) for each scan."""
    seen = scan_pairs(ops, bucket, block).groupBy(F.col("scan").alias("seq")).agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    error = F.when(F.col("start") >= F.col("end"), "invalid argument: scan: start must be < end")
    scans = ops.where("op = 'scan'").select("seq", error.alias("error"))
    return scans.join(seen, "seq", "left").select("seq", F.coalesce("n", F.lit(0)).alias("n"), "first_key", "last_key", "error")


def responses(ops: DataFrame, block: int = BLOCK) -> DataFrame:
    """(seq, response) for each point operation: a JSON line without its null fields."""
    told = point_results(ops, block)
    missing = (F.col("op") == "get") & ~F.col("was_live")
    line = F.struct(
        "seq", (~missing).alias("ok"), F.when(missing, "NOT_FOUND").alias("code"), F.when(missing, "key not found").alias("message"),
        F.when((F.col("op") == "get") & ~missing, to_base64(F.col("observed").cast("binary"))).alias("value_b64"), F.when(F.col("op") == "delete", F.col("was_live")).alias("removed"),
    )
    return told.select("seq", F.to_json(line).alias("response"))

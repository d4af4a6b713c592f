"""Token sequences in a keyed training order, as fixed-stride shards.

Each document's token ids and an end mark are cut into sequences of one length; the last is padded.
Sequences are numbered by partition and place in a written table, so a retried task gives the same
numbers. A keyed Feistel network permutes the numbers: it mixes the two digits of a number in a
mixed radix rows * columns that just covers the count, and walks on along its cycle while the result
lies beyond the count. The permuted number is the sequence's global slot. Slots are dealt to shards
by range; a shard's records have one stride, so a reader finds slot k at (k - first) * stride and
resumes anywhere by arithmetic alone.

A record: doc_id (8 bytes), number within the document (4), count of ids (4), ids (2 each), all
little-endian. Null and empty texts give one sequence that holds the end mark only; a null id is
written as -1; repeated rows give sequences of their own; an empty table gives no shard."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, staged

#: Ids in a sequence, sequences in a shard, rounds of the network.
LENGTH, SHARD, ROUNDS = 256, 1024, 6
#: Bytes of records that a range partition holds, about.
PART = 128 << 20
#: The public byte-level vocabulary's end mark.
END = 50256


def stride(length: int = LENGTH) -> int:
    return 16 + 2 * length


def permuted(index: Column, count: int, key: int) -> Column:
    """A keyed permutation of 0..count-1, as one expression.

    rows * columns exceeds the count by less than rows, and a walk takes at most one step more than
    that. A step leaves the range with a chance below 1 / rows, so 64 steps are far more than any walk
    of a large count takes; a walk that was not at its end by then would fail the job, and no slot
    beyond the count is ever given."""
    rows = max(1, int(np.ceil(np.sqrt(count))))
    columns = -(-max(1, count) // rows)
    steps = min(rows * columns - count + 1, 64)

    def once(x: Column) -> Column:
        low = F.pmod(x, F.lit(columns))
        high = ((x - low) / columns).cast("long")
        for r in range(ROUNDS):
            if r % 2:
                low = F.pmod(low + F.pmod(F.xxhash64(F.lit(key), F.lit(r), high), F.lit(columns)), F.lit(columns))
            else:
                high = F.pmod(high + F.pmod(F.xxhash64(F.lit(key), F.lit(r), low), F.lit(rows)), F.lit(rows))
        return high * columns + low

    walk = once(index.cast("long"))
    if steps > 1:
        lost = F.raise_error(F.lit("a walk of the permutation has not come back to the range")).cast("long")
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), walk, lambda x, _: F.when(x < count, x).otherwise(once(x)), lambda x: F.when(x < count, x).otherwise(lost))
    return walk


def sequences(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(part, pos, id, seq, n, record) of every document's sequences; written to the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        import tiktoken

        known, form = sent.value
        tokens = tiktoken.Encoding("own", pat_str=form, mergeable_ranks=known, special_tokens={})
        part, pos = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, len(batch["text"]), 256):
                out: dict = {c: [] for c in ("part", "pos", "id", "seq", "n", "record")}
                for id_, text in zip(batch["id"][a : a + 256], batch["text"][a : a + 256], strict=True):
                    ids = np.array([*tokens.encode_ordinary(text or ""), END], "<u2")
                    for seq, lo in enumerate(range(0, len(ids), length)):
                        own = ids[lo : lo + length]
                        head = np.array([-1 if id_ is None else id_], "<i8").tobytes() + np.array([seq, len(own)], "<i4").tobytes()
                        for c, v in (("part", part), ("pos", pos), ("id", id_), ("seq", seq), ("n", len(own)), ("record", head + own.tobytes())):
                            out[c].append(v)
                        pos += 1
                yield out

    rows = mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), cut, "part int, pos long, id long, seq int, n int, record binary")
    return staged(rows, "sequences")


def shards(rows: DataFrame, key: int, length: int = LENGTH, per_shard: int = SHARD) -> DataFrame:
    """(shard, first_slot, n_slots, n_ids, stride, payload): range partitions of slots, one row for each shard."""
    counts = rows.groupBy("part").agg(F.count("*").alias("count"))
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row of 12 bytes for each partition of the scan: 10 MB for 100 TB in partitions of 128 MB.
    offsets = F.broadcast(counts.select("part", before.alias("offset")))
    count = rows.count()
    placed = rows.join(offsets, "part").withColumn("slot", permuted(F.col("offset") + F.col("pos"), count, key))
    placed = placed.select("slot", (F.col("slot") / per_shard).cast("long").alias("shard"), "n", "record")
    size, of_table = stride(length), max(1, -(-count // per_shard))
    # Ranges of whole shards by arithmetic, so nothing is sampled and slots are computed once.
    parts = min(of_table, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * size // PART)))
    dealt = placed.withColumn("range", F.expr(f"cast(shard * {parts} div {of_table} as int)")).repartitionById(parts, "range").sortWithinPartitions("slot")
    dealt = dealt.select("slot", "shard", "n", "record")

    def pack(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict | None = None

        def done(x: dict) -> dict:
            return {c: [x[c]] for c in ("shard", "first_slot", "n_slots", "n_ids")} | {"stride": [size], "payload": [bytes(x["payload"])]}

        for batch in batches:
            for slot, shard, n, record in zip(*(batch[c] for c in ("slot", "shard", "n", "record")), strict=True):
                if held is None or held["shard"] != shard:
                    if held:
                        yield done(held)
                    held = {"shard": shard, "first_slot": slot, "n_slots": 0, "n_ids": 0, "payload": bytearray()}
                held["payload"] += record.ljust(size, b"\0")
                held["n_slots"] += 1
                held["n_ids"] += n
        if held:
            yield done(held)

    return mapped(dealt, pack, "shard long, first_slot long, n_slots long, n_ids long, stride int, payload binary")


def save(made: DataFrame, path: str) -> None:
    """Write shards as binary files below path/shard=k by Spark's own committed writer: a shard's bytes, then one newline."""
    made.select("shard", F.col("payload").cast("string").alias("value")).write.partitionBy("shard").text(path)


def read_from(made: DataFrame, slot: int, per_shard: int = SHARD) -> DataFrame:
    """(slot, record) from a slot on, in order, by skipping whole shards."""
    rest = made.where(F.col("shard") >= slot // per_shard)
    each = rest.select("first_slot", "stride", "payload", F.explode(F.sequence(F.lit(0), (F.col("n_slots") - 1).cast("int"))).alias("k"))
    record = F.substring("payload", F.col("k") * F.col("stride") + 1, F.col("stride"))
    return each.select((F.col("first_slot") + F.col("k")).alias("slot"), record.alias("record")).where(F.col("slot") >= slot).orderBy("slot")


def parsed(record: bytes) -> tuple[int, int, list[int]]:
    """(doc_id, number within it, ids) of a record."""
    seq, n = np.frombuffer(record, "<i4", 2, 8).tolist()
    return int(np.frombuffer(record, "<i8", 1)[0]), seq, np.frombuffer(record, "<u2", n, 16).tolist()


def vocabulary(path: str) -> dict[bytes, int]:
    """A file of base64 tokens and ranks, read by the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

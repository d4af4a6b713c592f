"""Near-duplicate components from bottom-k sketches of word shingles.

One hash function orders every document's shingles; its k smallest values are the sketch, and the
hash order is the same for all documents. Documents with equal sets form a class and are handled
once. Inverted lists are keyed by runs of neighbouring sketch values, so a passage that many
documents share seldom puts them on one list, while a pair at the threshold keeps at least one
common run: always if the sketch holds the whole set, else with a chance of a miss below 1e-5
(a run of 3 among 32 values at Jaccard 0.8) and 1e-6 at 0.85.

A list never yields all its pairs. First each class meets the smallest class it shares a list
with; then only lists that still hold two components are used, each class meeting one class of its
list's smallest component. Classes of lists that even then hold two components go through an exact
prefix filter: sets of that Jaccard share one of their rarest shingles, as many of them as a
partner may lack plus one, so classes that share only a common passage never meet; and a bitmap of
parities bounds from below by how many shingles two sets differ. The estimate of the union's sketch filters pairs,
and exact Jaccard on the full sets decides.

Only texts of pairs that the sketches leave are joined with them, by the ids that such pairs have.

Nulls and texts without words have an empty set and no links. Rows that share an id are one document,
which has the links of all its texts: they come out in one component, each with its own n_shingles.
A row without id takes part in no component and is not kept. Repeated rows each come out. Very long
texts are cut into words by parts. Of documents with equal sets the smallest id stands for all; an
empty table gives no rows; other columns of docs play no part, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, mapped, mix, shingle_sets, staged
from .components import components

#: Values in a sketch.
SKETCH = 32
#: Sets below this size also use runs of two, which small sets can't all lose.
SMALL = 12
#: Counters that order shingles by rarity; any order gives right results.
ORDER = 1 << 18
#: 64-bit words of a set's parities: they differ in no more bits than the sets in members.
PARITY = 8
#: How far below the threshold an estimate may lie: five standard deviations of 32 draws.
MARGIN = 0.35


def _runs(sketch: np.ndarray, length: int) -> np.ndarray:
    n = len(sketch) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, length, np.uint64)
    for k in range(length):
        out = out * np.uint64(_BASE) + sketch[k : k + n]
    return mix(out)


def _sketcher(size: int):
    def sketch(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = {"id": batch["id"], "n": [], "c1": [], "c2": [], "sketch": [], "keys": []}
            for own in shingle_sets([t or "" for t in batch["text"]], size):
                low = own[:SKETCH]
                keys = _runs(low, 3)
                if len(own) < SMALL * 1.25:
                    keys = np.concatenate((keys, _runs(low, 2)))
                out["n"].append(len(own))
                out["c1"].append(np.bitwise_xor.reduce(mix(own)).view(np.int64) if len(own) else 0)
                out["c2"].append(mix(own ^ np.uint64(_BASE)).sum(dtype=np.uint64).view(np.int64) if len(own) else 0)
                out["sketch"].append(low.view(np.int64))
                out["keys"].append(keys.view(np.int64))
            yield out

    return sketch


def _judge(size: int, num: int, den: int):
    def judge(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = {"a": [], "b": []}
            sets = zip(*(shingle_sets([t or "" for t in batch[c]], size) for c in ("text_a", "text_b")), strict=True)
            for a, b, (x, y) in zip(batch["a"], batch["b"], sets, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and den * both >= num * (len(x) + len(y) - both):
                    out["a"].append(a)
                    out["b"].append(b)
            yield out

    return judge


def _counter(size: int):
    def count(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(ORDER, np.int64)
        for batch in batches:
            for own in shingle_sets(batch["text"], size):
                np.add.at(total, (own % np.uint64(ORDER)).astype(np.int64), 1)
        seen = np.flatnonzero(total)
        yield {"bucket": seen.astype(np.int32), "n": total[seen]}

    return count


def _rarest(size: int, num: int, den: int, order):
    def rarest(batches: Iterator[dict]) -> Iterator[dict]:
        counts = order.value
        for batch in batches:
            out = {c: [np.zeros(0, np.int64)] for c in ("value", "at", "n", *(f"p{k}" for k in range(PARITY)))}
            for i, own in enumerate(shingle_sets(batch["text"], size)):
                n = len(own)
                first = np.argsort(counts[(own % np.uint64(ORDER)).astype(np.int64)], kind="stable")[: n - -(-num * n // den) + 1]
                places = np.bincount((mix(own) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
                words = np.packbits(places.astype(np.uint8), bitorder="little").view(np.int64)
                for c, v in (("value", own[first].view(np.int64)), ("at", i), ("n", n), *((f"p{k}", w) for k, w in enumerate(words))):
                    out[c].append(np.broadcast_to(v, len(first)))
            out = {c: np.concatenate(v) for c, v in out.items()}
            at = out.pop("at")
            yield out | {c: [batch[c][i] for i in at] for c in ("rep", "root")}

    return rarest


def near_duplicates(docs: DataFrame, shingle: int, num: int, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs; links have den * common >= num * union."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(texts.dtypes)["id"]
    made = mapped(texts, _sketcher(shingle), f"id {id_type}, n long, c1 long, c2 long, sketch array<long>, keys array<long>")
    made = staged(made.withColumn("row", F.monotonically_increasing_id()), "sketches")

    light = made.select("id", "n", "c1", "c2")
    repeated = staged(light.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "repeated")
    first = made.where("n > 0 and id is not null").groupBy("c1", "c2", "n").agg(F.min(F.struct("id", "row")).alias("first"))
    classes = staged(first.select("c1", "c2", "n", F.col("first.id").alias("rep"), F.col("first.row").alias("row")), "classes")
    reps = made.join(classes.select("row", "rep"), "row").select("rep", "n", "sketch", "keys")
    reps = staged(reps, "reps")

    lists = reps.select("rep", "n", F.explode("keys").alias("key"))
    shared = lists.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last")
    shared = staged(shared.select("key", "lead"), "shared")  # a written side lets Spark split a hot list in the join
    lists = staged(lists.join(shared, "key").select("key", "rep", "n", "lead"), "lists")

    sketches = reps.select("rep", "n", "sketch")

    def held(ids: DataFrame, column: str) -> DataFrame:
        """The texts of the ids in a column; a written table, so Spark broadcasts it where it is small."""
        wanted = staged(ids.select(F.col(column).alias("id")).distinct(), "wanted")
        return staged(texts.join(wanted, "id", "left_semi"), "texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a, b = (sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
        near = pairs.join(a, "a").join(b, "b").where(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}")
        union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, SKETCH)
        both = F.array_intersect(union, F.array_intersect("s_a", "s_b"))
        near = staged(near.where(F.size(both) >= (num / den - MARGIN) * F.size(union)).select("a", "b"), "near")
        own = held(near.select("a").union(near.select("b")), "a")
        with_texts = near.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        with_texts = with_texts.join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return staged(mapped(with_texts, _judge(shingle, num, den), f"a {id_type}, b {id_type}").distinct(), name)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    tested = staged(lists.where("rep <> lead").groupBy(F.col("rep").alias("b")).agg(F.min("lead").alias("a")).select("a", "b"), "pairs")
    # The classes of one id are linked, whatever their texts.
    several = light.where("n > 0").join(repeated, "id", "left_semi").join(classes.select("c1", "c2", "n", "rep"), ["c1", "c2", "n"])
    several = staged(several.select("id", "rep").distinct(), "several")
    lead = several.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a <> last")
    links = verified(tested, "links").union(several.join(lead, "id").select("a", F.col("rep").alias("b")))
    roots = components(links)

    def open_lists(lists: DataFrame) -> DataFrame:
        """The lists that hold two components or more, with each class's component and the list's smallest."""
        told = lists.select("key", "rep", "n").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        told = told.withColumn("root", F.coalesce("root", "rep"))
        least = told.groupBy("key").agg(F.min(F.struct("root", "rep")).alias("least"), F.max("root").alias("last")).where("least.root <> last")
        return told.join(staged(least.select("key", "least"), "least"), "key")

    lists = staged(open_lists(lists), "open")
    pairs = ordered(lists.where("root <> least.root").select(F.col("least.rep").alias("a"), F.col("rep").alias("b")))
    pairs = staged(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    links, tested = links.union(verified(pairs, "links")), tested.union(pairs)
    roots = components(links)

    rest = staged(open_lists(lists).select("rep", "root", "n").distinct(), "open")
    rest = staged(rest.join(held(rest, "rep"), F.col("rep") == F.col("id")).select("rep", "root", "n", "text"), "rest")
    counts = np.zeros(ORDER, np.int64)
    for row in mapped(rest.select("text"), _counter(shingle), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.bucket] = row.n
    order = docs.sparkSession.sparkContext.broadcast(counts)
    parity = [f"p{k}" for k in range(PARITY)]
    rare = mapped(rest, _rarest(shingle, num, den, order), f"value long, rep {id_type}, root {id_type}, n long, {', '.join(f'{p} long' for p in parity)}")
    rare = staged(rare, "rare")
    x, y = (rare.select("value", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "root", "n", *parity))) for s in "xy")
    apart = " + ".join(f"bit_count({p}_x ^ {p}_y)" for p in parity)
    rest = x.join(y, "value").where(f"root_x < root_y and least(n_x, n_y) * {den} >= greatest(n_x, n_y) * {num} and ({apart}) * {den + num} <= {den - num} * (n_x + n_y)")
    rest = ordered(rest.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b"))).join(tested, ["a", "b"], "left_anti")
    more = verified(staged(rest, "pairs"), "links")
    roots = components(links.union(more))

    found = classes.select("c1", "c2", F.col("n").alias("m"), "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    found = staged(found.select("c1", "c2", "m", "rep", F.coalesce("root", "rep").alias("component")), "found")
    out = light.join(found.drop("rep"), (light.c1 == found.c1) & (light.c2 == found.c2) & (light.n == found.m), "left")
    # A document with an empty text beside others is in their component.
    whole = several.join(found.select("rep", "component"), "rep").groupBy("id").agg(F.min("component").alias("whole"))
    out = out.join(whole, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("whole", "component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))

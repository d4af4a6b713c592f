import os

import pytest
import tiktoken
from pyspark.sql import functions as F

from foldstone.llm.queries import PATTERN, RANKS
from foldstone.llm.training_order import END, parsed, permuted, read_from, save, sequences, shards, stride, vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")


@pytest.mark.parametrize("count", [1, 2, 3, 5, 10, 17, 100, 1000, 4099])
def test_permutation(spark, count):
    rows = spark.range(count).select(permuted(F.col("id"), count, 11).alias("a"), permuted(F.col("id"), count, 12).alias("b")).collect()
    assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(count))
    if count > 99:
        assert [r.a for r in rows] != [r.b for r in rows]
        assert sum(abs(r.a - i) for i, r in enumerate(rows)) > count * count / 5  # a third of all pairs' distance is expected


def test_shards(spark, docs, odd, tmp_path):
    ranks, length, per_shard = vocabulary(RANKS), 32, 64
    tokens = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in enumerate(odd):
        ids = [*tokens.encode_ordinary(t or ""), END]
        want += [(i, k // length, ids[k : k + length]) for k in range(0, len(ids), length)]
    made = shards(sequences(docs(odd).repartition(3), ranks, PATTERN, length=length), 5, length, per_shard)
    rows = sorted(made.collect(), key=lambda r: r.shard)
    assert [r.shard for r in rows] == list(range(len(rows)))
    assert all(r.first_slot == r.shard * per_shard and len(r.payload) == r.n_slots * r.stride and r.stride == stride(length) for r in rows)
    got = [parsed(bytes(r.payload[k : k + r.stride])) for r in rows for k in range(0, len(r.payload), r.stride)]
    assert sorted(got) == sorted(want)
    assert got != sorted(got)

    later = [(r.slot, parsed(bytes(r.record))) for r in read_from(made, 100, per_shard).collect()]
    assert later == list(enumerate(got))[100:]

    save(made, f"file://{tmp_path}/out")
    for r in rows:
        (file,) = (tmp_path / "out" / f"shard={r.shard}").glob("part-*")
        assert file.read_bytes() == bytes(r.payload) + b"\n"


def test_nothing(spark, docs):
    assert shards(sequences(docs([]), vocabulary(RANKS), PATTERN), 5).count() == 0
    (one,) = shards(sequences(docs([None], [None]), vocabulary(RANKS), PATTERN), 5).collect()
    assert parsed(bytes(one.payload)) == (-1, 0, [END])

"""The engine against a dictionary, and the states that a crash may leave."""

import base64
import json
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from foldstone.functions.encoding import frame_checksum, from_base64, prefix_end, to_base64
from foldstone.functions.limits import EngineError, admitted
from foldstone.operators import fold, membership, quorum, reads, replay
from foldstone.operators.layers import LayeredTable
from foldstone.sources import oplog
from foldstone.streaming.ingest import into_layers, op_stream

OPS = "seq long, op string, key binary, value binary, start binary, end binary"


def stream(seed, n):
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        kind = r.choices(("put", "delete", "get", "scan"), (45, 20, 20, 15))[0]
        a, b = sorted((bytes([r.randrange(8)]), bytes([r.randrange(8)])))
        if kind == "scan":
            rows.append((seq, kind, None, None, a, b))
        else:
            rows.append((seq, kind, a, bytes(r.randrange(256) for _ in range(r.randrange(4))) if kind == "put" else None, None, None))
    return rows


def replayed(rows):
    state, points, scans = {}, {}, {}
    for seq, op, key, value, start, end in rows:
        if op == "scan":
            scans[seq] = [(k, v) for k, v in sorted(state.items()) if start <= k < end] if start < end else None
        else:
            points[seq] = (state.get(key), key in state)
            if op == "put":
                state[key] = value
            elif op == "delete":
                state.pop(key, None)
    return state, points, scans


def bucket(key):
    return F.conv(F.hex(F.substring(key, 1, 1)), 16, 10).cast("long")


@pytest.mark.parametrize(("seed", "block"), [(1, 16), (2, 64), (3, 1 << 20)])
def test_replay_is_a_dictionary(spark, seed, block):
    rows = stream(seed, 800)
    state, points, scans = replayed(rows)
    ops = spark.createDataFrame(rows, OPS)
    got = {r.seq: (None if r.observed is None else bytes(r.observed), r.was_live) for r in replay.point_results(ops, block).collect()}
    assert got == points
    pairs = {}
    for r in replay.scan_pairs(ops, bucket, block).collect():
        pairs.setdefault(r.scan, []).append((bytes(r.key), bytes(r.value)))
    for r in replay.scan_results(ops, bucket, block).collect():
        if scans[r.seq] is None:
            assert r.error
        else:
            assert sorted(pairs.get(r.seq, [])) == scans[r.seq]
            assert r.n == len(scans[r.seq])
    assert {bytes(r.key): bytes(r.value) for r in fold.live(oplog.mutations(ops)).collect()} == state


def test_layers_keep_the_state(spark, tmp_path):
    rows = stream(5, 900)
    ops = spark.createDataFrame(rows, OPS)
    table = LayeredTable(spark, f"file://{tmp_path}/t", "binary", "binary", fan=4)
    for lo in range(0, 900, 100):
        assert table.flush(oplog.mutations(ops.where((F.col("seq") >= lo) & (F.col("seq") < lo + 100))))
        table.maintain()
        assert len(table.manifest().layers) < 4
        state = replayed(rows[: lo + 100])[0]
        again = LayeredTable(spark, f"file://{tmp_path}/t", "binary", "binary", fan=4)
        assert {bytes(r.key): bytes(r.value) for r in again.read().collect()} == state
    assert table.compact()
    assert len(table.manifest().layers) == 1
    assert {bytes(r.key): bytes(r.value) for r in table.read().collect()} == state
    assert not table.compact()


def test_delete_shadows_a_flushed_layer(spark, tmp_path):
    table = LayeredTable(spark, f"file://{tmp_path}/t")
    table.flush(spark.createDataFrame([(0, "put", "a", "1"), (1, "put", "b", "2")], "seq long, op string, key string, value string"))
    tail = spark.createDataFrame([(2, "delete", "a", None)], "seq long, op string, key string, value string")
    view = table.read(tail)
    assert reads.get(view, "a").count() == 0
    assert [r.key for r in reads.scan(view, "a", "z").collect()] == ["b"]
    table.flush(spark.createDataFrame([(3, "delete", "a", None), (4, "delete", "b", None)], "seq long, op string, key string, value string"))
    assert table.compact()
    assert table.manifest().layers == []
    assert table.read().count() == 0


def test_states_after_a_crash(spark, tmp_path):
    path = tmp_path / "t"
    table = LayeredTable(spark, f"file://{path}")
    table.flush(spark.createDataFrame([(0, "put", "a", "1")], "seq long, op string, key string, value string"))
    (path / "manifest.json.tmp").write_text("half")
    os.makedirs(path / "layer=99")
    assert [r.value for r in table.read().collect()] == ["1"]
    assert table.vacuum() == ["layer=99", "manifest.json.tmp"]
    assert not table.flush(spark.createDataFrame([], "seq long, op string, key string, value string"))
    (path / "manifest.json").write_text(json.dumps({"version": 9}))
    (path / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(EngineError, match="CORRUPTION"):
        table.manifest()


def test_stream_flushes_each_batch_once(spark, tmp_path):
    schema = "seq long, op string, key string, value string"
    rows = [(i, "delete" if i % 5 == 4 else "put", f"k{i % 7}", str(i)) for i in range(60)]
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(f"{tmp_path}/in")
    table = LayeredTable(spark, f"file://{tmp_path}/t")
    for _ in range(2):
        into_layers(table, op_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/ck").awaitTermination()
    assert table.manifest().last_batch == 0
    assert not table.flush(spark.createDataFrame(rows[:3], schema), batch=0)
    want = {}
    for _, op, k, v in rows:
        want.pop(k, None)
        if op == "put":
            want[k] = v
    assert {r.key: r.value for r in table.read().collect()} == want


def test_limits_come_before_numbers(spark):
    writes = spark.createDataFrame([(0, "a", "x"), (1, "", "x"), (2, "b" * 9, "x"), (3, "c", "y" * 9), (4, "d", "")], "at long, key string, value string")
    good, refused = admitted(writes, max_key=8, max_value=8)
    assert [(r.key, r.seq) for r in oplog.numbered(good, "at").orderBy("seq").collect()] == [("a", 0), ("d", 1)]
    assert {r["at"]: (r.code, r.message) for r in refused.collect()} == {k: ("INVALID_ARGUMENT", m) for k, m in ((1, "key must not be empty"), (2, "key is too long"), (3, "value is too long"))}


def test_recovery_is_a_dense_prefix_with_all_acknowledged(spark):
    for lost, gap in (([], 50), ([0], 0), ([49], 49), ([7, 30], 7)):
        log = spark.range(50).withColumnRenamed("id", "seq").where(~F.col("seq").isin([-1, *lost]))
        assert [r.seq for r in oplog.dense_prefix(log).orderBy("seq").collect()] == list(range(gap))
    assert oplog.acknowledged(spark.range(50).withColumnRenamed("id", "seq"), 7).count() == 49
    assert oplog.dense_prefix(spark.range(0).withColumnRenamed("id", "seq")).count() == 0


def test_bytes(spark):
    keys = [b"\xff", b"\x00", b"a", b"a\x00", b"\x80"]
    df = spark.createDataFrame([(k,) for k in keys], "key binary")
    assert [bytes(r.key) for r in df.orderBy("key").collect()] == sorted(keys)
    texts = [base64.b64encode(k * 90).decode() for k in keys] + ["YQ", "YQ= =", "!!!", "YR==", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(from_base64(F.col("t")).alias("d"), "t").collect()
    assert [None if r.d is None else bytes(r.d) for r in rows] == [k * 90 for k in keys] + [None] * 4 + [b""]
    assert df.select(to_base64(F.repeat(F.lit("x"), 200).cast("binary")).alias("b")).first().b == base64.b64encode(b"x" * 200).decode()
    crc = spark.createDataFrame([(258, "put", b"k", b"vv"), (3, "delete", b"k", None)], "s long, o string, k binary, v binary").select(frame_checksum(F.col("s"), F.col("o"), F.col("k"), F.col("v")).alias("c")).collect()
    assert [r.c for r in crc] == [zlib.crc32(bytes.fromhex("0000000000000102" "01" "00000001" "6b" "00000002" "7676")), zlib.crc32(bytes.fromhex("0000000000000003" "02" "00000001" "6b" "00000000"))]
    assert prefix_end(b"a\xff\xff") == b"b"
    assert prefix_end(b"\xff") is None


def test_scan_refuses_turned_bounds(spark):
    view = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string")
    for start, end in (("d", "a"), ("a", "a")):
        with pytest.raises(EngineError, match="INVALID_ARGUMENT"):
            reads.scan(view, start, end)
    assert [r.key for r in reads.scan(view, "a", "c").collect()] == ["a", "b"]
    assert [r.key for r in reads.page(view, "a", "z", 1).collect()] == ["b"]


def test_filter_has_no_misses(spark):
    inside = spark.range(500).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("key"))
    outside = spark.range(500, 10_500).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("key"))
    words = membership.build(inside, 500)
    assert membership.might_contain(inside, words, 500).where("maybe").count() == 500
    assert membership.might_contain(outside, words, 500).where("maybe").count() < 500
    assert membership.sizes(1000, 0.01) == (9600, 7)


def test_quorum(spark):
    votes = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 2), (1, 1, 2, 3), (1, 2, 2, 4), (2, 0, 0, 5), (2, 1, 1, 6)], "term long, voter long, candidate long, seq long")
    assert [tuple(r) for r in quorum.elected(votes, 3).collect()] == [(1, 0, 2)]
    held = spark.createDataFrame([(1, 0, 9), (1, 1, 4), (1, 2, 7), (2, 0, 3)], "term long, node long, match_index long")
    assert [tuple(r) for r in quorum.commit_index(held, 3).collect()] == [(1, 7)]


def test_generated_stream_has_its_mix(spark):
    wide = oplog.generated(spark, 20_000, seed=3, keys=1 << 16, most=8).collect()
    assert {len(r.key) for r in wide if r.key} == {2} and {len(r.value) for r in wide if r.value} == set(range(1, 9))
    assert len({r.key for r in wide}) > 10_000 and all(r.start < r.end for r in wide if r.op == "scan")
    shares = {r.op: r["count"] / 20_000 for r in oplog.generated(spark, 20_000, seed=3).groupBy("op").count().collect()}
    assert all(abs(shares[k] - v) < 0.02 for k, v in {"put": 0.45, "delete": 0.2, "get": 0.2, "scan": 0.15}.items())


def test_numbers_are_dense_in_order(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("key")).repartition(7)
    got = [(r.seq, r.key) for r in oplog.numbered(rows, "key", base=3).collect()]
    assert sorted(got) == list(enumerate(sorted(k for _, k in got), 3))
    same = oplog.numbered(spark.range(50).select((F.col("id") % 3).alias("key")), "key").collect()
    assert sorted(r.seq for r in same) == list(range(50))
    assert oplog.numbered(rows.where("false"), "key").count() == 0
    raw = spark.createDataFrame([(bytes([i]),) for i in range(256)], "key binary")
    assert all(r.seq == r.key[0] for r in oplog.numbered(raw, "key").collect())

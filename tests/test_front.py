"""Request lines end to end, by batch, by stream and by command."""

import base64
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foldstone.cli import run
from foldstone.functions.limits import EngineError
from foldstone.operators.front import responses
from foldstone.operators.layers import LayeredTable
from foldstone.operators.replay import first_pairs
from foldstone.streaming.ingest import serve


def b(x):
    return base64.b64encode(x).decode()


def answers(state, lines):
    """A dictionary's responses, and the state after."""
    out = []
    for line in lines:
        q = json.loads(line)
        op, key = q["op"], base64.b64decode(q.get("key_b64", ""))
        r = {"seq": q["seq"], "ok": True}
        if op in ("put", "delete") and not key:
            r |= {"ok": False, "code": "INVALID_ARGUMENT", "message": "key must not be empty"}
        elif op == "put":
            state[key] = base64.b64decode(q["value_b64"])
        elif op == "delete":
            r["removed"] = state.pop(key, None) is not None
        elif op == "get":
            r |= {"value_b64": b(state[key])} if key in state else {"ok": False, "code": "NOT_FOUND", "message": "key not found"}
        elif op == "scan":
            lo, hi = base64.b64decode(q["start_b64"]), base64.b64decode(q["end_b64"])
            if lo >= hi:
                r |= {"ok": False, "code": "INVALID_ARGUMENT", "message": "invalid argument: scan: start must be < end"}
            else:
                most = min(max(q.get("limit", 1000), 1), 10_000)
                r["pairs"] = [{"key_b64": b(k), "value_b64": b(v)} for k, v in sorted(state.items()) if lo <= k < hi][:most]
        out.append(r)
    return out


def requests(seed, n):
    r = random.Random(seed)
    lines = []
    for i in range(n):
        op = r.choice(("put", "put", "put", "delete", "get", "get", "scan", "sync"))
        key = bytes(r.choice((0, 65, 255)) for _ in range(r.randrange(4)))
        q = {"seq": i % 7, "op": op}
        if op in ("put", "delete", "get"):
            q["key_b64"] = b(key)
        if op == "put":
            q["value_b64"] = b(bytes(r.randrange(256) for _ in range(r.randrange(5))))
        if op == "scan":
            q |= {"start_b64": b(key), "end_b64": b(bytes([r.choice((0, 65, 255)), 9]))} | ({"limit": r.choice((0, 2, 50_000))} if r.random() < 0.5 else {})
        lines.append(json.dumps(q))
    return lines


def test_batch_is_a_dictionary(spark):
    state = {b"A": b"1", b"\xff": b"", b"\x00A": b"x"}
    view = spark.createDataFrame(list(state.items()), "key binary, value binary")
    lines = requests(3, 250)
    table = spark.createDataFrame(list(enumerate(lines)), "seq_in long, line string")
    got = [json.loads(r.response) for r in responses(view, table, 50, stats={}).orderBy("seq_in").collect()]
    assert got == answers(state, lines)


def test_scans_meet_no_more_keys_than_their_limit(spark):
    """3,000 keys of one prefix; a batch that deletes and puts among them, and scans with limits from its first line on."""
    state = {b"user/%04d" % k: b"%d" % k for k in range(0, 6000, 2)}
    view = spark.createDataFrame(list(state.items()), "key binary, value binary")
    change = lambda i, op, k: json.dumps({"seq": i, "op": op, "key_b64": b(b"user/%04d" % k)} | ({"value_b64": b(b"new")} if op == "put" else {}))
    scan = lambda i, lo, hi, most: json.dumps({"seq": i, "op": "scan", "start_b64": b(lo), "end_b64": b(hi), "limit": most})
    lines = [scan(0, b"user/", b"user0", 3)] + [change(i, "delete", 2 * i) for i in range(30)] + [change(i, "put", 2 * i + 1) for i in range(20, 60)]
    lines += [scan(1, b"user/", b"user0", 4), scan(2, b"user/0041", b"user/0050", 50), scan(3, b"user/5990", b"v", 7), scan(4, b"a", b"b", 5), scan(5, b"user/2000", b"user/5000", 2000)]
    table = spark.createDataFrame(list(enumerate(lines)), "seq_in long, line string")
    got = [json.loads(r.response) for r in responses(view, table).orderBy("seq_in").collect()]
    assert got == answers(dict(state), lines)
    ops = [(-1, "put", k, v, None, None, None) for k, v in state.items()] + [(0, "delete", b"user/0000", None, None, None, None), (1, "scan", None, None, b"user/", b"user0", 10)]
    log = spark.createDataFrame(ops, "seq long, op string, key binary, value binary, start binary, end binary, most long")
    assert first_pairs(log).count() == 10


def test_each_line_is_read_once(spark):
    """However many steps need the requests."""
    read = spark.sparkContext.accumulator(0)

    def told(line):
        read.add(1)
        return line

    lines = requests(5, 120)
    table = spark.createDataFrame(list(enumerate(lines)), "seq_in long, line string")
    view = spark.createDataFrame([(b"A", b"1")], "key binary, value binary")
    made = responses(view, table.select("seq_in", F.udf(told, "string").asNondeterministic()("line").alias("line")), stats={})
    assert [json.loads(r.response) for r in made.orderBy("seq_in").collect()] == answers({b"A": b"1"}, lines)
    assert read.value == len(lines)


def test_scans_read_no_keys_beside_their_range(spark):
    """Many short scans among neighbouring keys: each is joined with the keys of its places, by equality, not with a stretch that is then cut."""
    keys = [b"%04d" % k for k in range(3000)]
    ops = [(k, "put", key, b"v", None, None, None) for k, key in enumerate(keys)]
    ops += [(10_000 + k, "scan", None, None, key, b"%04d" % (k + 3), 1000) for k, key in enumerate(keys)]
    ops.append((20_000, "scan", None, None, b"0", b"1", 1000))  # wider than a list of places
    ops.append((20_001, "scan", None, None, b"0", b"3", 1000))
    seen = first_pairs(spark.createDataFrame(ops, "seq long, op string, key binary, value binary, start binary, end binary, most long"))
    joins = [line for line in seen._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and not [line for line in joins if "<" in line]
    want = {(10_000 + k, keys[j]) for k in range(3000) for j in range(k, min(k + 3, 3000))}
    want |= {(20_000, k) for k in keys if k < b"1"} | {(20_001, k) for k in keys}
    got = [(r.scan, bytes(r.key)) for r in seen.collect()]
    assert len(got) == len(want) and set(got) == want


def test_garbage_gets_an_answer(spark):
    lines = ["", "{", "[1]", "null", '{"seq": 3, "op": "drop"}', '{"seq":1,"op":"get"}', '{"seq":1,"op":"scan","start_b64":"AA==","end_b64":"AQ==","limit":-1}']
    view = spark.createDataFrame([], "key binary, value binary")
    table = spark.createDataFrame(list(enumerate(lines)), "seq_in long, line string")
    got = [json.loads(r.response) for r in responses(view, table).orderBy("seq_in").collect()]
    assert [g["code"] for g in got] == ["INVALID_ARGUMENT"] * len(lines)
    assert not any(g["ok"] for g in got)


def test_stream_of_lines(spark, tmp_path):
    state, want = {}, []
    table = LayeredTable(spark, f"file://{tmp_path}/t", "binary", "binary", fan=3)
    (tmp_path / "in").mkdir()
    for k in range(4):
        lines = requests(10 + k, 60)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        want.append(answers(state, lines))
        serve(table, spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        got = [json.loads(line) for part in sorted((tmp_path / "out" / f"batch={k}").glob("part-*")) for line in part.read_text().splitlines()]
        assert got == want[k]
    assert {bytes(r.key): bytes(r.value) for r in table.read().collect()} == state
    assert len(table.manifest().layers) < 3


def test_stream_leaves_no_scratch_tables(spark, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    table = LayeredTable(spark, f"file://{tmp_path}/t", "binary", "binary")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(requests(2, 20)))
    serve(table, spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert (tmp_path / "out" / "batch=0").exists() and set(shared.iterdir()) == before


def test_admin_requests_act(spark, tmp_path):
    table = LayeredTable(spark, f"file://{tmp_path}/t", "binary", "binary")
    table.flush(spark.createDataFrame([(0, "put", b"a", b"1"), (1, "put", b"b", b"2")], "seq long, op string, key binary, value binary"))
    put = lambda seq, k, v: json.dumps({"seq": seq, "op": "put", "key_b64": b(k), "value_b64": b(v)})
    (tmp_path / "in").mkdir()
    lines = [put(1, b"c", b"33"), '{"seq":2,"op":"sync"}', '{"seq":3,"op":"flush"}', json.dumps({"seq": 4, "op": "delete", "key_b64": b(b"a")}), '{"seq":5,"op":"compact"}', '{"seq":6,"op":"compact"}', '{"seq":7,"op":"stats"}', json.dumps({"seq": 8, "op": "get", "key_b64": b(b"a")})]
    (tmp_path / "in" / "0.json").write_text("\n".join(lines))
    stats = {"flushes": 2, "flushed_records": 4, "flushed_bytes": 9, "compactions": 1, "compacted_records": 2, "tables": 1}
    want = [{"seq": k, "ok": True} for k in range(1, 8)] + [{"seq": 8, "ok": False, "code": "NOT_FOUND", "message": "key not found"}]
    want[3]["removed"], want[4]["merged"], want[5]["merged"], want[6]["stats"] = True, True, False, stats
    for attempt in range(2):  # the second from a new checkpoint: a batch that is tried again is answered the same and changes nothing
        serve(table, spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck{attempt}").awaitTermination()
        got = [json.loads(line) for part in sorted((tmp_path / "out" / "batch=0").glob("part-*")) for line in part.read_text().splitlines()]
        assert got == want
        assert (table.manifest().layers, table.vacuum()) == ([2], ["layer=1"] if attempt == 0 else [])
    assert {bytes(r.key): bytes(r.value) for r in table.read().collect()} == {b"b": b"2", b"c": b"33"}
    (r,) = responses(table.read(), spark.createDataFrame([(0, '{"seq":1,"op":"flush"}')], "seq_in long, line string")).collect()
    assert not json.loads(r.response)["ok"]


def test_scrub_finds_a_changed_file(spark, tmp_path):
    table = LayeredTable(spark, f"file://{tmp_path}/t")
    for v in "123":
        table.flush(spark.createDataFrame([(0, "put", "a", v), (1, "put", "b" + v, v)], "seq long, op string, key string, value string"))
    assert [(r.layer, r.records, r.intact) for r in table.scrub().orderBy("layer").collect()] == [(0, 2, True), (1, 2, True), (2, 2, True)]
    spark.createDataFrame([("a", "put", "9"), ("b2", "put", "2")], "key string, op string, value string").write.mode("overwrite").parquet(f"{tmp_path}/t/layer=1")
    for f in (tmp_path / "t" / "layer=2").glob("*"):
        f.unlink()
    assert [(r.layer, r.records, r.intact) for r in table.scrub().orderBy("layer").collect()] == [(0, 2, True), (1, 2, False), (2, 0, False)]


def test_flush_by_bytes(spark, tmp_path):
    table = LayeredTable(spark, f"file://{tmp_path}/t")
    tail = spark.createDataFrame([(0, "put", "a", "1234"), (1, "put", "a", "12345"), (2, "delete", "b", None)], "seq long, op string, key string, value string")
    assert not table.maybe_flush(tail, 9) and table.manifest().layers == []
    assert table.maybe_flush(tail, 8) and table.manifest().stats["flushed_bytes"] == 8


def test_commands(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for k, v in (("b", "2"), ("a", "1"), ("c", "3"), ("b", "4")):
        assert run(spark, path, "put", [k, v]) == ["OK"]
    assert run(spark, path, "get", ["b"]) == ["4"]
    assert run(spark, path, "scan", ["a", "c"]) == ["a\t1", "b\t4"]
    assert run(spark, path, "scan", ["a", "z", "1"]) == ["a\t1"]
    assert run(spark, path, "del", ["a"]) == ["OK"]
    assert run(spark, path, "sync", []) == run(spark, path, "flush", []) == ["OK"]
    assert run(spark, path, "compact", []) == ["merged=true"]
    assert "layers=1" in run(spark, path, "stats", [])
    for command, args, code in (("get", ["a"], "NOT_FOUND"), ("put", ["", "x"], "INVALID"), ("scan", ["z", "a"], "INVALID"), ("what", [], "INVALID")):
        with pytest.raises(EngineError, match=code):
            run(spark, path, command, args)


def test_layers_without_a_manifest_are_adopted(spark, tmp_path):
    table = LayeredTable(spark, f"file://{tmp_path}/t")
    for v in "12":
        table.flush(spark.createDataFrame([(0, "put", "a", v)], "seq long, op string, key string, value string"))
    (tmp_path / "t" / "manifest.json").unlink()
    again = LayeredTable(spark, f"file://{tmp_path}/t")
    assert again.adopt() == [0, 1]
    assert [r.value for r in again.read().collect()] == ["2"]
    assert again.manifest().next_id == 2

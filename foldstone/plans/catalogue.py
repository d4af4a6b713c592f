"""The named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions import encoding, limits
from foldstone.operators import fold, front, layers, membership, quorum, reads, replay, report
from foldstone.sources import oplog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The log of the events table in SQL.
OPS = """ops as (select event_id as seq,
  case when event_type in ('signup', 'purchase') then 'put' when event_type = 'error' then 'delete' when event_type = 'view' then 'get' else 'scan' end as op,
  'u' || lpad(cast(user_id as varchar), 8, '0') as k, props as v,
  'u' || lpad(cast(user_id + 10 as varchar), 8, '0') as hi from events),
m as (select seq, op, k, case when op = 'put' then v end as v from ops where op in ('put', 'delete'))"""
FOLD = OPS + """, f as (select k, op, v, seq from (select *, row_number() over (partition by k order by seq desc) as rn from m) where rn = 1)"""
POINT = OPS + """, w as (select seq, op, k, max(case when op in ('put', 'delete') then seq end) over (partition by k order by seq rows between unbounded preceding and 1 preceding) as ps from ops where op <> 'scan'),
pt as (select w.seq, w.op, w.k, case when p.op = 'put' then p.v end as observed, coalesce(p.op = 'put', false) as was_live from w left join ops p on p.seq = w.ps)"""
#: The sequence number of the snapshot query.
AT = 5000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.mutations(oplog.from_events(spark, sf_dir))


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.live(_changes(spark, sf_dir))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a wide key space."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(encoding.load_key("o", F.col("o_orderkey")).alias("key"), F.col("o_orderstatus").alias("value"), "o_custkey")


def _bucket(key: Column) -> Column:
    """A monotone number of a user's key: the user, ten to a bucket."""
    return (F.substring(key, 2, 8).cast("long") / 10).cast("long")


@query("live_view", f"with {FOLD} select k as key, v as value from f where op = 'put'")
def live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir)


@query("live_count", f"with {FOLD} select count(*) as live_keys, count(*) = 0 as is_empty from f where op = 'put'")
def live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir).agg(F.count("*").alias("live_keys"), (F.count("*") == 0).alias("is_empty"))


@query("tombstones", f"with {FOLD} select k as key from f where op = 'delete'")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.newest(_changes(spark, sf_dir)).where("op = 'delete'").select("key")


@query("fold_writes", f"with {FOLD} select k as key, op, v as value, seq from f")
def fold_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.newest(_changes(spark, sf_dir)).select("key", "op", "value", "seq")


@query("full_iterate", f"with {FOLD} select k as key, v as value, row_number() over (order by k) as place from f where op = 'put'")
def full_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs in key order with their place, numbered without one task for all rows."""
    return oplog.numbered(_view(spark, sf_dir), "key", base=1).withColumnRenamed("seq", "place").select("key", "value", "place")


@query("state_at_seq", f"with {OPS}, f as (select k, op, v, row_number() over (partition by k order by seq desc) as rn from m where seq <= {AT}) select k as key, v as value from f where rn = 1 and op = 'put'")
def state_at_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.state_at(_changes(spark, sf_dir), AT)


@query("acked_prefix", f"with {OPS}, a as (select ((max(seq) + 1) // 7) * 7 - 1 as acked from ops), f as (select k, op, v, row_number() over (partition by k order by seq desc) as rn from m, a where seq <= acked) select k as key, v as value from f where rn = 1 and op = 'put'")
def acked_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a commit after every seventh operation has made durable."""
    return fold.live(oplog.mutations(oplog.acknowledged(oplog.from_events(spark, sf_dir), 7)))


@query("get_point", "select 'o' || lpad(cast(o_orderkey as varchar), 8, '0') as key, o_orderstatus as value from orders where o_orderkey = 42")
def get_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.get(_orders(spark, sf_dir).select("key", "value"), "o00000042")


@query("multi_get", f"with {FOLD}, q as (select 'u' || lpad(cast(c_custkey as varchar), 8, '0') as k from customer) select q.k as key, f.v as value, case when f.k is null then 'NOT_FOUND' end as code from q left join (select * from f where op = 'put') f using (k)")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(oplog.user_key(F.col("c_custkey")).alias("key"))
    return reads.multi_get(_view(spark, sf_dir), keys)


@query("scan_range", f"with {FOLD} select k as key, v as value from f where op = 'put' and k >= 'u00000020' and k < 'u00000090'")
def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(_view(spark, sf_dir), "u00000020", "u00000090")


@query("scan_limit", f"with {FOLD} select k as key, v as value from f where op = 'put' and k >= 'u00000000' and k < 'u00000090' order by k limit 25")
def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pairs of a range: a limit is the feature."""
    return reads.scan(_view(spark, sf_dir), "u00000000", "u00000090", 25)


@query("scan_page", f"with {FOLD} select k as key, v as value from f where op = 'put' and k > 'u00000040' and k < 'u00000150' order by k limit 10")
def scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.page(_view(spark, sf_dir), "u00000040", "u00000150", 10)


@query("prefix_scan", "select 'o' || lpad(cast(o_orderkey as varchar), 8, '0') as key, o_orderstatus as value from orders where starts_with(lpad(cast(o_orderkey as varchar), 8, '0'), '0000001')")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: a prefix is the range up to the next prefix."""
    return reads.scan(_orders(spark, sf_dir).select("key", "value"), "o0000001", encoding.prefix_end(b"o0000001").decode())


@query("replay_point_ops", f"with {POINT} select seq, op, k as key, observed, was_live from pt")
def replay_point_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.point_results(oplog.from_events(spark, sf_dir))


@query("put_previous", f"with {POINT} select seq, k as key, observed as previous from pt where op = 'put'")
def put_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.point_results(oplog.from_events(spark, sf_dir)).where("op = 'put'").select("seq", "key", F.col("observed").alias("previous"))


@query("delete_was_live", f"with {POINT} select seq, k as key, was_live as removed from pt where op = 'delete'")
def delete_was_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.point_results(oplog.from_events(spark, sf_dir)).where("op = 'delete'").select("seq", "key", F.col("was_live").alias("removed"))


SCANS = OPS + """, ver as (select k, op, v, seq as vf, lead(seq) over (partition by k order by seq) as vt from m),
sc as (select seq, k as lo, hi from ops where op = 'scan'),
sr as (select sc.seq, ver.k, ver.v from sc join ver on ver.op = 'put' and ver.k >= sc.lo and ver.k < sc.hi and ver.vf < sc.seq and (ver.vt is null or ver.vt > sc.seq))"""


@query("replay_scans", f"with {SCANS} select sc.seq, count(sr.k) as n, min(sr.k) as first_key, max(sr.k) as last_key, cast(null as varchar) as error from sc left join sr using (seq) group by sc.seq")
def replay_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.scan_results(oplog.from_events(spark, sf_dir), _bucket)


@query("replay_scan_pairs", f"with {SCANS} select seq as scan, k as key, v as value from sr")
def replay_scan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.scan_pairs(oplog.from_events(spark, sf_dir), _bucket)


@query("scan_errors", f"with {OPS} select seq, case when k >= k2 then 'invalid argument: scan: start must be < end' end as error from (select seq, k, 'u' || lpad(cast(seq % 150 as varchar), 8, '0') as k2 from ops where op = 'scan')")
def scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with a bound of their own, of which many are turned round."""
    ops = oplog.from_events(spark, sf_dir).withColumn("end", oplog.user_key(F.col("seq") % 150))
    return replay.scan_results(ops, _bucket).select("seq", "error")


@query("version_history", f"with {OPS} select k as key, op, v as value, seq as since, lead(seq) over (partition by k order by seq) as until from m")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.versions(_changes(spark, sf_dir))


@query("overwrites", f"with {OPS} select k as key, count(*) as n_versions, sum(case when op = 'delete' then 1 else 0 end)::bigint as deletes from m group by k")
def overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n_versions"), F.sum(F.when(F.col("op") == "delete", 1).otherwise(0)).cast("long").alias("deletes"))


@query("limit_violations", "select doc_id, octet_length(encode(text)) as bytes, case when octet_length(encode(text)) > 4096 then 'value is too long' end as message from documents")
def limit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    told = limits.violation(F.col("doc_id").cast("string"), F.col("text"), max_value=4096)
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), told.alias("message"))


@query("dense_prefix", "with s as (select l_orderkey as seq, count(*) as records from lineitem group by 1), g as (select min(x) as gap from (select seq + 1 as x from s union all select 0 as x) where x not in (select seq from s)) select seq, records from s, g where seq < gap")
def dense_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a log with holes, an order for each number: what lies below the first hole."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    log = lines.groupBy(F.col("l_orderkey").alias("seq")).agg(F.count("*").alias("records"))
    return oplog.dense_prefix(log)


def _layered(spark: SparkSession, sf_dir: str) -> layers.LayeredTable:
    """The log written as ten layers, a tenth of its numbers each."""
    changes = _changes(spark, sf_dir)
    last = changes.agg(F.max("seq")).first()[0] or 0
    made = layers.LayeredTable(spark, layers.scratch(spark))
    made.flush_parts(changes, F.expr(f"seq div {last // 10 + 1}"), 10)
    return made


TENTHS = FOLD + """, t as (select max(seq) // 10 + 1 as width from m), l as (select k, op, v, seq, layer from (select m.*, seq // width as layer, row_number() over (partition by seq // width, k order by seq desc) as rn from m, t) where rn = 1)"""


@query("flush_layer", f"with {TENTHS} select k as key, op, v as value from l where layer = 0")
def flush_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layered(spark, sf_dir).layer(0).select("key", "op", "value")


@query("merged_read", f"with {FOLD} select k as key, v as value from f where op = 'put'")
def merged_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten written layers read together are the live view."""
    return _layered(spark, sf_dir).read()


@query("compact_partial", f"with {TENTHS} select key, op, value from (select k as key, op, v as value, row_number() over (partition by k order by seq desc) as rn from l where layer < 8) where rn = 1")
def compact_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest eight layers as one that is written and read back; deletes stay."""
    made = _layered(spark, sf_dir)
    made.maintain()
    return made.layer(made.manifest().layers[0]).select("key", "op", "value")


@query("compact_full", f"with {FOLD} select k as key, v as value from f where op = 'put'")
def compact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers as one, by two merges; read without a fold, as one layer holds a key once and no deletes."""
    made = _layered(spark, sf_dir)
    made.maintain()
    made.compact()
    return made.layers(made.manifest().layers).select("key", "value")


@query("adopted_read", f"with {FOLD} select k as key, v as value from f where op = 'put'")
def adopted_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers whose manifest is lost are adopted by number, and read the same."""
    made = _layered(spark, sf_dir)
    made.forget()
    made.adopt()
    return made.read()


@query("vacuumed_read", f"with {FOLD}, t as (select count(distinct layer) as n from (select seq // (select max(seq) // 10 + 1 from m) as layer from m)) select k as key, v as value, n as gone from f, t where op = 'put'")
def vacuumed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a full compaction its inputs' folders are deleted, and reads stay the same."""
    made = _layered(spark, sf_dir)
    made.compact()
    gone = len(made.vacuum())
    return made.read().withColumn("gone", F.lit(gone).cast("long"))


@query("layer_stats", f"with {TENTHS} select layer, count(*) as records, sum(case when op = 'delete' then 1 else 0 end)::bigint as deletes, min(k) as first_key, max(k) as last_key from l group by layer")
def layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _layered(spark, sf_dir)
    each = made.layers(made.manifest().layers).withColumn("layer", F.col("layer").cast("long"))
    return each.groupBy("layer").agg(F.count("*").alias("records"), F.sum(F.when(F.col("op") == "delete", 1).otherwise(0)).cast("long").alias("deletes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


#: Bytes at which a tail is flushed, in the query of that.
THRESHOLD = 4096


@query("flush_due", f"with {TENTHS} select layer, bytes, bytes >= {THRESHOLD} as due from (select layer, sum(octet_length(encode(k)) + case when op = 'put' then coalesce(octet_length(encode(v)), 0) else 1 end)::bigint as bytes from l group by layer)")
def flush_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tenth of the log, as a tail of its own: its folded bytes, and whether they reach the threshold."""
    made = _layered(spark, sf_dir)
    each = made.layers(made.manifest().layers).groupBy(F.col("layer").cast("long").alias("layer")).agg(F.sum(fold.size_of()).cast("long").alias("bytes"))
    return each.withColumn("due", F.col("bytes") >= THRESHOLD)


@query("pending_bytes", f"with {FOLD} select count(*) as keys, sum(octet_length(encode(k)) + case when op = 'put' then coalesce(octet_length(encode(v)), 0) else 1 end)::bigint as bytes from f")
def pending_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.pending_bytes(_changes(spark, sf_dir))


@query("write_amplification", f"with {TENTHS}, w as (select sum(octet_length(encode(k)) + case when op = 'put' then coalesce(octet_length(encode(v)), 0) else 1 end)::bigint as written from l), h as (select sum(octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0))::bigint as live from f where op = 'put') select written, live, round(written / live, 6) as amplification from w, h")
def write_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ten written layers against bytes of the live pairs, by one scan of the layers."""
    made = _layered(spark, sf_dir)
    each = made.layers(made.manifest().layers).withColumn("bytes", fold.size_of())
    by_key = each.groupBy("key").agg(F.sum("bytes").alias("written"), F.max(F.struct("rank", "op", "bytes")).alias("m"))
    live = F.sum(F.when(F.col("m.op") == "put", F.col("m.bytes")).otherwise(0))
    return by_key.agg(F.sum("written").cast("long").alias("written"), live.cast("long").alias("live")).withColumn("amplification", F.round(F.col("written") / F.col("live"), 6))


@query("scrub_layer", f"with {TENTHS} select layer::integer as layer, count(*) as records, true as intact from l group by layer")
def scrub_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every written layer's files read back and compared with the count and checksum from when it was made."""
    return _layered(spark, sf_dir).scrub()


@query("orphan_layers", f"with {TENTHS} select distinct layer::integer as layer from l")
def orphan_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there and not listed after a full compaction: its inputs."""
    made = _layered(spark, sf_dir)
    made.compact()
    return spark.createDataFrame([(i,) for i in made.orphans()], "layer int")  # numbers of layers, not rows


@query("sorted_run_check", "select l_orderkey as key, count(*) as n from lineitem group by 1 having count(*) > 1")
def sorted_run_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that keep lineitem by order from being one strictly ascending run."""
    return layers.out_of_order(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("key")))


REQUESTS = f"""with {OPS}, r as (select seq, op, case when op = 'scan' then null else k end as k, case when op = 'put' then v end as v, case when op = 'scan' then k end as s, case when op = 'scan' then hi end as e from ops)"""


@query("wire_requests", f"{REQUESTS} select seq, op, k as key, v as value, s as start, e as \"end\", cast(null as varchar) as code from r")
def wire_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as request lines, and read back."""
    ops = oplog.from_events(spark, sf_dir)
    coded = {f"{c}_b64": encoding.to_base64(F.col(c).cast("binary")) for c in ("key", "value", "start", "end")}
    lines = ops.select(F.col("seq").alias("seq_in"), F.to_json(F.struct("seq", "op", *(v.alias(k) for k, v in coded.items()))).alias("line"))
    back = oplog.from_requests(lines)
    return back.select("seq", "op", *(F.col(c).cast("string").alias(c) for c in ("key", "value", "start", "end")), "code")


@query("refused_requests", "select event_id as seq_in, case event_id % 6 when 0 then null when 1 then 'unknown op' when 2 then 'key_b64 is missing' when 3 then 'request can''t be read' when 4 then 'key_b64 is not base64' else 'invalid argument: scan: start must be < end' end as message, case when event_id % 6 <> 0 then 'INVALID_ARGUMENT' end as code from events")
def refused_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of request lines, one of them good."""
    lines = ('{"seq":1,"op":"get","key_b64":"YQ=="}', '{"seq":1,"op":"cas","key_b64":"YQ=="}', '{"seq":1,"op":"get"}', "not json", '{"seq":1,"op":"get","key_b64":"YQ"}', '{"seq":1,"op":"scan","start_b64":"Yg==","end_b64":"YQ=="}')
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq_in"))
    line = F.element_at(F.array(*map(F.lit, lines)), (F.col("seq_in") % len(lines) + 1).cast("int"))
    return oplog.from_requests(events.select("seq_in", line.alias("line"))).select("seq_in", "message", "code")


@query("wire_responses", f"""with {POINT} select seq, case when op = 'get' and not was_live then '{{"seq":' || seq || ',"ok":false,"code":"NOT_FOUND","message":"key not found"}}'
  when op = 'get' then '{{"seq":' || seq || ',"ok":true,"value_b64":"' || base64(encode(observed)) || '"}}'
  when op = 'delete' then '{{"seq":' || seq || ',"ok":true,"removed":' || was_live || '}}' else '{{"seq":' || seq || ',"ok":true}}' end as response from pt""")
def wire_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.responses(oplog.from_events(spark, sf_dir))


LIMIT = "case when seq % 5 = 0 then null else seq % 7 end"


def _request_lines(ops: DataFrame) -> DataFrame:
    coded = {f"{c}_b64": encoding.to_base64(F.col(c).cast("binary")) for c in ("key", "value", "start", "end")}
    return ops.select(F.col("seq").alias("seq_in"), F.to_json(F.struct("seq", "op", *(v.alias(k) for k, v in coded.items()), F.expr(LIMIT).alias("limit"))).alias("line"))


@query("wire_scans", f"""with {SCANS}, n as (select sr.seq, sr.k, sr.v, row_number() over (partition by sr.seq order by sr.k) as place from sr),
p as (select seq, string_agg('{{"key_b64":"' || base64(encode(k)) || '","value_b64":"' || base64(encode(v)) || '"}}', ',' order by k) as pairs from n where place <= greatest(coalesce({LIMIT}, 1000), 1) group by seq)
select sc.seq as seq_in, '{{"seq":' || sc.seq || ',"ok":true,"pairs":[' || coalesce(pairs, '') || ']}}' as response from sc left join p using (seq)""")
def wire_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of scan requests with limits among writes, from an empty store."""
    ops = oplog.from_events(spark, sf_dir)
    empty = spark.createDataFrame([], "key binary, value binary")
    told = front.responses(empty, _request_lines(ops))
    return told.join(ops.where("op = 'scan'").select(F.col("seq").alias("seq_in")), "seq_in", "left_semi")


HALVES = OPS + """, t as (select max(seq) // 2 + 1 as width from ops), h as (select k, op, v, seq, row_number() over (partition by seq // width, k order by seq desc) as rn from m, t),
s as (select count(*) as records, sum(octet_length(encode(k)) + case when op = 'put' then coalesce(octet_length(encode(v)), 0) else 1 end)::bigint as bytes from h where rn = 1),
f as (select count(*) as live from (select op, row_number() over (partition by k order by seq desc) as rn from m) where rn = 1 and op = 'put')"""


@query("wire_admin", f"""with {HALVES}, a(seq, rest) as (select -4, '' union all select -3, '' union all select -2, ',"merged":true' union all select -1, ',"stats":{{"flushes":2,"flushed_records":' || records || ',"flushed_bytes":' || bytes || ',"compactions":1,"compacted_records":' || live || ',"tables":1}}' from s, f)
select '{{"seq":' || (5 + seq) || ',"ok":true' || rest || '}}' as response from a""")
def wire_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of writes, then sync, flush, compact and stats: what the requests do and answer."""
    ops = oplog.from_events(spark, sf_dir)
    width = (ops.agg(F.max("seq")).first()[0] or 0) // 2 + 1
    made = layers.LayeredTable(spark, layers.scratch(spark))
    for half in (0, 1):
        made.flush(oplog.mutations(ops.where(F.expr(f"seq div {width} = {half}"))), half)
    merged, m = made.compact(), made.manifest()
    lines = spark.createDataFrame([(i, f'{{"seq":{i},"op":"{op}"}}') for i, op in enumerate(front.ADMIN, 1)], "seq_in long, line string")
    none = made.read().select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    return front.responses(none, lines, merged=merged, stats=m.stats | {"tables": len(m.layers)}).select("response")


@query("base64_roundtrip", "select page_id, base64(encode(url)) as coded, true as same from pages")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", encoding.to_base64(F.col("url").cast("binary")).alias("coded"))
    return pages.select("page_id", "coded", (encoding.from_base64(F.col("coded")).cast("string") == F.col("url")).alias("same"))


@query("hex_keys", "select hex(encode('u' || lpad(cast(user_id as varchar), 8, '0'))) as key_hex, count(*) as n from events group by 1")
def hex_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.hex(oplog.user_key(F.col("user_id"))).alias("key_hex")).agg(F.count("*").alias("n"))


@query("frame_checksums")
def frame_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no CRC-32 there; tests compare with zlib."""
    changes = _changes(spark, sf_dir)
    return changes.select("seq", encoding.frame_checksum(F.col("seq"), F.col("op"), F.col("key"), F.col("value")).alias("crc"))


@query("bloom_membership", "select (select count(*) from orders) + (select count(*) from customer) as probes, 0::bigint as misses, true as few_false")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys are in the filter; customers' keys, under another letter, are not."""
    inside = _orders(spark, sf_dir).select("key")
    outside = spark.read.parquet(f"{sf_dir}/customer.parquet").select(encoding.load_key("c", F.col("c_custkey")).alias("key"))
    n = inside.count()
    probes = inside.withColumn("there", F.lit(True)).unionByName(outside.withColumn("there", F.lit(False)))
    asked = membership.might_contain(probes, membership.build(inside, n), n)
    wrong = lambda there: F.sum(F.when((F.col("there") == there) & (F.col("maybe") != there), 1).otherwise(0)).cast("long")
    few = wrong(False) <= 0.05 * F.sum(F.when(~F.col("there"), 1).otherwise(0))
    return asked.agg(F.count("*").alias("probes"), wrong(True).alias("misses"), few.alias("few_false"))


@query("load_report", "select event_type, count(value) as n, round(avg(value), 6) as mean, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.99) as p99, max(value) as most from events group by event_type")
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type").withColumn("mean", F.round("mean", 6))


@query("load_keys", "select o_orderkey % 8 as client, count(*) as n, min('o' || lpad(cast(o_orderkey as varchar), 8, '0')) as first_key, max('o' || lpad(cast(o_orderkey as varchar), 8, '0')) as last_key from orders group by 1")
def load_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys dealt to eight clients by stride."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.pmod("o_orderkey", F.lit(8)).alias("client"), encoding.load_key("o", F.col("o_orderkey")).alias("key"))
    return orders.groupBy("client").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def _loaded(spark: SparkSession, numbers: DataFrame) -> layers.LayeredTable:
    """Keys and values of numbers, written as a layer."""
    made = layers.LayeredTable(spark, layers.scratch(spark))
    made.flush(numbers.select(F.col("number").alias("seq"), F.lit("put").alias("op"), encoding.load_key("o", F.col("number")).alias("key"), encoding.load_value("o", F.col("number"), 64).alias("value")))
    return made


def _order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("number"))


@query("load_verify", "select count(*) as reads, 0::bigint as mismatches from orders")
def load_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that was written is read back from its layer and compared with what it must be."""
    numbers = _order_numbers(spark, sf_dir)
    return report.verified(_loaded(spark, numbers).read(), "o", numbers, 64)


@query("verify_only", "select count(*) as reads, sum(case when o_orderkey % 3 = 0 then 1 else 0 end)::bigint as mismatches from orders")
def verify_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that another job has loaded is verified alone: what that job has left out is told."""
    numbers = _order_numbers(spark, sf_dir)
    return report.verified(_loaded(spark, numbers.where("number % 3 <> 0")).read(), "o", numbers, 64)


VOTES = "v as (select event_id as seq, event_id // 100 as term, user_id % 5 as voter, (user_id // 5) % 2 as candidate from events)"


@query("raft_votes", f"with {VOTES}, f as (select term, voter, candidate from (select *, row_number() over (partition by term, voter order by seq) as rn from v) where rn = 1) select term, candidate, count(*) as votes from f group by term, candidate having count(*) >= 3")
def raft_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners of elections among five nodes whose votes the events stand for."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    votes = events.select(F.col("event_id").alias("seq"), F.expr("event_id div 100").alias("term"), (F.col("user_id") % 5).alias("voter"), F.expr("(user_id div 5) % 2").alias("candidate"))
    return quorum.elected(votes, 5)


@query("raft_quorum_commit", "with b as (select event_id // 100 as term, user_id % 5 as node, max(event_id) as mi from events group by 1, 2), r as (select term, mi, row_number() over (partition by term order by mi desc) as rn from b) select term, mi as commit from r where rn = 3")
def raft_quorum_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    matches = events.select(F.expr("event_id div 100").alias("term"), (F.col("user_id") % 5).alias("node"), F.col("event_id").alias("match_index"))
    return quorum.commit_index(matches, 5)


FRESH = """w as (select event_id as seq, event_id // 100 as term, user_id % 5 as voter, (user_id // 5) % 2 as candidate from events where (event_id % 7, user_id % 11) >= ((event_id // 3) % 7, user_id % 5))"""


@query("raft_fresh_votes", f"with {FRESH}, f as (select term, voter, candidate from (select *, row_number() over (partition by term, voter order by seq) as rn from w) where rn = 1) select term, candidate, count(*) as votes from f group by term, candidate having count(*) >= 3")
def raft_fresh_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners among candidates whose log is not behind the voter's."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    votes = events.selectExpr(
        "event_id as seq", "event_id div 100 as term", "user_id % 5 as voter", "(user_id div 5) % 2 as candidate",
        "event_id % 7 as last_term", "user_id % 11 as last_index", "(event_id div 3) % 7 as own_term", "user_id % 5 as own_index",
    )
    return quorum.elected(quorum.fresh(votes), 5)


@query("raft_current_term_commit", "with b as (select event_id // 100 as term, user_id % 5 as node, max(event_id) as mi from events group by 1, 2), r as (select term, mi, row_number() over (partition by term order by mi desc) as rn from b) select term, mi as commit from r where rn = 3 and mi % 4 <> 0")
def raft_current_term_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As raft_quorum_commit, where every fourth entry is of an older term and so does not commit by count."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    matches = events.select(F.expr("event_id div 100").alias("term"), (F.col("user_id") % 5).alias("node"), F.col("event_id").alias("match_index"))
    entries = events.select(F.col("event_id").alias("index"), F.expr("event_id div 100 - if(event_id % 4 = 0, 1, 0)").alias("term"))
    return quorum.commit_index(matches, 5, entries)


LOGS = "logs as (select n.node, event_id as idx, case when n.node = 2 and event_id >= 700 then event_id // 100 + 1 else event_id // 100 end as term, event_type as command from events, (values (0), (1), (2)) n(node))"


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nodes' logs; the last node's differ in term from index 700 on."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("index"), F.col("event_type").alias("command"))
    told = events.withColumn("node", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return told.withColumn("term", F.expr("index div 100 + if(node = 2 and index >= 700, 1, 0)"))


@query("raft_divergence", f"with {LOGS} select min(a.idx) as first_conflict from logs a join logs b using (idx) where a.node = 0 and b.node = 2 and a.term <> b.term")
def raft_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quorum.divergence(_logs(spark, sf_dir), 0, 2)


@query("raft_log_matching", "select event_id // 5 as \"index\", event_id // 100 as term from events group by 1, 2 having count(distinct event_type) > 1")
def raft_log_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one index and term that differ, among logs of five nodes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    logs = events.select((F.col("event_id") % 5).alias("node"), F.expr("event_id div 5").alias("index"), F.expr("event_id div 100").alias("term"), F.col("event_type").alias("command"))
    return quorum.disagreements(logs)


@query("raft_apply_once", "select event_id as \"index\", event_type as command from events where event_id > 120 and event_id <= 640")
def raft_apply_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quorum.newly_applied(_logs(spark, sf_dir).where("node = 0"), 120, 640).select("index", "command")


@query("error_codes", "select * from (values " + ", ".join(f"('{c}', {str(r).lower()})" for c, r in limits.CODES) + ") t(code, retryable)")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.error_codes(spark)


@query("generated_replay")
def generated_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded stream's point results; tests compare them with a dictionary."""
    return replay.point_results(oplog.generated(spark, 10_000, seed=7))


@query("generated_wide_replay")
def generated_wide_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over 65,536 keys with values of up to eight bytes."""
    return replay.point_results(oplog.generated(spark, 20_000, seed=11, keys=1 << 16, most=8))

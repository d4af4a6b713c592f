"""Structured Streaming: mutations from a folder become layers, once for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldstone.operators.front import accepted, as_operations, good, responses
from foldstone.operators.layers import LayeredTable, dropped, scratch
from foldstone.sources.oplog import mutations, numbered


def into_layers(table: LayeredTable, ops: DataFrame, checkpoint: str, compact: bool = True) -> StreamingQuery:
    """Flush each micro-batch as a layer; a batch that is tried again after a failure changes nothing."""

    def flush(batch: DataFrame, number: int) -> None:
        table.flush(mutations(batch), number)
        if compact:
            table.maintain()

    return ops.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def op_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def serve(table: LayeredTable, lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Answer streams of request lines: the writes of batch n become a layer, then its responses are written to out/batch=n.

    lines has a column value. Reads see the writes before them. sync, flush, compact and stats act once
    for a batch, after its writes: when their answers appear, the writes are a layer, all layers are
    one if a compact was asked for, and the counters are those after it. A batch that is tried again
    is answered from the layers before it, which the manifest still names, and writes nothing twice."""

    def answer(batch: DataFrame, number: int) -> None:
        read = batch.select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at")).persist()
        placed = numbered(read, "at").select(F.col("seq").alias("seq_in"), "line").persist()
        asked = accepted(placed)
        if number > table.manifest().last_batch:
            table.flush(as_operations(asked).where(F.col("op").isin("put", "delete")).select("seq", "op", "key", "value"), number)
            if not good(asked).where("op = 'compact' and _row >= 0").isEmpty():
                table.compact(of_batch=True)
            table.maintain()
        m = table.manifest()
        if number == m.last_batch:
            folder = scratch(table.spark)
            made = responses(table.read(of=m.before), placed, merged=m.merged, stats=m.stats | {"tables": len(m.layers)}, folder=folder)
            made.orderBy("seq_in").select(F.col("response").alias("value")).write.mode("overwrite").text(f"{out}/batch={number}")
            dropped(table.spark, folder)
        placed.unpersist()
        read.unpersist()

    return lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

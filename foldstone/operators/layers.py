"""Immutable sorted layers and their merge, as partitions of one Parquet table that a small manifest lists.

Data files are written first, then the manifest is replaced; only then may the log be dropped. A
reader keeps the manifest it began with; inputs of a compaction are deleted by vacuum, later. The
manifest holds each layer's number of rows and checksum as they were when it was made, so files can
be read back and compared."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foldstone.functions.limits import EngineError

from .fold import newest, pending_bytes, size_of

#: Layers that are merged at once, and the number at which that begins.
FAN = 8
VERSION = 1


@dataclass
class Manifest:
    next_id: int = 0
    layers: list[int] = field(default_factory=list)  # oldest first
    last_batch: int = -1  # of the stream, already flushed; later ones have higher numbers
    before: list[int] = field(default_factory=list)  # the layers before that batch, and whether it merged all
    merged: bool = False
    made: dict[str, list[int]] = field(default_factory=dict)  # rows and checksum of each layer
    stats: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("flushes", "flushed_records", "flushed_bytes", "compactions", "compacted_records", "compacted_bytes"), 0))


def digest(where: Column | None = None) -> list[Column]:
    """Aggregates of a layer's rows, in any order: records, checksum and bytes."""
    only = (lambda x: x) if where is None else (lambda x: F.when(where, x))
    return [F.count(only(F.lit(1))), F.coalesce(F.bit_xor(only(F.xxhash64("key", "op", "value"))), F.lit(0)), F.coalesce(F.sum(only(size_of())), F.lit(0)).cast("long")]


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names (a local one only where all runs on one machine), until the session ends."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="foldstone-")
    path = f"{where.rstrip('/')}/foldstone-layers-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def kept(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """rows, written into a scratch folder and read back: what several steps read is computed once."""
    rows.write.parquet(f"{folder}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder before the session ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def out_of_order(rows: DataFrame, key: str = "key") -> DataFrame:
    """Keys that a sorted run must not have: those with a second row. Rows of a layer are sorted when written."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


class LayeredTable:
    """A folder of layers, a manifest, and one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "string", value_type: str = "string", fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.schema = f"key {key_type}, op string, value {value_type}"
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def manifest(self) -> Manifest:
        at = self._at(f"{self.path}/manifest.json")
        if not self._fs.exists(at):
            return Manifest()
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifest.json").collect())  # one short line
        try:
            known = json.loads(text)
            if known.pop("version") != VERSION:
                raise ValueError("version")
            return Manifest(**known)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise EngineError("CORRUPTION", f"manifest can't be read: {e}") from e

    def _publish(self, m: Manifest) -> None:
        new, at = self._at(f"{self.path}/manifest.json.tmp"), self._at(f"{self.path}/manifest.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps({"version": VERSION} | vars(m)).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, at, options)

    def _folder(self, layer: int) -> str:
        return f"{self.path}/layer={layer}"

    def layer(self, layer: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._folder(layer))

    def layers(self, numbers: list[int]) -> DataFrame:
        """(key, op, value, layer, rank) of several layers by one scan; rank: the place in numbers."""
        if not numbers:
            return self.spark.createDataFrame([], self.schema + ", layer int, rank int")
        rows = self.spark.read.schema(self.schema + ", layer int").option("basePath", self.path).parquet(*map(self._folder, numbers))
        return rows.withColumn("rank", F.array_position(F.array(*map(F.lit, numbers)), F.col("layer")).cast("int"))

    def _write(self, rows: DataFrame, first: int, parts: int = 1) -> list[list[int]]:
        """Layers from first on of rows(key, op, value, part), range-partitioned and sorted, with statistics and a Bloom filter on the key.

        Rows, checksum and bytes of each, observed while it is written."""
        for p in range(parts):  # what a writer left there that did not come to publish it
            self._fs.delete(self._at(self._folder(first + p)), True)
        seen = Observation()
        sums = [c.alias(f"{k}_{p}") for p in range(parts) for k, c in zip("rcb", digest(F.col("layer") == first + p), strict=True)]
        rows = rows.select("key", "op", "value", (F.col("part") + first).alias("layer")).repartitionByRange("layer", "key").sortWithinPartitions("layer", "key")
        # Observed behind the exchange, whose sample runs what is before it a second time.
        (rows.observe(seen, *sums).write.mode("append").partitionBy("layer").option("parquet.bloom.filter.enabled#key", "true").parquet(self.path))
        there = set(self._there())
        return [[seen.get[f"{k}_{p}"] for k in "rcb"] if first + p in there else [0, 0, 0] for p in range(parts)]

    def _add(self, m: Manifest, rows: DataFrame, parts: int) -> bool:
        """New layers into a manifest, those without rows left out; whether there is any."""
        some = False
        for p, (records, checksum, size) in enumerate(self._write(rows, m.next_id, parts)):
            if records:
                m.layers.append(m.next_id + p)
                m.made[str(m.next_id + p)] = [records, checksum]
                for k, v in (("flushes", 1), ("flushed_records", records), ("flushed_bytes", size)):
                    m.stats[k] += v
                some = True
        m.next_id += parts
        return some

    def flush(self, tail: DataFrame, batch: int | None = None) -> bool:
        """Fold a tail of mutations into a new layer; False if it is empty or the batch is already there."""
        m = self.manifest()
        if batch is not None and batch <= m.last_batch:
            return False
        if batch is not None:
            m.last_batch, m.before, m.merged = batch, list(m.layers), False
        some = self._add(m, newest(tail).withColumn("part", F.lit(0)), 1)
        self._publish(m)
        return some

    def flush_parts(self, tail: DataFrame, part: Column, parts: int) -> None:
        """A tail as so many layers by one job, oldest part first; part counts from 0."""
        m = self.manifest()
        newest_ = F.max(F.struct("seq", "op", "value")).alias("m")
        self._add(m, tail.groupBy(part.cast("int").alias("part"), "key").agg(newest_).select("key", "m.op", "m.value", "part"), parts)
        self._publish(m)

    def maybe_flush(self, tail: DataFrame, threshold: int) -> bool:
        """Flush a tail if its folded bytes have reached a threshold; whether it did."""
        return pending_bytes(tail).first()["bytes"] >= threshold and self.flush(tail)

    def _merge(self, m: Manifest, n: int, drop_deleted: bool) -> None:
        out = newest(self.layers(m.layers[:n]), "rank")
        ((records, checksum, size),) = self._write((out.where("op = 'put'") if drop_deleted else out).withColumn("part", F.lit(0)), m.next_id)
        for gone in m.layers[:n]:
            m.made.pop(str(gone), None)
        m.layers = ([m.next_id] if records else []) + m.layers[n:]
        if records:
            m.made[str(m.next_id)] = [records, checksum]
        m.next_id += 1
        for k, v in (("compactions", 1), ("compacted_records", records), ("compacted_bytes", size)):
            m.stats[k] += v
        self._publish(m)

    def maintain(self) -> int:
        """Merge the oldest layers while there are fan or more, keeping deletes; how often it did."""
        done = 0
        while len((m := self.manifest()).layers) >= self.fan:
            self._merge(m, self.fan, drop_deleted=False)
            done += 1
        return done

    def compact(self, of_batch: bool = False) -> bool:
        """Merge all layers and drop deletes; False with fewer than two. of_batch: the last batch asked for it, which the manifest notes."""
        m = self.manifest()
        if len(m.layers) < 2:
            return False
        m.merged = of_batch
        self._merge(m, len(m.layers), drop_deleted=True)
        return True

    def read(self, tail: DataFrame | None = None, of: list[int] | None = None) -> DataFrame:
        """(key, value) of the live keys, of the layers that the manifest lists now (or of those given) and a tail newer than all of them."""
        numbers = self.manifest().layers if of is None else of
        rows = self.layers(numbers).select("key", "op", "value", "rank")
        if tail is not None:
            rows = rows.unionByName(newest(tail).select("key", "op", "value", F.lit(len(numbers) + 1).alias("rank")))
        return newest(rows, "rank").where("op = 'put'").select("key", "value")

    def scrub(self) -> DataFrame:
        """(layer, records, intact) of the listed layers, their files read back and compared with what the manifest says."""
        m = self.manifest()
        told = self.spark.createDataFrame([(i, *m.made.get(str(i), [None, None])) for i in m.layers], "layer int, made long, was long")
        records, checksum, _ = digest()
        read = self.layers(m.layers).groupBy("layer").agg(records.alias("records"), checksum.alias("checksum"))
        same = (F.col("records") == F.col("made")) & (F.col("checksum") == F.col("was"))
        return told.join(read, "layer", "left").select("layer", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce(same, F.lit(False)).alias("intact"))

    def _there(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n[6:]) for n in names if n.startswith("layer=") and n[6:].isdigit())

    def forget(self) -> None:
        """Delete the manifest, as a crash may lose it."""
        self._fs.delete(self._at(f"{self.path}/manifest.json"), False)

    def adopt(self) -> list[int]:
        """List the layers of a folder without a manifest, by number, with their rows and checksums as they are; the manifest's layers."""
        m = self.manifest()
        if not self._fs.exists(self._at(f"{self.path}/manifest.json")):
            m.layers = self._there()
            m.next_id = max(m.layers, default=-1) + 1
            records, checksum, _ = digest()
            m.made = {str(r.layer): [r.records, r.checksum] for r in self.layers(m.layers).groupBy("layer").agg(records.alias("records"), checksum.alias("checksum")).collect()}
            self._publish(m)
        return m.layers

    def orphans(self) -> list[int]:
        """Layers that are there and that the manifest neither lists nor keeps for the last batch's answers."""
        m = self.manifest()
        return sorted(set(self._there()) - set(m.layers) - set(m.before))

    def vacuum(self) -> list[str]:
        """Delete orphans and staging files; their names."""
        keep = {f"layer={i}" for i in self._there()} - {f"layer={i}" for i in self.orphans()} | {"manifest.json", "_SUCCESS"}
        gone = [s.getPath() for s in self._fs.listStatus(self._at(self.path)) if s.getPath().getName() not in keep and not s.getPath().getName().startswith(".")]
        for at in gone:
            self._fs.delete(at, True)
        return sorted(at.getName() for at in gone)

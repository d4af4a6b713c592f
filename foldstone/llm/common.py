"""Helpers that the operators share: table reading, shared scratch tables, text blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_digest

#: White space of every word definition in this subpackage: space and bytes 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is named and all runs on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="foldstone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Folders that this process has staged and not dropped, in order.
_STAGED: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    The folder goes when the session ends, or before by drop_staged or drop_since."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/foldstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    _STAGED.remove(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the table that staged() made df of, once nothing reads it any more."""
    own = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
    for path in [p for p in _STAGED if p.rsplit("/", 1)[-1] in own]:
        _drop(df.sparkSession, path)


def staged_so_far() -> int:
    return len(_STAGED)


def drop_since(spark: SparkSession, count: int, but: DataFrame) -> None:
    """Delete what was staged since there were count tables, but for the one that is read as but."""
    own = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in but.inputFiles()}
    for path in [p for p in _STAGED[count:] if p.rsplit("/", 1)[-1] not in own]:
        _drop(spark, path)


def fold_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null value counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def text_blocks(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters together, at least one text each."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


#: An odd multiplier of rolling hashes modulo 2**64, and the seed of words' hashes.
_BASE, _SEED = 0x9E3779B97F4A7C15, 20_240_229
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_parts(text: str, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text's words, A-Z lower-cased, as bytes; a long text in parts that end at white space."""
    data = text.encode("utf-8", "surrogatepass").lower()  # of bytes, so only A-Z change
    at = 0
    while at < len(data):
        blank = _BLANK.search(data, at + size)
        end = blank.end() if blank else len(data)
        yield data[at:end].split()  # at space and bytes 9 to 13
        at = end


def word_values(texts: Iterable[str], values: Callable[[list[bytes]], np.ndarray], last: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """values() of the words of all texts end to end, last after each text, and the places where each text begins."""
    made, held, sizes = [values([])], [], [0]
    for text in texts:
        n = 0
        for words in word_parts(text):
            held += words
            n += len(words)
            if len(held) > 1 << 17:
                made.append(values(held))
                held = []
        if last is not None:
            held.append(last)
            n += 1
        sizes.append(n)
    made.append(values(held))
    return np.concatenate(made), np.cumsum(sizes)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word's bytes (XXH3)."""
    return np.frombuffer(b"".join([xxh3_64_digest(w, _SEED) for w in words]), ">u8").astype(np.uint64)


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's size-word shingles; fewer words make one, none an empty set."""
    for a, b in text_blocks(texts):
        words, at = word_values(texts[a:b], word_hashes)
        rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(_BASE) + words[k : k + len(rolled)]
        rolled = mix(rolled) >> np.uint64(1)  # so that signed columns keep the order
        for i in range(b - a):
            lo, hi = at[i], at[i + 1]
            if hi - lo >= size:
                yield np.unique(rolled[lo : hi - size + 1])
            elif hi > lo:
                own = np.uint64(hi - lo)
                with np.errstate(over="ignore"):
                    for w in words[lo:hi]:
                        own = own * np.uint64(_BASE) + w
                yield mix(np.array([own ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)) >> np.uint64(1)
            else:
                yield np.zeros(0, np.uint64)


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow for functions from and to columns as a dict of lists or arrays, so that nulls and long ids stay as they are."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for out in function({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)} for b in batches):
            yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind) and len(values) and isinstance(values[0], np.ndarray):
        offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), kind.value_type), type=kind)
    return pa.array(values, kind)

"""Approximate membership: a Bloom filter as a table of 64-bit words, built and asked by joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizes(n: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions (1 to 16) for n keys; the rate is held within 0.0001 and 0.5."""
    rate = min(max(rate, 0.0001), 0.5)
    bits = max(64, 64 * math.ceil(-max(n, 1) * math.log(rate) / math.log(2) ** 2 / 64))
    return bits, min(max(round(bits / max(n, 1) * math.log(2)), 1), 16)


def _places(key: Column, bits: int, hashes: int) -> Column:
    """Distinct bits of a key, by double hashing."""
    a, b = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * b, F.lit(bits))))


def build(keys: DataFrame, n: int, rate: float = 0.01) -> DataFrame:
    """(word, mask) of the words that have a bit set."""
    bits, hashes = sizes(n, rate)
    places = keys.select(F.explode(_places(F.col("key"), bits, hashes)).alias("place"))
    word, bit = (F.col("place") / 64).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    return places.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("mask"))


def might_contain(probes: DataFrame, words: DataFrame, n: int, rate: float = 0.01) -> DataFrame:
    """probes(key) with maybe: False only if the key was never put in."""
    bits, hashes = sizes(n, rate)
    asked = probes.select("key").distinct().select("key", F.explode(_places(F.col("key"), bits, hashes)).alias("place"))
    asked = asked.select("key", (F.col("place") / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int")).alias("bit"))
    hit = F.coalesce(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    told = asked.join(words, "word", "left").groupBy("key").agg(F.every(hit).alias("maybe"))
    return probes.join(told, "key")

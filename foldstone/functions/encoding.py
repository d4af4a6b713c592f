"""Binary functions: strict base64, frames with a checksum, ordered keys and prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_base64(data: Column) -> Column:
    """Without the line breaks that Spark puts in by default."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def from_base64(text: Column) -> Column:
    """The bytes of canonical base64, else null: what does not encode back to the text is refused."""
    data = F.try_to_binary(text, F.lit("base64"))
    return F.when(to_base64(data) == text, data)


def frame_checksum(seq: Column, op: Column, key: Column, value: Column) -> Column:
    """CRC-32 of a mutation's bytes: sequence, kind, key and value with their lengths."""
    parts = [F.lpad(F.hex(seq), 16, "0"), F.when(op == "put", "01").otherwise("02")]
    for c in (key, value):
        data = c.cast("binary")
        parts += [F.lpad(F.hex(F.coalesce(F.octet_length(data), F.lit(0))), 8, "0"), F.coalesce(F.hex(data), F.lit(""))]
    return F.crc32(F.unhex(F.concat(*parts)))


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys that begin with prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def load_key(prefix: str, number: Column) -> Column:
    """prefix and eight digits."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 8, "0"))


def load_value(prefix: str, number: Column, size: int) -> Column:
    """size hexadecimal characters that are a function of prefix and number."""
    rounds = -(-size // 64)
    return F.substring(F.concat(*(F.sha2(F.concat_ws("/", F.lit(prefix), number.cast("string"), F.lit(str(r))), 256) for r in range(rounds))), 1, size)

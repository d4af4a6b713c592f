"""One command on a folder of layers; python -m foldstone.cli --help tells which."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foldstone.functions.limits import EngineError, clamped_limit
from foldstone.operators import reads
from foldstone.operators.layers import LayeredTable


def run(spark: SparkSession, path: str, command: str, args: list[str]) -> list[str]:
    """The lines that a command prints."""
    table = LayeredTable(spark, path)
    if command in ("put", "del") and len(args) == 1 + (command == "put"):
        if not args[0]:
            raise EngineError("INVALID_ARGUMENT", "key must not be empty")
        row = (0, "put" if command == "put" else "delete", args[0], args[1] if command == "put" else None)
        table.flush(spark.createDataFrame([row], "seq long, op string, key string, value string"))
        table.maintain()
        return ["OK"]
    if command == "get" and len(args) == 1:
        found = reads.get(table.read(), args[0]).first()
        if found is None:
            raise EngineError("NOT_FOUND", "key not found")
        return [found.value]
    if command == "scan" and len(args) in (2, 3):
        most = spark.range(1).select(clamped_limit(F.lit(int(args[2])) if len(args) == 3 else F.lit(None).cast("int")).alias("n")).first().n
        return [f"{r.key}\t{r.value}" for r in reads.scan(table.read(), args[0], args[1], most).collect()]
    if command in ("sync", "flush") and not args:
        return ["OK"]  # every command's writes are a layer before it ends
    if command == "compact" and not args:
        return [f"merged={str(table.compact()).lower()}"]
    if command == "stats" and not args:
        m = table.manifest()
        return [f"{k}={v}" for k, v in (m.stats | {"layers": len(m.layers)}).items()]
    raise EngineError("INVALID_ARGUMENT", "unknown command or arguments")


def main() -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--dir", required=True)
    parser.add_argument("command", choices=("put", "get", "del", "scan", "sync", "flush", "compact", "stats"))
    parser.add_argument("args", nargs="*", help="a key and what else the command needs: a value, or an end and at most how many")
    given = parser.parse_args()
    spark = SparkSession.builder.appName("foldstone").config("spark.ui.enabled", "false").getOrCreate()
    try:
        print(*run(spark, given.dir, given.command, given.args), sep="\n")
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

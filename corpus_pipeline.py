"""The corpus pipeline: quality rules, near-dedup, decontamination, secrets, token ids.

Each stage takes what the one before has kept; all but the last return the columns of documents.
Rows are judged by their own texts, so null and repeated ids change nothing: of rows that repeat a text
near-dedup keeps one, the others keep all. Null and empty texts fail the quality rules, and pass any
other stage. Very long texts are handled whole. Empty tables give empty tables. Columns besides those
of documents, whatever their names, are carried along to the last stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.llm.common import drop_since, drop_staged, staged, staged_so_far, table
from foldstone.llm.decontaminate import without_leaks
from foldstone.llm.near_dup import near_duplicates
from foldstone.llm.pieces import Model, encoded
from foldstone.llm.quality import good_rows
from foldstone.llm.queries import PIECES
from foldstone.llm.secrets import redacted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a rule of the threshold table go."""
    return good_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard of 0.8 or more; each group's row of the smallest id stays (of no id only if none has one).

    Rows are told apart by a number that is written with them, so rows without an id and rows that
    share one are each judged by their own text. Texts are moved only if the rows to drop are too many
    to broadcast."""
    row = next(n for n in ("row", *(f"row{i}" for i in range(len(docs.columns)))) if n not in docs.columns)
    docs = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    told = near_duplicates(docs, shingle=5, num=80, id_col=row).select(F.col(row).alias("own"), F.col("component_id").alias("group"))
    told = staged(told, "groups")
    ids = docs.select(F.col(row).alias("own"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("own")).alias("rank"))
    groups = told.join(ids, "own").groupBy("group").agg(F.count("*").alias("n"), F.min("rank").alias("first")).where("n > 1")
    groups = staged(groups.select("group", F.col("first.own").alias("kept")), "kept")
    gone = told.where("own <> group").select("own").union(groups.select(F.col("group").alias("own")))
    gone = staged(gone.join(groups.select(F.col("kept").alias("own")), "own", "left_anti"), "gone")
    return docs.join(gone.withColumnRenamed("own", row), row, "left_anti").drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document that is left."""
    return encoded(docs, Model.load(PIECES))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("pieces", piece_ids),
]

#: SQL expresses neither the edit matching nor the character models nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = staged_so_far()
        made = staged(stage(spark, docs, sf_dir), name)
        # The stage's input and its own scratch tables go as soon as its output is written.
        drop_since(spark, before, made)
        if name != STAGES[0][0]:
            drop_staged(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)

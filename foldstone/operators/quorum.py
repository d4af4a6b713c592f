"""Replication rules as queries over tables of votes, logs and acknowledgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(nodes: int) -> int:
    return nodes // 2 + 1


def elected(votes: DataFrame, nodes: int) -> DataFrame:
    """(term, candidate, votes) of the winners; votes(term, voter, candidate, seq), of which a voter's first in a term counts."""
    once = votes.groupBy("term", "voter").agg(F.min(F.struct("seq", "candidate")).alias("first"))
    told = once.groupBy("term", F.col("first.candidate").alias("candidate")).agg(F.count("*").alias("votes"))
    return told.where(F.col("votes") >= majority(nodes))


def fresh(votes: DataFrame) -> DataFrame:
    """The votes that may be given: the candidate's log (last_term, last_index) is not behind the voter's (own_term, own_index)."""
    return votes.where("struct(last_term, last_index) >= struct(own_term, own_index)")


def commit_index(matches: DataFrame, nodes: int, entries: DataFrame | None = None) -> DataFrame:
    """(term, commit): the highest index that a majority of nodes holds; matches(term, node, match_index).

    With entries(index, term), a term commits only if the entry there is its own; older ones go with it."""
    best = matches.groupBy("term", "node").agg(F.max("match_index").alias("match_index"))
    ranked = best.groupBy("term").agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("held"))  # a value for each node
    out = ranked.where(F.size("held") >= majority(nodes)).select("term", F.element_at("held", majority(nodes)).alias("commit"))
    return out if entries is None else out.join(entries.select(F.col("index").alias("commit"), "term"), ["commit", "term"], "left_semi").select("term", "commit")


def disagreements(logs: DataFrame) -> DataFrame:
    """(index, term): places where entries of one index and term differ between nodes; logs(node, index, term, command)."""
    return logs.groupBy("index", "term").agg(F.countDistinct("command").alias("n")).where("n > 1").select("index", "term")


def divergence(logs: DataFrame, a: int, b: int) -> DataFrame:
    """(first_conflict): the least index at which two nodes' entries have other terms, from which a follower's log is cut; null if none."""
    x, y = (logs.where(F.col("node") == n).select("index", F.col("term").alias(f"term_{s}")) for n, s in ((a, "a"), (b, "b")))
    return x.join(y, "index").where("term_a <> term_b").agg(F.min("index").alias("first_conflict"))


def newly_applied(log: DataFrame, last_applied: int, commit: int) -> DataFrame:
    """The committed entries that were not applied yet; applying up to commit again gives none."""
    return log.where((F.col("index") > last_applied) & (F.col("index") <= commit)).orderBy("index")

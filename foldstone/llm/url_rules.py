"""URL filters: fixed host and path rules, and association rules that pattern growth mines from labels.

Urls that a fixed rule decides are the labels. Their tokens (labels of the host with their place,
parts of the path, names of the query) and the label make a basket. Frequent combinations are grown
as FP-growth grows them: equal baskets become one with its number (which is what the tree is for),
and a combination is extended, a level at a time, by the frequent tokens that come after its last one
in the baskets that hold it. Spark's own FPGrowth can't be used: it has no bound on length and lists
2**k sets for k tokens that stand together in urls, as the names of long queries do. Here a
combination grows only up to TOKENS, and only if a longer one can still say more: not if it is
sure already, nor if a part of it stands in the same baskets (a longer one then has the same baskets
as a shorter one). Both leave out redundant rules alone, so the rules are exactly those of all
combinations of up to TOKENS tokens.

Rules from tokens to the label block are kept if their support and confidence reach the bounds, they
say more than the share of blocked labels does, and no more general rule is as sure. There is no
bound on their number: they are a table, with an inverted index from each rule's rarest token. A
url meets the rules of its tokens by a join, and any rule whose tokens it all has blocks it.

Null urls and urls without :// have empty host and path, match no fixed rule and have no tokens, so
they are allowed. Of fixed rules that fit, the longest wins; two rules of one length can't both fit
unless they are the same text, of which the first listed wins. Repeated rows are judged each on its
own; very long urls are read whole; an empty table gives no rows. Other columns play no part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: (verdict, host, path), fixed by contract; a rule's text is host + path.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Least share of transactions, confidence and lift of a mined rule, and most tokens in it.
SUPPORT, CONFIDENCE, LIFT, TOKENS = 0.005, 0.8, 1.05, 4
#: Least number of transactions of a mined rule, whatever their share: below it a share is chance.
LEAST = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract defines them; both are empty without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # longer rules are asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels from the right with their place, path parts with digits made one 0, names of query fields."""
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    folders = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p="), F.regexp_replace(x, r"\d+", "0")))
    names = F.transform(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: F.split(x, "=")[0])
    fields = F.transform(F.filter(names, lambda x: x != ""), lambda x: F.concat(F.lit("q="), x))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(labels, folders, fields)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(tokens, confidence, support) of the rules towards block, from (tokens, verdict); tokens in order."""
    spark = labelled.sparkSession
    blocked = F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0))
    baskets = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n")).groupBy("tokens").agg(F.sum("n").alias("n"), blocked.alias("b"))
    baskets = staged(baskets, "baskets")
    whole = baskets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    empty = spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    if not whole["b"]:
        return empty
    enough = max(least, support * whole["n"])
    sure = max(confidence, LIFT * whole["b"] / whole["n"])
    # Rows to grow: a basket, and where in it the combination ends. Only tokens that are frequent in blocked baskets remain.
    usual = baskets.select(F.explode("tokens").alias("token"), "b").groupBy("token").agg(F.sum("b").alias("b")).where(F.col("b") >= enough).select("token")
    one = baskets.select("tokens", "n", "b", F.explode("tokens").alias("token")).join(usual, "token")
    items = one.groupBy("tokens").agg(F.first("n").alias("n"), F.first("b").alias("b"), F.array_sort(F.collect_set("token")).alias("items"))
    rows = staged(items.groupBy("items").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).withColumn("set", F.array().cast("array<string>")), "grown")
    found, before = empty, None
    for level in range(1, TOKENS + 1):
        after = F.filter("items", lambda x: F.coalesce(x > F.element_at("set", -1), F.lit(True))) if level > 1 else F.col("items")
        grown = rows.select("items", "n", "b", "set", F.explode(after).alias("token")).select("items", "n", "b", F.concat("set", F.array("token")).alias("set"))
        sets = grown.groupBy("set").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).where(F.col("b") >= enough).withColumn("c", F.col("b") / F.col("n"))
        if before is None:
            told = sets.withColumn("below", F.lit(-1.0))
        else:  # all parts one shorter must be growing ones, none in the same baskets; below: the surest rule within
            part = F.explode(F.transform(F.sequence(F.lit(1), F.lit(level)), lambda i: F.concat(F.slice("set", 1, i - 1), F.slice("set", i + 1, level))))
            each = sets.select("set", "n", "b", "c", part.alias("part")).join(before.select(F.col("set").alias("part"), F.col("n").alias("part_n"), "best"), "part")
            told = each.groupBy("set", "n", "b", "c").agg(F.count("*").alias("parts"), F.min("part_n").alias("fewest"), F.max("best").alias("below"))
            told = told.where((F.col("parts") == level) & (F.col("fewest") > F.col("n"))).drop("parts", "fewest")
        told = staged(told.withColumn("best", F.greatest("c", "below")), "sets")
        found = found.union(told.where((F.col("c") >= sure) & (F.col("c") > F.col("below"))).select("set", "c", F.col("b") / F.lit(float(whole["n"]))))
        before = told.where("best < 1")
        if level == TOKENS or before.isEmpty():
            break
        rows = staged(grown.join(before.select("set"), "set", "left_semi").select("items", "n", "b", "set"), "grown")
    return staged(found, "rules")


def blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct rows of urls(url, tokens) that a rule blocks, as (url), by the inverted index of rules(tokens).

    A rule stands under its token that the fewest rules have, so common tokens seldom lead to a rule."""
    rules = rules.select(F.col("tokens").alias("rule"))
    often = rules.select(F.explode("rule").alias("token")).groupBy("token").count()
    ranked = rules.select("rule", F.explode("rule").alias("token")).join(often, "token")
    index = staged(ranked.groupBy("rule").agg(F.min(F.struct("count", "token")).alias("rarest")).select("rule", F.col("rarest.token").alias("token")), "index")
    # A written table: Spark broadcasts it if it is small, and splits hot tokens of the urls if it is not.
    asked = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return asked.where(F.size(F.array_except("rule", "tokens")) == 0).select("url").distinct()


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict, mined) for each row of pages; mined: the verdict comes from association rules."""
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = parts(F.col("url"))
    base = base.withColumns({"host": host, "path": path})
    rule, fixed = fitting(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "fixed": fixed})
    with_tokens = base.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    mined = mine(with_tokens.where("fixed is not null").select("tokens", F.col("fixed").alias("verdict")))
    open_ = with_tokens.where("fixed is null and host <> ''").select("url", "tokens").distinct()
    fires = staged(blocked(open_, mined).withColumn("fires", F.lit(True)), "fires")
    out = base.join(fires, "url", "left")
    verdict = F.coalesce("fixed", F.when(F.col("fires"), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.col("fixed").isNull().alias("mined"))

"""The queries of the numbered operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .crf import fold, toxicity
from .decontaminate import leaks
from .gru import language_model
from .html_text import main_text
from .near_dup import near_duplicates
from .pieces import Model, encoded
from .quality import RULES, STOP_WORDS, quality
from .secrets import secrets
from .training_order import sequences, shards, vocabulary
from .url_rules import judged

#: Files of public tokenizers, which the driver reads; and how the byte-level one cuts texts before merging.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The key of the training order.
ORDER_KEY = 20_240_229


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(sequences(table(spark, sf_dir, "documents"), vocabulary(RANKS), PATTERN), ORDER_KEY)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words and 85 of 100, as its contract fixes."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).drop("mined")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(table(spark, sf_dir, "documents"), fold("doc_id", 10))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), Model.load(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (op1_toxicity, op2_secrets, op3_training_order, op4_near_duplicates, op5_quality, op6_url_rules, op7_main_text, op8_language_model, op9_benchmark_leaks, op10_pieces)
}
#: SQL for the same rows, where it can express them.
ORACLES: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def _rule_sql(measure: str, least: float | None, most: float | None, words: int) -> str:
    over, _, under = measure.partition(" / ")
    value = f"coalesce({over} / nullif({under}, 0), 0)" if under else over
    parts = ([f"{value} >= {least}"] if least is not None else []) + ([f"{value} <= {most}"] if most is not None else [])
    own = " and ".join(parts)
    return f"(n_words < {words} or {own})" if words else f"({own})"


ORACLES["op5_quality"] = f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{_WORD}') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from d),
i as (select r, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5),
g as (select i.r, i.i, array_to_string(words[i.i:i.i + 4], ' ') as g from i join w using (r)),
twice as (select r, g from g group by all having count(*) > 1),
spots as (select distinct r, unnest([i, i + 1, i + 2, i + 3, i + 4]) as spot from g join twice using (r, g)),
rep as (select r, count(*) as n_repeat_words from spots group by r),
m as (select w.r, doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(string_split(text, '!!')) - 1 as n_bangs, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, len(list_filter(words, lambda x, j: j > 1 and words[j - 1] = x)) as n_stutters,
  len(list_filter(words, lambda x: lower(x) in ({", ".join(f"'{s}'" for s in STOP_WORDS)}))) as n_stop_words from w left join rep using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(_rule_sql(*r[1:]) for r in RULES)} as kept from b"""

ORACLES["op4_near_duplicates"] = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) >= 3 then list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
t as (select a, b from e union all select b, a from e),
r(a, b) as (select doc_id, doc_id from documents union select r.a, t.b from r join t on r.b = t.a),
k as (select a, min(b) as component_id from r group by a)
select w.doc_id, coalesce(n, 0) as n_shingles, component_id, w.doc_id = component_id as kept from w left join n using (doc_id) join k on k.a = w.doc_id"""

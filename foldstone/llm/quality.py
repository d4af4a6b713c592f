"""Quality rules: a threshold table that is compiled into one projection, without user functions.

Words are runs of other than space and bytes 9 to 13. Null texts have no words. Every measure of a
text without words is 0 and such a text fails the rules of length. A measure that is equal to a bound
keeps it. Repeated rows are judged each on its own, very long texts whole; an empty table gives no
rows. Other columns of docs play no part in quality() and are carried by good_rows()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: (name, measure, least, most, words): a document of so many words or more is kept if every measure lies between its bounds.
#: Ratios are to words, or to lines that have a word.
RULES: tuple[tuple[str, str, float | None, float | None, int], ...] = (
    ("length", "n_words", 10, None, 0),
    ("word_length", "word_chars / n_words", 2, 12, 0),
    ("symbols", "n_symbols / n_words", None, 0.1, 0),
    ("loud", "n_bangs / n_words", None, 0.1, 0),
    ("duplicate_lines", "n_dup_lines / n_lines", None, 0.5, 0),
    ("repeats", "n_repeat_words / n_words", None, 0.2, 0),
    ("stutter", "n_stutters / n_words", None, 0.3, 0),
    ("stop_words", "n_stop_words / n_words", 0.002, None, 50),
)
#: Very common words of the four languages; texts of 50 words or more have at least a few.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "a", "der", "die", "und", "den", "das", "ein", "zu", "mit", "von", "le", "la", "de", "les", "et", "en", "un", "que", "el", "los", "y", "las", "se", "des", "ist", "nicht", "dans", "pour")


def _covered(hashes: Column, n: Column) -> Column:
    """The words that lie in a 5-word window which the text has twice or more."""

    def window(i: Column) -> Column:
        return F.xxhash64(*(F.get(hashes, i + k) for k in range(5)))

    def repeated(sorted_: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(sorted_, j)["w"] == x["w"], F.lit(False))

        hits = F.filter(sorted_, lambda x, j: twin(x, j - 1) | twin(x, j + 1))
        return _bound(F.array_sort(F.transform(hits, lambda x: x["i"])), lengths)

    def lengths(starts: Column) -> Column:
        own = F.transform(starts, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(starts, j + 1) - x, F.lit(5))))
        return F.aggregate(own, F.lit(0), lambda total, x: total + x)

    def spread(windows: Column) -> Column:
        return _bound(F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), repeated)

    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window))
    once = _bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(spread(w)))
    return F.coalesce(once, F.lit(0)).cast("long")


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over an array of one element."""
    return F.get(F.transform(F.array(value), body), 0)


def measures(text: Column) -> dict[str, Column]:
    """Columns to add one after another; later ones use earlier ones."""
    has_word = lambda line: F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != ""
    return {
        "_text": F.coalesce(text, F.lit("")),
        "_words": F.filter(F.split("_text", SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n"), has_word),
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
        "n_bangs": F.size(F.split("_text", "!!", -1)) - 1,
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "n_repeat_words": _covered(F.col("_hashes"), F.size("_words")),
        "n_stutters": F.size(F.filter("_hashes", lambda h, i: F.coalesce(F.get("_hashes", i - 1) == h, F.lit(False)))),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))),
    }


def compiled(rules=RULES) -> Column:
    """One boolean expression of a threshold table; a ratio to nothing counts as 0."""
    verdict = F.lit(True)
    for _, measure, least, most, words in rules:
        over, _, under = measure.partition(" / ")
        value = F.coalesce(F.try_divide(F.col(over), F.col(under)), F.lit(0.0)) if under else F.col(over)
        for holds in ([] if least is None else [value >= least]) + ([] if most is None else [value <= most]):
            verdict &= (F.col("n_words") < words) | holds if words else holds
    return verdict


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id_col, measures, base_failed, kept) for each row of docs."""
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_given"))
    for name, column in measures(F.col("_given")).items():
        out = out.withColumn(name, column)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def good_rows(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that the base and the rules keep, with their own columns."""
    own = [F.col(c).alias(f"_own{i}") for i, c in enumerate(docs.columns)]
    out = docs.select(*own, F.col(text_col).alias("_given"))
    for name, column in measures(F.col("_given")).items():
        out = out.withColumn(name, column)
    good = (F.col("n_words") >= 10) & (100 * F.col("n_repeat_words") <= 20 * F.col("n_words")) & compiled(rules)
    # A row number in the projection keeps the filter above it: pushed down, it would hold the measures many times over.
    out = out.withColumns({"_good": good, "_row": F.monotonically_increasing_id()}).where("_good and _row >= 0")
    return out.select(*(F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns)))

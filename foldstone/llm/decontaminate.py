"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: lower case, every run of other than letters and digits is one
space. An item of m characters may differ from a passage by budget edits: m * rate, at least 1 and at
most m // 8 - 1, so that a piece has 8 characters or more; items of fewer than 16 characters must
occur unchanged. Cut into budget + 1 pieces, at least one piece must occur in the passage unchanged
(pigeonhole); an automaton of all pieces finds those in one pass over a text, and Myers'
bit-parallel distance verifies the stretch around each hit. Items are handled in blocks of BLOCK
characters (an item is never cut), each block against all rows, so the automaton that a task holds
stays small however many items there are; a benchmark of up to BLOCK characters takes one pass.

Null and empty texts match nothing, nor do items without a letter or digit; empty tables give no
rows. Of several passages the least distance counts. Repeated items and rows are reported each on its
own. Very long texts are searched whole. Other columns of both tables play no part."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Characters of the items in one automaton, at most (or one item).
BLOCK = 2 << 20
#: Edits allowed per normalised character of an item.
RATE = 0.08

_OTHER = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def allowed(size: int, rate: float = RATE) -> int:
    """The edit budget of an item by its normalised characters."""
    return min(max(1, int(size * rate)), max(0, size // 8 - 1))


def myers(pattern: str, text: str) -> int:
    """The least edit distance of pattern to any stretch of text (Myers 1999), by big integers as bit vectors."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = score
    for c in text:
        eq = masks.get(c, 0)
        across = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        rise = (minus | ~(across | plus)) & full
        fall = plus & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise <<= 1  # a match may start anywhere: no carry into the first row
        fall <<= 1
        above = eq | minus
        plus = (fall | ~(above | rise)) & full
        minus = rise & above & full
        if score < best:
            best = score
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.budgets = [normalised(t) for _, t in items], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            m = len(item)
            budget = allowed(m, rate)
            self.budgets.append(budget)
            cuts = [m * k // (budget + 1) for k in range(budget + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    pieces.setdefault(item[lo:hi], []).append((i, lo))
        self.tree = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.tree.add_word(piece, (len(piece), at))
        if pieces:
            self.tree.make_automaton()

    def found(self, text: str) -> dict[int, int]:
        """The distance of each item that occurs in the normalised text within its budget."""
        windows: dict[int, list[list[int]]] = {}
        if not len(self.tree):
            return {}
        for end, (size, at) in self.tree.iter(text):
            for i, lo in at:
                first, budget = end + 1 - size - lo, self.budgets[i]
                span = [max(0, first - budget), first + len(self.items[i]) + budget]
                own = windows.setdefault(i, [])
                if own and span[0] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], span[1])
                    own[-1][0] = min(own[-1][0], span[0])
                else:
                    own.append(span)
        out = {}
        for i, spans in windows.items():
            item, best = self.items[i], self.budgets[i] + 1
            if item in text:
                best = 0
            else:
                for lo, hi in spans:
                    best = min(best, myers(item, text[lo:hi]))
            if best <= self.budgets[i]:
                out[i] = best
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items(item, text) in blocks, at least one; the driver holds one at a time."""
    held: list[tuple] = []
    size = made = 0
    for row in items.toLocalIterator():
        if held and size + len(row["text"]) > BLOCK:
            yield held
            held, size, made = [], 0, made + 1
        held.append((row["item"], row["text"]))
        size += len(row["text"])
    if held or not made:
        yield held


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """(id_col, item_col, distance) for each row of docs and each item that it holds within the item's edit budget."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    known = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    schema = f"id {dict(texts.dtypes)['id']}, item {dict(known.dtypes)['item']}, distance int"

    def against(block: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def match(batches: Iterator[dict]) -> Iterator[dict]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                rows = [(id_, sent.value[i][0], d) for id_, text in zip(batch["id"], batch["text"], strict=True) for i, d in matcher.found(normalised(text)).items()]
                yield dict(zip(("id", "item", "distance"), zip(*rows, strict=True) if rows else ((), (), ()), strict=True))

        return mapped(texts, match, schema)

    out = reduce(DataFrame.union, map(against, _blocks(known)))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance")


def _cleaner(sent, rate: float):
    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, rate)
        for texts in parts:
            yield texts.map(lambda t: not matcher.found(normalised(t)))

    return clean


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of docs that hold no item, with their own columns; a filter, so no text is shuffled and ids don't matter."""
    for block in _blocks(items.select(F.lit(0).alias("item"), F.col(item_text).alias("text")).where("text is not null")):
        docs = docs.where(_cleaner(docs.sparkSession.sparkContext.broadcast(block), rate)(F.col(text_col)))
    return docs

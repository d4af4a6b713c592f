"""Toxic spans by a linear-chain conditional random field over words.

Two states, ordinary and toxic; a word's emission is the sum of weights of its features (itself,
its prefixes, its suffix, hashed), and a table holds the transitions. Only documents carry labels,
so words are labelled first: in a toxic document the words with a feature whose document counts
speak for toxicity far beyond chance. The field is then fitted on these, forward-backward marginals
give each word's chance to be toxic, and a logistic curve over a document's expected number of
toxic words gives its score. Words of marginal 0.5 or more are the offending spans.

The fit takes at most SAMPLE labelled documents of each label, chosen by a hash of the id, and of these
as many as CHARS characters hold (one text may go beyond), in one task; everything else runs over all
rows. Without labelled rows of both kinds all scores are 0. The bound on evidence falls where there are
few toxic documents, with what a feature of all of them and no other could reach.

Null texts are empty; a text without words gets the score of zero toxic words; repeated rows are
scored each on its own. Of several texts with one id the least teaches, of several labels the highest.
Empty tables give no rows; other columns of both tables play no part."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_mod, mapped, text_blocks

#: Labelled documents of each label that the fit takes at most.
SAMPLE = 3000
#: Characters of each label's documents that the fit takes.
CHARS = 50_000_000
#: Feature slots, passes of the fit, and the evidence a feature needs to label words.
SLOTS, PASSES, EVIDENCE, ODDS = 1 << 18, 30, 30.0, 15.0
#: The share of the most that a feature could reach that is evidence enough.
REACH = 0.35
#: Least chance of a word that counts towards its document.
FLOOR = 0.2
#: Words whose emissions a task remembers.
CACHE = 300_000
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    return [f"w{word}", *(f"p{word[:n]}" for n in range(3, 7) if n < len(word)), f"s{word[-3:]}"]


def slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % SLOTS for f in features(word)]


def marginals(emission: np.ndarray, first: np.ndarray, turn: np.ndarray, start: np.ndarray, width: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Each word's chance of the toxic state, and the expected number of each transition, over documents end to end.

    A word is a 2 x 2 step from the state before to its own; a document's first word forgets what was
    before. Rows of width words are multiplied up side by side, chained, then scanned side by side again."""
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    rows = -(-n // width)
    odds = np.exp(np.clip(emission, -30, 30))
    step = np.full((2, 2, rows * width), 0.5)
    for i in (0, 1):
        for j in (0, 1):
            step[i, j, :n] = np.where(first, start[j], turn[i, j])
            if j:
                step[i, j, :n] *= odds
    by_row = np.ascontiguousarray(step.reshape(2, 2, rows, width).transpose(3, 0, 1, 2))  # width, 2, 2, rows

    (p, q), (r, s) = by_row[0]
    for (a, b), (c, d) in by_row[1:]:
        p, q, r, s = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
        total = p + q + r + s
        p, q, r, s = p / total, q / total, r / total, s / total
    whole = np.stack((p, q, r, s), 1).tolist()
    into, onto = [(0.5, 0.5)], [(0.5, 0.5)]
    for p, q, r, s in whole[:-1]:
        x, y = into[-1]
        x, y = x * p + y * r, x * q + y * s
        into.append((x / (x + y), y / (x + y)))
    for p, q, r, s in whole[:0:-1]:
        x, y = onto[-1]
        x, y = p * x + q * y, r * x + s * y
        onto.append((x / (x + y), y / (x + y)))
    ahead, behind = np.empty((2, width, rows)), np.empty((2, width, rows))
    x, y = np.array(into).T
    for k, ((a, b), (c, d)) in enumerate(by_row):
        x, y = x * a + y * c, x * b + y * d
        total = x + y
        x, y = x / total, y / total
        ahead[0, k], ahead[1, k] = x, y
    x, y = np.array(onto[::-1]).T
    for k in range(width - 1, -1, -1):
        behind[0, k], behind[1, k] = x, y
        (a, b), (c, d) = by_row[k]
        x, y = a * x + b * y, c * x + d * y
        total = x + y
        x, y = x / total, y / total
    ahead, behind = (v.transpose(0, 2, 1).reshape(2, -1)[:, :n] for v in (ahead, behind))
    joint = ahead * behind
    chance = joint[1] / (joint[0] + joint[1])
    inner = np.flatnonzero(~first)
    pairs = ahead[:, None, inner - 1] * step[:, :, inner] * behind[None, :, inner]
    return chance, (pairs / pairs.sum((0, 1))).sum(2)


def _evidence(texts: list[list[int]], toxic: np.ndarray, known: list[list[int]]) -> np.ndarray:
    """Which features speak for toxicity: a log-likelihood ratio of document counts and smoothed odds above their bounds."""
    counts = np.zeros((2, SLOTS))
    for words, label in zip(texts, toxic, strict=True):
        counts[int(label), list({s for w in set(words) for s in known[w]})] += 1
    docs = np.array([(~toxic).sum(), toxic.sum()], float)
    total, base = counts.sum(0), docs[1] / docs.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = np.stack((total * (1 - base), total * base))
        g = 2 * np.where(counts > 0, counts * np.log(counts / expected), 0).sum(0)
        odds = ((counts[1] + 0.1) / docs[1]) / ((counts[0] + 0.5) / docs[0])
    reach = -2 * docs[1] * np.log(base)
    return (g >= min(EVIDENCE, REACH * reach)) & (odds >= ODDS)


class Field:
    """Weights of a fitted field."""

    def __init__(self, weights: np.ndarray, turn: np.ndarray, start: np.ndarray, curve: np.ndarray):
        self.weights, self.turn, self.start, self.curve = weights, turn, start, curve
        self.cache: dict[str, float] = {}
        self.of_slot = weights.tolist()

    def emission(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = self.cache[word] = sum(self.of_slot[s] for s in slots(word))
        return found

    def chances(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Of each text's words."""
        for a, b in text_blocks(texts):
            words = [WORD.findall(_lower(t)) for t in texts[a:b]]
            at = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(int)
            emission = np.fromiter((self.emission(w) for own in words for w in own), float, at[-1])
            first = np.zeros(at[-1], bool)
            first[at[:-1][np.diff(at) > 0]] = True
            chance = marginals(emission, first, self.turn, self.start)[0]
            for i in range(b - a):
                yield chance[at[i] : at[i + 1]]

    @staticmethod
    def measures(chance: np.ndarray) -> list[float]:
        """Of a document: 1, the logarithm of the expected number of toxic words, and the highest chance.

        Chances below FLOOR are left out, or a long text would gather them to a toxic word."""
        return [1.0, float(np.log1p(20 * chance[chance >= FLOOR].sum())), float(chance.max(initial=0.0))]

    def score(self, chance: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.curve, self.measures(chance)))))


def fit(texts: list[str], toxic: np.ndarray) -> Field:
    """The field from three of four documents, its curve from the others."""
    rest = np.arange(len(texts)) % 4 == 3
    if len(set(toxic[rest].tolist())) < 2 or len(set(toxic[~rest].tolist())) < 2:
        return _with_curve(_field(texts, toxic), texts, toxic)
    field = _field([t for t, r in zip(texts, rest, strict=True) if not r], toxic[~rest])
    return _with_curve(field, [t for t, r in zip(texts, rest, strict=True) if r], toxic[rest])


def _with_curve(field: Field, texts: list[str], toxic: np.ndarray) -> Field:
    design, curve = np.array([field.measures(c) for c in field.chances(texts)]), np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge-held logistic curve
        p = 1 / (1 + np.exp(-design @ curve))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(3)
        curve = curve + np.linalg.solve(hessian, design.T @ (toxic - p) - 0.1 * curve)
    field.curve = curve
    return field


def _field(texts: list[str], toxic: np.ndarray) -> Field:
    index: dict[str, int] = {}
    docs = [[index.setdefault(w, len(index)) for w in WORD.findall(_lower(t))] for t in texts]
    known = [slots(w) for w in index]
    strong = _evidence(docs, toxic, known)
    telling = np.array([strong[s].any() for s in known], bool)
    lengths = np.array([len(d) for d in docs])
    words = np.fromiter((w for d in docs for w in d), np.int64, lengths.sum())
    first = np.zeros(len(words), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    labels = telling[words] & np.repeat(toxic, lengths)
    of_word, of_slot = np.repeat(np.arange(len(known)), [len(s) for s in known]), np.array([s for own in known for s in own], np.int64)

    pairs = Counter(zip(labels[:-1][~first[1:]].tolist(), labels[1:][~first[1:]].tolist(), strict=True))
    seen = np.array([[pairs[i, j] for j in (False, True)] for i in (False, True)], float)
    turn, start = np.log((seen + 1) / (seen + 1).sum(1, keepdims=True)), np.array([0.0, -4.0])
    weights, square, turn_square = np.zeros(SLOTS), np.full(SLOTS, 1e-3), np.full((2, 2), 1e-3)
    for _ in range(PASSES):
        emission = np.bincount(of_word, weights[of_slot], len(known))[words]
        chance, expected = marginals(emission, first, np.exp(turn), np.exp(start))
        by_word = np.bincount(words, labels - chance, len(known))
        slope = np.bincount(of_slot, by_word[of_word], SLOTS) - 0.02 * weights
        square += slope**2
        weights += 0.7 * slope / np.sqrt(square)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - 0.002, 0)
        change = seen - expected
        turn_square += change**2
        turn += 0.1 * change / np.sqrt(turn_square)
    return Field(weights, np.exp(turn), np.exp(start), np.zeros(3))


def _fitted(sample: DataFrame) -> Field | None:
    """Fit in one task over a bounded sample, in the order of its ranks; the driver gets the weights."""

    def train(batches: Iterator[dict]) -> Iterator[dict]:
        rows = sorted(row for batch in batches for row in zip(batch["rank"], batch["text"], batch["toxic"], strict=True))
        if len({toxic for _, _, toxic in rows}) == 2:
            f = fit([text for _, text, _ in rows], np.array([toxic for _, _, toxic in rows], bool))
            at = np.flatnonzero(f.weights)
            yield {"at": [*range(-9, 0), *at.tolist()], "value": np.concatenate((f.turn.ravel(), f.start, f.curve, f.weights[at]))}

    rows = mapped(sample.repartition(1), train, "at int, value double").toPandas()  # at most SLOTS + 9 rows
    if not len(rows):
        return None
    head = rows[rows["at"] < 0].sort_values("at")["value"].to_numpy()
    weights, body = np.zeros(SLOTS), rows[rows["at"] >= 0]
    weights[body["at"]] = body["value"]
    return Field(weights, head[:4].reshape(2, 2), head[4:6], head[6:9])


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, chars: int = CHARS) -> DataFrame:
    """(id_col, held_out, score, predicted, spans) for each row of docs; rows that are held_out teach nothing.

    held_out is a column of docs and never null. spans: start:end of the offending words in code points."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where("toxic in (0, 1)")
    one = told.groupBy("id").agg(F.max("toxic").alias("toxic"))
    # The sample's ids are chosen among the labelled ids alone; only their texts are then read.
    one = given.where("not held_out").select("id").distinct().join(one, "id")
    some = [one.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    chosen = given.where("not held_out").join(F.broadcast(some[0].union(some[1])), "id").groupBy("id", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    before = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, -1))
    chosen = chosen.withColumn("rank", F.xxhash64("id")).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < chars)
    field = _fitted(chosen.select("rank", "text", "toxic"))
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def apply(batches: Iterator[dict]) -> Iterator[dict]:
        field = sent.value
        for batch in batches:
            out: dict = {"id": batch["id"], "held_out": batch["held_out"], "score": [], "predicted": [], "spans": []}
            texts = [t or "" for t in batch["text"]]
            chances = field.chances(texts) if field else (np.zeros(0) for _ in texts)
            for text, chance in zip(texts, chances, strict=True):
                score = field.score(chance) if field else 0.0
                bad = np.flatnonzero(chance >= 0.5)
                spans = [m.span() for m in WORD.finditer(_lower(text))] if len(bad) else []
                out["score"].append(score)
                out["predicted"].append(int(score >= 0.5))
                out["spans"].append(",".join(f"{spans[i][0]}:{spans[i][1]}" for i in bad if i < len(spans)))
            yield out

    kind = dict(given.dtypes)["id"]
    return mapped(given, apply, f"id {kind}, held_out boolean, score double, predicted int, spans string").withColumnRenamed("id", id_col)


def _lower(text: str) -> str:
    """Lower-cased without a change of offsets: the few characters that would grow stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def fold(id_col: str, n: int) -> Column:
    return fold_mod(F.col(id_col), n) == 0

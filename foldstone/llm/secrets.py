"""Secret scans: known forms by pattern, others by two character Markov models.

Two first-order models of characters are trained from labelled samples: the values that the
patterns find stand for random strings, all other runs of the same alphabet for ordinary
identifiers. Both lean on a prior for what the samples lack: letters and digits of equal chance for
random strings, numbers and dates for ordinary runs. A run, or the part of one that no pattern has
found, is a secret if it has MIN_RUN characters or more and the log-likelihood ratio of the two
models is MIN_RATIO or more, whichever characters it has. Shorter ones are no secrets, as in the
patterns.
Counts are sums over all rows, made per partition, so only alphabet-sized tables meet.

Null texts are empty; an empty table gives no rows; repeated rows are scanned each on its own; very
long texts are swept once, spans and runs together. Of spans that begin together the kinds' order
decides which comes first. Offsets are code points. Other columns of docs play no part."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# With their least lengths inside: a run that is long enough has no earlier failing match, so the spans are the same.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Least characters of a run that the models may flag, and least log-likelihood ratio in nats.
MIN_RUN, MIN_RATIO = 12, 10.0
SYMBOLS = 128
#: Weight of single symbols in a model of pairs.
LEAN = 50.0
#: The alphabet of runs and values, and what each prior weighs: of random strings, and of ordinary runs in general and after a digit or a sign.
SIGNS, DIGITS = "+/_=-.", "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ANY, PLAIN, NUMBER = 0.5, 0.02, 0.3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _pairs(runs: list[str]) -> np.ndarray:
    """How often each pair of symbols occurs in runs; symbol 0 stands before and after each."""
    data = np.frombuffer(("\0" + "\0".join(runs) + "\0").encode(), np.uint8).astype(np.int64)
    return np.bincount(data[:-1] * SYMBOLS + data[1:], minlength=SYMBOLS * SYMBOLS) if runs else np.zeros(SYMBOLS * SYMBOLS, np.int64)


def _rests(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bool]]:
    """What spans, sorted by start, leave of each run, and whether that is a whole run; one sweep over both."""
    covered: list[list[int]] = []
    for lo, _, hi in spans:
        if covered and lo <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], hi)
        else:
            covered.append([lo, hi])
    at = 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        k, whole = at, True
        while k < len(covered) and covered[k][0] < end:
            whole = False
            if covered[k][0] > start:
                yield start, covered[k][0], False
            start = covered[k][1]
            k += 1
        if start < end:
            yield start, end, whole


def _samples(batches: Iterator[dict]) -> Iterator[dict]:
    total = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    for batch in batches:
        for text in batch["text"]:
            if text:
                spans = base_spans(text)
                if spans:
                    values = [ASSIGN.match(text, lo)[2] if kind == 0 else text[lo:hi] for lo, kind, hi in spans]
                    total[1] += _pairs(values)
                    total[0] += _pairs([text[lo:hi] for lo, hi, whole in _rests(text, spans) if whole])
                else:
                    total[0] += _pairs(RUN.findall(text))
    label, pair = np.nonzero(total)
    yield {"label": label.astype(np.int32), "pair": pair.astype(np.int32), "n": total[label, pair]}


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of log-likelihood ratios, random to ordinary, for each pair of neighbouring symbols."""
    counts = mapped(docs.select(F.col(text_col).alias("text")), _samples, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    table = np.zeros((2, SYMBOLS, SYMBOLS))
    for row in counts.collect():  # at most 2 * SYMBOLS ** 2 rows
        table[row.label, row.pair // SYMBOLS, row.pair % SYMBOLS] = row.n
    signs, digits = list(map(ord, SIGNS)), list(map(ord, DIGITS))
    letters = [0, *signs, *digits, *map(ord, LETTERS)]
    single = np.full((2, 1, SYMBOLS), 1e-9)
    single[:, :, letters] = table.sum(1, keepdims=True)[:, :, letters] + 1
    single /= single.sum(2, keepdims=True)
    # A symbol that was seldom seen leans on the frequencies of single symbols.
    ordinary, random = (table + LEAN * single) / (table.sum(2, keepdims=True) + LEAN)
    even = np.zeros(SYMBOLS)
    even[letters[1:]] = 0.97 / (len(DIGITS) + len(LETTERS))
    even[signs] = 0.03 / len(SIGNS)
    plain = np.zeros(SYMBOLS)
    plain[letters[1:]] = 1 / len(letters[1:])
    number = np.zeros(SYMBOLS)
    number[signs + digits] = 1 / (len(SIGNS) + len(DIGITS))
    random = (1 - ANY) * random + ANY * even
    ordinary = (1 - PLAIN) * ordinary + PLAIN * plain
    ordinary[signs + digits] = (1 - NUMBER) * ordinary[signs + digits] + NUMBER * number
    return np.log(np.maximum(random, 1e-12)) - np.log(np.maximum(ordinary, 1e-12))


def ratio(run: str, table: np.ndarray) -> float:
    data = np.frombuffer(("\0" + run + "\0").encode(), np.uint8)
    return float(table[data[:-1], data[1:]].sum())


def all_spans(text: str, table: np.ndarray) -> list[tuple[int, int, int]]:
    spans = base_spans(text)
    more = [(lo, 3, hi) for lo, hi, _ in _rests(text, spans) if hi - lo >= MIN_RUN and ratio(text[lo:hi], table) >= MIN_RATIO]
    return sorted(spans + more)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_markov) for each row of docs."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(train(docs, text_col))

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"id": batch["id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_markov": []}
            for text in batch["text"]:
                spans = all_spans(text or "", table.value)
                kinds = [k for _, k, _ in spans]
                for k, c in enumerate(("n_assign", "n_access", "n_hex", "n_markov")):
                    out[c].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(told([s for s in spans if s[1] < 3]).encode()).hexdigest())
                out["spans"].append(told(spans))
            yield out

    schema = f"id {dict(texts.dtypes)['id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"
    return mapped(texts, scan, schema).withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text_col replaced by mark; all other columns stay."""
    table = docs.sparkSession.sparkContext.broadcast(train(docs, text_col))

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if not text:
                return text
            out, at = [], 0
            for lo, _, hi in all_spans(text, table.value):
                if lo >= at:
                    out += [text[at:lo], mark]
                at = max(at, hi)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn(text_col, clean(F.col(text_col)))

"""A gated recurrent language model with a class-factored softmax, trained by truncated
backpropagation in numpy, beside add-0.1 unigrams.

Tokens are A-Z-lower-cased words and one end for each text. All training tokens are counted on
Spark, by the words themselves. The HEAD most frequent words of at most LONGEST bytes go to the tasks;
counts of the others stay a distributed table that each text's rare words are joined with. Output: a
class from the state, then a word of the class. The most frequent words form small classes, in which
the word depends on the state too; the others are classed by ending and frequency, and drawn by
count inside a class.

Every training text trains once: the rounds take disjoint sets of texts (by a hash of the id) that
together are all of them. In a round each partition runs on from the round's parameters over its
texts, and a mean by tokens becomes the next round's; so the model depends a little on how the table
is partitioned and batched (counts and the base score do not). A text is scored whole: the state is
carried from window to window.

Null texts are empty: they have the end alone. Very long texts are split into words by parts and
carry their state through. Without training texts every word is unknown and the model is its start;
an empty table gives no rows. Words of equal count are ordered by their bytes. Repeated rows are
scored each on its own; other columns of docs play no part."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, staged, text_blocks, word_parts, word_values

#: Words that tasks hold, at most, and their bytes; words with a softmax of their own; words in such a class; endings.
HEAD, LONGEST, TOP, IN_CLASS, ENDINGS = 1 << 18, 64, 512, 32, 8
FULL = TOP // IN_CLASS
CLASSES = FULL + 2 * ENDINGS
#: Width of the state, steps of backpropagation, texts side by side, rounds.
STATE, STEPS, LANES, ROUNDS = 16, 32, 256, 2
INPUTS = TOP + CLASSES
#: The end of a text, which no word is, and the input before a text's first word.
END, START = b"\n", INPUTS - 1
SMOOTH = 0.1
#: Steps whose states are kept at once, and characters of texts that are scored side by side.
WINDOW, SIDE = 16, 12 << 20
#: Distinct words that a task counts before it hands them on, and groups in which tasks' parameters are averaged first.
COUNTED, GROUPS = 300_000, 1024


def ending(word: bytes) -> int:
    """One of ENDINGS kinds of a word's last two bytes."""
    return (word[-1] * 31 + word[max(0, len(word) - 2)] * 7) % ENDINGS


class Index(dict):
    """A word's place in the head; of others -1 less their ending."""

    def __missing__(self, word: bytes) -> int:
        return -1 - ending(word)


class Head:
    """The frequent words by falling count: their counts and places in the softmax."""

    def __init__(self, words: list[bytes], counts: np.ndarray, rare_mass: np.ndarray):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words, self.counts = [words[i] for i in order], np.asarray(counts, np.int64)[order]
        place = np.arange(len(words))
        endings = np.fromiter(map(ending, self.words), np.int64, len(words))
        cls = np.where(place < TOP, place // IN_CLASS, FULL + endings).astype(np.int16)
        mass = np.bincount(cls, self.counts + SMOOTH, CLASSES)
        mass[FULL + ENDINGS :] = rare_mass
        self.mass = np.maximum(mass, SMOOTH)
        #: Of a word given its class, by count; words with a softmax of their own have 0 here.
        inside = np.log((self.counts + SMOOTH) / self.mass[cls])
        inside[:TOP] = 0.0
        # Places from the end stand for unknown words by their ending: arrays can be asked for -1 less an ending.
        self.cls = np.concatenate((cls, np.arange(CLASSES - 1, FULL + ENDINGS - 1, -1, dtype=np.int16)))
        self.inside = np.concatenate((inside, np.zeros(ENDINGS)))
        self.inputs = (TOP + self.cls).astype(np.int32)
        self.inputs[: min(TOP, len(words))] = place[:TOP]
        self.top_counts = np.full(TOP, 0.0)
        self.top_counts[: min(TOP, len(words))] = self.counts[:TOP]
        self._index: Index | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place of every token of texts, ends included, and where each text's begin."""
        if self._index is None:
            self._index = Index(zip(self.words, range(len(self.words)), strict=True))
        get = self._index.__getitem__
        return word_values(texts, lambda words: np.fromiter(map(get, words), np.int32, len(words)), END)


SHAPES = {"input": (INPUTS, 3 * STATE), "turn": (STATE, 3 * STATE), "class": (STATE, CLASSES), "class_bias": (CLASSES,), "word": (TOP, STATE), "word_bias": (TOP,)}


def initial(head: Head) -> dict[str, np.ndarray]:
    """Small weights, and biases that make the start the unigram model."""
    random = np.random.default_rng(7)
    out = {k: random.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    out["input"] *= 3
    out["class_bias"] = np.log(head.mass / head.mass.sum()).astype(np.float32)
    out["word_bias"] = np.log(head.top_counts + SMOOTH).astype(np.float32)
    return out


def flat(parameters: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parameters[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = values[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


def given(p: dict, inputs: np.ndarray) -> np.ndarray:
    """What inputs of shape (steps, lanes) bring to each step's gates and proposal: (steps, 3 * STATE, lanes)."""
    return np.ascontiguousarray(p["input"][inputs].transpose(0, 2, 1))


def step(p: dict, state: np.ndarray, brought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next state of each lane, a column, and what the state brought to the proposal.

    brought becomes the gates of renewal and of reset (logistic curves of the negative sum) and the proposal."""
    n = STATE
    turned = p["turn"].T @ state
    gates, proposal = brought[: 2 * n], brought[2 * n :]
    gates += turned[: 2 * n]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    proposal += gates[n:] * turned[2 * n :]
    np.tanh(proposal, out=proposal)
    new = proposal - state
    new *= gates[:n]
    new += state
    return new, turned[2 * n :]


def _softmax(x: np.ndarray, target: np.ndarray, chances: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log chance of each column's target and, if asked for, all chances less 1 at the target; x is overwritten."""
    at = np.arange(len(target))
    x -= x.max(0)
    own = x[target, at]
    np.exp(x, out=x)
    sums = x.sum(0)
    own = own - np.log(sums)
    if not chances:
        return own, None
    x *= 1 / sums
    x[target, at] -= 1
    return own, x


def outputs(p: dict, states: np.ndarray, cls: np.ndarray, rank: np.ndarray, slope: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log chance of each class, and of the word in it for words with a softmax; with slope, adds the gradients and returns that of the states.

    states are columns; rank: the place of words with a softmax, others' play no part."""
    logs, d = _softmax(p["class"].T @ states + p["class_bias"][:, None], cls, slope is not None)
    out = logs.astype(np.float64)
    back = None
    if slope is not None:
        slope["class"] += states @ d.T
        slope["class_bias"] += d.sum(1)
        back = p["class"] @ d
    order = np.argsort(cls, kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(FULL + 1))
    order = order[: bounds[FULL]]
    held, more, change = states[:, order], np.empty(len(order)), np.empty((STATE, len(order)), np.float32)
    ranks = rank[order]
    for c in range(FULL):
        lo, hi = bounds[c], bounds[c + 1]
        if hi > lo:
            words = slice(c * IN_CLASS, (c + 1) * IN_CLASS)
            more[lo:hi], d = _softmax(p["word"][words] @ held[:, lo:hi] + p["word_bias"][words, None], ranks[lo:hi] - c * IN_CLASS, slope is not None)
            if slope is not None:
                slope["word"][words] += d @ held[:, lo:hi].T
                slope["word_bias"][words] += d.sum(1)
                change[:, lo:hi] = p["word"][words].T @ d
    out[order] += more
    if slope is not None:
        back[:, order] += change
    return out, back


def fresh() -> dict[str, np.ndarray]:
    """Sums of squared gradients before the first of them."""
    return {k: np.full(s, 1e-3, np.float32) for k, s in SHAPES.items()}


def train(p: dict, head: Head, places: np.ndarray, rate: float = 0.05, squares: dict | None = None) -> int:
    """One pass of truncated backpropagation over texts end to end, p and squares in place; the number of tokens.

    The tokens are cut into lanes whose lengths differ by one at most, and each lane's state runs on."""
    if not len(places):
        return 0
    lanes = max(1, min(LANES, len(places) // STEPS))
    length, longer = -(-len(places) // lanes), len(places) % lanes or lanes
    # Lanes of full length come first, so only the last step has fewer.
    begins = np.concatenate(([0], np.cumsum(np.where(np.arange(lanes) < longer, length, length - 1))))[:-1]
    rank = places[np.minimum(begins + np.arange(length)[:, None], len(places) - 1)]
    cls, inputs = head.cls[rank], head.inputs[rank].astype(np.int16)
    before = np.vstack((np.full((1, lanes), START, np.int16), inputs[:-1]))
    state = np.zeros((STATE, lanes), np.float32)
    squares = fresh() if squares is None else squares
    n = STATE
    for lo in range(0, length, STEPS):
        steps = min(STEPS, length - lo)
        hi = lo + steps
        brought = given(p, before[lo:hi])
        states, turned = np.empty((steps + 1, n, lanes), np.float32), np.empty((steps, n, lanes), np.float32)
        states[0] = state
        for t in range(steps):
            states[t + 1], turned[t] = step(p, states[t], brought[t])
        state = states[steps]
        slope = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        size = steps * lanes - (lanes - longer if hi == length else 0)
        columns = states[1:].transpose(1, 0, 2).reshape(n, -1)
        _, own = outputs(p, columns[:, :size], cls[lo:hi].ravel()[:size], rank[lo:hi].ravel()[:size], slope)
        back = np.zeros((n, steps * lanes), np.float32)
        back[:, :size] = own
        back = np.ascontiguousarray(back.reshape(n, steps, lanes).transpose(1, 0, 2))
        # What the slope at a state is multiplied by for the gates, the proposal and its reset part: all steps at once.
        was, renew, reset, proposal = states[:-1], brought[:, :n], brought[:, n : 2 * n], brought[:, 2 * n :]
        stay, to_proposal = 1 - renew, renew * (1 - proposal * proposal)
        factors = np.empty((steps, 3, n, lanes), np.float32)
        factors[:, 0] = (was - proposal) * renew * stay
        factors[:, 2] = to_proposal * reset
        factors[:, 1] = factors[:, 2] * turned * (reset - 1)
        slopes, ahead = np.empty((steps, 3 * n, lanes), np.float32), np.zeros((n, lanes), np.float32)
        for k in range(steps - 1, -1, -1):
            back[k] += ahead
            np.multiply(factors[k], back[k], out=slopes[k].reshape(3, n, lanes))
            ahead = p["turn"] @ slopes[k]
            ahead += back[k] * stay[k]
        slope["turn"] += np.matmul(was, slopes.transpose(0, 2, 1)).sum(0)
        np.multiply(back, to_proposal, out=slopes[:, 2 * n :])
        own = before[lo:hi].ravel()
        for j in range(3 * n):
            slope["input"][:, j] = np.bincount(own, slopes[:, j].ravel(), INPUTS)
        for k, g in slope.items():
            g *= 32 / size
            np.clip(g, -5, 5, out=g)
            squares[k] += g * g
            g /= np.sqrt(squares[k])
            g *= rate
            p[k] -= g
    return len(places)


def scores(p: dict, head: Head, places: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Natural log chances of whole texts, but for rare words' draw in their class."""
    cls, inputs, inside = head.cls[places], head.inputs[places], head.inside[places]
    lengths = np.diff(begins)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = begins[:-1][order], lengths[order]
    totals, state = np.zeros(len(sizes)), np.zeros((STATE, len(sizes)), np.float32)
    for lo in range(0, int(sizes[0]) if len(sizes) else 0, WINDOW):
        steps = min(WINDOW, int(sizes[0]) - lo)
        lanes = np.searchsorted(-sizes, -np.arange(lo, lo + steps), "left")  # texts with more tokens than that
        where, states = [starts[:n] + lo + t for t, n in enumerate(lanes)], []
        state = state[:, : lanes[0]]
        for t, at in enumerate(where):
            before = inputs[at - 1] if lo + t else np.full(len(at), START, np.int32)
            state, _ = step(p, state[:, : len(at)], given(p, before[None])[0])
            states.append(state)
        at = np.concatenate(where)
        logs, _ = outputs(p, np.concatenate(states, 1), cls[at], places[at])
        logs += inside[at]
        totals += np.bincount(np.concatenate([np.arange(n) for n in lanes]), logs, len(totals))
    out = np.empty(len(totals))
    out[order] = totals
    return out


def rare_words(head: Head, texts: list[str], places: np.ndarray, begins: np.ndarray) -> list[list[bytes]]:
    """Each text's words that are not in the head, in order."""
    out = []
    for i, text in enumerate(texts):
        at = np.flatnonzero(places[begins[i] : begins[i + 1]] < 0)
        own: list[bytes] = []
        if len(at):
            done = 0
            for words in word_parts(text):
                stop = np.searchsorted(at, done + len(words))
                own += [words[k - done] for k in at[len(own) : stop].tolist()]
                done += len(words)
            if len(own) < len(at):  # the end itself, where nothing was trained
                own.append(END)
        out.append(own)
    return out


def counted(batches: Iterator[dict]) -> Iterator[dict]:
    """Counts of words, combined over as many batches as a task may hold words of."""
    held: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            for words in word_parts(text):
                held.update(words)
                if len(held) > COUNTED:
                    yield {"word": list(held), "n": list(held.values())}
                    held.clear()
            held[END] += 1
    yield {"word": list(held), "n": list(held.values())}


def language_model(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; scores are log10."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held_out"))
    learning = given.where("not held_out")

    counts = mapped(learning.select("text"), counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = staged(counts, "counts")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("types")).first()
    # The least count of a head word: by the number of words of each order of magnitude.
    order = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.expr("1024 * cast(pow(2, floor(log2(n / 1024))) as long)")).alias("least")
    least, held = 1 << 62, 0
    for s in counts.where(F.octet_length("word") <= LONGEST).groupBy(order).count().orderBy(F.desc("least")).collect():
        if held + s["count"] > HEAD:
            break
        least, held = s["least"], held + s["count"]
    in_head = (F.col("n") >= least) & (F.octet_length("word") <= LONGEST)
    rare_mass = np.full(ENDINGS, SMOOTH)
    byte = lambda at: F.conv(F.hex(F.substring("word", at, 1)), 16, 10).cast("int")
    kind = (byte(-1) * 31 + F.when(F.octet_length("word") > 1, byte(-2)).otherwise(byte(-1)) * 7) % ENDINGS
    for r in counts.where(~in_head).groupBy(kind.alias("e")).agg(F.sum(F.col("n") + SMOOTH).alias("m")).collect():
        rare_mass[r["e"]] += r["m"]
    frequent = counts.where(in_head).collect()  # at most HEAD rows
    head = Head([bytes(r["word"]) for r in frequent], np.array([r["n"] for r in frequent], np.int64), rare_mass)
    sent_head = spark.sparkContext.broadcast(head)
    parameters = flat(initial(head))

    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast(parameters)

        def learn(batches: Iterator[dict], sent=sent) -> Iterator[dict]:
            p, squares, n = shaped(sent.value.copy()), fresh(), 0
            for batch in batches:
                for lo, hi in text_blocks(batch["text"], SIDE):
                    n += train(p, sent_head.value, sent_head.value.places(batch["text"][lo:hi])[0], squares=squares)
            if n:
                yield {"part": [TaskContext.get().partitionId() % GROUPS], "values": [flat(p).astype(np.float64)], "n": [float(n)]}

        own = learning.where(F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == k).select("text")
        made = mapped(own, learn, "part int, values array<double>, n double").select("part", array_to_vector("values").alias("v"), "n")
        # One row of parameters for each task; means of means, so that no task reads them all.
        for by in (F.col("part"), F.lit(0)):
            made = made.groupBy(by.alias("part")).agg(Summarizer.mean(F.col("v"), F.col("n")).alias("v"), F.sum("n").alias("n"))
        mean = made.first()
        if mean:
            parameters = mean["v"].toArray()
    sent_model = spark.sparkContext.broadcast(parameters)

    def score(batches: Iterator[dict]) -> Iterator[dict]:
        p, head = shaped(sent_model.value), sent_head.value
        for batch in batches:
            for lo, hi in text_blocks(batch["text"], SIDE):
                texts = batch["text"][lo:hi]
                places, begins = head.places(texts)
                logs = scores(p, head, places, begins) / np.log(10)
                text, known = np.repeat(np.arange(hi - lo), np.diff(begins)), places >= 0
                rare = np.flatnonzero(~known)
                logs -= np.bincount(text[rare], np.log10(head.mass[head.cls[places[rare]]]), hi - lo)
                words = rare_words(head, texts, places, begins)
                yield {
                    "id": batch["id"][lo:hi], "held_out": batch["held_out"][lo:hi], "n_tokens": np.diff(begins), "n_known": np.bincount(text[known], minlength=hi - lo),
                    "base": np.bincount(text[known], np.log10(head.counts[places[known]] + SMOOTH), hi - lo), "model": logs, "rare": words,
                }

    kind = dict(given.dtypes)["id"]
    made = mapped(given, score, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<binary>")
    made = staged(made.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = made.select("row", F.explode("rare").alias("word")).join(counts.where(~in_head), "word", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)
    rare = rare.groupBy("row").agg(F.sum(log).alias("rare_log"), F.count("n").alias("rare_known"))
    out = made.drop("rare").join(rare, "row", "left").na.fill(0, ["rare_log", "rare_known"])
    whole = float(np.log10(size["n"] + SMOOTH * (size["types"] + 1)))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"), F.lit(int(size["n"])).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_log") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("model") + F.col("rare_log")).alias("score"),
    )

"""SentencePiece encoding as a max-plus scan, and decoding, with the library's own ids.

A segmentation is a path whose steps are pieces; a step's weight depends on the piece and the one
before. In a unigram model it is the piece's score. In a model of kind BPE it is 0 if merging the
two pieces' characters gives back these two pieces, else minus infinity: a sequence is the BPE of a
text exactly if all its neighbours are such pairs, so one path is left.

Cut a text at any places: the state at a cut is the piece that reaches it or goes beyond it. A chunk
is then a matrix over (state at its start, state at its end) of best sums, and matrices combine by
the associative max-plus product. Giant texts are split into chunks; each chunk's matrix is made on
its own. The matrices of FAN neighbours are multiplied into one, those of FAN such groups again, until
FAN or fewer are left for a text; a walk through these fixes the states at their ends, which go down
level by level to the ends of the chunks, and each chunk is then backtraced on its own. No task ever
holds more than FAN matrices of a text.

Where no piece can cross a place (before a space that follows another character, in models that
split at spaces) the scan is at rest, so words between such places are solved once and kept in a
bounded cache.

A character without a piece costs 10 below the least score and becomes byte pieces; so does a
literal U+2581 (the library makes it a space), so decoding restores any text. Models with another
normalisation than identity are refused. Null counts as empty; empty texts have no pieces; an empty
table gives no rows. Of equal sums the first state wins. Repeated rows are encoded each on its own;
other columns of docs play no part."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, staged

META, LITERAL, NEVER = "▁", "\ud800", float("-inf")
_REST = re.compile(f"(?<!{META}){META}")
#: Characters of a chunk; longer texts are split.
CHUNK = 1 << 14
#: Neighbouring matrices that are combined at once.
FAN = 64
#: Words whose pieces a worker remembers, in each of two halves.
CACHE = 400_000


class Model(NamedTuple):
    ids: dict[str, int]
    scores: dict[str, float]
    raw: list[bytes]
    bytes_: list[int]
    longest: int
    unknown: float
    split: bool
    merges: bool

    @staticmethod
    def load(path: str) -> Model:
        """Read by the driver; tasks get the tables, so no executor needs the file."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        form = proto.normalizer_spec
        if form.precompiled_charsmap or form.remove_extra_whitespaces or not form.add_dummy_prefix or proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models with identity normalisation are supported")
        usable = (1, 4)  # of the kinds of piece: normal and user-defined
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in usable}
        scores = {p.piece: p.score for p in proto.pieces if p.type in usable}
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(META, " ").encode() if p.type in usable else b"" for p in proto.pieces]
        of_bytes = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 6}
        return Model(
            ids, scores, raw, [of_bytes[f"<0x{b:02X}>"] for b in range(256)], max(map(len, ids)), min(scores.values()) - 10,
            not any(META in p.lstrip(META) for p in ids), proto.trainer_spec.model_type == 2,
        )


def marked(text: str, first: bool = True) -> str:
    """As the model sees a text: spaces are META, one is put in front."""
    text = text.replace(META, LITERAL).replace(" ", META)
    return META + text if first and text else text


def merged(model: Model, text: str) -> list[str]:
    """Merge the neighbours whose joint piece has the best score, leftmost first, until none has one."""
    parts, get = list(text), model.scores.get
    joint = [get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
    while joint:
        best = max(joint)
        if best == NEVER:
            break
        at = joint.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del joint[at]
        if at:
            joint[at - 1] = get(parts[at - 1] + parts[at], NEVER)
        if at < len(joint):
            joint[at] = get(parts[at] + parts[at + 1], NEVER)
    return parts


def rests(model: Model, text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The first and last place in lo+1..hi-1 that no piece crosses."""
    start = max(1, lo + 1)
    first = _REST.search(text, start, hi) if model.split else None
    if not first:
        return None
    last = text.rfind(META, start, hi)
    while text[last - 1] == META:
        last = text.rfind(META, start, last)
    return first.start(), last


Span = tuple[int, int]


class Encoder:
    def __init__(self, model: Model):
        self.model, self.cache, self.older, self.pairs = model, {}, {}, {}

    def _weight(self, before: str, piece: str) -> float:
        if not self.model.merges:
            return self.model.scores.get(piece, self.model.unknown)
        known = self.pairs.get((before, piece))
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[before, piece] = 0.0 if merged(self.model, before + piece) == [x for x in (before, piece) if x] else -np.inf
        return known

    def _ends(self, text: str, at: int) -> list[int]:
        """Where the pieces that start at a place end; a character without a piece stands for itself."""
        scores = self.model.scores
        found = [end for end in range(at + 2, min(at + self.model.longest, len(text)) + 1) if text[at:end] in scores]
        return [at + 1, *found] if at < len(text) else []

    def _forward(self, text: str, nodes: dict[int, dict[int, tuple[float, int | None]]], stop: int):
        """nodes[end][start]: the best sum of a path whose last piece is text[start:end], and the start before; from nodes on, by pieces that start before stop."""
        at = min(nodes, default=stop)
        while at < stop:
            here = nodes.get(at)
            if here:
                for end in self._ends(text, at):
                    piece = text[at:end]
                    for start, (total, _) in here.items():
                        total += self._weight(text[start:at], piece)
                        if total > -np.inf and total > nodes.setdefault(end, {}).get(at, (-np.inf, None))[0]:
                            nodes[end][at] = (total, start)
            at += 1
        return nodes

    def _path(self, text: str, nodes, last: Span, first: Span) -> list[int]:
        out: list[int] = []
        start, end = last
        while (start, end) != first:
            out += self._ids(text[start:end])[::-1]
            start, end = nodes[end][start][1], start
        return out[::-1]

    def _ids(self, piece: str) -> list[int]:
        known = self.model.ids.get(piece)
        return [known] if known is not None else [self.model.bytes_[b] for b in piece.replace(LITERAL, META).encode()]

    def best(self, text: str) -> tuple[float, list[int]]:
        """The best sum and ids of a text, by one scan."""
        nodes = self._forward(text, {0: {0: (0.0, None)}}, len(text))
        if not text:
            return 0.0, []
        start, (total, _) = max(nodes[len(text)].items(), key=lambda x: x[1][0])
        return total, self._path(text, nodes, (start, len(text)), (0, 0))

    def words(self, text: str) -> list[str]:
        """Parts that no piece crosses: META characters and what follows them up to the next."""
        if not self.model.split:
            return [text]
        parts = text.split(META)
        if parts[-1] and META * 2 not in text:
            return [*parts[:1], *(META + p for p in parts[1:])] if parts[0] else [META + p for p in parts[1:]]
        out, blank = ([parts[0]] if parts[0] else []), 0
        for part in parts[1:]:
            blank += 1
            if part:
                out.append(META * blank + part)
                blank = 0
        return [*out, META * blank] if blank else out

    def word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            # Merging is quadratic, the scan is not.
            if self.model.merges and len(word) <= 64:
                parts = merged(self.model, word)
                ids = list(map(self.model.ids.get, parts))
                if None in ids:
                    ids = [i for p in parts for i in self._ids(p)]
            else:
                ids = self.best(word)[1]
            found = array("i", ids).tobytes()
        if len(self.cache) >= CACHE:  # words that are still in use come back from the older half
            self.older, self.cache = self.cache, {}
        self.cache[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a marked text."""
        words = self.words(text)
        found = list(map(self.cache.get, words))
        return np.frombuffer(b"".join([self.word(w) if f is None else f for w, f in zip(words, found, strict=True)]), np.int32)

    def cut(self, text: str, at: int) -> list[Span]:
        """The states at a cut: the pieces that start before it and end there or beyond. The start of a text has one."""
        if at == 0:
            return [(0, 0)]
        return [(s, e) for s in range(max(0, at - self.model.longest), at) for e in self._ends(text, s) if e >= at]

    def matrix(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Best sums of a chunk lo..hi by the states at its ends; text has as many characters around as the longest piece."""
        enters, leaves = self.cut(text, lo), self.cut(text, hi)
        at = rests(self.model, text, max(e for _, e in enters), hi)
        out = np.full((len(enters), len(leaves)), -np.inf)
        if at is None:
            for k, (s, e) in enumerate(enters):
                nodes = self._forward(text, {e: {s: (0.0, None)}}, hi)
                out[k] = [nodes.get(f, {}).get(t, (-np.inf,))[0] for t, f in leaves]
            return out
        first, last = at
        enter = []
        for s, e in enters:
            found = self._forward(text, {e: {s: (0.0, None)}}, first).get(first, {})
            enter.append(max((v for v, _ in found.values()), default=-np.inf))
        middle = 0.0 if self.model.merges else sum(self.best(w)[0] for w in self.words(text[first:last]))
        nodes = self._forward(text, {last: {last: (0.0, None)}}, hi)
        leave = [nodes.get(f, {}).get(t, (-np.inf,))[0] for t, f in leaves]
        return np.array(enter)[:, None] + middle + np.array(leave)[None, :]

    def traced(self, text: str, lo: int, hi: int, enter: int, leave: int) -> np.ndarray:
        """The ids of a chunk whose states at both ends are known."""
        enters = self.cut(text, lo)
        first, last = enters[enter], self.cut(text, hi)[leave]
        at = rests(self.model, text, max(e for _, e in enters), hi)
        nodes = {first[1]: {first[0]: (0.0, None)}}
        if at is None:
            return np.array(self._path(text, self._forward(text, nodes, hi), last, first), np.int32)
        nodes = self._forward(text, nodes, at[0])
        start = max(nodes[at[0]].items(), key=lambda x: x[1][0])[0]
        head = self._path(text, nodes, (start, at[0]), first)
        nodes = self._forward(text, {at[1]: {at[1]: (0.0, None)}}, hi)
        tail = self._path(text, nodes, last, (at[1], at[1]))
        return np.concatenate((np.array(head, np.int32), self.encode(text[at[0] : at[1]]), np.array(tail, np.int32)))


def states(matrices: list[np.ndarray], enter: int = 0, leave: int | None = None) -> list[int]:
    """The state at each cut between neighbours whose outer states are given, or the best at the end: sums forward and a walk back."""
    sums, froms = np.full(len(matrices[0]), -np.inf), []
    sums[enter] = 0.0
    for m in matrices:
        through = sums[:, None] + m
        froms.append(through.argmax(0))
        sums = through.max(0)
    out = [int(sums.argmax()) if leave is None else leave]
    for f in reversed(froms):
        out.append(int(f[out[-1]]))
    return out[::-1]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The max-plus product of neighbours, which may be taken in any grouping."""
    out = matrices[0]
    for m in matrices[1:]:
        out = np.stack([(row[:, None] + m).max(0) for row in out])
    return out


def spelled(model: Model, ids) -> str:
    return b"".join([model.raw[i] for i in ids]).decode("utf-8", "replace")


def decode(model: Model, ids) -> str:
    text = spelled(model, ids)
    return text[1:] if text.startswith(" ") else text


_ENCODERS: dict = {}


def _encoder(sent) -> Encoder:
    """One for each model and worker, so its cache serves all tasks there."""
    if id(sent.value) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(sent.value)] = Encoder(sent.value)
    return _ENCODERS[id(sent.value)]


def around(text: str, start: int, size: int, reach: int) -> tuple[str, int, int]:
    """A chunk start..start+size of a text, marked, with reach characters around, and where it lies in that."""
    left = min(start, reach)
    part = marked(text[start - left : start + size + reach], start == left)
    more = start == left  # the META in front
    return part, (0 if start == 0 else left + more), left + size + more


def encoded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id_col, ids, n_pieces, round_trip) for each row of docs; round_trip: the ids decode to the text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(texts.dtypes)["id"]

    def whole(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = _encoder(sent)
        for batch in batches:
            ids = [encoder.encode(marked(t)) for t in batch["text"]]
            good = [decode(sent.value, i.tolist()) == t for i, t in zip(ids, batch["text"], strict=True)]
            yield {"id": batch["id"], "ids": ids, "n_pieces": [len(i) for i in ids], "round_trip": good}

    small = mapped(texts.where(F.length("text") <= chunk), whole, f"id {kind}, ids array<int>, n_pieces long, round_trip boolean")

    giant = staged(texts.where(F.length("text") > chunk).select("*", F.length("text").alias("length"), F.monotonically_increasing_id().alias("row")), "giant")
    reach = model.longest
    columns = ("text", "start", "left", "size")

    def parted(parts: DataFrame, most: int) -> DataFrame:
        """Parts of most characters, each with the place where it starts in its text and reach characters around."""
        at = parts.select("row", *columns, F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(most))).alias("at"))
        left = F.least(F.col("left") + F.col("at"), F.lit(reach))
        size = F.least(F.lit(most), F.col("size") - F.col("at"))
        text = F.substring("text", F.col("left") + F.col("at") - left + 1, left + size + reach)
        return at.select("row", text.alias("text"), (F.col("start") + F.col("at")).alias("start"), left.alias("left"), size.alias("size"))

    # A substring is found by walking from the text's start, so giant texts are first cut into parts of FAN chunks.
    cut = parted(parted(giant.select("row", "text", F.lit(0).alias("start"), F.lit(0).alias("left"), F.col("length").alias("size")), FAN * chunk), chunk)

    def seen(text: str, start: int, left: int, size: int) -> tuple[str, int, int]:
        """As around(), of a part that has left characters before the chunk."""
        begins = start == left
        return marked(text, begins), 0 if start == 0 else left + begins, left + size + begins

    def matrices(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = _encoder(sent)
        for batch in batches:
            made = [encoder.matrix(*seen(*x)) for x in zip(*(batch[c] for c in columns), strict=True)]
            yield {"row": batch["row"], "k": [s // chunk for s in batch["start"]], "enters": [len(m) for m in made], "sums": [m.ravel() for m in made]}

    def shaped(parts: list[dict]) -> list[np.ndarray]:
        return [np.array(p["sums"]).reshape(p["enters"], -1) for p in parts]

    def multiplied(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            made = [product(shaped(parts)) for parts in batch["parts"]]
            yield {"row": batch["row"], "k": batch["group"], "enters": [len(m) for m in made], "sums": [m.ravel() for m in made]}

    def solved(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"row": [], "k": [], "enter": [], "leave": []}
            for row, parts, enter, leave in zip(*(batch[c] for c in ("row", "parts", "enter", "leave")), strict=True):
                at = states(shaped(parts), enter, leave)
                for i, p in enumerate(parts):
                    for c, v in zip(out, (row, p["k"], at[i], at[i + 1]), strict=True):
                        out[c].append(v)
            yield out

    def grouped(sums: DataFrame, fan: int) -> DataFrame:
        """(row, group, parts): neighbours in order."""
        return sums.groupBy("row", F.expr(f"k div {fan}").cast("int").alias("group")).agg(F.array_sort(F.collect_list(F.struct("k", "enters", "sums"))).alias("parts"))

    def trace(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = _encoder(sent)
        for batch in batches:
            out: dict = {"row": batch["row"], "start": batch["start"], "ids": [], "covered": [], "good": []}
            for t, s, f, z, e, v in zip(*(batch[c] for c in (*columns, "enter", "leave")), strict=True):
                text, lo, hi = seen(t, s, f, z)
                ids = encoder.traced(text, lo, hi, e, v)
                read = text[encoder.cut(text, lo)[e][1] : encoder.cut(text, hi)[v][1]]
                out["ids"].append(ids)
                out["covered"].append(len(read))
                out["good"].append(spelled(sent.value, ids.tolist()) == read.replace(META, " ").replace(LITERAL, META))
            yield out

    matrix = "row long, k int, enters int, sums array<double>"
    levels = [staged(mapped(cut, matrices, matrix), "matrices")]
    most = -(-(giant.agg(F.max("length")).first()[0] or 0) // chunk)
    while most > FAN:
        levels.append(staged(mapped(grouped(levels[-1], FAN), multiplied, matrix), "matrices"))
        most = -(-most // FAN)
    solution = "row long, k int, enter int, leave int"
    # At the top a text has one group of FAN matrices at most.
    top = grouped(levels[-1], FAN).select("row", "parts", F.lit(0).alias("enter"), F.lit(None).cast("int").alias("leave"))
    at = mapped(top, solved, solution)
    for lower in reversed(levels[:-1]):
        at = mapped(grouped(lower, FAN).join(at.withColumnRenamed("k", "group"), ["row", "group"]), solved, solution)
    at = at.select("row", (F.col("k") * chunk).alias("start"), "enter", "leave")
    traced = mapped(cut.join(at, ["row", "start"]), trace, "row long, start int, ids array<int>, covered long, good boolean")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda p: p["ids"])).alias("ids")
    joined = traced.groupBy("row").agg(ids, F.sum("covered").alias("covered"), F.every("good").alias("good"))
    # The chunks' ids decode to their own stretches, which together are the text with one space in front.
    good = F.col("good") & (F.col("covered") == F.col("length") + 1)
    large = joined.join(giant.select("row", "id", "length"), "row").select("id", "ids", F.size("ids").cast("long").alias("n_pieces"), good.alias("round_trip"))
    return small.union(large).withColumnRenamed("id", id_col)

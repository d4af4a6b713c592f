import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.llm import gru
from foldstone.llm.crf import fold


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [0]


def corpus(n, seed):
    """Two languages, each with a grammar: what comes next depends on the word before."""
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [f"{'xy'[r.random() < 0.5]}{k}" for k in range(12)]
        at, own = r.randrange(12), []
        for _ in range(r.randint(5, 80)):
            own.append(words[at] + (str(r.randrange(10**6)) if r.random() < 0.05 else ""))
            at = (at + r.choice((1, 1, 1, 5))) % 12
        texts.append(" ".join(own))
    return texts


@pytest.fixture(params=[1 << 18, 8])
def head(request, monkeypatch):
    monkeypatch.setattr(gru, "HEAD", request.param)
    return request.param


def test_base_scores(docs, odd, head):
    texts = corpus(120, 1) + odd
    rows = {r.doc_id: r for r in gru.language_model(docs(texts), fold("doc_id", 10)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    count = collections.Counter(w for i, t in enumerate(texts) if not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        own, r = tokens(t), rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_model_beats_unigrams_on_held_out_texts(docs, monkeypatch):
    monkeypatch.setattr(gru, "LANES", 8)
    rows = [r for r in gru.language_model(docs(corpus(5000, 2)).repartition(2), fold("doc_id", 10)).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_every_learning_text_trains_once(docs, spark, monkeypatch):
    """The rounds' tokens are all training tokens, and none twice."""
    seen = spark.sparkContext.accumulator(0)
    whole = gru.train

    def noted(p, head, places, squares=None):
        n = whole(p, head, places, squares=squares)
        seen.add(n)
        return n

    monkeypatch.setattr(gru, "train", noted)
    texts = corpus(300, 5)
    rows = gru.language_model(docs(texts, [None if i % 50 == 1 else i for i in range(len(texts))]).repartition(3), fold("doc_id", 10)).collect()
    assert seen.value == rows[0].train_tokens == sum(r.n_tokens for r in rows if not r.held_out)


def test_all_tokens_of_a_pass_train():
    """Lanes of unequal length lose nothing: the last token alone changes its class's bias."""
    head = small_head()
    for n in (1, 2, 31, 63, 64, 65, 1000, 20_001):
        places = np.arange(n, dtype=np.int32) % 64
        p = gru.initial(head)
        assert gru.train(p, head, places) == n


def test_words_that_a_polynomial_hash_confuses(docs):
    """Words by the Thue-Morse rule and its mirror are two tokens."""
    a, b = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    rows = {r.doc_id: r for r in gru.language_model(docs([a, a, b], [1, 2, 0]), F.col("doc_id") == 0).collect()}
    assert rows[0].n_known == 1 and rows[1].n_known == 2


def test_nothing(docs):
    assert gru.language_model(docs([]), fold("doc_id", 10)).count() == 0
    (r,) = gru.language_model(docs([None], [None]), fold("doc_id", 10)).collect()
    assert (r.n_tokens, r.n_known) == (1, 1 - r.held_out)
    (r,) = gru.language_model(docs([None], [1]), F.lit(True)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (1, 0, 0)


def small_head():
    words = [f"w{i}".encode() for i in range(800)]
    return gru.Head([*words, gru.END], [*range(800, 0, -1), 300], np.full(gru.ENDINGS, 5.0))


def test_chances_sum_to_one():
    head, r = small_head(), np.random.default_rng(1)
    p = gru.initial(head)
    state = r.normal(size=(gru.STATE, 1)).astype(np.float32)
    n = len(head.words)
    logs, _ = gru.outputs(p, np.repeat(state, n, 1), head.cls[:n], np.arange(n))
    rare = np.exp(gru.outputs(p, np.repeat(state, gru.ENDINGS, 1), np.arange(gru.FULL + gru.ENDINGS, gru.CLASSES), np.zeros(gru.ENDINGS, int))[0])
    assert abs(np.exp(logs + head.inside[:n]).sum() + rare.sum() - 1) < 1e-4


def test_gradients():
    """Backpropagation's first step moves every parameter against its numeric slope."""
    head, r = small_head(), np.random.default_rng(2)
    own = r.integers(0, len(head.words), 12).astype(np.int32)
    start = gru.initial(head)

    def loss(p):
        before = np.append(np.int32(gru.START), head.inputs[own][:-1])
        state, states = np.zeros((gru.STATE, 1)), []
        for b in before:
            state, _ = gru.step(p, state, gru.given(p, np.array([[b]]))[0])
            states.append(state)
        return -gru.outputs(p, np.concatenate(states, 1), head.cls[own], own)[0].sum()

    moved = {k: v.copy() for k, v in start.items()}
    gru.train(moved, head, own, rate=1e-3)
    exact = {k: v.astype(np.float64) for k, v in start.items()}
    checked = 0
    for k in gru.SHAPES:
        change = (moved[k] - start[k]).ravel()
        for at in r.choice(np.flatnonzero(np.abs(change) > 5e-4), 8):
            up, down = ({**exact, k: exact[k].copy()} for _ in range(2))
            up[k].ravel()[at] += 1e-5
            down[k].ravel()[at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            if abs(slope) > 1e-3:
                assert np.sign(slope) == -np.sign(change[at]), (k, at)
                checked += 1
    assert checked > 30


def test_state_is_carried_from_window_to_window(monkeypatch):
    head = small_head()
    p = gru.initial(head)
    r = np.random.default_rng(3)
    texts = [r.integers(-8, len(head.words), n).astype(np.int32) for n in (1, 70, 16, 33)]
    flat, begins = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    made = []
    for window in (1, 16, 1000):
        monkeypatch.setattr(gru, "WINDOW", window)
        made.append(gru.scores(p, head, flat, begins))
    assert np.allclose(made[0], made[1], rtol=1e-5) and np.allclose(made[0], made[2], rtol=1e-5)
    alone = [gru.scores(p, head, t, np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(made[0], alone, rtol=1e-5)

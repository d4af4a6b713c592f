import os
import random

import numpy as np
import pytest
import sentencepiece

from foldstone.llm import pieces
from foldstone.llm.pieces import Encoder, Model, around, decode, encoded, marked, product, states
from foldstone.llm.queries import PIECES

from .conftest import prose

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no model file")


@pytest.fixture(scope="module")
def model():
    return Model.load(PIECES)


def some_texts(n=120):
    r = random.Random(1)
    odd = ["", " ", "  ", " a", "a  b ", "Hello  wörld\n x\t 😀  ", "日本語 梦 \x00 z", "a" * 40, "x" * 150 + "thetion" * 20]
    return odd + ["".join(r.choice(["the", " ", "  ", "a", "tion", "é", "😀", "\n", "ing", "日本"]) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_ids_are_the_library_s(model):
    lib, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES), Encoder(model)
    for t in [*some_texts(), prose(random.Random(5), 400)]:
        ids = encoder.encode(marked(t)).tolist()
        assert ids == lib.encode(t) == encoder.best(marked(t))[1]
        assert decode(model, ids) == lib.decode(ids) == t


@pytest.mark.parametrize("change", [{}, {"merges": False}, {"merges": False, "split": False}, {"split": False}])
def test_chunks_give_the_whole_scan(model, change):
    """Cut at any place, the combined matrices have the best sum of one scan, and the chunks' ids decode to the text."""
    model = model._replace(**change)
    encoder = Encoder(model)
    for t in [*some_texts(40), "▁▁ ▁x"]:
        total, whole = encoder.best(marked(t))
        for size in (1, 3, 7, 16, 40):
            parts = [around(t, s, min(size, len(t) - s), model.longest) for s in range(0, len(t), size)]
            if not parts:
                continue
            matrices = [encoder.matrix(*p) for p in parts]
            at = states(matrices)
            got = [i for k, p in enumerate(parts) for i in encoder.traced(*p, at[k], at[k + 1]).tolist()]
            sums = np.zeros(1)
            for m in matrices:
                sums = (sums[:, None] + m).max(0)
            assert abs(sums.max() - total) < 1e-6
            assert decode(model, got) == t
            if model.merges:
                assert got == whole


def test_rests_are_the_spaces_after_other_characters(model):
    r = random.Random(2)
    for _ in range(400):
        t = "".join(r.choice("ab▁▁") for _ in range(r.randint(1, 9)))
        lo, hi = sorted((r.randint(0, len(t)), r.randint(0, len(t))))
        at = [i for i in range(max(1, lo + 1), hi) if t[i] == "▁" != t[i - 1]]
        assert pieces.rests(model, t, lo, hi) == ((at[0], at[-1]) if at else None)


def test_matrices_combine_in_any_order(model):
    encoder, t = Encoder(model._replace(split=False)), "thetionthe ingtion" * 3
    a, b, c = (encoder.matrix(*around(t, s, 18, model.longest)) for s in range(0, 54, 18))
    assert np.array_equal(product([product([a, b]), c]), product([a, product([b, c])]))
    assert np.array_equal(product([a, b, c]), product([product([a, b]), c]))


@pytest.mark.parametrize("fan", [2, 3])
def test_levels_fix_the_states_of_one_walk(fan):
    """Random matrices, combined in groups and solved from the top down, against one walk through all."""
    r = np.random.default_rng(fan)
    for n in range(1, 12):
        sizes = [1, *r.integers(1, 5, n)]
        chunks = [r.normal(size=(a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        levels = [chunks]
        while len(levels[-1]) > fan:
            levels.append([product(levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
        at = states(levels[-1])
        for lower in reversed(levels[:-1]):
            groups = [lower[i : i + fan] for i in range(0, len(lower), fan)]
            at = [0] + [x for g, e, v in zip(groups, at, at[1:], strict=False) for x in states(g, e, v)[1:]]
        assert at == states(chunks)


def test_unigram_scan_is_the_best_of_all(model):
    small = {"a": -1.0, "b": -1.2, "ab": -1.9, "aba": -2.5, "▁": -0.5, "▁a": -1.4}
    encoder = Encoder(model._replace(ids={p: i for i, p in enumerate(small)}, scores=small, longest=3, merges=False, unknown=-9.0))

    def best(text):
        if not text:
            return 0.0
        return max(small.get(text[:n], -9.0 if n == 1 else -np.inf) + best(text[n:]) for n in range(1, min(3, len(text)) + 1))

    r = random.Random(0)
    for _ in range(60):
        t = "".join(r.choice("ab▁c") for _ in range(r.randint(1, 9)))
        assert abs(encoder.best(t)[0] - best(t)) < 1e-9


def test_operator(model, docs, odd, monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for chunk, fan in ((1 << 16, 64), (700, 64), (3000, 4)):
        monkeypatch.setattr(pieces, "FAN", fan)
        rows = encoded(docs(odd), model, chunk=chunk).collect()
        assert len(rows) == len(odd)
        for r in rows:
            text = odd[r.doc_id] or ""
            assert r.round_trip and r.n_pieces == len(r.ids)
            if "▁" not in text:
                assert list(r.ids) == lib.encode(text)
    assert encoded(docs([]), model).count() == 0
    twice = encoded(docs(["same"] * 3, [5, 5, None]), model).collect()
    assert len(twice) == 3 and len({tuple(r.ids) for r in twice}) == 1

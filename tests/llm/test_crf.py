import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from foldstone.llm.crf import fit, fold, marginals, toxicity

from .conftest import prose


def test_marginals_are_those_of_all_taggings():
    r = np.random.default_rng(0)
    emission, first = r.normal(size=37), np.zeros(37, bool)
    first[[0, 5, 6, 20, 30]] = True
    turn, start = np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([0.8, 0.2])
    pairs = np.zeros((2, 2))
    for width in (1, 3, 128):
        chance, moves = marginals(emission, first, turn, start, width)
        pairs = np.zeros((2, 2))
        for a, b in ((0, 5), (5, 6), (20, 30), (30, 37), (6, 20)):
            total, sums, own = 0.0, np.zeros(b - a), np.zeros((2, 2))
            for tags in itertools.product((0, 1), repeat=b - a):
                v = start[tags[0]] * np.prod([turn[x, y] for x, y in zip(tags, tags[1:], strict=False)]) * np.exp((emission[a:b] * tags).sum())
                total, sums = total + v, sums + v * np.array(tags)
                for x, y in zip(tags, tags[1:], strict=False):
                    own[x, y] += v
            assert np.allclose(chance[a:b], sums / total)
            pairs += own / total
        assert np.allclose(moves, pairs)


def labelled(n, seed):
    r = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        words = prose(r, 40).split()
        bad = i % 5 == 0
        for _ in range(4 * bad):
            words.insert(r.randrange(len(words)), r.choice(("grobnik", "Grobnika", "vlasten,")))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_documents(spark, docs):
    texts, toxic = labelled(500, 3)
    labels = spark.createDataFrame([(i, 1, t, "x") for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int, text string")
    rows = toxicity(docs(texts), labels, fold("doc_id", 5)).collect()
    assert len(rows) == 500
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.97
    for r in held:
        found = {texts[r.doc_id][int(a) : int(b)].lower() for a, b in (s.split(":") for s in r.spans.split(",") if s)}
        assert found <= {"grobnik", "grobnika", "vlasten"}
        assert bool(found) == bool(r.predicted)


def test_labels_of_held_out_rows_teach_nothing(spark, docs):
    texts, toxic = labelled(200, 4)
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)]
    turned = [1 - t if h else t for t, h in zip(toxic, held, strict=True)]
    made = []
    for own in (toxic, turned):
        labels = spark.createDataFrame(list(enumerate(own)), "doc_id long, toxic int")
        made.append(sorted((r.doc_id, r.score) for r in toxicity(docs(texts), labels, fold("doc_id", 5)).collect()))
    assert made[0] == made[1]


def test_few_toxic_documents_are_enough_and_order_does_not_matter():
    texts, toxic = labelled(60, 7)
    field = fit(texts, np.array(toxic, bool))
    more, labels = labelled(100, 8)
    found = [field.score(c) >= 0.5 for c in field.chances(more)]
    assert np.mean(np.array(found) == labels) > 0.95


def test_repeated_ids_and_the_bound_on_characters(spark, docs):
    texts, toxic = labelled(200, 9)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    ids = [*range(200), 3, 3, 5]
    both = [toxicity(docs([*texts, *more], ids).repartition(n), labels, F.lit(False)) for n, more in ((1, ["~~ a", "~~ b", "~~ c"]), (7, ["~~ c", "~~ a", "~~ b"]))]
    one, two = ({r.doc_id: r.score for r in made.collect() if r.doc_id not in (3, 5)} for made in both)
    assert one == two and any(s >= 0.5 for s in one.values())
    bounded = toxicity(docs(texts), labels, F.lit(False), chars=20_000).collect()
    assert len(bounded) == 200 and np.mean([r.predicted == toxic[r.doc_id] for r in bounded]) > 0.95


def test_odd_texts(spark, docs, odd):
    texts, toxic = labelled(150, 5)
    labels = spark.createDataFrame([*enumerate(toxic), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity(docs(texts + odd), labels, fold("doc_id", 5)).collect()
    assert len(rows) == len(texts) + len(odd)
    tail = {r.doc_id: r.score for r in rows if r.doc_id >= 150}
    assert tail[150] == tail[151] == tail[152]
    assert all(s < 0.5 for s in tail.values())
    assert toxicity(docs([]), labels, fold("doc_id", 5)).count() == 0
    none = toxicity(docs(["a", None], [None, 1]), labels.where("false"), F.lit(False)).collect()
    assert [r.score for r in none] == [0.0, 0.0]


def test_offsets_hold_where_lower_case_is_longer():
    texts, toxic = labelled(200, 6)
    field = fit(texts, np.array(toxic, bool))
    (chance,) = field.chances(["İİ ab grobnik"])
    assert chance.argmax() == 2

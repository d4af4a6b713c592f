import random

from hypothesis import given, settings
from hypothesis import strategies as st

from foldstone.llm import decontaminate
from foldstone.llm.decontaminate import RATE, allowed, leaks, myers, normalised, without_leaks

from .conftest import prose


def distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        before = row
    return min(before)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c", min_size=1, max_size=12), st.text(alphabet="ab c", max_size=30))
def test_myers_is_the_table(pattern, text):
    assert myers(pattern, text) == distance(pattern, text)


def test_passages_with_edits(spark, docs, odd):
    r = random.Random(2)
    items = [prose(r, n) for n in (12, 20, 35)] + ["", None, "?!", "tiny"]
    budget = [max(1, int(len(normalised(i)) * RATE)) for i in items[:3]]
    texts, want = list(odd), set()
    for k, item in enumerate(items[:3]):
        for edits in (0, 1, budget[k], budget[k] + 4):
            chars = list(item.upper() if edits == 1 else item)
            for at in r.sample([i for i, c in enumerate(chars) if c.isalpha()], edits):
                chars[at] = "7"
            if edits <= budget[k]:
                want.add((len(texts), k, edits))
            texts.append(prose(r, 30) + ",\n  " + "".join(chars).replace(" ", " \n", 2) + " ... " + prose(r, 10))
        texts.append(prose(r, 30) + item[: len(item) // 2] + prose(r, 30))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.distance) for x in leaks(docs(texts), table).collect() if x.item_id < 3}
    assert got == want
    assert leaks(docs([]), table).count() == 0
    assert leaks(docs(texts), table.where("false")).count() == 0


def test_every_match_of_brute_force(spark, docs, monkeypatch):
    r = random.Random(8)
    items = [prose(r, 6) for _ in range(12)]
    texts = []
    for _ in range(60):
        own = list(r.choice(items))
        for at in r.sample(range(len(own)), r.randint(0, 4)):
            own[at] = r.choice("xyz ")
        texts.append(prose(r, 8) + " " + "".join(own) + " " + prose(r, 8))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in leaks(docs(texts), table).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            n = normalised(item)
            found = distance(n, normalised(t))
            if found <= min(max(1, int(len(n) * RATE)), len(n) // 8 - 1):
                want[d, i] = found
    assert got == want
    monkeypatch.setattr(decontaminate, "BLOCK", 100)  # several blocks
    assert {(x.doc_id, x.item_id): x.distance for x in leaks(docs(texts), table).collect()} == want
    kept = without_leaks(docs(texts, [None] * 30 + [5] * 30), table)
    assert kept.columns == docs(texts).columns
    assert sorted(r.text for r in kept.collect()) == sorted(t for d, t in enumerate(texts) if not any((d, i) in want for i in range(12)))


def test_budgets():
    assert [allowed(n) for n in (1, 8, 15, 16, 24, 25, 100, 200)] == [0, 0, 0, 1, 1, 2, 8, 16]


def test_short_items_must_occur_unchanged(spark, docs):
    table = spark.createDataFrame([(1, "tiny thing"), (1, "tiny thing"), (2, "a rather longer one")], "item_id long, text string")
    rows = leaks(docs(["xx TINY  thing!", "tiny thjng", "a rother longer one", None, "", "xx TINY  thing!"]), table).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in rows) == [(0, 1, 0), (0, 1, 0), (2, 2, 1), (5, 1, 0), (5, 1, 0)]

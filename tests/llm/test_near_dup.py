import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from foldstone.llm.common import shingle_sets
from foldstone.llm.components import components
from foldstone.llm.near_dup import near_duplicates

from .conftest import prose


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, k, num, ids=None):
    ids = ids or list(range(len(texts)))
    sets = []
    for t in texts:
        w = word_list(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, dict(zip(ids, map(len, sets), strict=True))


def check(frame, texts, k, num):
    want, sizes = brute(texts, k, num)
    got = near_duplicates(frame, k, num).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def corpus(seed, n_base, copies):
    r = random.Random(seed)
    shared = prose(r, 25)
    texts = []
    for _ in range(n_base):
        words = (prose(r, r.choice((2, 4, 7, 15, 60, 150))) + (" " + shared if r.random() < 0.5 else "")).split()
        for _ in range(r.randint(1, copies)):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(own) // 14))):
                at = r.randrange(len(own))
                own[at : at + r.choice((0, 1))] = [prose(r, 1)] * r.choice((0, 1))
                own = own or ["z"]
            texts.append(" ".join(own))
    r.shuffle(texts)
    return texts


def test_components_are_those_of_all_pairs(docs):
    for seed, k, num in ((1, 3, 85), (2, 5, 80)):
        texts = corpus(seed, 40, 8)
        check(docs(texts), texts, k, num)


def test_large_group_of_near_copies(docs):
    r = random.Random(9)
    core = prose(r, 150).split()
    texts = []
    for _ in range(220):
        own = list(core)
        for at in r.sample(range(len(own)), r.randint(0, 9)):
            own[at] = prose(r, 1) + str(r.randrange(1000))
        texts.append(" ".join(own))
    check(docs(texts), texts, 3, 85)


def test_odd_texts(docs, odd):
    check(docs(odd), odd, 3, 85)
    assert near_duplicates(docs([]), 3, 85).count() == 0
    one = near_duplicates(docs(["", ""]), 3, 85).collect()
    assert sorted((r.component_id, r.kept) for r in one) == [(0, True), (1, True)]


def test_repeated_and_missing_ids(docs):
    got = near_duplicates(docs(["a b c d", "a b c d", "e f g h", "a b c d"], [7, 7, 7, None]), 3, 85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, False), (7, 7, True), (7, 7, True), (7, 7, True)]


def test_texts_of_one_id_are_one_document(docs):
    a, b, c = "a b c d e f", "u v w x y z", "q r s"
    got = near_duplicates(docs([a, b, a, b, "", c, c, ""], [7, 7, 9, 3, 7, 12, 11, 12]), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(3, 4, 3, True), (7, 0, 3, False), (7, 4, 3, False), (7, 4, 3, False), (9, 4, 3, False), (11, 1, 11, True), (12, 0, 11, False), (12, 1, 11, False)]


def test_words_that_a_polynomial_hash_confuses(docs):
    """Words by the Thue-Morse rule and its mirror."""
    a, b = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    got = near_duplicates(docs([a, b, f"{a} {b} {a}", f"{b} {a} {b}"]), 3, 85).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 299), (299, 298), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 298 for i in (298, 299, 300)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t\x0b", max_size=20), max_size=6))
def test_set_sizes(texts):
    for text, own in zip(texts, shingle_sets(texts, 3), strict=True):
        assert len(own) == brute([text], 3, 85)[1][0]

import random

import pytest

WORDS = "the of and to in is that it for a tion ing ent ere hat whi con ter ver est all not but his her".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture
def docs(spark):
    """Builds a documents table with a clashing column or two beside its own."""

    def build(rows, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "src0", len(t or ""), 9, 8, "x") for i, t in enumerate(rows)]
        return spark.createDataFrame(rows, DOCS + ", n long, row long, id string")

    return build


@pytest.fixture
def odd():
    """Texts that every operator must take: null, empty, blank, tiny, repeated, very long."""
    r = random.Random(4)
    long = prose(r, 30_000)
    return [None, "", " \n\t ", "a", "a", "héllo wörld ▁ 😀", "x" * 5000, long, long + " tail", "\n\n\n", "one two", "one two three"]

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from foldstone.llm import common  # noqa: E402
from foldstone.llm.decontaminate import leaks  # noqa: E402
from foldstone.llm.queries import ORACLES, QUERIES  # noqa: E402

from .conftest import prose  # noqa: E402
from .test_near_dup import brute as groups  # noqa: E402
from .test_quality import brute as measures  # noqa: E402
from .test_secrets import brute as found  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        frame = stage(spark, docs, SF)
        rows = frame.collect()
        made[name] = rows
        after = {r.doc_id for r in rows}
        assert len(after) == len(rows)
        assert after <= before.keys()
        if name == "quality":
            assert not any(measures(before[i])[-1] for i in after)
            assert len(after) > 0.7 * len(before)
        elif name == "near_dedup":
            root, _ = groups(list(before.values()), 5, 80, list(before))
            assert after == {i for i in before if root[i] == i}
        elif name == "decontamination":
            gone = {r.doc_id for r in leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert after == before.keys() - gone
        elif name == "secrets":
            assert after == before.keys()
            for r in rows:
                assert not found(r.text) and r.n_chars == len(r.text)
                if not found(before[r.doc_id]) and "[SECRET]" not in r.text:
                    assert r.text == before[r.doc_id]
        else:
            assert after == before.keys() and all(r.round_trip for r in rows)
        if name != "pieces":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(rows, docs.schema)
    last = {r.doc_id: list(r.ids) for r in pipeline.run(spark, SF).collect()}
    assert last == {r.doc_id: list(r.ids) for r in made["pieces"]}


def test_names():
    assert sorted({re.match(r"op(\d+)_", q)[1] for q in QUERIES}, key=int) == [str(n) for n in range(1, 11)]
    assert ORACLES.keys() <= QUERIES.keys()
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "pieces"]


def test_rows_without_an_id_and_with_the_same(spark, docs):
    """Each row is judged by its own text; of equal texts the smallest id stays; all columns are carried."""
    r = random.Random(3)
    a, b, c, d = (" ".join(prose(r, 1) + str(k) for k in range(60)) for _ in range(4))
    rows = [(7, a), (7, b), (3, a), (None, c), (None, c), (5, d), (5, d), (None, d), (8, ""), (8, None), (None, "")]
    frame = docs([t for _, t in rows], [i for i, _ in rows])
    kept = pipeline.near_dedup(spark, frame, SF)
    assert kept.columns == frame.columns
    got = sorted(((x.doc_id, x.text) for x in kept.collect()), key=str)
    assert got == sorted([(7, b), (3, a), (None, c), (5, d), (8, ""), (8, None), (None, "")], key=str)
    for name, stage in pipeline.STAGES[2:4]:
        after = stage(spark, frame, SF)
        assert after.columns == frame.columns and after.count() == len(rows), name


def test_scratch_tables_go_early(spark):
    before = common.staged_so_far()
    pipeline.run(spark, SF).collect()
    assert not any(name in path for path in common._STAGED[before:] for name in ("quality", "near_dedup", "decontamination", "sketches"))


def test_odd_documents(spark, docs, odd):
    frame = docs(odd).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        frame = stage(spark, frame, SF)
        assert frame.count() >= 0
    frame = docs([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.count() == 0

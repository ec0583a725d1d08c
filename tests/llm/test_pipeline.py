import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")


def test_stages(spark):
    docs = c.table(spark, SF, "documents")
    first, all_ = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in c.STAGES:
        docs = c.materialize(stage(spark, docs, SF), "test")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(kept[name])
        assert docs.columns == first or name == "tokens"
    order = [set(x) for x in kept.values()]
    assert all(b <= a for a, b in zip([set(all_), *order], order))
    assert order[0] == set(all_)  # all are prose in known languages
    texts = {}
    for i, r in kept["language"].items():
        texts.setdefault(r.text, []).append(i)
    assert set(kept["near_duplicates"]) <= {min(v) for v in texts.values()}
    assert set(kept["pii"]) == set(kept["decontaminate"])
    for r in kept["pii"].values():
        assert r.n_chars == len(r.text) or r.text == all_[r.doc_id].text
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in kept["tokens"].values())


def test_odd_rows_and_extra_columns(spark):
    rows = [(1, "the and of that with", "en", "s", 5, "a"), (1, "the and of that with", "en", "s", 5, "b"), (2, None, "en", "s", 0, "c"),
            (3, "", None, None, None, "d"), (None, "the other of mail joe@mail.example.com", "en", "s", 3, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found string")
    for name, stage in c.STAGES:
        docs = c.materialize(stage(spark, docs, SF), "test")
    got = docs.collect()
    assert len(got) == len({r.doc_id for r in got})
    assert all(r.found in "abe" for r in got)


def test_empty_documents(spark):
    docs = c.table(spark, SF, "documents").where(F.lit(False))
    for _, stage in c.STAGES:
        docs = c.materialize(stage(spark, docs, SF), "test")
    assert docs.count() == 0

"""Terms of a corpus are not dealt as rows: texts are dealt by key, and only rare terms by term."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowguard import session
from flowguard.operators import webshell
from flowguard.schemas import PACKET

TEXTS = [(0, "aa bb aa"), (1, "bb cc"), (2, "aa bb bb cc dd"), (2, "aa ee aa"), (3, "- !"), (None, "bb"), (None, "Bb ff"), (4, "éé ñandú"), (5, "aa bb")]


def wanted():
    """tf and weight of each key and term; equal keys are one text for the terms, but two for their number."""
    tf = {}
    for key, text in TEXTS:
        tf.setdefault(key, Counter()).update(t for t in re.findall(r"\w{2,}", text.lower()))
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((1 + len(TEXTS)) / (1 + n)) + 1 for t, n in df.items()}
    norm = {k: math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for k, c in tf.items()}
    return {(k, t): (n, n * idf[t] / norm[k]) for k, c in tf.items() for t, n in c.items()}


@pytest.fixture
def texts(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame(TEXTS, "pkt_no int, payload string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("known", [0, 2, 5, 1 << 18])
def test_weights_with_any_number_of_broadcast_terms(texts, known, monkeypatch):
    monkeypatch.setattr(webshell, "KNOWN_TERMS", known)
    found = webshell.corpus_tfidf(texts)
    got = {(r.pkt_no, r.term): (r.tf, r.tfidf) for r in found.collect()}
    want = wanted()
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert found.count() == len(want)
    terms = {"aa": 3.0, "bb": -2.5}
    hits = webshell.linear_hits(*webshell.corpus(texts), terms, -0.5).collect()
    score = Counter()
    for (k, t), (_, w) in want.items():
        score[k] += w * terms.get(t, 0.0)
    assert {r.pkt_no for r in hits} == {k for k, s in score.items() if s - 0.5 > 0} and len(hits) > 1


def test_rows_of_terms_are_not_dealt_by_text_and_term(texts):
    alone = texts.where("pkt_no IN (0, 1, 4, 5)")
    for found in (webshell.corpus_tfidf(alone), webshell.linear_hits(*webshell.corpus(alone), {"aa": 1.0}, 0.0)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(pkt_no#\d+L?, term", plan)
        assert "REPARTITION_BY_COL" in plan and "BroadcastHashJoin [term" in plan


def test_packets_that_share_a_number_are_one_text(spark):
    def upload(number, text):
        return {"pkt_no": number, "http": {"data": text.encode().hex()}, "ip": {"src": "a", "dst": "b"}}

    packets = spark.createDataFrame([{f.name: None for f in PACKET} | upload(*t) for t in ((1, "aa"), (1, "cc cc"), (2, "aa"), (3, "cc"))], PACKET)
    got = webshell.linear_events(packets, {"aa": 2.0, "cc": -2.0}, 0.0, ["pkt_no"]).collect()
    assert [r.detail for r in got] == ['{"pkt_no":2}']


def test_texts_of_enough_splits_are_not_exchanged(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    n = spark.sparkContext.defaultParallelism
    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(2 * n).write.parquet(path)
    monkeypatch.setattr(session, "SPREAD_BYTES", 1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        rows = spark.read.parquet(path)
        assert "Exchange" in session.spread(rows)._jdf.queryExecution().executedPlan().toString()
        kept = session.spread(rows, by_bytes=False)
        assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

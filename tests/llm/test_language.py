import os
import re
import time

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from flowguard.llm import language as l

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")


@pytest.fixture(scope="module")
def model(spark):
    return l.fit(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0"))


@needs_data
def test_held_out_accuracy(spark, model):
    rest = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1")
    found = l.identify(rest, "found", model)
    right = found.where(F.col("found.text_lang") == F.col("lang")).count()
    assert right >= 0.97 * rest.count()
    assert found.where(F.col("found.lang") == l.UNKNOWN).count() == 0


@needs_data
def test_evidence_is_fused(spark, model):
    rows = [(1, "<html lang='fr'><p>la de</p>", "a.example.com"), (2, "<html lang=xx>la de", "a.example.fr"), (3, "", "x.com"), (4, None, None),
            (5, "123 456 ---", "x.com"), (6, "<html lang=de><script>function the and of</script>", "x.com")]
    rows += [(100 + k, "<html>le les des que une dans pour", "b.example.fr") for k in range(30)] + [(200, "<html>on", "b.example.fr")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id int, html string, host string, found_host int")
    host = F.col("host")
    found = l.identify(df, "found", model, "html", None, host, F.lit("d"), l.suffix_language(host), markup=True)
    got = {r.page_id: r.found.lang for r in found.collect()}
    assert got[1] == "fr" and got[2] == "fr" and got[200] == "fr"
    assert got[3] == got[4] == got[5] == got[6] == l.UNKNOWN
    assert found.count() == len(rows)


@needs_data
def test_posterior_equals_the_sum_of_the_evidence(spark, model):
    text = "the and des que"
    df = spark.createDataFrame([(text, "fr", "h"), ("the with from that", None, "h"), ("zzz", "de", "i")], "text string, lang string, source string")
    rows = l.identify(df, "found", model, "text", "lang", F.col("source")).collect()
    data = np.frombuffer(text.encode(), np.uint8)
    ll = model.likelihoods(data, np.array([0, len(data)]))[0]
    votes = {}
    for r in rows:
        votes.setdefault(r.source, []).append(r.found.text_lang)
    names, every = model.names, sum(votes.values(), [])
    whole = [(every.count(n) + 1) / (len(every) + len(names)) for n in names]
    group = [(every.count(n) + l.PRIOR * w) / (len(every) + l.PRIOR) for n, w in zip(names, whole)]
    prior = [np.log((votes["h"].count(n) + l.PRIOR * g) / (len(votes["h"]) + l.PRIOR)) for n, g in zip(names, group)]
    said = [np.log(1 / 4) if n == l.UNKNOWN else np.log(0.9 if n == "fr" else 0.1 / 3) for n in names]
    score = ll + prior + said
    p = np.exp(score - score.max())
    first = next(r for r in rows if r.text == text)
    assert first.found.lang == names[int(score.argmax())]
    assert first.found.confidence == pytest.approx(p.max() / p.sum(), abs=1e-5)


@needs_data
def test_empty_table(none, model):
    assert l.identify(none, "found", model, "text", "lang", F.col("source")).count() == 0
    assert l.fit(none).table.shape == (1 << l.BITS, 5)


def test_markup():
    assert l.visible("<html><style>p{}</style>a<!-- b --><b>c</b>&amp;d<script>never ends").split() == ["a", "c", "d"]
    assert l.visible(None) == ""


PIECE = st.sampled_from(["<script>", "</script >", "<style a", "<!--", "-->", "<", ">", "&amp;", "a b", "<p>", "\n", "<html ", "lang = 'de'", "</style>"])


@given(st.lists(PIECE, max_size=14).map("".join))
def test_visible_text_equals_one_pattern_over_the_page(page):
    plain = re.compile(r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>|&[a-z0-9#]{1,10};")
    assert l.visible(page) == plain.sub(" ", page)
    tag = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", page)
    assert l.declared_language(page) == (tag[1].lower() if tag else None)


def test_long_broken_markup_is_read_in_linear_time():
    started = time.time()
    for piece in ("<", "<script", "<html ", "<!-", "<p a=", "<html lang  "):
        for page in (piece * 200_000, "<b>" + piece * 200_000, piece * 200_000 + ">"):
            l.visible(page)
            l.declared_language(page)
    assert time.time() - started < 20
    assert l.declared_language("<html " + "x" * 50_000 + " lang" + " " * 9 + "= fr>") == "fr"
    assert l.visible(None) == "" and l.declared_language(None) is None

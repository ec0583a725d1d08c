import random
import re

import pytest
from pyspark.sql import functions as F

from flowguard.llm import pii
from flowguard.llm.spans import spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    return {"email": True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text or "") if passes(kind, m.group())]
    return sorted(found)


@pytest.fixture(scope="module")
def mail(spark):
    r = random.Random(9)
    parts = ["a@b.c", "@", ".", "+", "_x@y.z-1", "1.2.3.4", "256.1.1.1", "007.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", " ", "é🙂", "12", "-", "\n", "n1@m.n.o.p", "%", "++1234567890"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(400)]
    texts += [None, "", "a" * 20000, "a@" * 3000, "1" * 20000, "1.2.3." * 4000, "a@b" + ".c" * 20000, "9 " * 20000, "+1" * 9000]
    texts += [f"call me at +1 (5{k:02d}) 555-77{k:02d} or mail joe{k}@mail.example.com, card 4111 1111 1111 1111, ref 1234-{k}" for k in range(100)]
    return texts


def test_base_spans_equal_the_plain_patterns(spark, mail):
    df = spark.createDataFrame(list(enumerate(mail)), "doc_id int, text string")
    rows = df.select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    assert {r.doc_id: [(x.start, x.kind, x.stop) for x in r.s] for r in rows} == {k: brute(t) for k, t in enumerate(mail)}


def test_spans_of_many_matches(spark):
    text = "🙂" + "ab1" * 1000
    got = spark.createDataFrame([(text,)], "t string").select(spans(F.col("t"), "[0-9]", F.lit(True)).alias("s")).first().s
    assert [(x.start, x.stop) for x in got] == [(m.start(), m.end()) for m in re.finditer("[0-9]", text)]


def test_judge_keeps_base_and_adds_outside_of_it(spark, mail):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(mail)], "doc_id int, text string, found_base string")
    judge = pii.fit(df)
    assert judge.trees
    judge.thresholds = {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0}  # take every candidate
    for r in pii.mark(df, judge, "found").collect():
        base = [(s.start, s.kind, s.stop) for s in r.found.base]
        every = [(s.start, s.kind, s.stop) for s in r.found.spans]
        assert base == brute(r.text) and set(base) <= set(every) and every == sorted(every)
        for a, _, b in set(every) - set(base):
            assert all(b <= x or y <= a for x, _, y in base)
        assert r.found_base == "x"


def test_trees_equal_the_fitted_model(spark):
    judge = pii.Judge([(1, 5.0, -1.0, (2, 0.5, 0.25, 2.0)), 0.5], [1.0, 0.1], {})
    c = spark.createDataFrame([(4.0, 9.0), (6.0, 0.0), (6.0, 1.0)], "long double, digits double").select(F.struct("long", "digits").alias("c"))
    got = [round(r.p, 9) for r in c.select(judge.probability(F.col("c")).alias("p")).collect()]
    import math

    assert got == [round(1 / (1 + math.exp(-2 * m)), 9) for m in (-0.95, 0.3, 2.05)]


def test_redaction(spark):
    df = spark.createDataFrame([("🙂 a b c d", [(2, 0, 3), (4, 3, 7), (6, 1, 9)]), ("x", []), ("abc", [(0, 2, 3)])], "t string, s array<struct<start:int,kind:int,stop:int>>")
    assert [r.v for r in df.select(pii.redacted(F.col("t"), F.col("s")).alias("v")).collect()] == ["🙂 [EMAIL] [PHONE]", "x", "[CARD]"]


def test_without_positive_candidates_nothing_is_added(spark, none):
    df = spark.createDataFrame([(1, "no data 1234567"), (2, None)], "doc_id long, text string")
    judge = pii.fit(df)
    assert not judge.trees
    assert [r.found.spans for r in pii.mark(df, judge, "found").collect()] == [[], []]
    assert pii.mark(none, pii.fit(none), "found").count() == 0


def test_a_fitted_judge_adds_what_the_patterns_miss_and_leaves_decoys(spark):
    r = random.Random(4)

    def card(good):
        d = "4" + "".join(str(r.randint(0, 9)) for _ in range(14))
        last = next(c for c in "0123456789" if luhn(d + c))
        return d + (last if good else str((int(last) + r.randint(1, 9)) % 10))

    def fours(d, between):
        return between.join(d[k : k + 4] for k in range(0, 16, 4))

    texts = []
    for k in range(400):
        texts.append(f"please call +{r.randint(1, 9)} ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)} today, order {r.randint(10**7, 10**8)} is on its way")
        texts.append(f"paid by {card(True)} and the part number is {card(False)} in release {r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(300, 999)}")
    planted = len(texts)
    texts += [f"phone (555) 123-40{k} is the number" for k in range(10, 60)]
    texts += ["paid by " + fours(card(True), ".") for _ in range(30)]
    decoys = len(texts)
    texts += ["the part number is " + fours(card(False), ".") for _ in range(30)] + [f"order {r.randint(10**7, 10**8)} is late" for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    judge = pii.fit(df.where(F.col("doc_id") < planted))
    found = {x.doc_id: x.found for x in pii.mark(df, judge, "found").collect()}
    for k, t in enumerate(texts):
        assert [(s.start, s.kind, s.stop) for s in found[k].base] == brute(t)
    added = {k: [t[s.start : s.stop] for s in found[k].spans if s not in found[k].base] for k, t in enumerate(texts)}
    caught = [added[k] for k in range(planted, decoys)]
    assert sum(len(x) == 1 for x in caught) >= 0.9 * len(caught)
    assert ["(555) 123-4010"] == added[planted]
    assert not any(added[k] for k in range(decoys, len(texts)))
    assert sum(bool(added[k]) for k in range(planted)) <= 0.02 * planted


def test_marks_are_taken_off(spark):
    rows = [(0, "a@b-c.d.e", 0), (1, "1.2.3.4", 1), (2, "4111 1111-1111 1111", 0), (2, "4111111111111111", 2), (3, "+1 (523) 555-1055", 0), (3, "+1 (523) 555-1055", 1), (3, "+49 30 1234567", 2)]
    df = spark.createDataFrame(rows, "k int, v string, way int")
    got = [r.v for r in df.select(pii.unmarked(F.col("k"), F.col("v"), F.col("way")).alias("v")).collect()]
    assert got == ["a@b-c", "1[.]2[.]3[.]4", "4111.1111.1111.1111", "4111 -1111 -1111 -1111", "(523) 555-1055", "0523 555-1055", "30.1234567"]


def test_rare_spans_of_a_large_table_are_learnt(spark):
    """Six documents of 20,000 show what a phone number is; all count, in whichever half they are."""
    rare = [5, 1002, 2996, 3993, 4990, 8978]
    call = F.concat(F.lit("please call +1 (555) 555-"), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit(" today"))
    other = F.concat(F.lit("order "), (F.col("doc_id") + 10_000_000).cast("string"), F.lit(" is on its way"))
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.when(F.col("doc_id").isin(rare), call).otherwise(other))
    counted = {r.label: r["count"] for r in pii.labelled(docs).groupBy("label").count().collect()}
    assert counted[1.0] >= 6 and counted[0.0] >= 19_994
    judge = pii.fit(docs)
    assert judge.trees and 3 in judge.thresholds
    new = spark.createDataFrame([(1, "please call (555) 555-40212 today"), (2, "order 10000001 is on its way")], "doc_id int, text string")
    assert [len(r.found.spans) for r in pii.mark(new, judge, "found").orderBy("doc_id").collect()] == [1, 0]

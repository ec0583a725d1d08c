import math
import random

import pytest
from pyspark.sql import functions as F

from flowguard.llm import topk


def brute(rows, k):
    def ints(v):
        return [math.floor(1024 * x) for x in v]

    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, v in good:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints(v), ints(w))), i) for i, w in good if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("k,lists,block", [(3, 2, 100), (4, 3, 2), (50, 1, 100)])
def test_equals_brute_force(spark, k, lists, block):
    r = random.Random(k)
    rows = [(i, [r.gauss(0, 1) for _ in range(7)]) for i in range(60)]
    rows += [(100 + i, [0.5, -0.25, 0.0, 1.0, 0.0, 0.0, 0.125]) for i in range(30)]  # many copies, queries among them
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 7), (203, [float("inf")] * 7), (None, [1.0] * 7), (204, []), (210, [1.0, 2.0])]
    rows += [rows[0], rows[1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=k, lists=lists, block=block)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, k)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 100 == 0).count() == 0

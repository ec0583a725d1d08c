"""The ordered scan against plain Python, with blocks small enough to be crossed all the time."""

import random

import pytest
from pyspark.sql import functions as F

from flowguard.operators.ordered import Last, Sum, Total, scan
from flowguard.operators.windows import count_window, skip_rows


def brute(rows):
    out, seen = [], {}
    totals = {}
    for g, _, v in rows:
        totals[g] = totals.get(g, 0) + (v or 0)
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        total, before_last = seen.get(g, (0, None))
        last = v if v is not None else before_last
        out.append((g, k, total, total + (v or 0), before_last, last, totals[g]))
        seen[g] = (total + (v or 0), last)
    return sorted(out)


@pytest.mark.parametrize("block,super_", [(1, 1), (2, 3), (16, 12)])
def test_scan_equals_a_loop(spark, block, super_):
    rng = random.Random(block)
    keys = rng.sample(range(-500, 5000), 400)
    # group "hot" holds most rows
    rows = [(rng.choice(["hot"] * 8 + ["a", "b"]), k, rng.choice([None, rng.randint(1, 9)])) for k in keys]
    df = spark.createDataFrame(rows, "g string, k long, v int").repartition(5)
    v = F.col("v").cast("long")
    got = scan(
        df, ["g"], "k", block_bits=block, super_bits=super_,
        before=Sum(v, before=True), upto=Sum(v), prev=Last(v, before=True), last=Last(v), all=Total(v),
    )
    cols = ["g", "k", "before", "upto", "prev", "last", "all"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(
        brute(rows), key=lambda r: (r[0], r[1])
    )


def test_scan_without_group(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("k")).repartition(3)
    got = scan(df, [], "k", block_bits=3, super_bits=2, i=Sum(F.lit(1).cast("long"), before=True))
    assert [r.i for r in got.orderBy("k").collect()] == list(range(1000))


@pytest.mark.parametrize("n", [9, 10, 11, 20, 21])
@pytest.mark.parametrize("trailing", ["followed", "full", "all"])
def test_window_edges(spark, n, trailing):
    df = spark.range(n).select(F.col("id").alias("pkt_no"))
    got = count_window(df, 10, trailing=trailing).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.max("batch_size").alias("size")
    )
    want = {
        "followed": (n - 1) // 10,  # the next packet has to be there
        "full": n // 10,
        "all": -(-n // 10),
    }[trailing]
    rows = sorted(tuple(r) for r in got.collect())
    assert [r[0] for r in rows] == list(range(want))
    assert all(r[1] == r[2] for r in rows)


def test_skip_rows(spark):
    df = spark.range(10).select((F.col("id") * 3).alias("line_no"))
    assert sorted(r.line_no for r in skip_rows(df, 4, "line_no").collect()) == [12, 15, 18, 21, 24, 27]


def test_no_window_over_a_whole_group(spark):
    """The rows themselves are only ever sorted within (group, block)."""
    df = spark.range(10).select(F.lit("a").alias("g"), F.col("id").alias("k"))
    plan = scan(df, ["g"], "k", s=Sum(F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_v_s" in line]
    assert any("_blk" in line for line in windows)
    assert all("_blk" in line or "_sup" in line for line in windows)


@pytest.mark.parametrize("step", [1 << 28, 1 << 45, 3])
def test_keys_of_any_density(spark, step):
    """Keys far apart: no window sees more rows than a digit has values."""
    n, digit = 300, 4
    df = spark.range(-n // 2, n // 2).select((F.col("id") * step).alias("k"), (F.col("id") % 5).alias("v")).repartition(4)
    got = scan(df, [], "k", block_bits=digit, super_bits=20, i=Sum(F.lit(1).cast("long"), before=True), last=Last(F.when(F.col("v") == 0, F.col("k"))))
    rows = got.orderBy("k").collect()
    assert [r.i for r in rows] == list(range(n))
    seen = None
    for r in rows:
        seen = r.k if r.v == 0 else seen
        assert r.last == seen


def test_four_digits_cover_every_key(spark):
    from flowguard.operators import ordered

    assert ordered.BLOCK_BITS + ordered.LEVELS * ordered.SUPER_BITS + 16 == 64
    keys = [-(1 << 63), -(1 << 40), -1, 0, 1, 1 << 20, 1 << 40, (1 << 63) - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    got = scan(df, [], "k", i=Sum(F.lit(1).cast("long")), n=Total(F.lit(1).cast("long")))
    assert [(r.i, r.n) for r in got.orderBy("k").collect()] == [(i + 1, len(keys)) for i in range(len(keys))]

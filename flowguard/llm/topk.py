"""Exact top-k search by a three-phase uniform threshold.

The score of a candidate is a sum over ``LISTS`` lists, one for each slice of the dimensions, of its
local scores (partial inner products). For each query:

1. gather the best local scores of each list, with the totals of those candidates, and the list's least
   score; the k-th best of these totals is a lower bound of the k-th best of all;
2. the bound's surplus over the sum of the least scores, divided by the number of lists, is a safe
   cutoff: who lies below it in every list can't be among the best. It is broadcast, and every entry
   at or above it is collected; upper bounds drop most candidates;
3. the exact scores of the candidates that are left are resolved by a join with the vectors.

Equal vectors are one candidate with its k + 1 smallest ids (all that ties can need), so a vector that
a third of the rows share is no group of pairs. Queries are dealt into blocks of about ``BLOCK``
vectors, each one broadcast and one set of passes over all vectors, however many there are.

Defined results: a vector that is null or holds a null or a non-finite component takes no part, nor
does a row with a null id; a shorter vector counts as padded with zeros; of rows that are equal in id
and vector one counts; a query's own id is never its candidate; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowguard.llm.common import materialize

K = 10
LISTS = 2
#: Entries that a task gathers of each list at least; more of them raise the cutoff.
DEPTH = 32
BLOCK = 1024
SCALE = 1024
#: Vectors multiplied at a time.
STEP = 2048


def _vectors(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, v): rows that take part, components as floor(1024 * x)."""
    good = F.col(vector).isNotNull() & F.col(id).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.where(good).select(F.col(id).alias("vec_id"), v.alias("v")).distinct()


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """(c, v, ids): different vectors with their k + 1 smallest ids."""
    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialize(classes.withColumn("c", F.monotonically_increasing_id()), "topk-classes")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = np.zeros((len(column), width), np.int64)
    counts = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    rows[np.repeat(np.arange(len(column)), counts), np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
    return rows


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a and b; in floating point where that is exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class _Block:
    """Query vectors of one block, and the slices of the dimensions."""

    def __init__(self, queries: list[int], vectors: list[list[int]], width: int, lists: int):
        self.queries = np.array(queries, np.int64)
        self.matrix = np.zeros((len(queries), width), np.int64)
        for row, v in zip(self.matrix, vectors):
            row[: len(v)] = v
        edges = [width * i // lists for i in range(lists + 1)]
        self.cuts = list(zip(edges, edges[1:]))

    def local(self, batches: Iterator[pa.RecordBatch]):
        """(class ids, local scores of each query in each list) for some vectors at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                ids, rows = part.column(0).to_numpy(), _matrix(part.column(1), self.matrix.shape[1])
                yield ids, [_product(self.matrix[:, a:b], rows[:, a:b]) for a, b in self.cuts]


_ENTRIES = "q long, list int, c long, score long, total long"


def _entries(q: np.ndarray, i: int, c: np.ndarray, score: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    names = ["q", "list", "c", "score", "total"]
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), i, np.int32)), pa.array(c), pa.array(score), pa.array(total)], names)


def _first(shared, k: int):
    """The best k local scores of each list among a task's vectors, and (c = -1) the least one."""

    def run(batches):
        block = shared.value
        best: dict[int, list[np.ndarray]] = {}
        lowest: dict[int, np.ndarray] = {}
        for ids, lists in block.local(batches):
            total = sum(lists)
            for i, scores in enumerate(lists):
                least = scores.min(axis=1)
                lowest[i] = np.minimum(lowest[i], least) if i in lowest else least
                rows = [np.broadcast_to(ids, scores.shape), scores, total]
                if i in best:
                    rows = [np.hstack(pair) for pair in zip(best[i], rows)]
                if rows[1].shape[1] > k:
                    keep = np.argpartition(-rows[1], k - 1, axis=1)[:, :k]
                    rows = [np.take_along_axis(x, keep, 1) for x in rows]
                best[i] = rows
        for i, (c, scores, total) in best.items():
            yield _entries(np.repeat(block.queries, c.shape[1]), i, c.ravel(), scores.ravel(), total.ravel())
            yield _entries(block.queries, i, np.full(len(block.queries), -1), lowest[i], lowest[i])

    return run


def _second(shared, cutoffs):
    """All entries whose local score reaches the cutoff of its query and list."""

    def run(batches):
        block, least = shared.value, cutoffs.value
        for ids, lists in block.local(batches):
            for i, scores in enumerate(lists):
                q, c = np.nonzero(scores >= least[:, i][:, None])
                if len(q):
                    yield _entries(block.queries[q], i, ids[c], scores[q, c], scores[q, c])

    return run


def _best(rows: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k).drop("place")


def _cutoffs(first: DataFrame, k: int, lists: int) -> dict[int, tuple[int, list[int]]]:
    """For each query of the block the lower bound of its k-th best total, and the least score of each list."""
    floor = first.where("c = -1").groupBy("q").agg(*[F.min(F.when(F.col("list") == i, F.col("score"))).alias(f"m{i}") for i in range(lists)])
    seen = first.where("c >= 0").groupBy("q", "c").agg(F.max("total").alias("total"))
    kth = _best(seen, ["q"], k, F.desc("total")).groupBy("q").agg(F.min("total").alias("tau"), F.count("*").alias("n"))
    kth = kth.join(floor, "q")
    out = {}
    for r in kth.collect():  # one row for each query of the block
        least = [r[f"m{i}"] for i in range(lists)]
        out[r.q] = (r.tau if r.n >= k else sum(least)), least
    return out


def _search(classes: DataFrame, queries: DataFrame, width: int, k: int, lists: int) -> DataFrame:
    """(q, c, score): for each query vector of one block the k best classes, and those that tie with the last."""
    spark = classes.sparkSession
    rows = queries.select("c", "v").collect()  # bounded by the block
    block = _Block([r.c for r in rows], [r.v for r in rows], width, lists)
    shared = spark.sparkContext.broadcast(block)
    vectors = classes.select("c", "v")
    found = _cutoffs(vectors.mapInArrow(_first(shared, max(k, DEPTH)), _ENTRIES), k, lists)
    cut = np.zeros((len(rows), lists), np.int64)
    bounds = []
    for row, q in enumerate(block.queries.tolist()):
        tau, least = found[q]
        surplus = -((sum(least) - tau) // lists)  # rounded up
        cut[row] = [m + surplus for m in least]
        bounds.append((q, *[m + surplus for m in least], *least))
    second = vectors.mapInArrow(_second(shared, spark.sparkContext.broadcast(cut)), _ENTRIES)
    names = [f"t{i}" for i in range(lists)] + [f"m{i}" for i in range(lists)]
    limits = spark.createDataFrame(bounds, ["q", *names])
    seen = second.groupBy("q", "c").agg(*[F.max(F.when(F.col("list") == i, F.col("score"))).alias(f"s{i}") for i in range(lists)])
    seen = seen.join(F.broadcast(limits), "q")
    # an entry that was not collected lies below the cutoff of its list
    upper = sum((F.coalesce(f"s{i}", F.greatest(F.col(f"t{i}") - 1, F.col(f"m{i}"))) for i in range(lists)), F.lit(0))
    lower = sum((F.coalesce(f"s{i}", f"m{i}") for i in range(lists)), F.lit(0))
    seen = materialize(seen.select("q", "c", upper.alias("upper"), lower.alias("lower")), "topk-seen")
    tau = _best(seen.select("q", "lower"), ["q"], k, F.desc("lower")).groupBy("q").agg(F.min("lower").alias("tau"), F.count("*").alias("n"))
    left = seen.join(F.broadcast(tau), "q").where((F.col("n") < k) | (F.col("upper") >= F.col("tau"))).select("q", "c")
    mine = queries.select(F.col("c").alias("q"), F.col("v").alias("w"))
    exact = left.join(vectors, "c").join(F.broadcast(mine), "q")
    score = F.aggregate(F.zip_with("v", "w", lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    exact = exact.select("q", "c", score.alias("score"))
    place = F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))
    return exact.withColumn("place", place).where(F.col("place") <= k).drop("place")


def top_k(
    rows: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = K, lists: int = LISTS, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query row, ties to the smaller id."""
    vectors = _vectors(rows, id, vector)
    classes = _classes(vectors, k)
    asked = _vectors(rows.where(is_query), id, vector).withColumnRenamed("vec_id", "query_id")
    asked = materialize(asked.join(classes.select("v", "c"), "v").select("query_id", "c"), "topk-queries")
    wanted = materialize(asked.select("c").distinct().join(classes, "c").select("c", "v"), "topk-wanted")
    width, n_classes = classes.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    n = max(1, math.ceil(wanted.count() / block))
    dealt = F.pmod(F.xxhash64("c"), F.lit(n))
    found = None
    for b in range(n):
        part = wanted.where(dealt == b) if n > 1 else wanted
        if n_classes and not part.isEmpty():
            one = materialize(_search(classes, part, max(1, width), k + 1, lists), "topk-found")
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = classes.sparkSession.createDataFrame([], "q long, c long, score long")
    each = found.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    # the best rows of a query vector; one more, as a query may be among them itself
    each = _best(each, ["q"], k + 1, F.desc("score"), F.col("vec_id"))
    pairs = asked.join(each, asked.c == each.q).where("query_id != vec_id").select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Ten best of all vectors for every vector whose id is divisible by 100."""
    from flowguard.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

"""Turning categories into numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from flowguard.functions.once import once
from flowguard.session import materialize


def label_encode(
    df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None, suffix: str = "_code"
) -> DataFrame:
    """Code every string column 0, 1, ... in sort order, afresh within each window of rows.

    For windows of bounded size, such as count windows; ``dense_code`` is for whole tables.
    """
    if columns is None:
        columns = [f.name for f in df.schema if f.dataType == StringType() and f.name not in by]
    return df.select(
        "*",
        *[
            (F.dense_rank().over(Window.partitionBy(*by).orderBy(c)) - 1).alias(f"{c}{suffix}")
            for c in columns
        ],
    )


#: Rank lists of at most this many values in all become one map for each scan.
MAP_VALUES = 512


def value_ranks(values: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """1-based ranks, as ``rank``, of the distinct (``group``, ``value``) rows, however many one group has.

    The rows are range-partitioned in sort order and written, as bounds from a sample may differ in a
    repeated task. Each partition numbers its own rows of a group, and a running sum over the
    partitions' counts gives what lies before them: no task sees all values of a group.
    """
    ranged = values.repartitionByRange(*group, value).select(*values.columns, F.spark_partition_id().alias("_range"))
    ranged = materialize(ranged, "ranks")
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    own = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(value))
    same = F.col("_range") == F.col("_r")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    numbered = ranged.withColumn("_own", own).join(before, same)
    return numbered.select(*values.columns, (F.col("_before") + F.col("_own")).alias("rank"))


def dense_code(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Replace each text column by its 1-based rank among the sorted distinct values of the scan ``by``.

    The distinct values of all columns are gathered in one pass, in long form, so copies are folded
    before the shuffle, and ranked by ``value_ranks``. Short lists come back as one map for each scan, in
    one join; longer ones in a join by value for each column. Nulls keep no code.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    values = df.select(F.col(by).alias("scan"), F.inline(pairs)).where("value IS NOT NULL").distinct()
    ranks = value_ranks(values, ["scan", "column"], "value").withColumn("rank", F.col("rank").cast("int"))
    ranks = materialize(ranks, "codes")
    if ranks.count() <= MAP_VALUES:
        entry = F.struct(F.struct("column", "value"), "rank")
        maps = ranks.groupBy(F.col("scan").alias("_s")).agg(F.map_from_entries(F.collect_list(entry)).alias("_codes"))
        coded = df.join(maps, F.col(by).eqNullSafe(F.col("_s")), "left")

        def code(c: str) -> Column:
            return F.try_element_at("_codes", F.struct(F.lit(c).alias("column"), F.col(c).alias("value")))

        coded = once(coded, **{f"_r_{c}": code(c) for c in columns})
        return coded.select(*[F.col(f"_r_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
    for c in columns:
        own = ranks.where(F.col("column") == c).select(F.col("scan").alias("_s"), F.col("value").alias(f"_v_{c}"), F.col("rank").alias(f"_r_{c}"))
        df = df.join(own, F.col(by).eqNullSafe(F.col("_s")) & (F.col(c) == F.col(f"_v_{c}")), "left").drop("_s")
    wanted = [c for c in df.columns if not c.startswith(("_v_", "_r_"))]
    return df.selectExpr(*[f"_r_{c} AS {c}" if c in columns else c for c in wanted])


def value_map(column: str, table: Mapping) -> Column:
    """Replace the values named in ``table``, all at once; others stay as they are."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return F.expr(f"coalesce(try_element_at(map({pairs}), string({column})), string({column}))")


def truthy(value: Column) -> Column:
    """1 unless the value is null or zero."""
    return (value.isNotNull() & (value != 0)).cast("int")

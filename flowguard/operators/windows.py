"""Tumbling windows of a fixed number of packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowguard.operators.ordered import Sum, Total, scan


def number_rows(df: DataFrame, by: Sequence[str] = (), order: str = "pkt_no") -> DataFrame:
    """Add ``idx``, the 0-based position in arrival order, and ``n_total``, the rows of the group."""
    one = F.lit(1).cast("long")
    return scan(df, by, order, idx=Sum(one, before=True), n_total=Total(one))


def count_window(
    df: DataFrame,
    size: int = 100,
    by: Sequence[str] = (),
    order: str = "pkt_no",
    trailing: str = "all",
) -> DataFrame:
    """Cut the packets into windows of ``size``.

    Adds ``batch_id``, ``i`` (the place within the window) and ``batch_size``.

    ``trailing`` says which windows are kept: ``all`` of them, ``full`` those of ``size`` packets, or
    ``followed`` those that a later packet follows (a stream judges a window when the next packet arrives).
    """
    end = (F.col("batch_id") + 1) * size
    keep = {"followed": end < F.col("n_total"), "full": end <= F.col("n_total"), "all": F.lit(True)}
    return (
        number_rows(df, by, order)
        .withColumn("batch_id", F.expr(f"idx div {size}"))
        .withColumn("i", F.col("idx") % size)
        .withColumn("batch_size", F.least(F.lit(size), F.col("n_total") - F.col("batch_id") * size))
        .where(keep[trailing])
        .drop("idx", "n_total")
    )


def skip_rows(df: DataFrame, k: int, order: str) -> DataFrame:
    """All rows but the first ``k`` in order: resume after the lines already read."""
    return number_rows(df, order=order).where(F.col("idx") >= k).drop("idx", "n_total")

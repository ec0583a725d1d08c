"""Packets kept by count window, so that events find their evidence without moving packets.

``store`` writes the windowed packets once into a table that is bucketed by window and sorted by packet
number within a bucket. ``packets_of`` joins events to it: the events, a few rows for each window, are
shuffled to the table's buckets (or broadcast by adaptive execution, where they are measured to be
small), and the packet side is read in place. Windows hold a bounded number of packets, so a bucket is as
even as the hash of the windows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowguard.session import work_folder

#: Packets of a bucket, about.
BUCKET_ROWS = 1 << 20


def store(windowed: DataFrame, by: Sequence[str] = (), order: str = "pkt_no", buckets: int | None = None) -> str:
    """Write packets that carry their window (``by``, ``batch_id``); returns the name of the table.

    The files lie in the shared folder. Without ``buckets`` the packets are counted first.
    """
    spark = windowed.sparkSession
    n = buckets or max(1, math.ceil(windowed.count() / BUCKET_ROWS))
    keys = [*by, "batch_id"]
    name = f"evidence_{uuid.uuid4().hex}"
    # dealt as the table is, so that a bucket is one file
    dealt = windowed.repartition(n, *keys)
    writer = dealt.write.format("parquet").bucketBy(n, *keys).sortBy(*keys, order)
    writer.option("path", work_folder(spark, "evidence")).saveAsTable(name)
    return name


def packets_of(events: DataFrame, spark: SparkSession, table: str, by: Sequence[str] = (), target: str = "dst_ip") -> DataFrame:
    """The packets behind each event: those of its window that went to its target.

    Events are rows with ``by``, ``batch_id`` and ``target``; equal ones count once. The targets of a window,
    no more than it has packets, become one list, so that both sides are joined by the columns the table
    is dealt by. Packets without a target belong to no event.
    """
    keys = [*by, "batch_id"]
    wanted = events.groupBy(*keys).agg(F.collect_set(target).alias("_targets"))
    packets = spark.table(table)
    return packets.join(wanted, keys).where(F.array_contains("_targets", F.col(target))).select(*packets.columns)

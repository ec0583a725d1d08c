"""Abnormal hosts: runs of consecutive alarms, with the names of the assets they concern."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from flowguard.operators.events import detected
from flowguard.operators.ordered import Last, Sum, scan

NEW_ALARM = "[新报警]"  # fixed value: prefix of alarms that were not handled yet
PART_ROWS = 50_000  # alarms whose text goes into one row


def new_alarms(alarms: DataFrame) -> DataFrame:
    """Unhandled alarms; the prefix test is pushed into Parquet and JDBC scans."""
    return alarms.where(F.col("info").startswith(NEW_ALARM))


def runs(alarms: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Number the runs of equal consecutive ``datetime`` of each host, in ``seq`` order.

    Adds ``run`` (from 1) and ``place`` (from 0) within the run. Alarms without an address are a host
    of their own.  ``keep`` may hold what lies between the two scans, which read it several times.
    """
    host = F.coalesce(F.concat(F.lit("="), "ip"), F.lit(""))
    seen = scan(
        alarms.withColumn("_host", host), ["_host"], "seq",
        _before=Last(F.struct("datetime"), before=True),
        _idx=Sum(F.lit(1).cast("long"), before=True),
    )
    starts = F.col("_before").isNull() | ~F.col("_before.datetime").eqNullSafe(F.col("datetime"))
    return (
        scan(
            keep(seen), ["_host"], "seq",
            run=Sum(starts.cast("long")),
            _first=Last(F.when(starts, F.col("_idx"))),
        )
        .withColumn("place", F.col("_idx") - F.col("_first"))
        .drop("_before", "_idx", "_first", "_host")
    )


def asset_names(assets: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Asset names of each address as sorted ``(asset_name, copies)`` lists.

    Copies are folded before the shuffle.  An address with very many names has several rows
    (``part`` of ``parts``), so that no list grows without bound.
    """
    counted = (
        assets.where("ip IS NOT NULL AND asset_name IS NOT NULL")
        .groupBy("ip", "asset_name")
        .agg(F.count("*").alias("copies"))
    )
    sizes = counted.groupBy("ip").agg(F.count("*").alias("n_names"))
    parts = F.ceil(F.col("n_names") / part_rows)
    return (
        counted.join(sizes, "ip")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("asset_name"), F.col("parts")))
        .groupBy("ip", "n_names", "parts", "part")
        .agg(F.array_sort(F.collect_list(F.struct("asset_name", "copies"))).alias("names"))
    )


def with_asset_names(
    df: DataFrame, assets: DataFrame, part_rows: int = PART_ROWS, show: Callable[[DataFrame], DataFrame] = lambda lists: lists
) -> DataFrame:
    """Add ``names`` (null when there are none) and ``n_names`` to every row.

    An address with more names than fit one list gives a row for each part of them (``name_part`` 0,
    1, ...), so that all are kept.  ``show`` may put another form of ``names`` in its place, once for each
    list and before it is copied to the rows.  Adaptive execution picks the join by the real size of the lists
    and splits hot addresses.
    """
    lists = asset_names(assets, part_rows).select("ip", "n_names", F.col("part").cast("int").alias("name_part"), "names")
    none = {"n_names": F.coalesce("n_names", F.lit(0)), "name_part": F.coalesce("name_part", F.lit(0))}
    return df.join(show(lists), "ip", "left").withColumns(none)


def events(alarms: DataFrame, assets: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One event per run of a host: its alarm texts joined in order, and the asset names.

    A run of more than ``part_rows`` alarms gives further rows (``part`` 1, 2, ...), each with the
    next stretch of text.
    """
    numbered = runs(new_alarms(alarms)).withColumn("part", F.expr(f"place div {part_rows}"))
    return merged(numbered, assets)


def merged(numbered: DataFrame, assets: DataFrame) -> DataFrame:
    """Events of alarms that carry the ``run`` and ``part`` they belong to."""
    rows = numbered.groupBy("ip", "run", "part").agg(
        F.expr("listagg(info, '') WITHIN GROUP (ORDER BY seq)").alias("detail"),
        F.min("datetime").alias("time"),
        F.count("*").alias("alarms"),
    )
    return with_asset_names(rows.select("*", detected()), assets)


def takeover_ips(alarms: DataFrame) -> DataFrame:
    """Which address each run is reported under if a run ends only when ``datetime`` changes.

    Without a key per host, the event of a run carries the address of the alarm that ended it;
    the last run keeps its own.  Adds ``run`` and ``event_ip``, one row per run.
    """
    one_key = alarms.withColumnRenamed("ip", "alarm_ip").withColumn("ip", F.lit("all"))
    numbered = runs(one_key).select("run", "seq", "alarm_ip", "datetime")
    ends = numbered.groupBy("run").agg(
        F.max_by("alarm_ip", "seq").alias("_last_ip"),
        F.min_by("alarm_ip", "seq").alias("_first_ip"),
        F.min("datetime").alias("time"),
        F.count("*").alias("alarms"),
    )
    following = ends.select((F.col("run") - 1).alias("run"), F.col("_first_ip").alias("_next_ip"))
    return ends.join(following, "run", "left").select(
        "run", F.coalesce("_next_ip", "_last_ip").alias("event_ip"), "time", "alarms"
    )

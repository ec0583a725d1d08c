"""Event rows, and the one table in which all detectors meet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.schemas import ENVELOPE, HOST_EVENT, MSG_HOST, MSG_TRAFFIC, TRAFFIC_EVENT


#: Column with the time of detection.
DETECTED = "detected_at"


def detected() -> Column:
    """The processing time: one value for all rows of a batch query; a stream puts its micro-batch's time in its place."""
    return F.current_timestamp().alias(DETECTED)


def packet_event(hits: DataFrame, kind: int, detail: Sequence[str]) -> DataFrame:
    """One traffic event per packet; ``detail`` names the packet columns kept as evidence."""
    time = F.col("sniff_ts") if "sniff_ts" in hits.columns else F.lit(None).cast("timestamp")
    return hits.select(
        F.lit(kind).alias("type"),
        time.alias("time"),
        detected(),
        F.col("ip.src").alias("src_ip"),
        F.col("ip.dst").alias("dst_ip"),
        F.to_json(F.struct(*detail)).alias("detail"),
    )


def packet_key(packets: DataFrame) -> Column:
    """What tells packets apart: numbers may be unique for a sensor only."""
    return F.to_json(F.struct(*[c for c in ("sensor", "pkt_no") if c in packets.columns]))


def _envelope(df: DataFrame, kind: int, slot: str, row: Column) -> DataFrame:
    """Wrap ``row`` as the ``traffic`` or ``host`` part of an envelope, the other part null."""
    return df.select(
        F.lit(kind).alias("type"),
        *[
            (row if f.name == slot else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in ENVELOPE.fields[1:]
        ],
    )


def traffic_envelope(events: DataFrame) -> DataFrame:
    row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRAFFIC_EVENT])
    return _envelope(events, MSG_TRAFFIC, "traffic", row)


def host_envelope(events: DataFrame) -> DataFrame:
    row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HOST_EVENT])
    return _envelope(events, MSG_HOST, "host", row)


def all_events(traffic: Sequence[DataFrame], hosts: Sequence[DataFrame] = ()) -> DataFrame:
    """UNION ALL of every detector's events."""
    parts = [traffic_envelope(t) for t in traffic] + [host_envelope(h) for h in hosts]
    return reduce(DataFrame.unionByName, parts)

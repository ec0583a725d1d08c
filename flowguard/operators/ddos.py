"""Flood detection over count windows of packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowguard.functions.encode import label_encode
from flowguard.functions.network import ip_field
from flowguard.operators.events import detected
from flowguard.operators.scoring import Scorer
from flowguard.operators.windows import count_window
from flowguard.schemas import DDOS

HOSTILE_RATIO = 0.8  # a window alarms above this share of hostile packets
TARGET_SHARE = 0.3  # a destination is a target above this share of the window's packets

# What a model sees, in order.
MODEL_INPUTS = [
    "highest_layer_code", "transport_layer_code", "source_flag", "dst_ip_code",
    "src_port", "dst_port", "length", "packet_rate",
]


def allow_flag(src: Column, allowed: Sequence[str] = ()) -> Column:
    """0 for an allowed source, 1 for any other."""
    return F.when(src.isin(*allowed), 0).otherwise(1) if allowed else F.lit(1)


def drop_allowed(df: DataFrame, allowed: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Packets whose source is not in a table of allowed addresses (column ``ip``), which may be of any size."""
    return df.join(allowed.select(F.col("ip").alias(ip)).distinct(), ip, "left_anti")


def packet_rate(by: Sequence[str] = ("batch_id",)) -> Column:
    """``i`` divided by the seconds since the window's first packet; 0 where that is undefined."""
    first = F.first("sniff_ts").over(Window.partitionBy(*by).orderBy("i"))
    seconds = (F.unix_micros("sniff_ts") - F.unix_micros(first)) / 1e6
    return F.coalesce(F.try_divide(F.col("i").cast("double"), seconds), F.lit(0.0))


def flatten(packets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The few flat columns that flood detection needs, so that little else is shuffled.

    ARP packets have addresses of their own; ports are 0 without a transport layer.
    """
    is_arp = F.col("highest_layer") == "ARP"
    is_plain = is_arp | F.col("transport_layer").isNull()

    def port(name: str) -> Column:
        return F.when(is_plain, 0).otherwise(F.coalesce(F.col(name), F.lit(0))).alias(name)

    return packets.select(
        *by, "pkt_no", "sniff_ts", "highest_layer",
        F.when(is_plain, "None").otherwise(F.col("transport_layer")).alias("transport_layer"),
        F.when(is_arp, F.col("arp.src_proto_ipv4")).otherwise(ip_field("src")).alias("src_ip"),
        F.when(is_arp, F.col("arp.dst_proto_ipv4")).otherwise(ip_field("dst")).alias("dst_ip"),
        port("src_port"), port("dst_port"), "length",
    )


def features(windowed: DataFrame, allowed: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Model features of flat packets that carry their count window.

    A packet with no usable addresses is dropped only here, after it took its place in the window.
    """
    return (
        windowed.withColumn("packet_rate", packet_rate([*by, "batch_id"]))
        .where("src_ip IS NOT NULL AND dst_ip IS NOT NULL")
        .withColumn("source_flag", allow_flag(F.col("src_ip"), allowed))
    )


def encode(feats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the per-window codes of the three text features."""
    return label_encode(feats, [*by, "batch_id"], ["highest_layer", "transport_layer", "dst_ip"])


def batch_ratio(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of hostile packets among the decodable ones of each window, with the verdict."""
    hostile = F.sum((F.col("prediction") == 1).cast("long"))
    return (
        scored.groupBy(*by, "batch_id")
        .agg(hostile.alias("hostile"), F.count("*").alias("decodable"))
        .withColumn("ratio", F.try_divide("hostile", "decodable"))
        .withColumn("alarm", F.col("ratio") > HOSTILE_RATIO)
    )


def targets(scored: DataFrame, by: Sequence[str] = (), share: float = TARGET_SHARE) -> DataFrame:
    """Destinations with more than ``share`` of *all* packets of their window.

    One row per window and destination, with the evidence (at most a window of packet numbers)
    and the window's hostile ratio.  Both aggregations run on the partitioning by window.
    """
    window = Window.partitionBy(*by, "batch_id")
    return (
        scored.groupBy(*by, "batch_id", "dst_ip")
        .agg(
            F.count("*").alias("packets"),
            F.sum((F.col("prediction") == 1).cast("long")).alias("_hostile"),
            F.max("batch_size").alias("batch_size"),
            F.sort_array(F.collect_list("pkt_no")).alias("evidence"),
            F.max("sniff_ts").alias("_last"),
        )
        .withColumn("ratio", F.try_divide(F.sum("_hostile").over(window), F.sum("packets").over(window)))
        .withColumn("time", F.max("_last").over(window))
        .where(F.col("packets") > share * F.col("batch_size"))
        .drop("_hostile", "_last")
    )


def events(
    packets: DataFrame,
    scorer: Scorer,
    size: int = 100,
    by: Sequence[str] = (),
    allowed: Sequence[str] = (),
    trailing: str = "all",
) -> DataFrame:
    """Flood events: the likely targets of each window that is mostly hostile."""
    windowed = count_window(flatten(packets, by), size, by, trailing=trailing)
    return window_events(windowed, scorer, by, allowed)


def window_events(
    windowed: DataFrame, scorer: Scorer, by: Sequence[str] = (), allowed: Sequence[str] = ()
) -> DataFrame:
    """The same for flat packets that already carry their window."""
    scored = scorer(encode(features(windowed, allowed, by), by))
    return targets(scored, by).where(F.col("ratio") > HOSTILE_RATIO).select(
        F.lit(DDOS).alias("type"),
        "time",
        detected(),
        F.lit("").alias("src_ip"),
        "dst_ip",
        F.to_json("evidence").alias("detail"),
        *by,
        "batch_id",
    )

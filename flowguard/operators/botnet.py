"""Botnet detection, packet by packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.functions import network as net
from flowguard.operators.events import packet_event
from flowguard.operators.scoring import Scorer
from flowguard.schemas import BOTNET

STATE = "FSR_SA"  # the only connection state the features ever carry
MODEL_INPUTS = [
    "duration", "protocol", "source_port", "dest_port", "source_u32", "dest_u32",
    "total_packets", "total_bytes", "state",
]


def eligible() -> Column:
    """Packets that can be judged: a transport layer other than UDP, both ports, TCP counters."""
    return (
        F.col("transport_layer").isNotNull()
        & (F.col("transport_layer") != "UDP")
        & F.col("src_port").isNotNull()
        & F.col("dst_port").isNotNull()
        & F.col("tcp").isNotNull()
    )


def features(packets: DataFrame, concatenate: bool = False, carry: bool = False) -> DataFrame:
    """Add the nine model inputs; packets without IPv4 addresses are left out (``carry`` as in ``is_ipv4``)."""
    usable = eligible() & net.is_ipv4(F.col("ip.src"), carry) & net.is_ipv4(F.col("ip.dst"), carry)
    protocol = net.protocol_code(F.col("transport_layer"))
    return packets.where(usable & protocol.isNotNull()).select(
        "*",
        F.col("time_delta").cast("double").alias("duration"),
        protocol.alias("protocol"),
        F.col("src_port").alias("source_port"),
        F.col("dst_port").alias("dest_port"),
        net.ipv4_number(F.col("ip.src")).alias("source_u32"),
        net.ipv4_number(F.col("ip.dst")).alias("dest_u32"),
        net.total_packets(F.col("tcp.seq"), F.col("tcp.ack"), concatenate).alias("total_packets"),
        F.col("length").cast("long").alias("total_bytes"),
        net.state_code(F.lit(STATE)).alias("state"),
    )


def events(packets: DataFrame, scorer: Scorer, detail: list[str] | None = None, carry: bool = False) -> DataFrame:
    hits = scorer(features(packets, carry=carry)).where("prediction <> 0")
    return packet_event(hits, BOTNET, detail or packets.columns)

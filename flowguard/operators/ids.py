"""Events out of the alert log of an external intrusion-detection system."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowguard.operators.events import detected
from flowguard.schemas import IDS_ALERT, PORT_SCAN, SQL_INJECT, XML_INJECT

# Phrases in the alert message and the event they mean; the first match wins.
PHRASES = [("Port Scan", PORT_SCAN), ("SQL Inject", SQL_INJECT), ("XML Inject", XML_INJECT)]


def parse_alerts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add the fields of each JSON line; a line that is no such object gets nulls."""
    return lines.withColumn("_a", F.from_json(line, IDS_ALERT)).select("*", "_a.*").drop("_a")


def classify(alerts: DataFrame) -> DataFrame:
    """Add the event ``type``; alerts with none of the phrases are left out."""
    kind = F.lit(None).cast("int")
    for phrase, code in reversed(PHRASES):
        kind = F.when(F.contains(F.col("msg"), F.lit(phrase)), code).otherwise(kind)
    return alerts.withColumn("type", kind).where("type IS NOT NULL")


def events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Injection and port-scan events.

    The log's own time stamp is kept as the detail; ``time`` is set where it is a full ISO date.
    """
    stamp = F.col("timestamp")
    time = F.when(stamp.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), stamp.try_cast("timestamp"))
    return classify(parse_alerts(lines, line)).select(
        "type",
        time.alias("time"),
        detected(),
        F.col("src_ap").alias("src_ip"),
        F.col("dst_ap").alias("dst_ip"),
        F.col("timestamp").alias("detail"),
    )

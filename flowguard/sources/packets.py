"""The packet topic: reading, decoding and landing.

Kafka needs the ``spark-sql-kafka`` package on the cluster; the file readers take the same rows
from JSON or Parquet folders.  A checkpoint stands in for a consumer group: every query has its
own, so every detector sees every packet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from flowguard.schemas import PACKET

CORRUPT = "_corrupt"
#: Times in messages keep their microseconds.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def kafka_values(spark: SparkSession, servers: str, topic: str, offsets: str = "latest", **options: str) -> DataFrame:
    """Messages of a topic as a stream with a text column ``value``."""
    reader = spark.readStream.format("kafka").options(**options)
    return (
        reader.option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", offsets)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def packet_files(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False, **options) -> DataFrame:
    """Packets in a folder, as a table or as a stream of arriving files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(PACKET).format(fmt).options(**options).load(path)


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Parse each JSON message; adds the packet columns and ``_corrupt``, the text that failed.

    Malformed messages never raise: ``accepted`` and ``rejected`` split the result.
    """
    schema = T.StructType([*PACKET.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **JSON}
    parsed = messages.withColumn("_p", F.from_json(value, schema, options))
    # an empty message gives no struct at all
    failed = F.when(F.col("_p").isNull(), F.coalesce(value, F.lit(""))).otherwise(F.col(f"_p.{CORRUPT}"))
    return parsed.select(*messages.columns, *[f"_p.{f.name}" for f in PACKET], failed.alias(CORRUPT))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected(decoded: DataFrame, value: str = "value") -> DataFrame:
    return decoded.where(F.col(CORRUPT).isNotNull()).select(value)


def encode(packets: DataFrame) -> DataFrame:
    """Packets as JSON messages."""
    return packets.select(F.to_json(F.struct(*packets.columns), JSON).alias("value"))


def tcp_only(packets: DataFrame) -> DataFrame:
    """The capture filter: only TCP packets are landed."""
    return packets.where("transport_layer = 'TCP'")


def with_day(packets: DataFrame) -> DataFrame:
    return packets.withColumn("day", F.to_date("sniff_ts"))


def land(packets: DataFrame, path: str) -> None:
    """Append to a Parquet table with one folder per day, which later scans prune by.

    Rows are spread over several files per day, so a busy day does not end in one task.
    """
    with_day(packets).write.mode("append").partitionBy("day").parquet(path)


def land_stream(packets: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    writer = with_day(packets).writeStream.format("parquet").partitionBy("day")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()

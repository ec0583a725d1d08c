"""Where events go."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowguard.schemas import ENVELOPE
from flowguard.session import materialize
from flowguard.sources.packets import JSON


def to_messages(envelopes: DataFrame) -> DataFrame:
    """Envelopes as JSON messages in ``value``."""
    return envelopes.select(F.to_json(F.struct(*[f.name for f in ENVELOPE]), JSON).alias("value"))


def from_messages(messages: DataFrame) -> DataFrame:
    return messages.select(F.from_json("value", ENVELOPE, JSON).alias("_e")).select("_e.*")


def write_messages(envelopes: DataFrame, path: str) -> None:
    to_messages(envelopes).write.mode("append").text(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return from_messages(spark.read.text(path))


def publish_stream(envelopes: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Send envelopes to a Kafka topic."""
    writer = to_messages(envelopes).writeStream.format("kafka").option("topic", topic)
    return writer.option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()


def host_rows(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the abnormal-host result table, and the rejected ones that have no asset name.

    The time defaults to now; several names of a host are listed in one text.
    """
    names = F.array_join(F.transform("names", lambda n: n["asset_name"]), ",")
    rows = events.select(
        "ip", names.alias("name"), "detail", F.coalesce("time", F.current_timestamp()).alias("time")
    )
    return rows.where("name IS NOT NULL"), rows.where("name IS NULL")


def write_host_rows(events: DataFrame, path: str) -> None:
    kept, rejected = host_rows(events)
    kept.write.mode("append").parquet(f"{path}/kept")
    rejected.write.mode("append").parquet(f"{path}/rejected")


def highest_id(spark: SparkSession, path: str, id: str = "id") -> int:
    """The highest id of a result table, 0 where the table does not exist or is empty; Parquet footers answer it."""
    try:
        return spark.read.parquet(path).agg(F.max(id)).first()[0] or 0
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0


def append_with_ids(rows: DataFrame, path: str, id: str = "id") -> int:
    """Append ``rows`` with ids of their own that go on after those in the table; returns the highest.

    The rows are written once, with the number of their task and their place in it; running sums of the
    tasks' counts turn both into an id, so ids have no gaps and no row passes a task with all others.
    One writer at a time: two that append together would start at the same id.
    """
    spark = rows.sparkSession
    placed = materialize(rows.withColumn("_place", F.monotonically_increasing_id()), "appended")
    task, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("_task", task)
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    counts = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    counts = counts.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    base = highest_id(spark, path, id)
    number = (F.lit(base) + F.col("_before") + place + 1).cast("long")
    placed.join(counts, "_task").select(number.alias(id), *rows.columns).write.mode("append").parquet(path)
    return highest_id(spark, path, id)

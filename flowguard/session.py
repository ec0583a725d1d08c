"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "flowguard") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix=f"{app}-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster shares (``spark.checkpoint.dir``).

    Where that setting is absent a local folder stands in, but only if driver and executors are one
    process; on a cluster each machine would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="flowguard-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of files, as Spark estimates them, for one task of a step heavy on the CPU.
SPREAD_BYTES = 4 << 20
#: Rows of one part where each row becomes a large vector.
PART_ROWS = 2048


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of the rows, as Spark estimates them by the size of the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, by_bytes: bool = True) -> DataFrame:
    """Give a scan more partitions, for steps heavy on the CPU: one for each slot, and one for each
    ``SPREAD_BYTES``, so that no task grows with the table.

    A table of enough files or row groups gets no exchange.  Without ``by_bytes`` the splits of the scan, which Spark
    bounds, are enough if there is one for each slot: for steps that take a row at a time, where the exchange of
    a large table's texts would take more disk than the table.
    """
    size = estimated_bytes(df) if by_bytes else 0
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def in_parts(df: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """A written table dealt to parts of about ``rows`` rows, before each row becomes a large vector."""
    wanted = -(-df.count() // rows)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


#: Working files are read a few times at most, so they take as little disk as they can.
CODEC = "zstd"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str) -> None:
    """Write ``df`` over what is at ``path``, for a later step.

    What the write has shuffled goes with its end: otherwise it lies on disk until the driver collects its garbage, and the
    steps of a job add up.  Whatever runs the same plan again makes it anew.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", CODEC).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a working table that no later step reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a costly result is read several times: the table survives lost executors and,
    unlike an RDD checkpoint, readers of it still prune columns.
    """
    path = work_folder(df.sparkSession, name)
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

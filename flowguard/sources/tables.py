"""Alert logs, relational tables and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowguard.schemas import ALARM, ASSET
from flowguard.session import materialize


def alert_lines(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """Lines of the alert log, as a column ``line``.

    As a stream, each file is read once, so this is for logs that are rotated; ``options`` are those of
    the file source, ``cleanSource`` and ``sourceArchiveDir`` for what happens to files that were read.
    A log that grows in place is for ``tail_log``.
    """
    reader = (spark.readStream if stream else spark.read).options(**options)
    return reader.text(path).select(F.col("value").alias("line"))


def tail_log(
    spark: SparkSession, path: str, state: str, sink: Callable[[DataFrame, int], None], pattern: str = "*"
) -> int:
    """Hand the lines that were added to the files of ``path`` since the last call to ``sink``.

    ``sink`` gets rows (``path``, ``place``, ``line``), ``place`` being the order within the new lines of a
    file, and the number of the call. ``state`` is a folder that keeps how many bytes of each file
    were read; a call that fails before its state is written runs again under the same number, so a
    sink that replaces the output of that number gives each line once. A line without an end waits; a file
    that became shorter was emptied and is read from its start. Returns the number of the call.
    """
    kept = f"{state}/read"
    seen = _last_state(spark, kept)
    run = 0 if seen is None else 1 + seen.agg(F.max("run")).first()[0]
    source = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    # the sizes are settled first, as the files may grow while they are read
    sizes = materialize(source.select("path", F.col("length").alias("size")), "log-sizes")
    files = source.select("path", "content").join(sizes, "path")
    if seen is not None:
        files = files.join(seen.drop("run"), "path", "left")
    else:
        files = files.withColumn("bytes", F.lit(0).cast("long"))
    start = F.when(F.col("bytes") <= F.col("size"), F.col("bytes")).otherwise(0)
    fresh = files.withColumn("start", F.coalesce(start, F.lit(0)).cast("int"))
    fresh = fresh.select("path", "start", F.expr("substring(content, start + 1, int(size) - start)").alias("fresh"))
    # one character for each byte finds the last line end, wherever a character was cut
    open_ = F.length(F.substring_index(F.decode("fresh", "ISO-8859-1"), "\n", -1))
    fresh = fresh.withColumn("done", F.length("fresh") - open_)
    text = F.decode(F.expr("substring(fresh, 1, done)"), "UTF-8")
    split = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    lines = fresh.where("done > 0").select("path", F.posexplode(split).alias("place", "line"))
    sink(lines, run)
    read = fresh.select("path", (F.col("start") + F.col("done")).cast("long").alias("bytes"), F.lit(run).alias("run"))
    read.write.mode("overwrite").parquet(f"{kept}/{run % 2}")
    return run


def _last_state(spark: SparkSession, kept: str) -> DataFrame | None:
    """The newer of the two tables that are written in turn; a table without its success mark was not finished."""
    found = []
    for slot in (0, 1):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{kept}/{slot}/_SUCCESS")
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            found.append(spark.read.parquet(f"{kept}/{slot}"))
    found = [f for f in found if not f.isEmpty()]
    return max(found, key=lambda f: f.agg(F.max("run")).first()[0], default=None)


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational database; column choice and prefix filters are pushed down.

    Credentials are options of the caller, and ``partitionColumn``, ``lowerBound``, ``upperBound``
    and ``numPartitions`` split the read over executors.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def alarm_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALARM).parquet(path)


def asset_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSET).parquet(path)


def binary_files(spark: SparkSession, path: str, pattern: str = "*", stream: bool = False) -> DataFrame:
    """Every file below a folder, or a single one: ``file_name``, ``file_size``, ``content``.

    ``content`` is only read when a later step uses it. Spark's source leaves out files without a byte.
    """
    reader = spark.readStream if stream else spark.read
    files = (
        reader.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), F.col("length").alias("file_size"), "content")

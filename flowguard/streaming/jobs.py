"""Streams that reuse the batch operators on every micro-batch.

State is a small table in the checkpoint folder with what the next micro-batch still needs.  It has
two slots: micro-batch k reads slot ``(k - 1) % 2`` and writes slot ``k % 2``, and its results go to
a folder named after k.  A repeated micro-batch thus finds the same input and replaces its own output.
Because the operators are distributed within a sensor or flow, no key is bound to one task.

A stateful detector is a ``Step``: micro-batch and ``Carried`` in, result rows out.  Alone or beside others in
``fan_out``, it is the same step.  Events get the time of their micro-batch as time of detection; Spark logs that
time with the offsets, so a repeated micro-batch has it again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flowguard.operators import ftp, hosts
from flowguard.operators.events import DETECTED
from flowguard.operators.ordered import Sum, Total, scan
from flowguard.session import remove, save

IDLE_SECONDS = 600  # a transfer that is silent for longer ends as it is
FOLDER = "micro_batch"  # a column of what is read back, so no event may have one of this name


class Carried:
    """What a step keeps between micro-batches, in two slots of ``folder``, and what it holds there within one."""

    def __init__(self, spark: SparkSession, folder: str, batch: int):
        self.spark, self.folder, self.batch = spark, folder, batch
        self._held = 0

    def read(self, schema: StructType, name: str = "slot") -> DataFrame:
        """What the previous micro-batch left over."""
        if self.batch == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}={(self.batch - 1) % 2}")

    def save(self, df: DataFrame, name: str = "slot") -> None:
        save(df, f"{self.folder}/{name}={self.batch % 2}")

    def hold(self, df: DataFrame) -> DataFrame:
        """``df`` written once, for as long as this micro-batch is not released.

        Not persisted: a plan on top of persisted plans carries all of them through every planning step,
        and with some ordered scans above each other that takes far longer than the work.
        """
        path = f"{self.folder}/held-{self._held}"
        self._held += 1
        save(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Delete what was held: the rows that were made of it are written."""
        for k in range(self._held):
            remove(self.spark, f"{self.folder}/held-{k}")
        self._held = 0


@dataclass(frozen=True)
class Step:
    """A stateful detector: saves its state and returns the rows that are settled."""

    run: Callable[[DataFrame, Carried], DataFrame]


Detector = Step | Callable[[DataFrame], DataFrame]


def _detected(found: DataFrame, at: Column) -> DataFrame:
    """Events, bare or in envelopes, with the time of their micro-batch."""
    for f in found.schema:
        if f.name == DETECTED:
            found = found.withColumn(DETECTED, at)
        elif isinstance(f.dataType, StructType) and DETECTED in f.dataType.names:
            stamped = F.col(f.name).withField(DETECTED, at.cast("timestamp"))
            found = found.withColumn(f.name, F.when(F.col(f.name).isNotNull(), stamped))
    return found


def _start(stream: DataFrame, each: Callable[[DataFrame, int, Column], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    """Run ``each`` (rows, number, time of the micro-batch) on every micro-batch."""
    mark = "_detected_at"

    def timed(batch: DataFrame, batch_id: int) -> None:
        row = batch.select(mark).first()
        each(batch.drop(mark), batch_id, F.lit(row[0]) if row else F.current_timestamp())

    writer = stream.withColumn(mark, F.current_timestamp()).writeStream.foreachBatch(timed)
    return writer.option("checkpointLocation", f"{checkpoint}/source").trigger(**trigger).start()


def window_step(
    judge: Callable[[DataFrame], DataFrame], size: int = 100, by: Sequence[str] = (), order: str = "pkt_no"
) -> Step:
    """Tumbling windows of ``size`` packets.

    A window is handed to ``judge`` (windowed rows in, event rows out) once a later packet of the
    same group has arrived; at most ``size`` rows per group are carried to the next micro-batch.
    """
    by = list(by)
    one = F.lit(1).cast("long")

    def run(batch: DataFrame, carried: Carried) -> DataFrame:
        schema = StructType([*batch.schema.fields]).add("batch_id", "long").add("i", "long")
        fresh = batch.withColumns({c: F.lit(None).cast("long") for c in ("batch_id", "i")})
        rows = carried.hold(carried.read(schema).unionByName(fresh))
        # the first carried row of a group tells the number of its open window
        start = F.when(F.col("i") == 0, F.col("batch_id")).otherwise(F.lit(0).cast("long"))
        placed = (
            scan(rows, by, order, _idx=Sum(one, before=True), _n=Total(one), _base=Total(start))
            .withColumn("_w", F.expr(f"_idx div {size}"))
            .withColumn("batch_id", F.col("_base") + F.col("_w"))
            .withColumn("i", F.col("_idx") % size)
            .withColumn("batch_size", F.lit(size).cast("long"))
        )
        fired = (F.col("_w") + 1) * size < F.col("_n")
        carried.save(placed.where(~fired).select(*schema.names))
        return judge(placed.where(fired).drop("_idx", "_n", "_base", "_w"))

    return Step(run)


def count_windows(
    stream: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    size: int = 100,
    by: Sequence[str] = (),
    order: str = "pkt_no",
    **trigger,
) -> StreamingQuery:
    """``window_step`` over a stream of its own; the results of micro-batch k go to ``out/micro_batch=k``."""
    step = window_step(judge, size, by, order)

    def each(batch: DataFrame, batch_id: int, at: Column) -> None:
        carried = Carried(batch.sparkSession, f"{checkpoint}/carried", batch_id)
        save(_detected(step.run(batch, carried), at), f"{out}/{FOLDER}={batch_id}")
        carried.release()

    return _start(stream, each, checkpoint, trigger)


def _ended(batch: DataFrame, carried: Carried, idle_seconds: int | None) -> tuple[DataFrame, DataFrame]:
    """Files that a FIN or a later row ended, and those that were silent for too long; rows of other files are carried."""
    rows = carried.hold(carried.read(batch.schema).unionByName(batch))
    timed = rows if idle_seconds is None else carried.hold(ftp.since_last(rows))
    placed = carried.hold(ftp.sessions(timed, idle_seconds))
    done = ftp.files(placed.where("closed")).drop("sess")
    still = placed.where(~F.col("closed") & F.col("file_name").isNotNull())
    if idle_seconds is None:
        expired = done.where(F.lit(False))
    else:
        # the newest packet of all flows is the clock; it never goes back
        clock = StructType().add("at", "timestamp")
        now = carried.hold(carried.read(clock, "clock").unionByName(rows.select(F.col("sniff_ts").alias("at"))).agg(F.max("at").alias("at")))
        carried.save(now, "clock")
        seen = still.groupBy("flow").agg(F.max("sniff_ts").alias("_seen"))
        limit = F.unix_micros("_seen") + idle_seconds * 1_000_000
        late = carried.hold(seen.where(limit < F.unix_micros(now.scalar())).select("flow"))
        expired = ftp.files(still.join(late, "flow", "left_semi")).drop("sess")
        still = still.join(late, "flow", "left_anti")
    carried.save(rows.join(still.select("flow", "seq"), ["flow", "seq"], "left_semi"))
    return done, expired


def ftp_step(judge: Callable[[DataFrame], DataFrame], idle_seconds: int | None = IDLE_SECONDS) -> Step:
    """FTP rows in; ``judge`` makes events of the files whose transfer has ended, by a FIN or by silence."""

    def run(batch: DataFrame, carried: Carried) -> DataFrame:
        done, expired = _ended(batch, carried, idle_seconds)
        return judge(done.unionByName(expired.withColumn("closed", F.lit(True))))

    return Step(run)


def ftp_files(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    idle_seconds: int | None = IDLE_SECONDS,
    late: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Files of finished FTP transfers.

    Rows of unfinished transfers are carried.  A transfer that has been silent for ``idle_seconds``, measured
    on packet time, is closed as it is and goes to ``expired``, so state cannot grow without bound; None keeps
    such transfers open.  With ``late`` (an interval) Spark's watermark drops rows that come later than that
    behind the newest, and packets that were sent twice within it.
    """
    if late is not None:
        stream = stream.withWatermark("sniff_ts", late).dropDuplicatesWithinWatermark(["flow", "seq"])

    def each(batch: DataFrame, batch_id: int, at: Column) -> None:
        carried = Carried(batch.sparkSession, f"{checkpoint}/carried", batch_id)
        done, expired = _ended(batch, carried, idle_seconds)
        save(done, f"{out}/done/{FOLDER}={batch_id}")
        save(expired, f"{out}/expired/{FOLDER}={batch_id}")
        carried.release()

    return _start(stream, each, checkpoint, trigger)


def host_step(assets: DataFrame, part_rows: int = hosts.PART_ROWS) -> Step:
    """Events of alarm runs that have ended, and of full parts of a run that goes on; ``run`` and ``part`` are those of the table.

    At most the alarms of one part are carried for a host.
    """

    def run(batch: DataFrame, carried: Carried) -> DataFrame:
        kept = StructType([*batch.schema.fields]).add("run", "long").add("place", "long").add("head", "boolean")
        fresh = hosts.new_alarms(batch).withColumns(
            {"run": F.lit(None).cast("long"), "place": F.lit(None).cast("long"), "head": F.lit(None).cast("boolean")}
        )
        rows = carried.hold(carried.read(kept).unionByName(fresh).withColumnsRenamed({"run": "_run", "place": "_place", "head": "_head"}))
        host = F.coalesce(F.concat(F.lit("="), "ip"), F.lit(""))
        number = carried.hold(hosts.runs(rows, carried.hold).withColumn("_host", host))
        # the first carried alarm of a host tells the run and the place to go on from
        base_run, base_place = (F.when(F.col("_head"), c).otherwise(F.lit(0).cast("long")) for c in (F.col("_run") - 1, F.col("_place")))
        number = carried.hold(scan(number, ["_host"], "seq", _base=Total(base_run), _from=Total(base_place)))
        of_first = F.when(F.col("run") == 1, F.col("_from")).otherwise(0)
        number = number.withColumn("place", F.col("place") + of_first).withColumn("run", F.col("run") + F.col("_base"))
        number = number.withColumn("part", F.expr(f"place div {part_rows}"))
        last = number.groupBy("_host").agg(F.max(F.struct("run", "part")).alias("_open"))
        number = number.join(last, "_host")
        is_open = F.struct("run", "part") == F.col("_open")
        head = (F.col("place") % part_rows == 0).alias("head")
        carried.save(number.where(is_open).select(*batch.columns, "run", "place", head))
        return hosts.merged(number.where(~is_open).select(*batch.columns, "run", "part"), assets)

    return Step(run)


def fan_out(
    stream: DataFrame, detectors: Mapping[str, Detector], out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Every detector, stateful or not, sees every row, and the source is read once.

    Each reads its columns of the micro-batch, which is held in a file of the checkpoint folder (persisted, all its texts would lie
    on the executors' disks as they are), and leaves what it finds in that folder.  Once all are through, that
    goes at once to ``out/micro_batch=<k>/detector=<name>``: one commit, which a micro-batch that is repeated after a
    failure, between two detectors or later, replaces.  Where detectors have different columns, those that one of them
    lacks are null.
    """

    def each(batch: DataFrame, batch_id: int, at: Column) -> None:
        save(batch, f"{checkpoint}/batch")
        batch = batch.sparkSession.read.schema(batch.schema).parquet(f"{checkpoint}/batch")
        found = []
        for name, detect in detectors.items():
            carried = Carried(batch.sparkSession, f"{checkpoint}/carried-{name}", batch_id)
            rows = detect.run(batch, carried) if isinstance(detect, Step) else detect(batch)
            rows = _detected(rows, at)
            staged = f"{checkpoint}/staged-{name}"
            save(rows, staged)
            carried.release()
            found.append(batch.sparkSession.read.schema(rows.schema).parquet(staged).withColumn("detector", F.lit(name)))
        merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        merged.write.mode("overwrite").partitionBy("detector").parquet(f"{out}/{FOLDER}={batch_id}")
        for name in ("batch", *(f"staged-{name}" for name in detectors)):
            remove(batch.sparkSession, f"{checkpoint}/{name}")

    return _start(stream, each, checkpoint, trigger)


def stateless(stream: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the rows of a stateless plan as they come: the batch function of a detector, or the
    alert log, applied to a stream."""
    writer = stream.writeStream.format("parquet").option("path", out)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()

"""All detectors on one stream of messages: decode, detect, wrap, write.

A message is (``topic``, ``value``), as a subscription to several topics gives it: packets and alarms as JSON, alert
logs as lines.  The stream is read once; every micro-batch goes through nine detectors and ends in one
commit of envelopes, from which ``published`` makes the messages of the event topic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowguard.operators import botnet, ddos, elf_clean, ftp, ids, webshell, xss
from flowguard.operators.events import host_envelope, traffic_envelope
from flowguard.operators.scoring import Scorer
from flowguard.schemas import ALARM, PACKET, TROJAN, VIRUS, WORM
from flowguard.sources import packets as source, sinks
from flowguard.streaming.jobs import IDLE_SECONDS, Detector, Step, fan_out, ftp_step, host_step, window_step

PACKETS, ALERTS, ALARMS = "packets", "alerts", "alarms"


def message(topic: str, value: Column) -> list[Column]:
    return [F.lit(topic).alias("topic"), value.alias("value")]


def decoded(messages: DataFrame) -> DataFrame:
    """(``topic``, ``value``, ``packet``): packets are parsed once for all detectors; those that can't be are left as text."""
    text = F.col("value")
    packets = messages.select("topic", text.alias("_text"), F.when(F.col("topic") == PACKETS, text).alias("value"))
    packet = F.struct(*[f.name for f in PACKET])
    rows = source.decode(packets)
    good = (F.col("topic") == PACKETS) & F.col(source.CORRUPT).isNull()
    return rows.select("topic", F.when(~good, F.col("_text")).alias("value"), F.when(good, packet).alias("packet"))


def _of(topic: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.where(F.col("topic") == topic).select("value")


def packets_of(rows: DataFrame) -> DataFrame:
    return rows.where("packet IS NOT NULL").select("packet.*")


def alarms_of(rows: DataFrame) -> DataFrame:
    return _of(ALARMS)(rows).select(F.from_json("value", ALARM, source.JSON).alias("_a")).select("_a.*")


def over(read: Callable[[DataFrame], DataFrame], detector: Detector, wrap: Callable[[DataFrame], DataFrame]) -> Detector:
    """``detector`` on what ``read`` makes of the decoded messages, its events in envelopes."""
    if isinstance(detector, Step):
        return Step(lambda rows, carried: wrap(detector.run(read(rows), carried)))
    return lambda rows: wrap(detector(read(rows)))


def detectors(
    flood: Scorer,
    bots: Scorer,
    shells: Callable[[DataFrame], DataFrame],
    scripts: Scorer,
    file_verdicts: Callable[[DataFrame], DataFrame],
    assets: DataFrame,
    size: int = 100,
    by: Sequence[str] = (),
    idle_seconds: int | None = IDLE_SECONDS,
    detail: Sequence[str] = ("pkt_no",),
    carry: bool = False,
) -> dict[str, Detector]:
    """The detectors by name.  ``shells`` makes events of packets; ``file_verdicts`` takes files with a ``key`` and gives
    (``key``, ``prediction``), which trojan and worm follow; a virus alarm is raised for every file.
    ``carry`` is how the botnet detector reads addresses (``is_ipv4``).
    """

    def file_events(files: DataFrame) -> DataFrame:
        name = F.concat_ws("/", F.col("flow"), F.col("file_no").cast("string"))
        keyed = files.withColumn("key", name).withColumn("sess", F.lit(None).cast("long"))
        verdict = file_verdicts(keyed)
        return elf_clean.file_events(keyed, {TROJAN: verdict, WORM: verdict, VIRUS: verdict}, "key", force=(VIRUS,))

    traffic: dict[str, tuple[Callable[[DataFrame], DataFrame], Detector]] = {
        "flood": (
            lambda m: ddos.flatten(packets_of(m), by),
            window_step(lambda w: ddos.window_events(w, flood, by), size, by),
        ),
        "botnet": (packets_of, lambda p: botnet.events(p, bots, list(detail), carry)),
        "webshell": (packets_of, shells),
        "xss": (packets_of, lambda p: xss.events(p, scripts, detail=list(detail))),
        "alerts": (_of(ALERTS), lambda lines: ids.events(lines, "value")),
        "files": (lambda m: ftp.from_packets(packets_of(m)), ftp_step(file_events, idle_seconds)),
    }
    found = {name: over(read, detector, traffic_envelope) for name, (read, detector) in traffic.items()}
    found["hosts"] = over(alarms_of, host_step(assets), host_envelope)
    return found


def watch(messages: DataFrame, judges: dict[str, Detector], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Envelopes of all events of a stream of messages; micro-batch k is one commit, ``out/micro_batch=k``."""
    return fan_out(decoded(messages), judges, out, checkpoint, **trigger)


def envelopes(spark: SparkSession, out: str) -> DataFrame:
    """All envelopes that ``watch`` has written, with the detector and the micro-batch they come from."""
    return spark.read.parquet(out)


def published(spark: SparkSession, out: str) -> DataFrame:
    """The same as messages of the event topic."""
    return sinks.to_messages(envelopes(spark, out))

"""Streams give what the batch operators give, whatever the micro-batches and restarts."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from flowguard.operators import ddos, ftp, ids, scoring, windows
from flowguard.schemas import ALARM, ASSET, PACKET
from flowguard.session import materialize, work_folder
from flowguard.sources import packets as source, tables
from flowguard.streaming import jobs

T0 = datetime(2024, 1, 1)
RULE = scoring.rule("length >= 70")


def flood(n):
    row = dict(
        pkt_no=n, sensor="ab"[n % 3 == 0], sniff_ts=T0 + timedelta(seconds=n), layers=["eth", "ip", "tcp"],
        highest_layer="TCP", transport_layer="TCP", length=60 if n % 40 < 15 else 80,
        ip={"src": "s", "dst": f"d{n % 2}"}, src_port=1, dst_port=2,
    )
    return tuple(row.get(f.name) for f in PACKET)


@pytest.fixture
def feed(spark, tmp_path):
    """Files that arrive one after the other."""
    folder = tmp_path / "in"

    def add(rows, schema=PACKET):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        return str(folder)

    return add


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_count_windows_over_micro_batches_and_restarts(spark, feed, tmp_path):
    packets = [flood(n) for n in range(101)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for cut in ((0, 7), (7, 8), (8, 47), (47, 101)):  # each run restarts from the checkpoint
        path = feed(packets[slice(*cut)])
        flat = ddos.flatten(source.packet_files(spark, path, stream=True), ["sensor"])
        judge = lambda w: ddos.window_events(w, RULE, ["sensor"])
        run(jobs.count_windows(flat, judge, out, state, size=10, by=["sensor"], availableNow=True))
    got = spark.read.parquet(out).drop("micro_batch")
    want = ddos.events(spark.createDataFrame(packets, PACKET), RULE, size=10, by=["sensor"], trailing="followed")
    shown = [c for c in want.columns if c != "detected_at"]
    assert got.count() > 3 and got.where("detected_at IS NULL").isEmpty()
    assert sorted(map(str, got.select(*shown).collect())) == sorted(map(str, want.select(*shown).collect()))


def test_carried_rows_stay_below_a_window(spark, feed, tmp_path):
    path = feed([flood(n) for n in range(95)])
    flat = ddos.flatten(source.packet_files(spark, path, stream=True), ["sensor"])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run(jobs.count_windows(flat, lambda w: w, out, state, size=10, by=["sensor"], availableNow=True))
    carried = spark.read.parquet(f"{state}/carried/slot=0").groupBy("sensor").count().collect()
    assert all(1 <= r["count"] <= 10 for r in carried)
    batch = windows.count_window(ddos.flatten(spark.createDataFrame([flood(n) for n in range(95)], PACKET), ["sensor"]), 10, ["sensor"], trailing="followed")
    assert spark.read.parquet(out).count() == batch.count()


FTP = "flow string, seq long, sniff_ts timestamp, request_command string, request_arg string, text_lines string, fin int"


def transfer(flow, start, pieces, fin=True):
    rows = [(flow, start, T0 + timedelta(seconds=start), "STOR", f"{flow}{start}", None, 0)]
    for i, p in enumerate(pieces, 1):
        rows.append((flow, start + i, T0 + timedelta(seconds=start + i), None, None, f"h\n.{p}###\n", 0))
    if fin:
        end = start + len(pieces) + 1
        rows.append((flow, end, T0 + timedelta(seconds=end), None, None, None, 1))
    return rows


def test_ftp_files_over_micro_batches(spark, feed, tmp_path):
    a = transfer("a", 0, "xyz") + transfer("a", 10, "uv") + transfer("a", 20, "q", fin=False)
    b = [("b", 0, T0, None, None, "h\n.lost###\n", 1)] + transfer("b", 1, "k")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for rows in (a[:2] + b[:2], a[2:6], a[6:9] + b[2:], a[9:]):
        path = feed(rows, FTP)
        stream = spark.readStream.schema(FTP).parquet(path)
        run(jobs.ftp_files(stream, out, state, availableNow=True))
    got = spark.read.parquet(f"{out}/done").select("flow", "file_name", "content", "size").collect()
    want = ftp.files(ftp.sessions(spark.createDataFrame(a + b, FTP))).where("closed")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("flow", "file_name", "content", "size").collect()))
    assert sorted(r.file_name for r in got) == ["a0", "a10", "b1"]
    open_rows = spark.read.parquet(f"{state}/carried/slot=1").select("flow", "seq").collect()
    assert sorted(map(tuple, open_rows)) == [("a", 20), ("a", 21)]


def test_silent_transfers_expire(spark, feed, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for rows in (transfer("a", 0, "x", fin=False), transfer("b", 1000, "y", fin=False)):
        stream = spark.readStream.schema(FTP).parquet(feed(rows, FTP))
        run(jobs.ftp_files(stream, out, state, idle_seconds=600, availableNow=True))
    assert [r.file_name for r in spark.read.parquet(f"{out}/expired").collect()] == ["a0"]
    assert {r.flow for r in spark.read.parquet(f"{state}/carried/slot=1").collect()} == {"b"}


def test_fan_out_reads_once_and_serves_all(spark, feed, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for cut in ((0, 20), (20, 30)):
        stream = source.packet_files(spark, feed([flood(n) for n in range(*cut)]), stream=True)
        detectors = {"even": lambda b: b.where("pkt_no % 2 = 0").select("pkt_no"), "all": lambda b: b.select("pkt_no")}
        run(jobs.fan_out(stream, detectors, out, state, availableNow=True))
    got = spark.read.parquet(out).groupBy("detector").count().collect()
    assert {r.detector: r["count"] for r in got} == {"even": 15, "all": 30}


def test_alert_log_resumes(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i, kind in enumerate(["Port Scan", "SQL Inject", "ping"]):
        (folder / f"{i}.txt").write_text(f'{{"msg":"{kind}","timestamp":"{i}","src_ap":"a","dst_ap":"b"}}\n\n')
        lines = tables.alert_lines(spark, str(folder), stream=True)
        run(jobs.stateless(ids.events(lines), out, state, availableNow=True))
    assert sorted((r.type, r.detail) for r in spark.read.parquet(out).collect()) == [(6, "1"), (9, "0")]


def test_binary_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.bin").write_bytes(b"\x7fELF")
    got = tables.binary_files(spark, str(tmp_path), "*.bin").collect()
    assert [(r.file_name, r.file_size, bytes(r.content)) for r in got] == [("a.bin", 4, b"\x7fELF")]


def test_landing_stream_and_table_files(spark, feed, tmp_path):
    out, state = str(tmp_path / "landed"), str(tmp_path / "state")
    stream = source.packet_files(spark, feed([flood(n) for n in range(5)]), stream=True)
    run(source.land_stream(source.tcp_only(stream), out, state, availableNow=True))
    landed = spark.read.parquet(out)
    assert landed.count() == 5 and {str(r.day) for r in landed.collect()} == {"2024-01-01"}
    assert source.packet_files(spark, out).columns == [*PACKET.names, "day"]

    folder = str(tmp_path / "tables")
    spark.createDataFrame([(1, "a", "i", T0)], ALARM).write.parquet(f"{folder}/alarms")
    spark.createDataFrame([("a", "n")], ASSET).write.parquet(f"{folder}/assets")
    assert tables.alarm_files(spark, f"{folder}/alarms").first().seq == 1
    assert tables.asset_files(spark, f"{folder}/assets").first().asset_name == "n"


def test_shared_folder_is_taken_from_the_session():
    session = SimpleNamespace(conf=SimpleNamespace(get={"spark.checkpoint.dir": "hdfs://host/shared/"}.get))
    one, two = work_folder(session, "kept"), work_folder(session, "kept")
    assert one.startswith("hdfs://host/shared/kept-") and one != two


def test_materialize_reads_pruned(spark):
    kept = materialize(spark.range(3).withColumn("b", F.lit("x")), "kept")
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 3 and "ReadSchema: struct<id:bigint>" in plan


def test_silence_ends_a_file_in_a_table(spark):
    rows = transfer("a", 0, "xy", fin=False) + [("a", 900, T0 + timedelta(seconds=900), None, None, "h\n.late###\n", 0)]
    rows += transfer("a", 901, "z")
    frame = spark.createDataFrame(rows, FTP)
    got = {r.file_name: (r.content, r.closed) for r in ftp.files(ftp.sessions(frame, 600)).collect()}
    assert got == {"a0": ("x#\ny#\n", True), "a901": ("z#\n", True)}
    assert any("late" in r.content for r in ftp.files(ftp.sessions(frame)).collect())


def test_all_detectors_survive_a_failure_between_them(spark, feed, tmp_path, monkeypatch):
    """A repeated micro-batch replaces its events, finds its state again, and keeps its time of detection."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    failing, calls, times = [True], [], []
    stamp = jobs._detected
    monkeypatch.setattr(jobs, "_detected", lambda found, at: (times.append(str(at)), stamp(found, at))[1])

    def flaky(rows):
        calls.append(1)
        if failing[0] and len(calls) > 1:
            raise RuntimeError("lost")
        return ids.events(rows.select(F.lit('{"msg":"Port Scan"}').alias("line")).limit(1))

    def start(path):
        stream = source.packet_files(spark, path, stream=True)
        flood_step = jobs.window_step(lambda w: ddos.window_events(w, RULE), size=10)
        over = jobs.Step(lambda rows, carried: flood_step.run(ddos.flatten(rows), carried))
        return jobs.fan_out(stream, {"flood": over, "alerts": flaky}, out, state, availableNow=True)

    packets = [flood(n) for n in range(101)]
    run(start(feed(packets[:47])))
    with pytest.raises(Exception, match="lost"):
        start(feed(packets[47:])).awaitTermination()
    failing[0] = False
    run(start(str(tmp_path / "in")))
    got = spark.read.parquet(out)
    want = ddos.events(spark.createDataFrame(packets, PACKET), RULE, size=10, trailing="followed")
    floods = got.where("detector = 'flood'").select(*[c for c in want.columns if c != "detected_at"])
    assert sorted(map(str, floods.collect())) == sorted(map(str, want.drop("detected_at").collect()))
    assert got.where("detector = 'alerts'").count() == 2
    found = {r.micro_batch: r.at for r in got.groupBy("micro_batch").agg(F.collect_set("detected_at").alias("at")).collect()}
    # one time for all events of a micro-batch: the one that its first, failed attempt had
    assert sorted(found) == [0, 1] and all(len(at) == 1 for at in found.values())
    assert len(times) == 5 and times[0] == times[1] != times[2] == times[3] == times[4]


def test_alarm_runs_of_a_stream(spark, feed, tmp_path):
    from flowguard.operators import hosts

    day = timedelta(days=1)
    rows = [(k, "h" + str(k % 2), "[新报警]" + str(k), T0 + day * (k // 14)) for k in range(60)]
    assets = spark.createDataFrame([("h0", "n")], ASSET)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for cut in ((0, 9), (9, 10), (10, 40), (40, 60)):
        stream = spark.readStream.schema(ALARM).parquet(feed(rows[slice(*cut)], ALARM))
        run(jobs.fan_out(stream, {"hosts": jobs.host_step(assets, part_rows=3)}, out, state, availableNow=True))
    shown = ["ip", "run", "part", "detail", "time", "alarms", "n_names"]
    got = {(r.ip, r.run, r.part): tuple(r) for r in spark.read.parquet(out).select(*shown).collect()}
    all_ = hosts.events(spark.createDataFrame(rows, ALARM), assets, part_rows=3).select(*shown).collect()
    want = {(r.ip, r.run, r.part): tuple(r) for r in all_}
    open_ = {max((k for k in want if k[0] == h)) for h in ("h0", "h1")}
    assert got == {k: v for k, v in want.items() if k not in open_} and len(got) > 8


def test_held_rows_do_not_carry_the_plans_below(spark, tmp_path):
    """Ordered scans on top of persisted plans took minutes of planning on the smallest data."""
    for batch in (0, 1):
        carried = jobs.Carried(spark, str(tmp_path), batch)
        first = carried.hold(spark.range(3 + batch))
        second = carried.hold(first.join(first.withColumnRenamed("id", "other"), F.col("id") == F.col("other")))
        assert "InMemoryRelation" not in second._jdf.queryExecution().withCachedData().toString()
        assert "Join" not in second._jdf.queryExecution().withCachedData().toString()
        assert second.count() == 3 + batch
    assert len(list(tmp_path.glob("held-*"))) == 2

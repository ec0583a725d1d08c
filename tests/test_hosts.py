"""Runs of alarms and asset names."""

from datetime import datetime

import pytest

from flowguard.operators import events, hosts
from flowguard.schemas import ALARM, ASSET
from flowguard.sources import sinks

D1, D2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
NEW = hosts.NEW_ALARM


@pytest.fixture
def alarms(spark):
    rows = [
        (1, "a", f"{NEW}1", D1), (2, "a", "[info]x", D1), (3, "b", f"{NEW}2", D1), (4, "a", f"{NEW}3", D1),
        (5, "a", f"{NEW}4", D2), (6, "a", f"{NEW}5", D1), (7, "c", f"{NEW}6", D2),
    ]
    return spark.createDataFrame(rows, ALARM)


@pytest.fixture
def assets(spark):
    return spark.createDataFrame([("a", "n2"), ("a", "n1"), ("a", "n2"), ("c", "only"), (None, "x")], ASSET)


def test_runs_and_text(alarms, assets):
    got = hosts.events(alarms, assets).collect()
    rows = sorted((r.ip, r.run, r.part, r.detail.replace(NEW, "|"), r.time, r.n_names) for r in got)
    assert rows == [
        ("a", 1, 0, "|1|3", D1, 2), ("a", 2, 0, "|4", D2, 2), ("a", 3, 0, "|5", D1, 2),
        ("b", 1, 0, "|2", D1, 0), ("c", 1, 0, "|6", D2, 1),
    ]
    names = {r.ip: r.names and [tuple(n) for n in r.names] for r in got}
    assert names == {"a": [("n1", 1), ("n2", 2)], "b": None, "c": [("only", 1)]}


def test_long_run_gives_parts(alarms, assets):
    got = hosts.events(alarms, assets, part_rows=1).where("ip = 'a' AND run = 1").orderBy("part").collect()
    assert [(r.part, r.detail) for r in got] == [(0, f"{NEW}1"), (1, f"{NEW}3")]


def test_many_names_are_split_but_whole(spark):
    rows = [("a", f"n{i}") for i in range(50)] * 3
    parts = hosts.asset_names(spark.createDataFrame(rows, ASSET), part_rows=10).collect()
    assert len(parts) > 1 and {r.parts for r in parts} == {5}
    assert sorted(n.asset_name for r in parts for n in r.names) == sorted(f"n{i}" for i in range(50))
    assert {n.copies for r in parts for n in r.names} == {3}


def test_takeover_reports_the_alarm_that_ended_the_run(alarms):
    got = hosts.takeover_ips(hosts.new_alarms(alarms)).orderBy("run").collect()
    # runs by datetime only: [1 3 4] [5] [6] [7]
    assert [(r.run, r.event_ip, r.alarms) for r in got] == [(1, "a", 3), (2, "a", 1), (3, "c", 1), (4, "c", 1)]


def test_prefix_is_pushed_down(spark, alarms, tmp_path):
    path = str(tmp_path / "alarms")
    alarms.write.parquet(path)
    plan = hosts.new_alarms(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(info" in plan


def test_host_sink_rejects_rows_without_a_name(spark, alarms, assets, tmp_path):
    path = str(tmp_path / "hosts")
    sinks.write_host_rows(hosts.events(alarms, assets), path)
    kept = spark.read.parquet(f"{path}/kept").collect()
    assert {(r.ip, r.name) for r in kept} == {("a", "n1,n2"), ("c", "only")}
    assert [r.ip for r in spark.read.parquet(f"{path}/rejected").collect()] == ["b"]


def test_host_envelope(alarms, assets):
    row = events.all_events([], [hosts.events(alarms, assets)]).where("host.ip = 'c'").first()
    assert (row.type, row.traffic, row.host.n_names, row.host.names[0].asset_name) == (1, None, 1, "only")


def test_alarms_without_an_address_are_reported(spark, assets):
    rows = [(1, None, f"{NEW}1", D1), (2, "a", f"{NEW}2", D1), (3, None, f"{NEW}3", D1), (4, "", f"{NEW}4", D1)]
    got = hosts.events(spark.createDataFrame(rows, ALARM), assets).collect()
    assert sorted((str(r.ip), r.detail.replace(NEW, "|")) for r in got) == [("", "|4"), ("None", "|1|3"), ("a", "|2")]


def test_no_name_is_lost_above_one_list(spark, alarms, tmp_path):
    rows = [("a", f"n{i:03d}") for i in range(51)]
    named = hosts.with_asset_names(alarms.where("ip = 'a'").limit(1), spark.createDataFrame(rows, ASSET), part_rows=10)
    got = named.collect()
    assert sorted(n.asset_name for r in got for n in r.names) == [n for _, n in rows]
    assert {r.n_names for r in got} == {51} and len({r.name_part for r in got}) == len(got)

"""Flood, botnet, web-shell, XSS and IDS detection on hand-made packets."""

import math
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowguard.operators import botnet, ddos, events, ids, scoring, webshell, windows, xss
from flowguard.plans import queries
from flowguard.schemas import PACKET, as_packets
from flowguard.sources import packets as source, sinks

T0 = datetime(2024, 1, 1)
RULE = scoring.rule("length >= 70")


def packet(n, dst="d", length=80, seconds=None, **more):
    base = {
        "pkt_no": n, "sensor": "s", "sniff_ts": T0 + timedelta(seconds=n if seconds is None else seconds),
        "layers": ["eth", "ip", "tcp"], "highest_layer": "TCP", "transport_layer": "TCP", "length": length,
        "ip": {"src": "10.0.0.1", "dst": dst}, "src_port": 1, "dst_port": 2,
        "tcp": {"seq": "1", "ack": "2", "fin": 0}, "time_delta": 0.5,
    }
    return {**base, **more}


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([tuple(r.get(f.name) for f in PACKET) for r in rows], PACKET)

    return make


def test_ratio_and_share_are_strict(table):
    """Exactly 80 % hostile is no alarm; exactly 30 % of the packets is no target."""
    at_limit = [packet(i, length=80 if i < 8 else 60) for i in range(11)]
    assert ddos.events(table(at_limit), RULE, size=10).count() == 0
    over = [packet(i, dst="x" if i < 3 else "y", length=60 if i == 0 else 80) for i in range(11)]
    got = ddos.events(table(over), RULE, size=10, trailing="followed").collect()
    assert [(r.dst_ip, r.detail, r.src_ip) for r in got] == [("y", "[3,4,5,6,7,8,9]", "")]
    every = ddos.events(table(over), RULE, size=10).collect()  # the last window is judged as it is
    assert sorted((r.batch_id, r.dst_ip, r.detail) for r in every) == [(0, "y", "[3,4,5,6,7,8,9]"), (1, "y", "[10]")]
    assert got[0].time == T0 + timedelta(seconds=9)


def test_undecodable_packets_keep_their_place(table):
    """They count as packets of the window and in ``i``, but not in the hostile ratio."""
    rows = [packet(i, layers=["eth"], ip=None) if i in (0, 5) else packet(i, dst=f"d{i % 2}") for i in range(11)]
    flat = windows.count_window(ddos.flatten(table(rows)), 10, trailing="full")
    feats = ddos.features(flat).orderBy("pkt_no").collect()
    assert [r.i for r in feats] == [1, 2, 3, 4, 6, 7, 8, 9]
    assert [r.packet_rate for r in feats] == [1.0] * 8
    ratio = ddos.batch_ratio(RULE(ddos.features(flat))).first()
    assert (ratio.hostile, ratio.decodable, ratio.alarm) == (8, 8, True)
    assert {r.packets for r in ddos.targets(RULE(ddos.features(flat))).collect()} == {4}


def test_equal_timestamps_give_rate_zero(table):
    flat = windows.count_window(ddos.flatten(table([packet(i, seconds=0) for i in range(4)])), 3, trailing="full")
    assert [r.packet_rate for r in ddos.features(flat).collect()] == [0.0, 0.0, 0.0]


def test_arp_and_plain_ip_have_no_ports(table):
    arp = packet(0, highest_layer="ARP", ip=None, arp={"src_proto_ipv4": "1.1.1.1", "dst_proto_ipv4": "2.2.2.2"})
    plain = packet(1, transport_layer=None)
    rows = ddos.flatten(table([arp, plain])).orderBy("pkt_no").collect()
    assert [(r.src_ip, r.dst_ip, r.transport_layer, r.src_port, r.dst_port) for r in rows] == [
        ("1.1.1.1", "2.2.2.2", "None", 0, 0), ("10.0.0.1", "d", "None", 0, 0),
    ]


def test_allow_list(spark, table):
    flat = ddos.flatten(table([packet(0), packet(1, ip={"src": "9.9.9.9", "dst": "d"})]))
    assert [r[0] for r in flat.orderBy("pkt_no").select(ddos.allow_flag(F.col("src_ip"), ["9.9.9.9"])).collect()] == [1, 0]
    allowed = spark.createDataFrame([("9.9.9.9",)], "ip string")
    assert [r.pkt_no for r in ddos.drop_allowed(flat, allowed).collect()] == [0]


def test_windows_of_sensors_are_apart(table):
    rows = [packet(i, sensor="ab"[i % 2]) for i in range(22)]
    got = ddos.events(table(rows), RULE, size=5, by=["sensor"])
    assert Counter((r.sensor, r.batch_id) for r in got.collect()) == {(s, b): 1 for s in "ab" for b in (0, 1, 2)}


def test_botnet_features_and_rejects(table):
    rows = [
        packet(0), packet(1, transport_layer="UDP"), packet(2, transport_layer=None), packet(3, src_port=None),
        packet(4, ip=None, ipv6={"src": "::1", "dst": "::2"}), packet(5, ip={"src": "10.0.0.999", "dst": "d"}),
        packet(6, ip={"src": "0.0.1.0", "dst": "0.0.0.9"}),
    ]
    got = botnet.features(table(rows)).select("pkt_no", *botnet.MODEL_INPUTS).collect()
    assert [tuple(r) for r in got] == [(6, 0.5, 0, 1, 2, 256, 9, 3.0, 80, 30)]
    event = botnet.events(table(rows), scoring.rule("true"), ["pkt_no"]).first()
    assert (event.type, event.src_ip, event.detail) == (2, "0.0.1.0", '{"pkt_no":6}')


def test_xss_first_field_hides_the_others(table):
    rows = [
        packet(0, http={"request_uri": "/%3Cscript%3E", "cookie": "<c>"}),
        packet(1, http={"cookie": "a<c>b"}, form_text="Value: <f>"),
        packet(2, form_text="Key: k\n  Value: a:<f> \nValue: plain"),
        packet(3),
    ]
    first = xss.texts(table(rows)).select("pkt_no", "field", "text").collect()
    assert sorted(tuple(r) for r in first) == [
        (0, "uri", "<script>"), (1, "cookie", "<c>"), (2, "form", "<f>"), (2, "form", "plain"),
    ]
    both = xss.texts(table(rows), mode="any").select("pkt_no", "field", "text").collect()
    assert sorted(tuple(r) for r in both) == [
        (0, "cookie", "<c>"), (0, "uri", "<script>"), (1, "cookie", "<c>"), (1, "form", "<f>"),
        (2, "form", "<f>"), (2, "form", "plain"),
    ]
    found = xss.events(table(rows), scoring.rule("contains(frame, '<f')"), detail=["pkt_no"]).collect()
    assert [(r.type, r.detail) for r in found] == [(8, '{"pkt_no":2}')]


def test_xss_finds_what_is_far_into_a_long_text(table):
    rows = [packet(0, http={"cookie": "<" + "a" * 25_000 + "!>"})]
    assert xss.events(table(rows), scoring.rule("contains(frame, '!')"), detail=["pkt_no"]).count() == 1


def test_webshell_payload_choice(table):
    rows = [
        packet(0, http={"data": b"form".hex()}, mime_multipart={"data": b"file".hex()}),
        packet(1, http={"data": b"form".hex()}), packet(2, http={"data": ""}), packet(3), packet(4, http={"data": "f"}),
    ]
    got = webshell.payloads(table(rows)).select("pkt_no", "payload").collect()
    assert sorted(tuple(r) for r in got) == [(0, "file"), (1, "form")]


def test_tfidf_formula(spark):
    texts = ["aa bb aa", "bb cc", "aa bb bb cc dd"]
    df = spark.createDataFrame(list(enumerate(texts)), "pkt_no int, payload string")
    counts = webshell.term_counts(df)
    got = {(r.pkt_no, r.term): r.tfidf for r in webshell.tfidf(counts, webshell.fit_idf(counts, df.agg(F.count("*")))).collect()}
    docs = [Counter(t.split()) for t in texts]
    idf = {t: math.log((1 + 3) / (1 + sum(t in d for d in docs))) + 1 for d in docs for t in d}
    for n, d in enumerate(docs):
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in d.items()))
        for t, c in d.items():
            assert got[n, t] == pytest.approx(c * idf[t] / norm)
    assert len(got) == sum(map(len, docs))


def test_tfidf_of_a_corpus_reads_the_texts_once(spark, tmp_path):
    """Equal keys are one text for the terms but two for their number, as is a text without a term."""
    texts = [(0, "aa bb aa"), (1, "bb cc"), (2, "aa bb bb cc dd"), (2, "aa ee"), (3, "- !"), (None, "bb")]
    path = str(tmp_path / "texts")
    spark.createDataFrame(texts, "pkt_no int, payload string").write.parquet(path)
    df = spark.read.parquet(path)
    counts = webshell.term_counts(df)
    want = webshell.tfidf(counts, webshell.fit_idf(counts, df.agg(F.count("*")))).collect()
    weights = webshell.corpus_tfidf(df)
    got = weights.collect()
    assert weights.columns == ["pkt_no", "term", "tf", "tfidf"]
    assert {(r.pkt_no, r.term, r.tf): round(r.tfidf, 12) for r in got} == {(r.pkt_no, r.term, r.tf): round(r.tfidf, 12) for r in want}
    assert len(got) == len(want) == 10
    assert webshell.corpus_tfidf(df.where("pkt_no > 9")).count() == 0


def test_tfidf_query_decodes_its_texts_once(spark):
    found = queries.tfidf(spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("tryValidateUTF8String") == 1
    assert "ReusedExchange" in plan


def test_top_class_and_threshold(spark):
    row = spark.range(1).select(
        scoring.top_class(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))), scoring.at_least_half(F.lit(0.5)),
        scoring.at_least_half(F.lit(0.51)),
    ).first()
    assert tuple(row) == (1, 0, 1)


def test_trained_scorer_survives_saving(spark, table, tmp_path):
    rows = [packet(i, length=60 + i % 20, ip={"src": "10.0.0.1", "dst": "10.0.0.2"}) for i in range(60)]
    feats = botnet.features(table(rows)).withColumn("label", F.expr("double(length >= 70)"))
    fitted = scoring.train_forest(feats, botnet.MODEL_INPUTS, "label", trees=3)
    fitted.save(str(tmp_path / "model"))
    got = scoring.load(str(tmp_path / "model"))(feats).collect()
    assert all(r.prediction == int(r.length >= 70) for r in got)


def test_ids_lines(spark):
    lines = [
        '{"msg":"XML Inject and SQL Inject","timestamp":"2024-01-01T00:00:00","src_ap":"a","dst_ap":"b"}',
        '{"msg":"Port Scan, SQL Inject","timestamp":"06/01-1:2","src_ap":"a","dst_ap":"b"}',
        '{"msg":"ping","timestamp":"t","src_ap":"a","dst_ap":"b"}', "{broken", "",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = sorted(ids.events(df).collect(), key=lambda r: r.type)
    assert [(r.type, r.detail) for r in got] == [(6, "2024-01-01T00:00:00"), (9, "06/01-1:2")]
    assert got[0].time == T0 and got[1].time is None


def test_decode_splits_bad_messages(spark, table):
    sent = source.encode(table([packet(0), packet(1)]))
    bad = spark.createDataFrame([("{nope",), ("",)], "value string")
    decoded = source.decode(sent.union(bad))
    assert sorted(r.pkt_no for r in source.accepted(decoded).collect()) == [0, 1]
    assert source.accepted(decoded).drop("value").schema == PACKET
    assert sorted(r.value for r in source.rejected(decoded).collect()) == ["", "{nope"]


def test_land_filters_and_prunes(spark, table, tmp_path):
    path = str(tmp_path / "landed")
    source.land(source.tcp_only(table([packet(0), packet(1, transport_layer="UDP"), packet(2, seconds=90_000)])), path)
    landed = spark.read.parquet(path)
    assert sorted(r.pkt_no for r in landed.collect()) == [0, 2]
    plan = landed.where("day = date'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_as_packets_fills_missing_fields(spark):
    df = spark.sql("SELECT 1 AS pkt_no, named_struct('cookie', 'c') AS http, 2 AS extra")
    row = as_packets(df).first()
    assert as_packets(df).schema.simpleString() == PACKET.simpleString()
    assert row.http.cookie == "c" and row.http.data is None and row.ip is None


def test_envelope_round_trip(spark, table, tmp_path):
    found = botnet.events(table([packet(0, ip={"src": "10.0.0.1", "dst": "10.0.0.2"})]), scoring.rule("true"), ["pkt_no"])
    path = str(tmp_path / "events")
    sinks.write_messages(events.all_events([found]), path)
    row = sinks.read_messages(spark, path).first()
    assert (row.type, row.traffic.type, row.traffic.dst_ip, row.host) == (0, 2, "10.0.0.2", None)
    assert row.traffic.time == T0

from flowguard.operators import evidence
from flowguard.session import work_folder
from flowguard.sources import sinks, tables


def test_ids_go_on_over_appends(spark):
    path = f"{work_folder(spark, 'ids')}/t"
    assert sinks.highest_id(spark, path) == 0
    sizes = [1000, 0, 1, 257]
    for k, n in enumerate(sizes):
        rows = spark.range(n).selectExpr(f"{k} AS append", "id AS v").repartition(5)
        assert sinks.append_with_ids(rows, path) == sum(sizes[: k + 1])
    rows = spark.read.parquet(path).collect()
    assert sorted(r.id for r in rows) == list(range(1, sum(sizes) + 1))
    assert len({(r.append, r.v) for r in rows}) == len(rows)
    for k in range(len(sizes)):
        own = [r.id for r in rows if r.append == k]
        assert not own or (min(own) == sum(sizes[:k]) + 1 and max(own) == sum(sizes[: k + 1]))


def test_evidence_is_found_without_moving_packets(spark):
    packets = spark.range(5000).selectExpr("id AS pkt_no", "id % 2 AS sensor", "id DIV 200 AS batch_id", "IF(id % 7 = 0, null, concat('d', id % 3)) AS dst_ip")
    table = evidence.store(packets, ["sensor"], buckets=4)
    events = spark.createDataFrame([(0, 3, "d1"), (1, 3, "d2"), (1, 3, "d2"), (0, 99, "d0"), (0, 4, None), (0, 5, "d9")], "sensor long, batch_id long, dst_ip string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evidence.packets_of(events, spark, table, ["sensor"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted(r.pkt_no for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [p for p in range(5000) if p // 200 == 3 and p % 7 and (p % 2, p % 3) in {(0, 1), (1, 2)}]
    assert got == want
    packet_side = plan[plan.index("SortMergeJoin") :].split("+- Sort")[0]
    assert "FileScan" in packet_side and "Exchange" not in packet_side, plan


def test_files_by_name_pattern(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "x.bin").write_bytes(b"123")
    (tmp_path / "a" / "b" / "y.bin").write_bytes(b"\x00")
    (tmp_path / "a" / "z.txt").write_bytes(b"no")
    files = tables.binary_files(spark, str(tmp_path), "*.bin")
    assert sorted((r.file_name, r.file_size, bytes(r.content)) for r in files.collect()) == [("x.bin", 3, b"123"), ("y.bin", 1, b"\x00")]
    assert [(r.file_name, r.file_size) for r in tables.binary_files(spark, str(tmp_path / "x.bin")).select("file_name", "file_size").collect()] == [("x.bin", 3)]
    plan = files.select("file_name", "file_size")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]

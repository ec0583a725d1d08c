"""Steps whose tasks must not grow with the table."""

from pyspark.sql import functions as F

from flowguard import session
from flowguard.operators import hosts


def test_parts_are_bounded_by_rows_and_bytes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    spark.range(5000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text")).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    assert session.in_parts(rows, 500).rdd.getNumPartitions() == 10
    assert session.in_parts(rows, 500).count() == 5000
    monkeypatch.setattr(session, "SPREAD_BYTES", 50_000)
    parts = session.spread(rows).rdd.getNumPartitions()
    assert parts > 2 * spark.sparkContext.defaultParallelism
    assert session.spread(rows).count() == 5000


def test_asset_text_is_made_before_the_join(spark):
    alarms = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seq int, ip string")
    assets = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x")], "ip string, asset_name string")

    def show(lists):
        return lists.withColumn("names", F.array_join(F.transform("names", lambda n: n["asset_name"]), ","))

    got = hosts.with_asset_names(alarms, assets, show=show).orderBy("seq").collect()
    assert [(r.seq, r.names, r.n_names) for r in got] == [(1, "x,y", 2), (2, "x,y", 2), (3, None, 0)]

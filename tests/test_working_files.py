"""What the steps of a job leave on disk."""

import time

from pyspark.sql import functions as F

from flowguard.plans import queries
from flowguard.schemas import PACKET
from flowguard.session import materialize, save
from flowguard.sources import packets as source
from flowguard.streaming import jobs


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def left_after(spark, step):
    before = shuffle_files(spark)
    step()
    for _ in range(20):  # executors remove them in their own time
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    return left


def test_shuffles_of_a_written_table_go_with_the_write(spark, tmp_path):
    dealt = spark.range(5000).select("id", (F.col("id") % 700).alias("g")).groupBy("g").agg(F.sum("id").alias("s"))
    kept = []
    assert not left_after(spark, lambda: kept.append(materialize(dealt, "kept")))
    assert not left_after(spark, lambda: save(dealt, str(tmp_path / "saved")))
    assert kept[0].count() == 700 and dealt.count() == 700  # the same plan runs again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") != "true"
    assert any(".zstd." in p.name for p in (tmp_path / "saved").iterdir())


def test_micro_batches_are_held_in_files_not_persisted(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [{f.name: None for f in PACKET} | {"pkt_no": n} for n in range(30)]
    spark.createDataFrame(rows, PACKET).write.parquet(folder)
    plans = []

    def detect(batch):
        plans.append(batch.select("pkt_no")._jdf.queryExecution().withCachedData().toString())
        return batch.select("pkt_no")

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = source.packet_files(spark, folder, stream=True)
    jobs.fan_out(stream, {"a": detect, "b": detect}, out, state, availableNow=True).awaitTermination()
    assert len(plans) == 2 and not any("InMemoryRelation" in p for p in plans)
    assert spark.read.parquet(out).count() == 60


def test_held_tables_go_once_the_events_are_written(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(30).write.parquet(folder)
    seen = []

    def run(rows, carried):
        held = carried.hold(carried.hold(rows).where("id % 2 = 0"))
        carried.save(held.limit(1))
        return held

    def look(rows):
        seen.append(sorted(p.name for p in (tmp_path / "state" / "carried-a").iterdir() if p.is_dir()))
        return rows

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = spark.readStream.schema("id long").parquet(folder)
    jobs.fan_out(stream, {"a": jobs.Step(run), "b": look}, out, state, availableNow=True).awaitTermination()
    assert seen == [["slot=0"]]
    assert {r.detector: r["count"] for r in spark.read.parquet(out).groupBy("detector").count().collect()} == {"a": 15, "b": 30}
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["carried-a", "source"]


def test_only_programs_that_are_carried_are_dealt(spark, tmp_path):
    spark.createDataFrame([(n, "x" * 300, "en") for n in range(8)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(c, t, ("user", "assistant")[t % 2], "h\n.abc#####\n") for c in range(6) for t in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    _, files = queries.carried_files(spark, str(tmp_path))
    whole = {r.doc_id: bytes(r.content) for r in queries.fx.elf_files(spark, str(tmp_path)).collect()}
    got = {int(r.file_name.split("/")[0]): bytes(r.content) for r in files.collect()}
    assert got == {c: whole[c] if c % 2 == 0 else b"abc\n" for c in range(6)}
    plan = files._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)[1]
    program = next(line for line in plan.split("\n") if "_program" in line)
    assert program.count("% 2) = 0) THEN CASE") == 1, program

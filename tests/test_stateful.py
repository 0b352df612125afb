"""State of streams: three micro-batches and restarts give what a batch gives; replayed batches change nothing."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from corvane.operators import history
from corvane.operators import islands as I
from corvane.sources.store import SeedStore
from corvane.streaming import feedback, stateful
from corvane.streaming.twins import run_available


def parts_of(df, order, n=3):
    """df in n parts by order."""
    last = df.agg(F.max(order)).first()[0] + 1
    return [df.where((F.col(order) * n / last).cast("int") == k) for k in range(n)]


def streamed(spark, tmp_path, parts, make, mode="append"):
    """What a stream over the parts gives that is stopped and started again between them."""
    for part in parts:
        part.write.mode("append").parquet(str(tmp_path / "in"))
        run_available(make(spark.readStream.schema(parts[0].schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"), mode)
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.fixture(scope="module")
def results(spark):
    r = random.Random(2)
    rows = [(i % 3, i // 3, r.random() < 0.3, r.randint(0, 4), f"code {r.randint(0, 40)}", r.random() < 0.05) for i in range(600)]
    return spark.createDataFrame(rows, "run long, seq long, ok boolean, branch long, code string, cleared boolean").cache()


def test_gate(spark, results, tmp_path):
    got = streamed(spark, tmp_path, parts_of(results.select("run", "seq", "ok"), "seq"), stateful.gate)
    want = history.rolling_gate(results, "run", "seq", F.col("ok")).select("run", "seq", "active")
    assert sorted(got.collect()) == sorted(want.collect()) and want.where("active").count() > 10


def test_gate_from_a_batch(spark, results, tmp_path):
    """The first part as a batch table, the others as a stream."""
    first, *rest = parts_of(results.select("run", "seq", "ok"), "seq")
    for part in rest:  # with time to live a batch comes even without rows, so that `availableNow` would not end
        part.write.mode("append").parquet(str(tmp_path / "in"))
        s = stateful.gate(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")), initial=first, ttl=3_600_000)
        s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = history.rolling_gate(results, "run", "seq", F.col("ok")).select("run", "seq", "active").join(first.select("run", "seq"), ["run", "seq"], "left_anti")
    assert sorted(got.collect()) == sorted(want.collect())


def test_carry(spark, results, tmp_path):
    p = results.select("run", "seq", F.col("ok").alias("keep"), "code")
    got = streamed(spark, tmp_path, parts_of(p, "seq"), stateful.carry)
    want = history.carried_all(p, "code", F.col("keep"), "seq", "run", 50).select("run", "seq", "previous")
    assert sorted(map(repr, got.select("run", "seq", "previous").collect())) == sorted(map(repr, want.collect()))


def test_streaks(spark, results, tmp_path):
    rows = results.select("run", "branch", "seq", F.col("ok").alias("hit"), F.col("code").alias("source"), "cleared")
    seen = []

    def collect(batch, batch_id):
        seen.extend((batch_id, *map(tuple, [r])) for r in batch.collect())

    for part in parts_of(rows, "seq"):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        s = stateful.streaks(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        s.writeStream.foreachBatch(collect).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r["run"], r["seq"], not r["hit"])):
        m, s = want.get((r["run"], r["branch"]), (0, None))
        want[r["run"], r["branch"]] = (0, s) if r["cleared"] else (0 if r["hit"] else m + 1, r["source"])
    last = {}
    for batch_id, (run, branch, misses, source) in sorted(seen):
        last[run, branch] = (misses, source)
    assert last == want and len({b for b, _ in seen}) == 3


def feed(spark, results):
    verdict = F.when(F.col("ok"), "SAFE").when(F.col("branch") == 0, "ERROR").when(F.col("branch") == 1, "TIMED_OUT").otherwise("FAILURE")
    return results.select("run", "seq", verdict.alias("verdict"), "code", F.lit("c").alias("language"), F.concat(F.lit("f"), "seq").alias("file"), F.lit("m").alias("message"), F.array(F.lit(1.0).cast("float")).alias("vec"))


def test_feedback(spark, results, tmp_path):
    d = feed(spark, results)
    fb = feedback.Feedback(spark, str(tmp_path / "fb"), SeedStore(spark, str(tmp_path / "seeds"), buckets=2), islands=3, interval=20)
    assert fb.table("gate").count() == 0
    state = lambda: [sorted(map(repr, t.collect())) for t in (*(fb.table(n) for n in feedback.TABLES), fb.store.seeds().drop("meta"))]
    for k, part in enumerate(parts_of(d, "seq")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(fb).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        assert fb.done() == list(range(k + 1))
        if k == 1:
            before = state()
            fb(part, 1)  # comes again
            assert state() == before
            shutil.rmtree(tmp_path / "fb" / "done" / "batch=1")
            shutil.rmtree(tmp_path / "fb" / "islands" / "batch=1")
            fb(part, 1)  # was broken off
            assert state() == before
    r = d.withColumn("ok", F.col("verdict") == "SAFE")
    assert sorted(fb.table("gate").collect()) == sorted(history.rolling_gate(r, "run", "seq", F.col("ok")).select("run", "seq", "active").collect())
    assert sorted(fb.table("islands").collect()) == sorted(I.evolved(r, 3, 20).collect())
    safe = r.where("ok")
    assert {x["code"]: x["seq"] for x in fb.store.seeds().collect()} == {x["code"]: x["s"] for x in safe.groupBy("code").agg(F.max("seq").alias("s")).collect()}
    assert fb.table("log_validation").count() == 600 and fb.table("log").count() == r.where("verdict = 'ERROR'").count() > 0

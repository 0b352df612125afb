"""Runs end at their bounds, by one batch more at most, and go on later."""

from corvane.streaming.bounds import Bounded, run_bounded


def arriving(spark, tmp_path, n=8):
    for i in range(n):
        spark.createDataFrame([(i, k) for k in range(10)], "part long, k long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("part long, k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_rows(spark, tmp_path):
    s, seen = arriving(spark, tmp_path), []
    handle = lambda batch, batch_id: seen.append((batch_id, batch.count()))
    b = Bounded(handle, most=25)
    run_bounded(s, b, str(tmp_path / "cp"))
    assert seen == [(0, 10), (1, 10), (2, 10)] and (b.rows, b.batches) == (30, 3)
    run_bounded(s, Bounded(handle, most=1), str(tmp_path / "cp"))  # what came too late is not lost
    assert {i for i, _ in seen} == {0, 1, 2, 3} and len({i for i, _ in seen}) == 4


def test_hours(spark, tmp_path):
    s, seen = arriving(spark, tmp_path), []
    now = [0.0]

    def handle(batch, batch_id):
        seen.append(batch_id)
        now[0] += 1800

    run_bounded(s, Bounded(handle, hours=1.25, clock=lambda: now[0]), str(tmp_path / "cp"))
    assert seen == [0, 1, 2]  # 0, 30 and 60 minutes are below 75, 90 are not

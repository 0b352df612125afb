"""The vector index gives what a scan gives, and reads little where vectors lie in clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import vector_index as V
from corvane.operators.ranking import nearest


def clustered(n, dims=16, centres=12, spread=0.05):
    r = np.random.default_rng(1)
    c = r.normal(size=(centres, dims))
    x = c[r.integers(0, centres, n)] + spread * r.normal(size=(n, dims))
    x[3], x[10], x[11] = 0, x[12], x[12]  # no direction, and equal ones
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(clustered(2000) + [(5000, None)], "vec_id long, vec array<float>").repartition(4)


@pytest.mark.parametrize("n", [1, 5, 40])
def test_equals_scan_and_prunes(spark, vectors, tmp_path, n, monkeypatch):
    monkeypatch.setattr(V, "ASKED", 7)  # blocks are copied
    q = vectors.where("vec_id % 50 = 0 OR vec_id IN (3, 10, 5000)").withColumnRenamed("vec_id", "query_id")
    found = V.VectorIndex.build(vectors, str(tmp_path / "index"), cells=24, block=32).search(q, n)
    assert rows(found.rows) == rows(nearest(q.where("vec IS NOT NULL"), vectors, n))
    read = found.read.where("query_id <> 3").agg(F.sum("rows_read") / F.sum("rows_in_all")).first()[0]
    assert read < 0.3  # the twelve clusters are told apart
    plan = found.rows._jdf.queryExecution().toString()
    assert "toLocalIterator" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_fewer_vectors_than_asked(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, vec array<double>")
    index = V.VectorIndex.build(v, str(tmp_path / "index"))
    assert rows(index.search(v.withColumnRenamed("vec_id", "query_id"), 5).rows) == [(1, 1, 1, 1.0), (1, 2, 2, 0.0), (2, 1, 2, 1.0), (2, 2, 1, 0.0)]
    assert index.blocks.agg(F.sum("n")).first()[0] == 2


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, vec array<double>")
    index = V.VectorIndex.build(none, str(tmp_path / "index"))
    some = spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>")
    assert index.search(some, 3).rows.count() == 0
    again = V.VectorIndex.build(some.withColumnRenamed("query_id", "vec_id"), str(tmp_path / "other"))
    assert again.search(none.withColumnRenamed("vec_id", "query_id"), 3).rows.count() == 0


def test_cells_are_partitions(spark, vectors, tmp_path):
    """A list is read by its cell's folder alone."""
    index = V.VectorIndex.build(vectors, str(tmp_path / "index"), cells=10, block=64)
    assert len(list((tmp_path / "index" / "lists").glob("cell=*"))) <= 10
    assert index.blocks.where("n > 64 OR low > high").count() == 0
    assert "PartitionFilters: [isnotnull(cell" in index.lists.where("cell = 3")._jdf.queryExecution().toString()

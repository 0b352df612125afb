"""O-K6, S13: an index of vectors by direction whose answers are exact.

Cells are fitted by spherical k-means on a bounded sample; every vector then goes to the cell of its nearest centre. A
cell's vectors, sorted by their angle to the centre, are packed into blocks with the least and the largest of these
angles. A vector x of a block and a query q are at least as far apart as q's angle to the centre is outside of the
block's range (the triangle inequality on the sphere), so a block that cannot hold anything nearer than the n-th
best known so far is not read. Queries meet blocks in joins; nothing of them passes the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Angles are taken for this much nearer than they come out, as an arc cosine near 1 is inexact.
SLACK = 1e-6
#: Queries that meet one copy of a block.
ASKED = 4096


class Found(NamedTuple):
    """`rows`: query_id, vec_id, score, rank. `read`: query_id, rows_read, rows_in_all."""

    rows: DataFrame
    read: DataFrame


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those without a direction stay zero, at a right angle to all."""
    return x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres by spherical k-means. Each first centre is a row drawn by its distance to those before it (k-means++, with
    a fixed seed); cells that get no row keep their centre."""
    x, r = unit(sample), np.random.default_rng(0)
    first, near = [0], x @ x[0]
    while len(first) < min(cells, len(x)):
        far = np.maximum(0.0, 1 - near)
        first.append(int(r.choice(len(x), p=far / far.sum())) if far.sum() else len(first))
        near = np.maximum(near, x @ x[first[-1]])
    c = x[first]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        some = np.linalg.norm(total, axis=1) > 0
        c = np.where(some[:, None], unit(total), c)
    return c


def _bound() -> Column:
    """No vector between `low` and `high` of a centre is nearer to a query at `angle` from it."""
    return F.greatest(F.lit(0.0), F.col("low") - F.col("angle"), F.col("angle") - F.col("high")) - SLACK


def _nearest(df: DataFrame, n: int, *by: str) -> DataFrame:
    """Of each query the first rows that hold n vectors between them."""
    w = W.partitionBy("query_id").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("_before") < n).drop("_before")


@dataclass
class VectorIndex:
    """An index written by build(). `cells` (cell, centre) are at most as many as were fitted; `blocks` have one row for
    each block: cell, block, low, high, n; `lists` the same with ids and vectors, a folder a cell."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = 20_000, block: int = 1024) -> VectorIndex:
        """Index (vec_id, vec), null vectors left out, with `cells` cells or as many as the root of the rows, 1,024 at
        most, fitted on the `sample` rows that come first by hash of their id."""
        spark = vectors.sparkSession
        v = vectors.where("vec IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"))
        some = [r["vec"] for r in v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
        n = v.count()
        centres = fit_cells(np.asarray(some, np.float64), min(cells or max(1, min(1024, int(n**0.5))), len(some))) if some else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast(centres)

        def assign(batches):
            for b in batches:
                if b.num_rows:
                    cos = unit(_matrix(b.column(1))) @ shared.value.T
                    own = cos.argmax(1)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int64)), pa.array(_angle(cos.max(1)))], ["vec_id", "vec", "cell", "angle"])

        def pack(batches):
            held: list[tuple] = []

            def flush():
                cell, ids, angles = held[0][0], [r[1] for r in held], [r[2] for r in held]
                blob = np.asarray([r[3] for r in held], np.float64).tobytes()
                names = ["cell", "low", "high", "n", "ids", "vecs"]
                out = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((cell, pa.int64()), (min(angles), pa.float64()), (max(angles), pa.float64()), (len(ids), pa.int64()), (ids, pa.list_(pa.int64())), (blob, pa.binary()))], names)
                held.clear()
                return out

            for b in batches:
                for r in zip(*(b.column(i).to_pylist() for i in range(4))):
                    if held and (r[0] != held[0][0] or len(held) == block):
                        yield flush()
                    held.append(r)
            if held:
                yield flush()

        placed = v.mapInArrow(assign, "vec_id long, vec array<double>, cell long, angle double").select("cell", "vec_id", "angle", "vec")
        by = ["cell", "angle", "vec_id"]
        packed = placed.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(pack, "cell long, low double, high double, n long, ids array<long>, vecs binary")
        packed.withColumn("block", F.monotonically_increasing_id()).write.partitionBy("cell").parquet(f"{path}/lists")
        lists = spark.read.schema("low double, high double, n long, ids array<long>, vecs binary, block long, cell long").parquet(f"{path}/lists")
        lists.select("cell", "block", "low", "high", "n").write.parquet(f"{path}/blocks")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell long, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
        return VectorIndex(spark, path)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def blocks(self) -> DataFrame:
        return self._table("blocks", "cell long, block long, low double, high double, n long")

    @property
    def lists(self) -> DataFrame:
        return self._table("lists", "low double, high double, n long, ids array<long>, vecs binary, block long, cell long")

    def _cells(self, queries: DataFrame) -> DataFrame:
        """(query_id, cell, angle, n, bound): the angle to each cell's centre, the cell's rows, and the least angle to any."""
        cells = self._table("cells", "cell long, centre array<double>").orderBy("cell").collect()  # as many as were fitted
        shared = self.spark.sparkContext.broadcast(np.asarray([r["centre"] for r in cells], np.float64))

        def run(batches):
            for b in batches:
                if b.num_rows and len(shared.value):
                    angle = _angle(unit(_matrix(b.column(1))) @ shared.value.T)
                    k = angle.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), k)), pa.array(np.tile(np.arange(k), len(angle))), pa.array(angle.ravel())], ["query_id", "cell", "angle"])

        whole = F.broadcast(self.blocks.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")))
        return queries.mapInArrow(run, "query_id long, cell long, angle double").join(whole, "cell").select("query_id", "cell", "angle", "n", _bound().alias("bound"))

    def _blocks_of(self, cells: DataFrame) -> DataFrame:
        """(query_id, cell, block, n, bound) of the blocks of such cells."""
        return cells.select("query_id", "cell", "angle").join(self.blocks, "cell").select("query_id", "cell", "block", "n", _bound().alias("bound"))

    def _scan(self, pairs: DataFrame, queries: DataFrame, n: int) -> DataFrame:
        """query_id, vec_id, score: of each pair (query_id, block) the n best of the block."""
        asked = pairs.join(queries, "query_id").select("cell", "block", "query_id", "vec")
        often = F.broadcast(pairs.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("copies")).where("copies > 1"))  # a row for ASKED pairs at least
        asked = asked.join(often, "block", "left").withColumn("copy", F.pmod(F.xxhash64("query_id"), F.coalesce("copies", F.lit(1)))).select("block", "copy", "query_id", "vec")
        cells = [r[0] for r in pairs.select("cell").distinct().collect()]  # as many as were fitted
        held = self.lists.where(F.col("cell").isin(cells)).select("block", "ids", "vecs")
        held = held.join(often, "block", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("copies", F.lit(1)) - 1).cast("long")))).drop("copies")

        def run(key, asked: pa.Table, held: pa.Table) -> pa.Table:
            if not asked.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            ids = held["ids"].combine_chunks().flatten().to_numpy()
            x, q = unit(np.frombuffer(held["vecs"][0].as_py(), np.float64).reshape(ids.size, -1)), unit(_matrix(asked["vec"]))
            near = q @ x.T
            least = np.partition(near, -min(n, ids.size), axis=1)[:, -min(n, ids.size)]
            i, j = np.nonzero(near >= least[:, None] - 1e-9)
            score = (q[i] * x[j]).sum(1)  # summed in one order, so that equal vectors tie
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(i.size) - np.searchsorted(i, i)
            kept = place < n
            return pa.table({"query_id": asked["query_id"].to_numpy()[i[kept]], "vec_id": ids[j[kept]], "score": score[kept]})

        return asked.groupBy("block", "copy").cogroup(held.groupBy("block", "copy")).applyInArrow(run, "query_id long, vec_id long, score double")

    def search(self, queries: DataFrame, n: int) -> Found:
        """For each query (query_id, vec) the n vectors of highest cosine, ties by id, as ranking.nearest(); and how many
        rows were read for it. First the nearest blocks of the nearest cells with n rows are read, then those that the n-th best of them does
        not rule out, whole cells before their blocks. Queries without a vector have no answer; query ids are unique."""
        from corvane.sources.store import kept

        q = kept(queries.where("vec IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")), "queries")
        cells = kept(self._cells(q), "cells")
        first = kept(_nearest(self._blocks_of(_nearest(cells, n, "angle", "cell")), n, "bound", "block"), "first-blocks")
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        rank = F.row_number().over(best)
        known = kept(self._scan(first, q, n).withColumn("rank", rank).where(F.col("rank") <= n), "first-found")
        worst = known.where(F.col("rank") == n).select("query_id", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "score"))).alias("reach"))
        in_reach = F.col("reach").isNull() | (F.col("bound") <= F.col("reach"))
        more = self._blocks_of(cells.join(worst, "query_id", "left").where(in_reach)).join(worst, "query_id", "left").where(in_reach)
        more = more.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti")
        more = kept(more.select("query_id", "cell", "block", "n"), "more-blocks")
        rows = known.drop("rank").unionByName(self._scan(more, q, n)).withColumn("rank", rank).where(F.col("rank") <= n)
        total = self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_all"))
        read = first.select("query_id", "n").unionByName(more.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("rows_read"))
        return Found(rows, read.crossJoin(F.broadcast(total)))  # one row

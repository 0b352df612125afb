"""Ranked selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diversified_top(df: DataFrame, k: int, score: str, category: str, order: str) -> DataFrame:
    """O-K1: the best row of each category first, by score, then the others; k in all, with `position`.

    The k best of each category, and the k best first ones, are all that can be taken, so each is cut down by
    partition before anything meets in one task."""
    w = W.partitionBy(category).orderBy(F.desc(score), order)  # only k + 1 rows of a partition of it pass
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k + 1)
    best = ranked.orderBy((F.col("_rn") == 1).desc(), F.desc(score), order).limit(k)
    return best.withColumn("position", F.row_number().over(W.orderBy((F.col("_rn") == 1).desc(), F.desc(score), order))).drop("_rn")


def bounded_population(df: DataFrame, group: str, fitness: str, order: str, most: int = 50) -> DataFrame:
    """O-K3: the fittest of each group, earlier ones first among equals."""
    w = W.partitionBy(group).orderBy(F.desc(fitness), order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def ranked_by_range(df: DataFrame, group: str, *by: str | Column) -> DataFrame:
    """`rank` of each row in its group, from 1, and `_size` of the group: rows are sorted by ranges, each range numbers its
    own part of a group and starts after the parts before it, so a large group is spread over tasks. Rows whose group
    is null are left out."""
    from corvane.sources.store import kept

    t = df.where(F.col(group).isNotNull()).repartitionByRange(group, *by).sortWithinPartitions(group, *by)
    t = kept(t.withColumn("_p", F.spark_partition_id()).withColumn("_s", F.monotonically_increasing_id()), "ranked")
    w = W.partitionBy(group).orderBy("_p")
    parts = t.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    parts = parts.select(group, "_p", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(group)).alias("_size"))
    own = t.withColumn("_r", F.row_number().over(W.partitionBy(group, "_p").orderBy("_s")))
    return own.join(parts, [group, "_p"]).withColumn("rank", (F.col("_r") + F.col("_before")).cast("int")).drop("_p", "_s", "_r", "_before")


def top_fraction(df: DataFrame, group: str, fitness: str, order: str, fraction: float) -> DataFrame:
    """O-K4: that part of each group, rounded down, but one row at least, however large the group is."""
    t = ranked_by_range(df, group, F.desc(fitness), order)
    return t.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_size") * fraction))).drop("_size")


def best(df: DataFrame, group: str, fitness: str, order: str, column: str) -> DataFrame:
    """O-K5: the fittest of each group, the earlier one among equals."""
    return df.groupBy(group).agg(F.max_by(column, F.struct(fitness, -F.col(order))).alias("best"))


def over_fetched(df: DataFrame, k: int, score: str, category: str, order: str, times: int = 4) -> DataFrame:
    """O-K2: `times` as many as are wanted, as some will not do."""
    return diversified_top(df, times * k, score, category, order)


def global_rank(df: DataFrame, key: Column, tie: str, parts: int = 64, sample: int = 20) -> DataFrame:
    """`rank` of every row by a text key and then `tie`, from 1. Bounds from parts * sample keys, the smallest by hash,
    cut the keys into ranges; each is ranked by itself and starts after the rows of those before it."""
    t = df.withColumn("_key", key)
    some = sorted(r[0] for r in t.select("_key").distinct().where("_key IS NOT NULL").orderBy(F.xxhash64("_key"), "_key").limit(parts * sample).collect())
    bounds = some[sample::sample]
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_key"))) if bounds else F.lit(0)
    t = t.withColumn("_at", F.when(F.col("_key").isNull(), -1).otherwise(at))
    n = {r["_at"]: r["n"] for r in t.groupBy("_at").agg(F.count("*").alias("n")).collect()}  # parts + 1 rows at most
    before, total = {}, 0
    for i in sorted(n):
        before[i], total = total, total + n[i]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_at")) if before else F.lit(0)
    own = F.row_number().over(W.partitionBy("_at").orderBy("_key", tie))
    return t.withColumn("rank", (own + start).cast("long")).drop("_key", "_at")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(queries: DataFrame, store: DataFrame, n: int, block: int = 256) -> DataFrame:
    """O-K6: for each query (query_id, vec) the n rows of store (vec_id, vec) of highest cosine, ties by id.

    The queries are a stated set. They are broadcast in blocks of at most `block` vectors, each task keeps the n
    best of its rows for each query, and only those meet."""
    import numpy as np
    import pyarrow as pa

    spark = store.sparkSession
    rows = queries.select("query_id", "vec").orderBy("query_id").toLocalIterator()
    schema = "query_id long, vec_id long, score double"
    parts: list[DataFrame] = []

    def scan(ids: list[int], vectors: list[list[float]]) -> DataFrame:
        q = np.asarray(vectors, np.float64)
        shared = spark.sparkContext.broadcast((np.asarray(ids), q / np.maximum(1e-300, np.linalg.norm(q, axis=1, keepdims=True))))

        def run(batches):
            ids, q = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column(0).to_numpy()
                x = np.stack([np.asarray(v, np.float64) for v in b.column(1).to_pylist()])
                score = q @ (x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))).T
                take = np.stack([np.lexsort((own, -s))[:n] for s in score])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, take.shape[1])), pa.array(own[take].ravel()), pa.array(np.take_along_axis(score, take, 1).ravel())], ["query_id", "vec_id", "score"])

        return store.where("vec IS NOT NULL").select(F.col("vec_id").cast("long"), "vec").mapInArrow(run, schema)

    ids, vectors = [], []
    for r in rows:
        ids.append(r["query_id"])
        vectors.append(r["vec"])
        if len(ids) == block:
            parts.append(scan(ids, vectors))
            ids, vectors = [], []
    if ids or not parts:
        parts.append(scan(ids, vectors) if ids else spark.createDataFrame([], schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

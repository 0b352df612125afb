"""State that follows an order of iterations: gates, streaks, carries, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rolling_gate(df: DataFrame, run: str, order: str, ok: Column, window: int = 50, threshold: float = 0.30) -> DataFrame:
    """`active` once the last `window` results are there and fewer than `threshold` of them are good."""
    w = W.partitionBy(run).orderBy(order).rowsBetween(1 - window, 0)
    rate = F.avg(F.when(ok, 1.0).otherwise(0.0)).over(w)
    return df.withColumn("active", (F.count("*").over(w) == window) & (rate < threshold))


def rolling_gate_all(df: DataFrame, order: str, ok: Column, window: int = 50, threshold: float = 0.30, bucket: int = 10_000) -> DataFrame:
    """W1 over one long run: ranges of `bucket` order values are windows of their own, each with the rows that reach
    into it from the range before, so no task sees the whole run. Order values are dense integers."""
    at = F.floor(F.col(order) / bucket)
    late = F.col(order) % bucket >= bucket - (window - 1)
    spread = df.withColumn("_b", F.explode(F.when(late, F.array(at, at + 1)).otherwise(F.array(at))))
    return rolling_gate(spread, "_b", order, ok, window, threshold).where(F.col("_b") == at).drop("_b")


def success_rate(ok: Column, empty: float) -> Column:
    """A1, A2: share of good results; `empty` if there are none."""
    return F.coalesce(F.avg(ok.cast("double")), F.lit(empty))


def miss_streaks(df: DataFrame, branch: str, order: str, hit: Column) -> DataFrame:
    """Misses of each branch since its last hit; hits of a record come before its misses."""
    last = df.where(hit).groupBy(branch).agg(F.max(order).alias("_last"))
    late = df.where(~hit).join(last, branch, "left").where(F.col("_last").isNull() | (F.col(order) >= F.col("_last")))
    return df.select(branch).distinct().join(late.groupBy(branch).agg(F.count("*").alias("misses")), branch, "left").select(branch, F.coalesce("misses", F.lit(0)).cast("long").alias("misses"))


def blocked(streaks: DataFrame, threshold: int = 10) -> DataFrame:
    """F11."""
    return streaks.where(F.col("misses") >= threshold)


def last_writer(df: DataFrame, branch: str, order: str, source: str) -> DataFrame:
    """Who wrote last."""
    return df.groupBy(branch).agg(F.max_by(source, order).alias("source"))


def carried(value: Column, keep: Column, run: str, order: str) -> Column:
    """The last kept value before this row."""
    w = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.last(F.when(keep, value), ignorenulls=True).over(w)


def carried_all(df: DataFrame, value: str, keep: Column, order: str, run: str | None = None, bucket: int = 10_000) -> DataFrame:
    """W9 over long runs, as `previous`: ranges of `bucket` order values are windows of their own, and each knows the
    last value kept before it. Order values are whole numbers."""
    own = [run] if run else []
    t = df.withColumn("_b", F.floor(F.col(order) / bucket)).withColumn("_k", F.when(keep, F.col(value)))
    last = t.groupBy(*own, "_b").agg(F.max_by("_k", F.when(F.col("_k").isNotNull(), F.col(order))).alias("_l"))
    w = (W.partitionBy(*own) if own else W.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    last = last.select(*own, "_b", F.last("_l", ignorenulls=True).over(w).alias("_before"))
    inside = F.last("_k", ignorenulls=True).over(W.partitionBy(*own, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    out = t.withColumn("_in", inside).join(last, [*own, "_b"]).withColumn("previous", F.coalesce("_in", "_before"))
    return out.drop("_b", "_k", "_in", "_before")


def cleared(streaks: DataFrame, branch: str, solved: DataFrame) -> DataFrame:
    """The streaks of solved branches start anew; who wrote last is kept elsewhere."""
    gone = solved.select(branch).distinct().withColumn("_solved", F.lit(True))
    return streaks.join(gone, branch, "left").withColumn("misses", F.when(F.col("_solved"), F.lit(0)).otherwise(F.col("misses")).cast("long")).drop("_solved")


def worth_targeting(df: DataFrame, branch: str, downstream: Column, at_least: int = 5) -> DataFrame:
    """branches with enough uncovered lines behind them."""
    return df.groupBy(branch).agg(F.count(F.when(downstream, 1)).alias("downstream")).where(F.col("downstream") >= at_least)


def first_solved(streaks: DataFrame, seen: DataFrame, sources: DataFrame, worth: DataFrame, solutions: DataFrame, branch: str, threshold: int = 10) -> DataFrame:
    """O-K7: of the blocked branches, in the order they were first seen (branch, first), the first one with a source, worth
    targeting and with a solution that is not empty: branch, source, solution."""
    told = solutions.where(F.coalesce("solution", F.lit("")) != "")
    t = blocked(streaks, threshold).join(seen, branch).join(sources.where("source IS NOT NULL"), branch).join(worth.select(branch), branch, "left_semi").join(told, branch)
    return t.orderBy("first", branch).limit(1).select(branch, "source", "solution")


def prompt_score(df: DataFrame, prompt: str, code: Column, good: Column) -> DataFrame:
    """distinct cleaned programs of each prompt that are good; they are told apart by digest."""
    return df.groupBy(prompt).agg(F.countDistinct(F.when(good, F.sha2(code, 256))).alias("score"))


def periodic(df: DataFrame, order: str, interval: int) -> DataFrame:
    """every interval-th iteration but the first of all; an interval of 0 never comes."""
    return df.where((F.col(order) % interval == 0) & (F.col(order) != 0)) if interval else df.limit(0)


def record_results(results: DataFrame, population: DataFrame | None, islands: int, most: int = 50, fraction: float = 0.10) -> DataFrame:
    """W8 for the results (seq, ok, code) between two migrations: migration if there is a population yet, then what is ok
    joins the island of its iteration with fitness 1.0, each island keeping its fittest. Rows of a population are
    island, fitness, seq, code, rank; what has migrated comes after what was there by seq. The gate and the seed
    store take the same results by rolling_gate() and upsert()."""
    from corvane.operators.ranking import bounded_population

    cols = ["island", "fitness", "seq", "code"]
    now = results.where("ok").select((F.col("seq") % islands).alias("island"), F.lit(1.0).alias("fitness"), "seq", "code")
    if population is not None:
        now = now.unionByName(population.select(cols))
        if islands > 1:
            now = now.unionByName(migrate(population.select(cols), "island", "fitness", "seq", islands, fraction).select(cols))
    return bounded_population(now, "island", "fitness", "seq", most)


def promotions(df: DataFrame, batch: str, order: str, keep: Column, code: str) -> DataFrame:
    """F8: the last kept row of each batch."""
    return df.groupBy(batch).agg(F.max_by(F.when(keep, F.col(code)), F.when(keep, F.col(order))).alias("promoted"))


def uncovered_run(df: DataFrame, file: str, line: str, uncovered: Column, after: Column) -> DataFrame:
    """Length of the first run of uncovered lines after the branch's line, 0 without one."""
    w = W.partitionBy(file).orderBy(line).rowsBetween(W.unboundedPreceding, 0)
    late = df.where(F.col(line) > after)
    g = late.withColumn("_g", F.sum(F.when(uncovered, 0).otherwise(1)).over(w)).where(uncovered)
    n = g.groupBy(file, "_g").agg(F.count("*").alias("n")).groupBy(file).agg(F.min_by("n", "_g").alias("n"))
    return df.select(file).distinct().join(n, file, "left").select(file, F.coalesce("n", F.lit(0)).cast("long").alias("downstream"))


def migrate(df: DataFrame, island: str, fitness: str, order: str, islands: int, fraction: float = 0.10, landed: float = 0.5) -> DataFrame:
    """The top fraction of each island, as it lands on the next one in the ring."""
    from corvane.operators.ranking import top_fraction

    top = top_fraction(df, island, fitness, order, fraction)
    return top.withColumn(island, (F.col(island) + 1) % islands).withColumn(fitness, F.lit(landed)).drop("rank")

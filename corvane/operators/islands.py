"""W5, W7, W8, O-K3: islands of programs, fed by results in order, with migration between them.

A result that is good joins the island of its iteration with fitness 1.0; before every `interval`-th iteration's result
each island in turn copies its fittest part to another one, with fitness 0.5, so that later islands send on what earlier
ones have sent. An island keeps its `most` fittest, earlier ones first among equals. Good results all have the highest
fitness, so beyond the first `most` of an island none can change it: a run is a fold over at most `most` results an
island, in one group, whatever its length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POPULATION = "run long, island long, rank long, fitness double, seq long, code string"
State = list[list[tuple[float, int, str]]]


def destination(run: int, iteration: int, source: int, islands: int) -> int:
    """Another island than the source, by hash: gate_number() of the same key."""
    n = int(hashlib.md5(f"island:{run}:{iteration}:{source}".encode()).hexdigest()[:8], 16) % (islands - 1)
    return n + (n >= source)


def join_island(island: list[tuple[float, int, str]], fitness: float, seq: int, code: str, most: int) -> None:
    island.insert(bisect_right(island, -fitness, key=lambda x: -x[0]), (fitness, seq, code))
    del island[most:]


def migrate_once(run: int, iteration: int, state: State, fraction: float, landed: float, most: int) -> None:
    for source, own in enumerate(state):
        if own:
            to = state[destination(run, iteration, source, len(state))]
            for _, seq, code in own[: max(1, int(len(own) * fraction))]:
                join_island(to, landed, seq, code, most)


def fold(run: int, state: State, good: list[tuple[int, str]], start: int, stop: int, interval: int, fraction: float = 0.10, landed: float = 0.5, most: int = 50) -> State:
    """The islands after the iterations from start to stop, of which `good` (seq, code) in order are good."""
    at = max(interval, -(-start // interval) * interval) if interval else stop + 1
    for seq, code in [*good, (stop + 1, None)]:
        while at <= min(seq, stop):
            if len(state) < 2 or all(len(x) >= most for x in state):  # nobody can land: on to the next good result
                at = (min(seq, stop) // interval + 1) * interval
                break
            migrate_once(run, at, state, fraction, landed, most)
            at += interval
        if code is not None:
            join_island(state[seq % len(state)], 1.0, seq, code, most)
    return state


def evolved(results: DataFrame, islands: int, interval: int = 50, fraction: float = 0.10, most: int = 50, population: DataFrame | None = None) -> DataFrame:
    """The islands (run, island, rank, fitness, seq, code) of each run after its results (run, seq, ok, code), on top
    of a population if there is one. Iterations of a run are whole numbers without gaps; results without a code are not
    good. Runs of the population without new results stay as they are."""
    good = results.where("ok AND code IS NOT NULL").select("run", "seq", "code", (F.col("seq") % islands).alias("island"))
    first = good.withColumn("_rn", F.row_number().over(W.partitionBy("run", "island").orderBy("seq"))).where(F.col("_rn") <= most).select("run", "seq", "code")
    bounds = results.groupBy("run").agg(F.min("seq").alias("start"), F.max("seq").alias("stop"))
    none = [F.lit(None).cast(k).alias(c) for c, k in (("island", "long"), ("rank", "long"), ("fitness", "double"), ("seq", "long"), ("code", "string"))]
    known = bounds.select("run", "start", "stop", *none)
    if population is not None:
        known = known.unionByName(population.select("run", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), "island", "rank", "fitness", "seq", "code"))

    def run(key: tuple, good: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        state: State = [[] for _ in range(islands)]
        held = known[known["island"].notna()].sort_values("rank")
        for i, f, s, c in zip(held["island"], held["fitness"], held["seq"], held["code"]):
            state[int(i)].append((float(f), int(s), c))
        reach = known[known["stop"].notna()]
        if len(reach):
            good = good.sort_values("seq")
            state = fold(key[0], state, list(zip(good["seq"].tolist(), good["code"])), int(reach["start"].iloc[0]), int(reach["stop"].iloc[0]), interval, fraction, most=most)
        rows = [(key[0], i, r, f, s, c) for i, island in enumerate(state) for r, (f, s, c) in enumerate(island, 1)]
        return pd.DataFrame(rows, columns=["run", "island", "rank", "fitness", "seq", "code"])

    return first.groupBy("run").cogroup(known.groupBy("run")).applyInPandas(run, POPULATION)

"""Islands against a plain list that is sorted after every result."""

import random

import pytest

from corvane.operators import islands as I


def plain(run, results, islands, interval, most):
    state = [[] for _ in range(islands)]

    def add(i, fitness, seq, code):
        state[i].append((fitness, seq, code))
        state[i].sort(key=lambda x: x[0], reverse=True)
        del state[i][most:]

    for seq, ok, code in sorted(results):
        if interval and seq and seq % interval == 0 and islands > 1:
            for source in range(islands):
                if state[source]:
                    to = I.destination(run, seq, source, islands)
                    for _, s, c in list(state[source][: max(1, int(len(state[source]) * 0.10))]):
                        add(to, 0.5, s, c)
        if ok and code is not None:
            add(seq % islands, 1.0, seq, code)
    return [(run, i, r, f, s, c) for i, x in enumerate(state) for r, (f, s, c) in enumerate(x, 1)]


def runs(seed, longest):
    r = random.Random(seed)
    return {run: [(i, r.random() < r.choice([0.02, 0.4]), None if r.random() < 0.05 else f"{run}-{i}") for i in range(r.randint(1, longest))] for run in range(5)}


def rows(df):
    return sorted(map(tuple, df.select("run", "island", "rank", "fitness", "seq", "code").collect()))


@pytest.mark.parametrize("islands,interval,most", [(3, 7, 4), (8, 50, 50), (1, 5, 6), (2, 1, 3), (4, 0, 5)])
def test_fold(spark, islands, interval, most):
    data = runs(islands, 900)
    df = spark.createDataFrame([(run, *x) for run, xs in data.items() for x in xs], "run long, seq long, ok boolean, code string").repartition(5)
    want = sorted(r for run, xs in data.items() for r in plain(run, xs, islands, interval, most))
    assert rows(I.evolved(df, islands, interval, most=most)) == want


def test_in_parts(spark):
    """A run in three parts, each on top of the islands of those before, ends as the whole does; other runs stay."""
    data = runs(9, 400)
    schema = "run long, seq long, ok boolean, code string"
    population = None
    for part in range(3):
        df = spark.createDataFrame([(run, *x) for run, xs in data.items() for x in xs if x[0] // 100 == part or part == 2 and x[0] >= 200], schema)
        got = I.evolved(df, 4, 10, most=8, population=population)
        population = spark.createDataFrame(got.collect(), I.POPULATION)
    assert rows(population) == sorted(r for run, xs in data.items() for r in plain(run, xs, 4, 10, 8))


def test_no_results(spark):
    none = spark.createDataFrame([], "run long, seq long, ok boolean, code string")
    assert rows(I.evolved(none, 4)) == []


def test_long_run_is_one_plan(spark):
    """However many migrations, each table is read a fixed number of times."""
    df = spark.createDataFrame([(0, i, i % 3 == 0, "x") for i in range(5000)], "run long, seq long, ok boolean, code string")
    text = I.evolved(df, 8, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") + text.count("LocalRelation") <= 2

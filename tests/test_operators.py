import pytest
from pyspark.sql import functions as F

from corvane.operators import dedup, history, mutators, ranking, sampling


def test_gate_waits_for_a_full_window(spark):
    def active(oks):
        d = spark.createDataFrame([(0, i, ok) for i, ok in enumerate(oks)], "run int, seq long, ok boolean")
        return [r["active"] for r in history.rolling_gate(d, "run", "seq", F.col("ok")).orderBy("seq").collect()]

    assert active([False] * 50) == [False] * 49 + [True]
    assert active([True] * 15 + [False] * 35)[-1] is False


def test_gate_by_ranges_equals_one_window(spark):
    d = spark.range(3000).withColumn("ok", F.pmod(F.xxhash64("id"), F.lit(10)) < 3).withColumn("run", F.lit(0))
    a = history.rolling_gate(d, "run", "id", F.col("ok")).select("id", "active")
    b = history.rolling_gate_all(d, "id", F.col("ok"), bucket=100).select("id", "active")
    assert sorted(a.collect()) == sorted(b.collect())


def test_streaks(spark):
    rows = [(1, i, i == 9) for i in range(19)] + [(2, 0, True), (2, 0, False)]
    d = spark.createDataFrame(rows, "branch int, seq int, hit boolean")
    got = {r["branch"]: r["misses"] for r in history.miss_streaks(d, "branch", "seq", F.col("hit")).collect()}
    assert got == {1: 9, 2: 1}


def test_first_report(spark):
    d = spark.createDataFrame([(0, "u", "a"), (1, "u", "b"), (2, "", ""), (3, None, "t")], "pos int, url string, title string")
    assert sorted(r["pos"] for r in dedup.first_reports(d, ["pos"]).collect()) == [0, 3]


def test_diversified_top(spark):
    d = spark.createDataFrame([("A", 9, 0), ("A", 8, 1), ("B", 1, 2)], "c string, s int, o int")
    got = ranking.diversified_top(d, 2, "s", "c", "o").orderBy("position").collect()
    assert [(r["c"], r["s"]) for r in got] == [("A", 9), ("B", 1)]


def test_top_fraction_keeps_one(spark):
    d = spark.range(5).select(F.lit(0).alias("g"), F.col("id").alias("f"), "id")
    assert ranking.top_fraction(d, "g", "f", "id", 0.10).count() == 1


def test_nearest_in_blocks(spark):
    d = spark.range(60).select(F.col("id").alias("vec_id"), F.array((F.col("id") + 1).cast("float"), F.lit(7.0).cast("float")).alias("vec"))
    q = d.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    whole = ranking.nearest(q, d, 3).select("query_id", "vec_id").collect()
    assert sorted(whole) == sorted(ranking.nearest(q, d, 3, block=4).select("query_id", "vec_id").collect())
    slow = d.alias("a").join(q.alias("b")).select("query_id", "a.vec_id", ranking.cosine(F.col("a.vec"), F.col("b.vec")).alias("s"))
    best = slow.withColumn("r", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id)")).where("r = 1")
    assert {(r["query_id"], r["vec_id"]) for r in best.collect()} <= {tuple(r) for r in whole}
    assert ranking.nearest(q.limit(0), d, 3).count() == 0


def test_masks_read_back(spark):
    d = spark.createDataFrame([(1, "int a = b + c - d;"), (2, ""), (3, "int x " * 40)], "doc_id long, code string")
    for r in sampling.mask(d).join(d, "doc_id").collect():
        parts = r["masked"].split(sampling.MASK)
        assert "".join(x + y for x, y in zip(parts, [*r["tokens"], ""])) == r["code"]
    assert sampling.mask(d).where("doc_id = 3").first()["tokens"].__len__() == 6


def test_registry_takes_only_total_mutators(spark):
    r = mutators.builtin()
    assert r.add("empty", lambda c: F.lit(""), spark) and not r.add("null", lambda c: F.lit(None).cast("string"), spark) and not r.add("number", lambda c: F.length(c), spark)
    out = spark.range(100).select(r.apply(F.concat(F.lit("int a"), "id"), F.col("id"), 100).alias("x"))
    assert out.where("x IS NULL OR x = ''").count() == 0


@pytest.mark.parametrize("empty", [True, False])
def test_distilled_pads(spark, empty):
    got = spark.createDataFrame([] if empty else [(0, "a"), (1, "NO_TRANSLATION"), (2, "a"), (3, "")], "pos long, text string")
    more = spark.createDataFrame([(i, f"f{i}") for i in range(9)] + [(9, "a")], "pos long, text string")
    assert dedup.distilled(got, more).count() == 5


def test_mask_candidates_against_brute_force(spark):
    """The pieces of C-like programs by a scan that knows no regular expressions."""
    import random

    rng = random.Random(6)
    words = ["int", "float", "void", "integer", "x", "y1"]
    ops = ["==", "!=", "<=", ">=", "&&", "||", "<<", ">>", "++", "--", "+", "-", "*", "/", "%", "&", "|", "^", "~", "<", ">"]
    data, want = [], set()
    for i in range(60):
        code = ""
        for _ in range(rng.randint(0, 25)):
            if rng.random() < 0.5:
                w = rng.choice(words)
                if w in ("int", "float", "void"):
                    want.add((i, len(code), len(code) + len(w), w))
                code += w
            else:
                w = rng.choice(ops)
                want.add((i, len(code), len(code) + len(w), w))
                code += w
            code += " "
        data.append((i, code))
    got = sampling.mask_candidates(spark.createDataFrame(data, "doc_id long, code string")).drop("code")
    assert {tuple(r) for r in got.collect()} == want
    n = {i: sum(w[0] == i for w in want) for i, _ in data}
    picked = {r["doc_id"]: len(r["tokens"]) for r in sampling.mask(spark.createDataFrame(data, "doc_id long, code string")).collect()}
    assert picked == {i: max(1, int(k * 0.15)) if k else 0 for i, k in n.items()}


def test_global_rank(spark):
    import re

    from corvane.functions.text import natural_key, natural_text

    names = [f"a{i % 50}b{i}" for i in range(300)] + ["", None, "A7", "a07", "7x", "12x"]
    d = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    plain = lambda s: [int(x) if x.isdigit() else x.lower() for x in re.split("([0-9]+)", s)]
    order = sorted(range(len(names)), key=lambda i: (names[i] is not None, plain(names[i] or ""), i))
    got = ranking.global_rank(d, natural_text(F.col("name")), "id", parts=8, sample=4)
    assert [r["id"] for r in got.orderBy("rank").collect()] == order and got.agg(F.max("rank")).first()[0] == len(names)
    assert [r["id"] for r in d.orderBy(natural_key(F.col("name")), "id").collect()] == order
    assert ranking.global_rank(d.limit(0), natural_text(F.col("name")), "id").count() == 0


def test_catalog_of_mutators(spark, tmp_path):
    spark.createDataFrame([("m2", "a", "b"), ("m1", "(", "x"), ("m0", "^.*$", "")], "name string, pattern string, put string").write.parquet(str(tmp_path / "c"))
    r = mutators.Registry.load(spark, str(tmp_path / "c"))
    assert r.names() == ["m0", "m2"]
    r.save(spark, str(tmp_path / "d"))
    assert mutators.Registry.load(spark, str(tmp_path / "d")).rules() == r.rules()


def test_results_of_islands(spark):
    """Against the islands as lists: migration, then what is safe, 50 at most."""
    rows = [(i, i % 3 == 0, f"c{i}") for i in range(400)]
    d = spark.createDataFrame(rows, "seq long, ok boolean, code string")
    population, islands = None, [[], []]
    for k in range(4):
        population = history.record_results(d.where(f"seq div 100 = {k}"), population, 2, most=20)
        moved = [[(0.5, s) for _, s in x[: max(1, int(len(x) * 0.1))]] if x else [] for x in islands]
        now = [[*islands[i], *moved[1 - i], *((1.0, s) for s, ok, _ in rows if s // 100 == k and ok and s % 2 == i)] for i in range(2)]
        islands = [sorted(x, key=lambda y: (-y[0], y[1]))[:20] for x in now]
    got = {i: [(r["fitness"], r["seq"]) for r in population.where(f"island = {i}").orderBy("rank").collect()] for i in range(2)}
    assert got == dict(enumerate(islands))


def test_guarded_functions(spark):
    """A mutator that raises, loops, gives a number or nothing on chosen rows leaves those rows alone, and only those."""
    from corvane.operators import mutators

    def odd(code):
        if code.startswith("raise"):
            raise RuntimeError(code)
        while code.startswith("loop"):
            pass
        return {"int": 5, "none": None, "empty": ""}.get(code, code + "!")

    r = mutators.Registry()
    assert r.add_function("m", odd, seconds=0.3) and r.names() == ["m"]
    assert not r.add_function("bad", lambda c: 1 / 0) and not r.add_function("number", len) and not r.add_function("slow", lambda c: [1 for _ in iter(int, 1)], seconds=0.2)
    codes = ["a", "raise x", "loop", "int", "none", "empty", "b", None]
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code string").coalesce(1)
    got = [x["out"] for x in df.select("id", r.apply(F.col("code"), F.col("id"), 100).alias("out")).orderBy("id").collect()]
    assert got == ["a!", "raise x", "loop", "int", "none", "empty", "b!", None]
    # Rows that no mutator is chosen for do not reach the function.
    assert df.select(r.apply(F.col("code"), F.col("id"), 0).alias("out")).where("out IS NULL").count() == 1


def test_ranks_by_range(spark):
    """Ranks in groups of which one has nearly all rows, over several ranges, ties by order."""
    rows = [("a" if i % 9 else "b", float(i * 7 % 50), i) for i in range(2000)] + [(None, 1.0, 5000), ("c", 2.0, 5001)]
    df = spark.createDataFrame(rows, "g string, f double, i long").repartition(5)
    want = {}
    for g in "abc":
        for r, (_, i) in enumerate(sorted((-f, i) for x, f, i in rows if x == g), 1):
            want[i] = r
    got = ranking.ranked_by_range(df, "g", F.desc("f"), "i")
    assert {r["i"]: r["rank"] for r in got.collect()} == want
    top = {r["i"] for r in ranking.top_fraction(df, "g", "f", "i", 0.1).collect()}
    size = {g: sum(x == g for x, _, _ in rows) for g in "abc"}
    assert top == {i for g, _, i in rows if g and want[i] <= max(1, int(size[g] * 0.1))}

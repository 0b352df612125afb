"""Queries over verdicts, reports, histories, vectors and samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import verdicts as V
from corvane.operators import dedup, history, mutators, ranking, sampling
from corvane.plans.catalog import query, table
from corvane.sources import files

# Verdicts. Events stand in for runs: the type gives the exit code, the value what was said.
RUNS = """(SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'cpp' WHEN 1 THEN 'go' WHEN 2 THEN 'smt2' ELSE 'java' END AS language,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 1 ELSE 4 END AS exit_code,
  CASE WHEN value > 50 THEN 'undefined reference to `main''' ELSE 'error' END AS stderr, user_id % 11 = 0 AS timed_out,
  CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS retry_exit FROM events)"""
VERDICT = """CASE WHEN timed_out AND language = 'cpp' THEN 'ERROR' WHEN timed_out THEN 'TIMED_OUT' WHEN exit_code = 0 THEN 'SAFE' WHEN language = 'smt2' THEN 'FAILURE'
  WHEN exit_code = 1 AND language = 'cpp' AND contains(stderr, 'undefined reference') AND retry_exit = 0 THEN 'SAFE' WHEN exit_code = 1 THEN 'FAILURE' ELSE 'ERROR' END"""


def runs(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        "event_id", "user_id", "value",
        F.when(n % 4 == 0, "cpp").when(n % 4 == 1, "go").when(n % 4 == 2, "smt2").otherwise("java").alias("language"),
        F.when(F.col("event_type").isin("purchase", "signup"), 0).when(F.col("event_type").isin("view", "click"), 1).otherwise(4).alias("exit_code"),
        F.when(F.col("value") > 50, V.NO_MAIN).otherwise("error").alias("stderr"),
        (F.col("user_id") % 11 == 0).alias("timed_out"),
        F.when(n % 2 == 0, 0).otherwise(1).alias("retry_exit"),
    )


def judged(spark, sf_dir):
    v = V.verdict(F.col("language"), F.col("exit_code"), F.col("stderr"), F.col("timed_out"), F.col("retry_exit"))
    return runs(spark, sf_dir).withColumn("verdict", v)


@query("v1_v5_verdicts", f"SELECT event_id, language, {VERDICT} AS verdict FROM {RUNS}")
def verdicts(spark, sf_dir):
    return judged(spark, sf_dir).select("event_id", "language", "verdict")


@query("d2_verdict_codes", f"SELECT verdict, CASE verdict WHEN 'SAFE' THEN 1 WHEN 'FAILURE' THEN 2 WHEN 'ERROR' THEN 3 ELSE 10 END AS code, count(*) AS n FROM (SELECT {VERDICT} AS verdict FROM {RUNS}) GROUP BY 1, 2")
def verdict_codes(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n")).withColumn("code", V.code_of(F.col("verdict")))


CRASH = "CASE WHEN exit_code = 0 THEN 'SAFE' WHEN contains(stderr, '{0}') THEN 'ERROR' ELSE 'FAILURE' END"


@query("v8_crash", f"SELECT event_id, {CRASH.format('undefined')} AS verdict FROM {RUNS}")
def crash(spark, sf_dir):
    return runs(spark, sf_dir).select("event_id", V.crash_verdict(F.col("exit_code"), F.col("stderr"), "undefined").alias("verdict"))


DIFF = "CASE WHEN NOT contains(text, 'er') THEN 'FAILURE' WHEN b IS NULL THEN 'ERROR' WHEN a = b THEN 'SAFE' ELSE 'ERROR' END"


@query("v9_differential", f"SELECT d.doc_id, {DIFF} AS verdict FROM (SELECT doc_id, text, n_chars % 3 AS a FROM documents) d LEFT JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS b FROM labels) l ON d.doc_id = l.doc_id")
def differential(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("n_chars") % 3).alias("a"))
    b = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("b"))
    return d.join(b, "doc_id", "left").select("doc_id", V.differential_verdict(F.col("text"), F.col("a"), F.col("b"), "er").alias("verdict"))


@query("v7_v10_by_oracle", f"SELECT event_id, CASE user_id % 3 WHEN 1 THEN 'DIFF' WHEN 2 THEN {CRASH.format('error')} ELSE {CRASH.format('undefined')} END AS verdict FROM {RUNS}")
def by_oracle(spark, sf_dir):
    r = runs(spark, sf_dir)
    oracle = F.when(F.col("user_id") % 3 == 1, "diff").when(F.col("user_id") % 3 == 2, "metamorphic").otherwise("crash")
    x = lambda m: V.crash_verdict(F.col("exit_code"), F.col("stderr"), m)
    return r.select("event_id", V.by_oracle(oracle, x("undefined"), F.lit("DIFF"), x("error")).alias("verdict"))


@query(
    "k5_log_routing",
    f"""SELECT event_id, v = 'ERROR' AS main_log, CASE WHEN v = 'ERROR' THEN 'f has potential error!' END AS main_message, CASE v WHEN 'SAFE' THEN 'f is safe' WHEN 'FAILURE' THEN 'f failed validation with error message: ' || stderr
    WHEN 'ERROR' THEN 'f has potential error!' || chr(10) || 'error message:' || chr(10) || stderr ELSE 'f timed out' END AS message FROM (SELECT *, {VERDICT} AS v FROM {RUNS})""",
)
def log_routing(spark, sf_dir):
    return judged(spark, sf_dir).select("event_id", V.main_log(F.col("verdict")).alias("main_log"), F.when(V.main_log(F.col("verdict")), V.main_log_message(F.lit("f"))).alias("main_message"), V.log_message(F.lit("f"), F.col("verdict"), F.col("stderr")).alias("message"))


@query("evaluate_corpus", f"SELECT language, verdict, count(*) AS n FROM (SELECT language, {VERDICT} AS verdict FROM {RUNS}) GROUP BY language, verdict")
def evaluate(spark, sf_dir):
    """The offline evaluation as a whole: scan, classify, count."""
    return judged(spark, sf_dir).groupBy("language", "verdict").agg(F.count("*").alias("n"))


# Dedup.
@query("od1_upsert_last_wins", "SELECT md5(text) AS id, max(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def od1(spark, sf_dir):
    return dedup.upsert(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("id", "doc_id")


REPORTS = "(SELECT event_id AS pos, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'u' || (user_id % 40) END AS url, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS title FROM events)"


@query("od2_first_report", f"SELECT min(pos) AS pos, coalesce(nullif(url, ''), nullif(title, '')) AS key FROM {REPORTS} WHERE coalesce(nullif(url, ''), nullif(title, '')) IS NOT NULL GROUP BY 2")
def od2(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("u"), F.col("user_id") % 40)).alias("url"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("title"))
    return dedup.first_reports(r, ["pos"]).select("pos", F.coalesce(F.nullif("url", F.lit("")), F.nullif("title", F.lit(""))).alias("key"))


@query(
    "od3_distilled_padded",
    """WITH g AS (SELECT min(s_suppkey) AS pos, text FROM (SELECT s_suppkey, 'c' || (s_suppkey % 3) AS text FROM supplier WHERE s_suppkey % 4 <> 0) GROUP BY text),
    f AS (SELECT min(n_nationkey) AS pos, n_name AS text FROM nation GROUP BY n_name),
    r AS (SELECT pos, text, row_number() OVER (ORDER BY pos) AS r FROM f WHERE text NOT IN (SELECT text FROM g))
    SELECT pos, text, 0 AS source FROM g UNION ALL SELECT pos, text, 1 FROM r WHERE r.r <= 5 - (SELECT count(*) FROM g)""",
)
def od3(spark, sf_dir):
    k = F.col("s_suppkey")
    got = table(spark, sf_dir, "supplier").select(k.alias("pos"), F.when(k % 4 == 0, F.lit("no_translation: x")).otherwise(F.concat(F.lit("c"), k % 3)).alias("text"))
    more = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("text"))
    return dedup.distilled(got, more)


@query("od4_ordered_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def od4(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return t.select("conv_id", F.array_join(dedup.ordered_distinct(F.transform("t", lambda x: F.array(x["role"]))), ",").alias("roles"))


@query("od6_distinct_texts", "SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY source")
def od6(spark, sf_dir):
    """The distinct texts are combined by their digest, so no text is shuffled."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.countDistinct(F.sha2("text", 256)).alias("n"))


# Ranking.
@query("ok1_diversified_top", "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN rn = 1 THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS position FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) QUALIFY position <= 40")
def ok1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return ranking.diversified_top(d, 40, "n_chars", "source", "doc_id").select("doc_id", F.col("position").cast("long").alias("position"))


@query("ok2_over_fetch", "SELECT doc_id FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) ORDER BY CASE WHEN rn = 1 THEN 0 ELSE 1 END, n_chars DESC, doc_id LIMIT 40")
def ok2(spark, sf_dir):
    return ranking.over_fetched(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), 10, "n_chars", "lang", "doc_id").select("doc_id")


@query("ok3_bounded_population", "SELECT event_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 50")
def ok3(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("island"), "value")
    return ranking.bounded_population(e, "island", "value", "event_id").select("event_id", F.col("rank").cast("long").alias("rank"))


TOP = "SELECT event_id, user_id % 8 AS island FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 8 ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id % 8) AS n FROM events) WHERE r <= greatest(1, floor(n * 0.1))"


@query("ok4_top_fraction", TOP)
def ok4(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("island"), "value")
    return ranking.top_fraction(e, "island", "value", "event_id", 0.1).select("event_id", "island")


@query("ok5_best_individual", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS best FROM events GROUP BY user_id")
def ok5(spark, sf_dir):
    return ranking.best(table(spark, sf_dir, "events"), "user_id", "value", "event_id", "event_id")


NEAREST = """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)
    SELECT query_id, vec_id, round(s, 6) AS score FROM (SELECT query_id, vec_id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS s FROM q, embeddings)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 3"""


@query("ok6_cosine_top", NEAREST)
def ok6(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    return ranking.nearest(q, e, 3).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("ok6_indexed_top", NEAREST)
def ok6_indexed(spark, sf_dir):
    """The same from an index of all vectors; queries meet its blocks in joins."""
    from corvane.operators.vector_index import VectorIndex
    from corvane.sources.store import scratch

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    found = VectorIndex.build(e, scratch(spark, "vectors")).search(q, 3)
    return found.rows.select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("ok9_highest_version", "SELECT p_brand, max(p_size) AS newest FROM part GROUP BY p_brand")
def ok9(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").alias("newest"))


# Aggregates.
@query("a1_a2_success_rates", "SELECT user_id, round(coalesce(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) FILTER (WHERE value > 90), 1.0), 9) AS optimist, round(coalesce(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) FILTER (WHERE value > 90), 0.0), 9) AS pessimist FROM events GROUP BY user_id")
def a1(spark, sf_dir):
    ok = F.when(F.col("value") > 90, F.col("event_type") == "click")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(history.success_rate(ok, 1.0), 9).alias("optimist"), F.round(history.success_rate(ok, 0.0), 9).alias("pessimist"))


@query("a3_store_count", "SELECT count(*) AS n FROM embeddings")
def a3(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))


@query("a4_covered_sets", "SELECT l_suppkey, count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag = 'R') AS covered, count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS uncovered FROM lineitem GROUP BY l_suppkey")
def a4(spark, sf_dir):
    hit = F.col("l_returnflag") == "R"
    t = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.when(hit, F.col("l_linenumber"))).alias("c"), F.collect_set(F.when(~hit, F.col("l_linenumber"))).alias("u"))
    return t.select("l_suppkey", F.size("c").cast("long").alias("covered"), F.size("u").cast("long").alias("uncovered"))


@query("a5_a6_batched_prompts", "SELECT conv_id, turn // 5 AS batch, md5(string_agg((turn % 5 + 1) || '. ' || left(text, 400), chr(10) ORDER BY turn)) AS prompt FROM conversations GROUP BY conv_id, turn // 5")
def a5(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.expr("turn div 5").alias("batch"), "turn", F.left("text", F.lit(400)).alias("text"))
    g = c.groupBy("conv_id", "batch").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat((x["turn"] % 5 + 1).cast("string"), F.lit(". "), x["text"])), "\n")
    return g.select("conv_id", "batch", F.md5(said).alias("prompt"))


@query(
    "a7_uncovered_run",
    """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) <> 'N' AS u FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey, l_linenumber),
    g AS (SELECT *, sum(CASE WHEN u THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM l),
    n AS (SELECT l_orderkey, g, count(*) AS n FROM g WHERE u GROUP BY l_orderkey, g),
    f AS (SELECT l_orderkey, arg_min(n, g) AS n FROM n GROUP BY l_orderkey)
    SELECT o.l_orderkey, coalesce(n, 0) AS downstream FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN f ON o.l_orderkey = f.l_orderkey""",
)
def a7(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    return history.uncovered_run(t, "l_orderkey", "l_linenumber", F.col("l_returnflag") != "N", F.lit(1))


@query("f10_worth_targeting", "SELECT l_suppkey, count(*) AS downstream FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey HAVING count(*) >= 5")
def f10(spark, sf_dir):
    return history.worth_targeting(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R")


GATE_SQL = "('0x' || left(md5('{0}:' || {1}), 8))::BIGINT"

# Windows and state.
EVENTS = "(SELECT event_id, user_id, user_id % 20 AS branch, event_type = 'click' AS hit, event_type FROM events)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 20).alias("branch"), (F.col("event_type") == "click").alias("hit"), "event_type", "value")


@query("w1_gate_one_run", "SELECT event_id, count(*) OVER w = 50 AND avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) OVER w < 0.30 AS active FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def w1(spark, sf_dir):
    return history.rolling_gate_all(events(spark, sf_dir), "event_id", F.col("hit"), bucket=1000).select("event_id", "active")


STREAK = f"""(SELECT b.branch, coalesce(m.misses, 0) AS misses FROM (SELECT DISTINCT branch FROM {EVENTS}) b LEFT JOIN
  (SELECT e.branch, count(*) AS misses FROM {EVENTS} e LEFT JOIN (SELECT branch, max(event_id) AS last FROM {EVENTS} WHERE hit GROUP BY branch) h ON e.branch = h.branch
   WHERE NOT e.hit AND (h.last IS NULL OR e.event_id >= h.last) GROUP BY e.branch) m ON b.branch = m.branch)"""


@query("w2_miss_streaks", f"SELECT branch, misses FROM {STREAK}")
def w2(spark, sf_dir):
    return history.miss_streaks(events(spark, sf_dir), "branch", "event_id", F.col("hit"))


@query("f11_blocked", f"SELECT branch, misses FROM {STREAK} WHERE misses >= 2")
def f11(spark, sf_dir):
    return history.blocked(history.miss_streaks(events(spark, sf_dir), "branch", "event_id", F.col("hit")), 2)


@query("w4_cleared", f"SELECT branch, CASE WHEN branch % 4 = 0 THEN 0 ELSE misses END AS misses FROM {STREAK}")
def w4(spark, sf_dir):
    e = events(spark, sf_dir)
    return history.cleared(history.miss_streaks(e, "branch", "event_id", F.col("hit")), "branch", e.where("branch % 4 = 0"))


TARGETS = f"""SELECT s.branch, w.source, n.n_name AS solution FROM {STREAK} s
    JOIN (SELECT branch, min(event_id) AS first FROM {EVENTS} GROUP BY branch) f USING (branch)
    JOIN (SELECT branch, CASE WHEN branch % 3 <> 0 THEN arg_max(event_type, event_id) END AS source FROM {EVENTS} GROUP BY branch) w USING (branch)
    JOIN (SELECT branch FROM {EVENTS} WHERE NOT hit GROUP BY branch HAVING count(*) >= 5) d USING (branch)
    JOIN nation n ON n.n_nationkey = s.branch
    WHERE s.misses >= 2 AND w.source IS NOT NULL AND n.n_nationkey % 5 <> 0 ORDER BY first, branch LIMIT 1"""


@query("ok7_first_solved", TARGETS)
def ok7(spark, sf_dir):
    """F11, W3, F10 and a solution, the first in the order in which branches were seen."""
    e = events(spark, sf_dir)
    seen = e.groupBy("branch").agg(F.min("event_id").alias("first"))
    sources = history.last_writer(e, "branch", "event_id", "event_type").withColumn("source", F.when(F.col("branch") % 3 != 0, F.col("source")))
    worth = history.worth_targeting(e, "branch", ~F.col("hit"))
    solutions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("branch"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("solution"))
    return history.first_solved(history.miss_streaks(e, "branch", "event_id", F.col("hit")), seen, sources, worth, solutions, "branch", threshold=2)


@query("w3_last_writer", "SELECT user_id % 20 AS branch, arg_max(event_type, event_id) AS source FROM events GROUP BY 1")
def w3(spark, sf_dir):
    return history.last_writer(events(spark, sf_dir), "branch", "event_id", "event_type")


@query("w5_w6_routing", "SELECT event_id, event_id % 3 AS island, ['loop', 'type'][CAST(event_id % 3 % 2 AS INTEGER) + 1] AS bias FROM events")
def w5(spark, sf_dir):
    i = F.pmod("event_id", F.lit(3))
    return table(spark, sf_dir, "events").select("event_id", i.alias("island"), F.element_at(F.array(F.lit("loop"), F.lit("type")), (F.pmod(i, F.lit(2)) + 1).cast("int")).alias("bias"))


@query("w7_ring_migration", f"SELECT event_id, (island + 1) % 8 AS island, CAST(0.5 AS DOUBLE) AS fitness FROM ({TOP})")
def w7(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("island"), F.col("value").alias("fitness"))
    return history.migrate(e, "island", "fitness", "event_id", 8).select("event_id", "island", "fitness")


ISLANDS = """
WITH RECURSIVE r AS (SELECT event_id % 4 AS run, event_id // 4 AS seq, event_type = 'click' AND value > 80 AS ok FROM events),
a AS (SELECT run, seq % 8 AS island, seq FROM r WHERE ok QUALIFY row_number() OVER (PARTITION BY run, seq % 8 ORDER BY seq) <= 50),
l AS (SELECT run, max(seq) AS stop FROM r GROUP BY run),
f AS (
  SELECT 8 AS t, run, -1::BIGINT AS island, 0.0::DOUBLE AS fitness, 0::BIGINT AS ord, 0::BIGINT AS seq FROM l
  UNION ALL
  (WITH now AS (SELECT * FROM f),
   fed AS (
     SELECT t, run, island, fitness, ord, seq FROM now
     UNION ALL SELECT s.t, a.run, a.island, 1.0, a.seq * 1000, a.seq FROM a JOIN (SELECT DISTINCT t, run FROM now) s ON a.run = s.run AND s.t % 8 = 0 AND a.seq // 50 = s.t // 8 - 1),
   cut AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY run, island) AS n FROM fed WINDOW w AS (PARTITION BY run, island ORDER BY fitness DESC, ord) QUALIFY rank <= 50),
   sent AS (
     SELECT t, c.run, CASE WHEN j >= t % 8 THEN j + 1 ELSE j END AS island, 0.5 AS fitness, (t // 8) * 50000 - 500 + (t % 8) * 10 + rank AS ord, seq
     FROM (SELECT *, ('0x' || left(md5('island:' || run || ':' || ((t // 8) * 50) || ':' || (t % 8)), 8))::BIGINT % 7 AS j FROM cut) c JOIN l USING (run)
     WHERE island = t % 8 AND rank <= greatest(1, floor(least(n, 50) * 0.1)) AND (t // 8) * 50 <= stop)
   SELECT t + 1, run, island, fitness, ord, seq FROM (SELECT t, run, island, fitness, ord, seq FROM cut UNION ALL SELECT * FROM sent)
   WHERE t // 8 <= (SELECT max(stop) // 50 FROM l)
   QUALIFY row_number() OVER (PARTITION BY run, island ORDER BY fitness DESC, ord) <= 50)),
z AS (SELECT run, island, fitness, ord, seq FROM f WHERE t = (SELECT max(t) FROM f)
      UNION ALL SELECT run, island, 1.0, seq * 1000, seq FROM a WHERE seq // 50 = (SELECT max(stop) // 50 FROM l))
SELECT run, island, row_number() OVER (PARTITION BY run, island ORDER BY fitness DESC, ord) AS rank, fitness, seq FROM z WHERE island >= 0 QUALIFY rank <= 50
"""


@query("w7_island_fold", ISLANDS)
def w7_fold(spark, sf_dir):
    """Four runs with a migration before every fiftieth result, later islands seeing what earlier ones sent."""
    from corvane.operators.islands import evolved

    n = F.col("event_id")
    r = table(spark, sf_dir, "events").select((n % 4).alias("run"), F.floor(n / 4).alias("seq"), ((F.col("event_type") == "click") & (F.col("value") > 80)).alias("ok"), F.md5(n.cast("string")).alias("code"))
    return evolved(r, 8).select("run", "island", "rank", "fitness", "seq")


EPOCHS = 4


def _w8_sql() -> str:
    """The islands after four runs of results with a migration between them."""
    best = "SELECT *, row_number() OVER (PARTITION BY island ORDER BY fitness DESC, seq) AS rank FROM ({0}) QUALIFY rank <= 50"
    safe = "SELECT event_id % 8 AS island, CAST(1.0 AS DOUBLE) AS fitness, event_id AS seq FROM events WHERE event_type = 'click' AND value > 80 AND event_id * 4 // (SELECT max(event_id) + 1 FROM events) = {0}"
    parts = [f"p0 AS ({best.format(safe.format(0))})"]
    for k in range(1, EPOCHS):
        n = f"SELECT *, count(*) OVER (PARTITION BY island) AS n FROM p{k - 1}"
        moved = f"SELECT (island + 1) % 8 AS island, CAST(0.5 AS DOUBLE) AS fitness, seq FROM ({n}) WHERE rank <= greatest(1, floor(n * 0.1))"
        parts.append(f"p{k} AS ({best.format(f'{safe.format(k)} UNION ALL SELECT island, fitness, seq FROM p{k - 1} UNION ALL {moved}')})")
    return f"WITH {', '.join(parts)} SELECT island, rank, seq, fitness FROM p{EPOCHS - 1}"


@query("w8_record_result", _w8_sql())
def w8(spark, sf_dir):
    """Results by islands: what is safe joins, migration comes between the runs, each island keeps its 50."""
    from corvane.sources.store import kept

    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("event_id")).first()[0]
    r = e.select(F.col("event_id").alias("seq"), ((F.col("event_type") == "click") & (F.col("value") > 80)).alias("ok"), F.md5(F.col("event_id").cast("string")).alias("code"), F.floor(F.col("event_id") * EPOCHS / F.lit(last + 1)).alias("epoch"))
    population = None
    for k in range(EPOCHS):  # a step's islands are at most 400 rows; written, they keep each plan as small as the first
        population = kept(history.record_results(r.where(F.col("epoch") == k), population, 8), "population")
    return population.select("island", F.col("rank").cast("long").alias("rank"), "seq", "fitness")


@query("w8_gate_and_seeds", f"""SELECT g.active, g.n, s.n AS seeds FROM (
      SELECT active, count(*) AS n FROM (SELECT count(*) OVER w = 50 AND avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) OVER w < 0.30 AS active FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) GROUP BY active) g,
    (SELECT count(DISTINCT props) AS n FROM events WHERE event_type = 'click') s""")
def w8_rest(spark, sf_dir):
    """The gate and the seed store over the same results."""
    e = table(spark, sf_dir, "events")
    gate = history.rolling_gate_all(e, "event_id", F.col("event_type") == "click").groupBy("active").agg(F.count("*").alias("n"))
    seeds = dedup.upsert(e.where("event_type = 'click'").select(F.col("props").alias("code"), F.col("event_id").alias("seq")), "code", ["seq"]).agg(F.count("*").alias("seeds"))
    return gate.crossJoin(F.broadcast(seeds))  # one row


def in_parts(spark, df, order: str, each, n: int = 3) -> None:
    """df written in n parts by order, one after another; after each one `each` is called with the folder's stream."""
    from corvane.sources.store import scratch

    path, last = scratch(spark, "arriving"), df.agg(F.max(order)).first()[0]
    for k in range(n):
        df.where(F.floor(F.col(order) * n / F.lit((last or 0) + 1)) == k).write.mode("append").parquet(path)
        each(spark.readStream.schema(df.schema).parquet(path))


def streamed(spark, df, order: str, make):
    """What a stream gives that is stopped after each of three parts and goes on from its checkpoint."""
    from corvane.sources.store import scratch
    from corvane.streaming.twins import run_available

    out, checkpoint = scratch(spark, "streamed"), scratch(spark, "stream-state")
    in_parts(spark, df, order, lambda s: run_available(make(s), out, checkpoint))
    return spark.read.parquet(out)


@query("w1_stateful_gate", "SELECT user_id AS run, event_id AS seq, count(*) OVER w = 50 AND avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) OVER w < 0.30 AS active FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def w1_stateful(spark, sf_dir):
    """The gate as a stream with its last results in a list state, over three parts of the events."""
    from corvane.streaming import stateful

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("ok"))
    return streamed(spark, e, "seq", stateful.gate)


@query("w9_stateful_carry", "SELECT user_id AS run, event_id AS seq, last_value(CASE WHEN event_type = 'click' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events")
def w9_stateful(spark, sf_dir):
    """The last kept code as a stream with a value state."""
    from corvane.streaming import stateful

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("keep"), F.col("props").alias("code"))
    return streamed(spark, e, "seq", stateful.carry)


@query("w8_feedback_stream", ISLANDS)
def w8_feedback(spark, sf_dir):
    """Gate, islands, seeds and logs by micro-batch, over three parts of the events: the islands in the end."""
    from corvane.sources.store import SeedStore, scratch
    from corvane.streaming.feedback import Feedback

    n = F.col("event_id")
    verdict = F.when((F.col("event_type") == "click") & (F.col("value") > 80), "SAFE").otherwise("FAILURE")
    e = table(spark, sf_dir, "events").select((n % 4).alias("run"), F.floor(n / 4).alias("seq"), verdict.alias("verdict"), F.md5(n.cast("string")).alias("code"), F.lit("cpp").alias("language"), F.concat(n, F.lit(".fuzz")).alias("file"), F.lit("error").alias("message"), F.array(F.col("value").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    kept_by = Feedback(spark, scratch(spark, "feedback"), SeedStore(spark, scratch(spark, "store"), buckets=8))
    checkpoint = scratch(spark, "stream-state")
    in_parts(spark, e, "seq", lambda s: s.writeStream.foreachBatch(kept_by).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return kept_by.table("islands").select("run", "island", "rank", "fitness", "seq")


@query("s13_seed_store", "SELECT language, count(*) AS n, sum(seq) AS seqs FROM (SELECT arg_max(lang, doc_id) AS language, max(doc_id) AS seq FROM documents GROUP BY md5(text)) GROUP BY language")
def s13(spark, sf_dir):
    """A store created with every other text and opened again to take them all."""
    from corvane.sources.store import SeedStore, scratch

    d = table(spark, sf_dir, "documents")
    new = d.select(F.col("text").alias("code"), F.array(F.col("n_chars").cast("float")).alias("vec"), F.create_map(F.lit("source"), F.col("source")).alias("meta"), F.col("doc_id").alias("seq"), F.col("lang").alias("language"))
    path = scratch(spark, "store")
    SeedStore(spark, path).add(new.where("seq % 2 = 0"))
    store = SeedStore(spark, path)
    store.add(new)
    return store.seeds().groupBy("language").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("k8_saved_mutators", rf"""SELECT doc_id, md5(CASE {GATE_SQL.format('mutator', 'doc_id')} % 4 WHEN 0 THEN regexp_replace(text, '\bint\b', 'long', 'g') WHEN 1 THEN replace(text, '==', '!=') WHEN 2 THEN regexp_replace(text, '\bfor\b', 'while', 'g') ELSE text || chr(10) END) AS out FROM documents""")
def k8(spark, sf_dir):
    """The catalog saved as a table and read again, one of its mutators for every text."""
    from corvane.sources.store import scratch

    path = scratch(spark, "mutators")
    mutators.builtin().save(spark, path)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(mutators.Registry.load(spark, path).apply(F.col("text"), F.col("doc_id"), 100)).alias("out"))


@query("w9_previous_example", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events")
def w9(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return history.carried_all(e, "event_id", F.col("event_type") == "click", "event_id", "user_id", bucket=1000).select("event_id", "previous")


@query("w10_loop_bounds", "SELECT count(*) AS n FROM events WHERE event_id < 1000")
def w10(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id < 1000").agg(F.count("*").alias("n"))


@query("w11_rotation_changes", "SELECT event_id FROM (SELECT event_id, (event_id // 50) % 7 AS s, lag((event_id // 50) % 7) OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS p FROM events) WHERE p IS NOT NULL AND s <> p")
def w11(spark, sf_dir):
    from corvane.functions.text import spec_index

    e = table(spark, sf_dir, "events").select("event_id", spec_index(F.col("event_id"), 7).alias("s"))
    p = F.lag("s").over(W.partitionBy(F.floor(F.col("event_id") / 1000)).orderBy("event_id"))
    return e.withColumn("p", p).where("p IS NOT NULL AND s <> p").select("event_id")


@query("f8_promotion", "SELECT conv_id, turn // 5 AS batch, arg_max(md5(text), turn) FILTER (WHERE role = 'assistant') AS promoted FROM conversations GROUP BY 1, 2")
def f8(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.expr("turn div 5").alias("batch"), "turn", F.md5("text").alias("code"), "role")
    keyed = c.withColumn("key", F.struct("conv_id", "batch"))
    return history.promotions(keyed, "key", "turn", F.col("role") == "assistant", "code").select("key.conv_id", "key.batch", "promoted")


# Sampling.
GATE = GATE_SQL


@query("f14_r5_bernoulli", f"SELECT event_id FROM events WHERE {GATE.format('gate', 'event_id')} % 100 < 20")
def f14(spark, sf_dir):
    return table(spark, sf_dir, "events").where(sampling.bernoulli(F.col("event_id"), 20)).select("event_id")


@query("r3_r6_choice", f"SELECT event_id, {GATE.format('choice', 'event_id')} % 4 AS pick FROM events")
def r3(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sampling.choice(F.col("event_id"), 4).alias("pick"))


@query(
    "r1_k_of_n",
    f"""SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY {GATE.format('mask', "(conv_id || ':' || turn)")}, turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    WHERE r <= greatest(1, floor(n * 0.15))""",
)
def r1(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return sampling.k_of_n(c, "conv_id", "turn", 0.15).where("picked").select("conv_id", "turn")


# Operators lie in runs of their characters; a run is gone through place by place, as matches take one or two of them.
CANDIDATES = r"""
WITH RECURSIVE p AS (SELECT page_id AS doc_id, html AS code FROM pages),
g AS (SELECT doc_id, regexp_extract_all(code, '[=!<>&|+\-*/%^~]+') AS m, string_split_regex(code, '[=!<>&|+\-*/%^~]+') AS gap FROM p),
u AS (SELECT doc_id, unnest(m) AS run, unnest(gap[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM g),
runs AS (SELECT doc_id, run, sum(length(gap) + length(run)) OVER (PARTITION BY doc_id ORDER BY i) - length(run) AS base FROM u),
f(doc_id, run, base, k, n) AS (
  SELECT doc_id, run, base, -1::BIGINT, 0::BIGINT FROM runs
  UNION ALL
  SELECT doc_id, run, base, k + greatest(n, 1), CASE
      WHEN k + greatest(n, 1) > 0 AND substr(run, k + greatest(n, 1), 1) IN ('=', '!', '<', '>') THEN 0
      WHEN substr(run, k + greatest(n, 1) + 1, 2) IN ('==', '!=', '<=', '>=', '&&', '||', '<<', '>>', '++', '--') AND substr(run, k + greatest(n, 1) + 3, 1) <> '=' THEN 2
      WHEN substr(run, k + greatest(n, 1) + 2, 1) = '=' THEN 0
      WHEN substr(run, k + greatest(n, 1) + 1, 1) IN ('+', '-', '*', '/', '%', '&', '|', '^', '~') THEN 1
      WHEN substr(run, k + greatest(n, 1) + 1, 1) IN ('<', '>') AND substr(run, k + greatest(n, 1) + 2, 1) <> substr(run, k + greatest(n, 1) + 1, 1) THEN 1 ELSE 0 END
  FROM f WHERE k + greatest(n, 1) < length(run)),
w AS (SELECT doc_id, regexp_extract_all(code, '[\p{L}\p{N}_]+') AS m, string_split_regex(code, '[\p{L}\p{N}_]+') AS gap FROM p),
x AS (SELECT doc_id, unnest(m) AS word, unnest(gap[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM w),
words AS (SELECT doc_id, word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM x),
c AS (
  SELECT doc_id, CAST(base + k AS INT) AS start, CAST(base + k + n AS INT) AS "end", substr(run, k + 1, n) AS token FROM f WHERE n > 0
  UNION ALL SELECT doc_id, CAST(e - length(word) AS INT), CAST(e AS INT), word FROM words WHERE word IN ('int', 'float', 'double', 'long', 'short', 'unsigned', 'signed', 'char', 'bool', 'void', 'auto', 'size_t'))
"""


@query("r2_mask_candidates", CANDIDATES + 'SELECT doc_id, start, "end" AS stop, token FROM c')
def r2(spark, sf_dir):
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("code"))
    return sampling.mask_candidates(docs).select("doc_id", "start", F.col("end").alias("stop"), "token")


@query(
    "r1_masked_programs",
    CANDIDATES.rstrip() + f""",
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {GATE.format('mask', "(doc_id || ':' || start)")}, start) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM c),
    o AS (SELECT *, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM k WHERE r <= greatest(1, floor(n * 0.15))),
    j AS (SELECT doc_id, string_agg(substr(code, before + 1, start - before) || '___MASK___', '' ORDER BY start) AS head, max("end") AS last, count(*) AS n FROM o JOIN p USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, md5(coalesce(head, '') || substr(code, coalesce(last, 0) + 1)) AS masked, coalesce(n, 0) AS n FROM p LEFT JOIN j USING (doc_id)""",
)
def masked(spark, sf_dir):
    m = sampling.mask(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("code")))
    return m.select("doc_id", F.md5("masked").alias("masked"), F.size("tokens").alias("n"))


@query(
    "r4_u1_mutated",
    rf"""SELECT doc_id, md5(CASE WHEN {GATE.format('gate', 'doc_id')} % 100 < 20 THEN CASE {GATE.format('mutator', 'doc_id')} % 4 WHEN 0 THEN regexp_replace(text, '\bint\b', 'long', 'g')
    WHEN 1 THEN replace(text, '==', '!=') WHEN 2 THEN regexp_replace(text, '\bfor\b', 'while', 'g') ELSE text || chr(10) END ELSE text END) AS out FROM documents""",
)
def r4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(mutators.builtin().apply(F.col("text"), F.col("doc_id"))).alias("out"))


@query("u1_guarded_functions", f"""SELECT doc_id, md5(CASE {GATE_SQL.format('mutator', 'doc_id')} % 4
      WHEN 0 THEN replace(text, 'int', 'long') WHEN 1 THEN CASE WHEN length(text) % 2 = 1 THEN text ELSE text || ';' END WHEN 2 THEN CASE WHEN text LIKE '%a%' THEN text ELSE 'x' || text END ELSE replace(text, ' ', '  ') END) AS out FROM documents""")
def u1(spark, sf_dir):
    """Functions, of which one fails on texts of odd length and one gives a number for those with an a; and a rule."""

    def odd(code):
        if len(code) % 2:
            raise ValueError(code)
        return code + ";"

    r = mutators.Registry()
    r.add_function("f0", lambda code: code.replace("int", "long"), seconds=10.0)
    r.add_function("f1", odd, seconds=10.0)
    r.add_function("f2", lambda code: len(code) if "a" in code and code != mutators.SMOKE else "x" + code, seconds=10.0)
    r.add_rule("f3", " ", "  ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(r.apply(F.col("text"), F.col("doc_id"), 100)).alias("out"))


# Sources, over tables in place of files.
@query("s5_column_fallback", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, ''), c_mktsegment) AS title, coalesce(nullif(c_name, ''), '') AS body, '' AS url FROM customer")
def s5(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("short_desc"), F.col("c_mktsegment").alias("title"), F.col("c_name").alias("long desc"))
    keyed = c.select(F.col("c_custkey").cast("string").alias("status"), "short_desc", "title", "long desc")
    return files.bug_reports(keyed).select(F.col("symptom").cast("long").alias("c_custkey"), "title", "body", "url")


@query("s6_open_issues", "SELECT event_id AS pos, event_type AS title, coalesce(props, '') AS body, 'u' || event_id AS url, '' AS symptom FROM events WHERE user_id % 3 <> 0 ORDER BY event_id LIMIT 100")
def s6(spark, sf_dir):
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select(n.alias("pos"), F.col("event_type").alias("title"), F.col("props").alias("body"), F.concat(F.lit("u"), n).alias("html_url"), F.when(F.col("user_id") % 3 == 0, "x").alias("pull_request"))
    return files.open_issues(e, 100)


@query("s6_paged_issues", "SELECT event_id AS number, event_type AS title, coalesce(props, '') AS body, 'u' || event_id AS url, '' AS symptom, 'closed' AS state FROM events WHERE user_id % 3 <> 0 AND event_id % 2 = 0")
def s6_paged(spark, sf_dir):
    """All closed issues of pages of 100, each found by its link from the one before."""
    from corvane.sources import issues
    from corvane.sources.store import kept, scratch

    n, page = F.col("event_id"), F.floor(F.col("event_id") / 100)
    issue = F.struct(n.alias("number"), F.col("event_type").alias("title"), F.col("props").alias("body"), F.concat(F.lit("u"), n).alias("html_url"), F.when(n % 2 == 0, "closed").otherwise("open").alias("state"), F.when(F.col("user_id") % 3 == 0, F.struct(n.alias("number"))).alias("pull_request"))
    pages = table(spark, sf_dir, "events").groupBy(page.alias("page")).agg(F.collect_list(issue).alias("issues"))
    link = F.concat(F.lit('<page=0>; rel="first", <page='), F.col("page") + 1, F.lit('>; rel="next"'))
    name = F.concat(F.lit("page="), F.col("page"))
    stored = kept(pages.select(name.alias("page"), F.to_json(F.struct(F.lit(200).alias("status"), link.alias("link"), "issues")).alias("value")), "pages")
    path = scratch(spark, "issues")
    issues.packed(stored, path)
    issues.register(spark)
    return spark.read.format("issues").option("path", path).option("packed", "true").load().where("state = 'closed'").select("number", "title", "body", "url", "symptom", "state")


@query("s9_resume_offset", "SELECT coalesce(max(doc_id) + 1, 0) AS next_id FROM documents")
def s9(spark, sf_dir):
    return files.resume_offset(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query("s10_k6_specs", r"SELECT doc_id, generate_subscripts(p, 1) - 1 AS spec_idx, md5(unnest(p)) AS spec FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)")
def s10(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", files.join_specs(F.split("text", "\n"), "-----").alias("text"))
    return files.specs(joined, "text", "-----").select("doc_id", F.col("spec_idx").cast("long").alias("spec_idx"), F.md5("spec").alias("spec"))


@query("s12_coverage", "SELECT l_orderkey, l_linenumber AS line, l_quantity < 25 AS hit FROM lineitem WHERE l_returnflag <> 'A'")
def s12(spark, sf_dir):
    q = F.col("l_quantity")
    count = F.when(F.col("l_returnflag") == "A", "-").when(q < 25, F.greatest(q.cast("int"), F.lit(1)).cast("string")).otherwise("#####")
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq"), F.format_string("%9s:%5d:code", count, "l_linenumber").alias("text"))
    return files.coverage(t, "l_orderkey", "seq", "text").select("l_orderkey", "line", "hit")


@query("d21_log_lines", "SELECT source, count(*) AS n FROM (SELECT source, doc_id FROM documents WHERE doc_id % 3 = 0) GROUP BY source")
def d21(spark, sf_dir):
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[INFO] "), F.left("lang", F.lit(2)))).otherwise(F.lit("more"))
    t = table(spark, sf_dir, "documents").select("doc_id", "source", line.alias("line"))
    return files.log_lines(t, "doc_id", "line", "source").groupBy("source").agg(F.count("*").alias("n"))


@query("x11_first_stop_length", "SELECT doc_id, CAST(CASE WHEN strpos(text, '. ') > 0 THEN strpos(text, '. ') - 1 ELSE length(text) END AS BIGINT) AS n FROM documents")
def first_stop(spark, sf_dir):
    at = F.instr("text", ". ")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(at > 0, at - 1).otherwise(F.length("text")).cast("long").alias("n"))


@query("k1_appended_programs", "SELECT source AS run, doc_id AS id, md5(text) AS code FROM documents WHERE text IS NOT NULL")
def k1(spark, sf_dir):
    """Programs appended in two parts and read again."""
    from corvane.sources import sinks
    from corvane.sources.store import scratch

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("source").alias("run"), F.col("doc_id").alias("id"), F.col("text").alias("code"))
    path = scratch(spark, "programs")
    for part in (0, 1):
        sinks.append_programs(d.where(F.pmod("id", F.lit(2)) == part), path)
    return spark.read.parquet(path).select("run", "id", F.md5("code").alias("code"))


@query("k4_log_levels", "SELECT level, count(*) AS n, min(message) AS first FROM (SELECT CASE event_type WHEN 'error' THEN 'INFO' WHEN 'click' THEN 'TRACE' WHEN 'view' THEN 'VERBOSE' ELSE 'DEBUG' END AS level, 'event ' || event_id AS message FROM events) WHERE level IN ('INFO', 'TRACE') GROUP BY level")
def k4(spark, sf_dir):
    """A log written up to the level of TRACE; unknown levels are not logged."""
    from corvane.sources import sinks
    from corvane.sources.store import scratch

    e = F.col("event_type")
    level = F.when(e == "error", "INFO").when(e == "click", "TRACE").when(e == "view", "VERBOSE").otherwise("DEBUG")
    path = scratch(spark, "log")
    sinks.log_table(table(spark, sf_dir, "events").select(level.alias("level"), F.concat(F.lit("event "), "event_id").alias("message")), path, most=2)
    return spark.read.parquet(path).groupBy("level").agg(F.count("*").alias("n"), F.min("message").alias("first"))


@query("u9_embedded_texts", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS x, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS y FROM documents WHERE text IS NOT NULL")
def u9(spark, sf_dir):
    """Vectors by an injected function of batches of texts."""
    from corvane.sources.store import embedded

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    v = embedded(d, "text", lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    return v.select("doc_id", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))

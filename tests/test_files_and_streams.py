import pandas as pd
from pyspark.sql import functions as F

from corvane.operators import history
from corvane.sources import files, sinks
from corvane.streaming import twins


def test_corpus(spark, tmp_path):
    run = tmp_path / "run1"
    run.mkdir()
    for i in (0, 1, 7):
        (run / f"{i}.fuzz").write_text(f"int a{i};\n")
    (run / "log.txt").write_text("x")
    c = files.corpus(spark, [str(run)])
    assert sorted((r["run"], r["id"]) for r in c.collect()) == [("run1", 0), ("run1", 1), ("run1", 7)]
    assert files.resume_offset(c).first()[0] == 8
    sinks.append_programs(c, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_functions(spark, tmp_path):
    (tmp_path / "gcc" / "deep").mkdir(parents=True)
    body = "int fold_it(int x) {\n  if (x) for (;;) while (x) { }\n return x; }\n\nstatic int other(int y) {\n return y; }\n"
    (tmp_path / "gcc" / "deep" / "a.cc").write_text(body)
    (tmp_path / "gcc" / "b.txt").write_text(body)
    got = files.functions_of(files.source_files(spark, str(tmp_path)), str(tmp_path)).collect()
    assert [(r["function_name"], r["complexity"]) for r in got] == [("fold_it", 3)]
    assert got[0]["pass_category"].startswith("GCC core")


def test_whole_definitions_of_many_batches(spark):
    """Slices of several times what goes back at once, some texts null: every definition comes, whole."""
    body = "if (x) { s = \"}\"; }\n" * 5_000
    t = spark.range(0, 60, 1, 1).selectExpr("concat('/r/a/', id, '.cc') AS path", f"if(id % 3 = 0, null, concat('int g', id, '(int x) {{\n', repeat('{body[:20]}', 5000), '}}')) AS text")
    got = {r["file"]: (r["at"], r["function_name"], r["complexity"], len(r["snippet"])) for r in files.functions_of(t, "/r", structured=True).collect()}
    assert got == {f"/r/a/{i}.cc": (0, f"g{i}", 5_000, files.EXCERPT) for i in range(60) if i % 3}
    spans = {f"/r/a/{i}.cc": f"int g{i}(int x) {{\n{body}}}" for i in range(60) if i % 3}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"path": list(spans), "text": [f"{x}\n" for x in spans.values()]})
    out = list(files.slices(iter([batch]), lambda x: files.definitions(x, "cpp")))
    assert {r["file"]: r["slice"] for b in out for r in b.to_pylist()} == spans and len(out) > 2


def test_functions_go_back_before_the_next_text_is_read():
    """A batch with many texts, and one text with many nested definitions, are never held as slices all at once."""
    import pyarrow as pa

    code, taken, read = "int f(int x) {\n" + "x;\n" * 40_000 + "}\n", [], []

    def batches(*columns):
        for c in columns:
            read.append(len(c))
            yield pa.RecordBatch.from_pydict({"path": [str(i) for i in range(len(c))], "text": pa.array(c, pa.string())})

    def found(text):
        taken.append(text)
        return files.definitions(text, "cpp")

    out = files.slices(batches([None, code] * 50, [], ["", code]), found)
    first = next(out)
    assert len(taken) < 20 and read == [100] and sum(map(len, first["slice"].to_pylist())) < 2 * files.BATCH
    rest = [r for b in [first, *out] for r in b.to_pylist()]
    assert [r["file"] for r in rest] == [str(i) for i in range(1, 100, 2)] + ["1"] and {(r["at"], r["function_name"], r["slice"]) for r in rest} == {(0, "f", code.rstrip())}
    nested = "".join(f"int g{i}() {{\n" for i in range(300)) + "x;" * 20_000 + "}" * 300
    sizes = [sum(len(x.as_py()) for x in b["slice"]) for b in files.slices(batches([nested]), found)]
    assert sum(sizes) > 300 * 40_000 and max(sizes) < files.BATCH + len(nested)


def test_control_words_are_counted_once(spark):
    """Whole slices are searched for the column, and not once more for the filter; the words are those of a plain search."""
    import random
    import re

    rng = random.Random(5)
    parts = ["if", "else", "for", "while", "switch", "try", "catch", "i", "f", "_", "9", " ", "\n", "(", "é", "if(", "elseif"]
    t = ["int g() {" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) + "}" for _ in range(500)]
    df = files.functions_of(spark.createDataFrame(list(zip(map(str, range(500)), t)), "path string, text string"), "/", threshold=0, structured=True)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(?:if|else|") == 1
    assert {int(r["file"]): r["complexity"] for r in df.collect()} == {i: len(re.findall(r"\b(?:if|else|for|while|switch|try|catch)\b", x, re.A)) for i, x in enumerate(t)}


def test_what_holds_no_structure_is_blanked():
    """As a search a character at a time finds it, in a text of any length; long comments and literals in one step each."""
    import random
    import re

    from corvane.functions import structure

    plain = re.compile(r"""\b(?:u8|[uUL])?R"(?P<d>[^\s()\\"]{0,16})\(.*?(?:\)(?P=d)"|\Z)|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.){1,8}'|^[ \t]*#(?:[^\n\\]|\\.)*+""", re.S | re.M)
    rng = random.Random(6)
    parts = ["/*", "*/", "*", "/", "//", '"', "'", "\\", "\n", "x", "é", " ", "#", 'R"(', ')"', "{", "}", "();"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert structure.OPAQUE.sub(structure.blank, t) == plain.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), t), t
    long = "/* " + "{*\n" * 300_000 + '*/ "' + '{\\"' * 300_000 + '"'
    assert re.sub("[ \n]", "", structure.OPAQUE.sub(structure.blank, long)) == ""


def test_definitions():
    from corvane.functions.structure import c_definitions, python_definitions

    code = """#define F(x) { x }
namespace n { struct A { A(int x) : y(x) { if (x) { y = 1; } } public: ~A() {} bool operator==(const A &o) const { return "}" == o.s; } int y; };
static int *A::b(int (*f)(int), char c = '{') /* { */ { for (;;) { auto g = [](int z) { return z; }; } } // }
int (*pick(int k))(int) { return 0; }
template <class T> T A<T>::c(T t) noexcept { while (t) { } return t; }
int x = f(1); enum E { P, Q }; int arr[] = { 1, 2 }; if (x) { } }
int open(int q) { switch (q) {"""
    got = c_definitions(code)
    assert [n for _, _, n in got] == ["A", "~A", "operator==", "b", "pick", "c", "open"]
    text = {n: code[s:e] for s, e, n in got}
    assert text["b"].startswith("static int *A::b(") and text["b"].endswith("} }") and text["~A"] == "~A() {}" and text["open"].endswith("{")
    py = "class K:\n  def é(self):\n    def inner(): pass\n    return 1\nasync def f(): return 2\n"
    assert [(n, py[s:e]) for s, e, n in python_definitions(py)] == [("é", "def é(self):\n    def inner(): pass\n    return 1"), ("inner", "def inner(): pass"), ("f", "async def f(): return 2")]
    assert python_definitions("def (") == [] and c_definitions("(" * 10_000 + "{" * 10_000) is not None


def test_old_style_raw_and_templated_definitions():
    from corvane.functions.structure import c_definitions

    found = lambda code: [(code[s:e], n) for s, e, n in c_definitions(code)]
    old = "static int add(a, b)\n  int a;\n  char *b[3], c;\n{ return a; }"
    assert found(f"int proto(a);\n{old}\nint f(x) int x; int g(int y) {{ return y; }}") == [(old, "add"), ("int g(int y) { return y; }", "g")]
    raw = 'auto h(const char *s = R"x(} { " )" )x") -> int { return s[0] == \'{\'; }'
    assert found(f"{raw} int z;") == [(raw, "h")]
    code = "template <class T, int N = (1 > 0)> auto A<T, N>::B::m(T (&t)[N]) const -> decltype(t) { if (t) { } } struct S { S &operator()(int) { return *this; } friend bool operator<(S, S) { return true; } operator bool() { return 1; } };"
    assert [n for _, n in found(code)] == ["m", "operator()", "operator<", "operator bool"]
    assert found("int (*(*pick(int k))(char))(int) { return 0; }")[0][1] == "pick"
    assert found('R"(' * 20_000) == [] and found("f(a) " + "int a;" * 20_000) == []


def test_headers_equal_the_pattern():
    import random

    rng = random.Random(7)
    parts = ["int", "f", "A::b", " ", "  ", "\n", "\n\n", "(", ")", "{", "}", "x y", ",", "*", "<T>", "() {", "(int a) {", "(a, (b)) \n{"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert [(m.span(), m.group(1)) for m in files.headers(text)] == [(m.span(), m.group(1)) for m in files.HEADER.finditer(text)], text


def test_ledger(spark, tmp_path):
    p = tmp_path / "bugs.csv"
    p.write_text(',fixed,status,symptom,short desc,long desc,reported to,,v\nx,1,new,crash,"Title, one","line ""1""\nline 2",http://u,,\n,,,,,,,,\nTotal,1,,,,,,,\n')
    got = files.bug_ledger(spark, str(p)).collect()
    assert [tuple(r) for r in got] == [("Title, one", 'line "1"\nline 2', "http://u", "crash")]


def test_coverage_branches(spark):
    rows = [("f", i, t) for i, t in enumerate(["        -:    0:Source:a", "        3:    1:if", "branch  0 taken 2 (fallthrough)", "branch  1 taken 0", "    #####:    2:x", "branch  0 never executed"])]
    d = spark.createDataFrame(rows, "file string, seq int, text string")
    assert sorted((r["line"], r["branch"] if r["branch"] is not None else -1, r["hit"]) for r in files.coverage(d, "file", "seq", "text").collect()) == [(1, -1, True), (1, 0, True), (1, 1, False), (2, -1, False), (2, 0, False)]


def test_log_lines(spark):
    rows = [("r", i, t) for i, t in enumerate(["[INFO] a", "b", "[VERBOSE] c"])]
    got = files.log_lines(spark.createDataFrame(rows, "run string, seq int, line string"), "seq", "line", "run").orderBy("seq").collect()
    assert [(r["level"], r["message"]) for r in got] == [("INFO", "a\nb"), ("VERBOSE", "c")]


def test_merge_seeds(spark, tmp_path):
    s = "code string, meta map<string,string>, seq int"
    spark.createDataFrame([("a", {"v": "1"}, 0), ("b", {}, 1)], s).write.parquet(str(tmp_path / "v0"))
    got = sinks.merge_seeds(str(tmp_path / "v0"), spark.createDataFrame([("a", {"v": "2"}, 5)], s), str(tmp_path / "v1"))
    assert {r["code"]: r["meta"].get("v") for r in got.collect()} == {"a": "2", "b": None}


def events(spark, tmp_path):
    pdf = pd.DataFrame({"run": [i % 3 for i in range(400)], "seq": range(400), "ok": [i % 7 < 1 for i in range(400)]})
    d = spark.createDataFrame(pdf).select("run", "seq", "ok")
    d.repartition(1).write.parquet(str(tmp_path / "in"))
    return d


def test_gate_stream_equals_batch(spark, tmp_path):
    d = events(spark, tmp_path)
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    twins.run_available(twins.gate_stream(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = history.rolling_gate(d, "run", "seq", F.col("ok")).select("run", "seq", "active")
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select("run", "seq", "active").collect()) == sorted(batch.collect())


def test_streak_stream_equals_batch(spark, tmp_path):
    d = events(spark, tmp_path).select(F.col("run").alias("branch"), "seq", F.col("ok").alias("hit"), F.col("seq").cast("string").alias("source"))
    s = spark.readStream.schema("run long, seq long, ok boolean").parquet(str(tmp_path / "in"))
    s = s.select(F.col("run").alias("branch"), "seq", F.col("ok").alias("hit"), F.col("seq").cast("string").alias("source"))
    q = twins.streak_stream(s).writeStream.format("memory").queryName("streaks").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["branch"]: (r["misses"], r["source"]) for r in spark.table("streaks").collect()}
    want = {r["branch"]: r["misses"] for r in history.miss_streaks(d, "branch", "seq", F.col("hit")).collect()}
    last = {r["branch"]: r["source"] for r in history.last_writer(d, "branch", "seq", "source").collect()}
    assert got == {b: (want[b], last[b]) for b in want}


def test_first_seen_and_counts(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 3}:00:00", "SAFE", f"c{i % 4}") for i in range(12)] + [("2024-01-02 00:00:00", "SAFE", "z")]
    d = spark.createDataFrame(rows, "ts string, verdict string, code string")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("ts"))
    twins.run_available(twins.first_seen_stream(s, "ts", "2 days"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 5
    twins.run_available(twins.counts_stream(s, "ts"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    got = spark.read.parquet(str(tmp_path / "o2"))
    assert got.agg(F.sum("n")).first()[0] == 12


def test_log_lines_across_ranges(spark):
    rows = [("r", i, "[INFO] a" if i % 7 == 0 else f"b{i}") for i in range(40)]
    d = spark.createDataFrame(rows, "run string, seq int, line string")
    key = lambda df: sorted((r["seq"], r["level"], r["message"]) for r in df.collect())
    assert key(files.log_lines(d, "seq", "line", "run", bucket=3)) == key(files.log_lines(d, "seq", "line", "run"))


def test_log_levels(spark, tmp_path):
    d = spark.createDataFrame([("INFO", "a"), ("TRACE", "b"), ("VERBOSE", "c"), ("OTHER", "d")], "level string, message string")
    sinks.log_table(d, str(tmp_path / "log"), most=2)
    assert sorted(r["message"] for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["a", "b"]


def test_specs_read_back(spark):
    d = spark.createDataFrame([(["one", "two\nlines", "three"],)], "parts array<string>")
    text = d.select(files.join_specs(F.col("parts"), "-----").alias("text"))
    assert [r["spec"] for r in files.specs(text, "text", "-----").orderBy("spec_idx").collect()] == ["one", "two\nlines", "three"]


def test_settings_and_requests(tmp_path):
    from corvane.sources.config import Settings, load_settings, request

    (tmp_path / "c.yaml").write_text("fuzzing:\n  batch_size: 7\nhuf:\n  phase3:\n    window: 9\n  other: x\n")
    assert load_settings(str(tmp_path / "c.yaml")) == Settings(batch_size=7, window=9)
    (tmp_path / "empty.yaml").write_text("")
    assert load_settings(str(tmp_path / "empty.yaml")) == Settings()
    made = request({"model": "m", "max_tokens": 5, "temperature": 1.0, "prompt": "p", "system": "s"})
    assert [m["role"] for m in made["messages"]] == ["system", "user"] and request({}, made) is made


def vectors(texts):
    return [[float(len(t)), 1.0] for t in texts]


def test_seed_store(spark, tmp_path):
    from corvane.sources.store import SeedStore

    new = lambda *rows: spark.createDataFrame(list(rows), "code string, meta map<string,string>, seq long, language string")
    assert SeedStore(spark, None, vectors).add(new(("a", {}, 0, "c"))) == 0 and SeedStore(spark, str(tmp_path / "s")).add(new(("a", {}, 0, "c"))) == 0
    store = SeedStore(spark, str(tmp_path / "s"), vectors)
    q = spark.createDataFrame([(1, "xx")], "query_id long, text string")
    assert store.similar(q).count() == 0 and store.seeds().count() == 0
    assert store.add(new(("a", {"v": "1"}, 0, "c"), ("bbbb", {}, 1, "go"), ("bb", {}, 2, "go"))) == 3
    again = SeedStore(spark, str(tmp_path / "s"), vectors)
    assert again.add(new(("a", {"v": "2"}, 5, "c"))) == 3 and len(again.versions()) == 2
    assert again.seeds("c").first()["meta"] == {"v": "2"} and {r["code"] for r in again.seeds("go").collect()} == {"bbbb", "bb"}
    assert [r["code"] for r in again.similar(q, 1).collect()] == ["bb"] and [r["code"] for r in again.similar(q, 5, "c").collect()] == ["a"]


def test_adding_rewrites_touched_buckets_only(spark, tmp_path):
    from corvane.sources.store import SeedStore

    new = lambda ids, v: spark.createDataFrame([(f"code {i}", [float(i), 1.0], {"v": v}, i + 1000 * int(v), "go" if i % 3 else "c") for i in ids], "code string, vec array<float>, meta map<string,string>, seq long, language string")
    store = SeedStore(spark, str(tmp_path / "s"), buckets=32)
    assert store.add(new(range(400), "1")) == 400 == store.count()
    first, before = store.versions()[-1], store.manifest()
    files_of = lambda v: {str(p) for p in (tmp_path / "s" / "data" / f"version={v}").rglob("*.parquet")}
    held = files_of(first)
    again = SeedStore(spark, str(tmp_path / "s"))  # the buckets are the store's own
    assert again.add(new([7, 500, 501, 502], "2")) == 403
    after = again.manifest()
    moved = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(moved) <= 4 and all(after[b] == before[b] for b in set(after) - moved) and files_of(first) == held
    read = {p.split("/data/")[1].split("/part-")[0] for p in again.seeds().inputFiles()}
    assert {x.split("/")[1] for x in read if first not in x} == {f"bucket={b}" for b in moved}
    assert again.seeds().count() == 403 and {r["code"]: r["meta"]["v"] for r in again.seeds().collect()}["code 7"] == "2"
    assert again.seeds(version=first).where("meta['v'] = '2'").count() == 0 and again.add(new([], "3")) == 403
    assert again.seeds("c").select("language").distinct().collect()[0][0] == "c"


def test_cleared_streaks_stream(spark, tmp_path):
    rows = [(1, i, False, f"s{i}", i == 3) for i in range(6)]
    d = spark.createDataFrame(rows, "branch long, seq long, hit boolean, source string, cleared boolean")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    twins.streak_stream(s).writeStream.format("memory").queryName("cleared").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("cleared").collect()] == [(1, 2, "s5")]


def test_carry_stream_equals_batch(spark, tmp_path):
    d = events(spark, tmp_path).select("run", "seq", F.col("ok").alias("keep"), F.concat(F.lit("c"), "seq").alias("code"))
    s = spark.readStream.schema("run long, seq long, ok boolean").parquet(str(tmp_path / "in"))
    s = s.select("run", "seq", F.col("ok").alias("keep"), F.concat(F.lit("c"), "seq").alias("code"))
    twins.run_available(twins.carry_stream(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r["run"], r["seq"], r["previous"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    for bucket in (7, 10_000):
        batch = history.carried_all(d, "code", F.col("keep"), "seq", "run", bucket)
        assert sorted((r["run"], r["seq"], r["previous"]) for r in batch.collect()) == got
    one = d.withColumn("p", history.carried(F.col("code"), F.col("keep"), "run", "seq"))
    assert sorted((r["run"], r["seq"], r["p"]) for r in one.collect()) == got

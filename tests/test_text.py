import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import verdicts as V


def one(spark, f, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select(f(F.col("c")).alias("o")).collect()
    return [r["o"] for r in rows]


def test_comments(spark):
    assert one(spark, T.strip_c_comments, "a//b\nc", '"//x" /*y*/ z', "a//b\rc\n", "'/*' x // '", "") == ["a \nc", '"//x"   z', "a \n", "'/*' x  ", ""]
    assert one(spark, T.strip_smt_comments, "a;b\nc") == ["a\nc"]
    assert one(spark, T.strip_python_comments, 'a#b\n"""x\ny"""z') == ["a\nz"]


def test_fences(spark):
    assert one(spark, T.fenced, "no", "```cpp\nint x;\n```", "```inline```", "```c\nrest") == ["", "int x;\n", "", "rest"]


def model_depth(code):
    depth = i = 0
    while i < len(code):
        if code[i] in "\"'":
            q, i = code[i], i + 1
            while i < len(code) and code[i] != q:
                i += 2 if code[i] == "\\" else 1
        elif code[i] in "{}":
            depth = depth + 1 if code[i] == "{" else max(0, depth - 1)
        i += 1
    return depth


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("a{}\"'\\\n/*", max_size=30), min_size=50, max_size=80))
def test_braces_and_comments_match_a_scan(spark, codes):
    assert one(spark, T.open_braces, *codes) == [model_depth(c) for c in codes]
    pattern = re.compile(r"//.*?$|/\*.*?\*/|'(?:\\.|[^\\'])*'|\"(?:\\.|[^\\\"])*\"", re.S | re.M)
    assert one(spark, T.strip_c_comments, *codes) == [pattern.sub(lambda m: " " if m.group().startswith("/") else m.group(), c) for c in codes]


def test_braces(spark):
    assert one(spark, T.close_braces, 'f(){ s="}";', "f(){}", "}{") == ['f(){ s="}";\n}\n', "f(){}", "}{\n}\n"]


def test_cut(spark):
    assert [len(x) for x in one(spark, lambda c: T.cut_at_stops(c, ["###"]), "x" * 12000, "ab###c")] == [10000, 2]


def test_rotation(spark):
    r = spark.range(50, 51).select(T.spec_index(F.col("id"), 5).alias("s"), T.hint_index(F.col("id")).alias("h"), T.spec_index(F.col("id"), 5, 0).alias("z")).first()
    assert (r["s"], r["h"], r["z"]) == (1, 0, 0)


def test_long_literals_do_not_overflow(spark):
    long = '"' + "x\\n" * 50_000 + '" // c'
    assert one(spark, T.strip_c_comments, long) == [long[:-4] + " "]


def test_verdicts(spark):
    rows = [("cpp", 1, V.NO_MAIN, False, 0), ("cpp", 4, "x", False, None), ("go", None, "x", True, None), ("c", None, "x", True, None), ("smt2", 2, "", False, None), ("java", 1, None, False, None), ("go", 0, None, False, None)]
    d = spark.createDataFrame(rows, "l string, e int, s string, t boolean, r int")
    assert [r[0] for r in d.select(V.verdict(*(F.col(c) for c in "lestr"))).collect()] == ["SAFE", "ERROR", "TIMED_OUT", "ERROR", "FAILURE", "FAILURE", "FAILURE"]


def test_required_api_null_passes(spark):
    d = spark.createDataFrame([("a", None), ("a", "b"), (" b ", "b")], "c string, api string")
    assert [r[0] for r in d.select(T.promoted_text(F.col("c"), F.col("api"))).collect()] == [True, False, True]


def test_targets_and_settings(spark, tmp_path):
    from corvane.functions.targets import LANGUAGES, make_target
    from corvane.sources import config

    d = spark.createDataFrame([("int main() { // x\n assert ", 0)], "c string, e int")
    for language in LANGUAGES:
        t = make_target(language, begin="int main() {", target_api="assert")
        r = d.select(t.keep(F.col("c")).alias("k"), t.clean(F.col("c")).alias("c"), t.clean_code(F.col("c")).alias("d"), t.wrap_prompt(F.col("c")).alias("w"), t.verdict(F.col("e"), F.lit(""), F.lit(False)).alias("v")).first()
        assert r["k"] == (language != "go" or True) and r["v"] == "SAFE" and r["w"].endswith("int main() {")
    with __import__("pytest").raises(ValueError):
        make_target("cobol")
    assert config.settings({"a": {"window": 7, "other": 1}, "b": {"c": {"islands": 3}}}) == config.Settings(window=7, islands=3)
    p = tmp_path / "best"
    assert config.best_prompt(str(p), lambda: "x") == config.best_prompt(str(p), lambda: "y") == "x"


def test_injected_responses(spark):
    from corvane.operators.agents import respond_with

    d = spark.createDataFrame([("a",), ("b",)], "p string")
    assert sorted(tuple(r) for r in respond_with(d, "p", lambda s: s.str.upper()).collect()) == [("a", "A"), ("b", "B")]


def test_headers_go_above_main_or_to_the_end(spark):
    begin = lambda b, *h: spark.range(1).select(T.with_headers(F.lit(b), F.array(*map(F.lit, h))).alias("x")).first()["x"]
    assert begin("#include <a>\nint main() {", "<b>", "<a>", "<c>", "<b>") == "#include <a>\n#include <b>\n#include <c>\nint main() {"
    assert begin("#include <a> \n\n", "<c>", "<b>") == "#include <a>\n#include <b>\n#include <c>"


def test_chats(spark):
    c = lambda first: [tuple(t) for t in spark.range(1).select(T.example_chat(F.lit("s"), F.lit("d"), F.lit(""), F.lit("ask"), F.lit(first)).alias("x")).first()["x"]]
    assert c("") == [("system", "s"), ("user", "d"), ("user", ""), ("user", "ask")]
    assert c("one") == [("system", "s"), ("user", "d"), ("user", ""), ("user", "ask"), ("assistant", "```\none\n```"), ("user", "ask")]


def test_headers_are_found_in_one_pass(spark):
    """Against a search for each header; the plan has one pattern, and no name holds another one as a whole word."""
    import re

    names = [n for own in T.HEADERS.values() for n in own]
    whole = lambda own, text: re.search(T.word(own), text) is not None
    assert all(a == b or not whole([a], b) for a in names for b in names)
    texts = [None, "", *names, *[f"x{n} {n}_ {n}9" for n in names], *[f"é{n}(" for n in names], " ".join(names), "::".join(reversed(names)), "std::is_same_value std::is_same_v<int> strncpyx,log;assert", "std::stringstream std::sorted sort std:: sort", *[f"{a}{s}{b}" for a, b in zip(names, names[1:]) for s in (".", "_", "::", "")]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.needed_headers(F.col("t")).alias("h"))
    want = {i: [h for h, own in T.HEADERS.items() if whole(own, t or "")] for i, t in enumerate(texts)}
    assert {r["i"]: r["h"] for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "RLIKE" not in plan

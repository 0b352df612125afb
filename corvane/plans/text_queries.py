"""Queries over texts, cleaned and shaped as programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.history import periodic, prompt_score
from corvane.plans.catalog import query, table

#: Common words of the texts stand in for what programs are made of.
WORDS = {" of ": " { ", " that ": " } ", " the ": " // ", " and ": ' " ', " to ": " /* ", " in ": " */ ", " is ": " if ", " for ": " ; ", " with ": " # ", " by ": " ```\n"}
CODE = "text"
for _a, _b in WORDS.items():
    CODE = f"replace({CODE}, '{_a}', '{_b}')"
LANGS = "CASE doc_id % 5 WHEN 0 THEN 'cpp' WHEN 1 THEN 'smt2' WHEN 2 THEN 'python' WHEN 3 THEN 'go' ELSE 'other' END"
LIT = r"""("(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*'')"""
C_SQL = rf"""replace(regexp_replace(regexp_replace(code, '(?s){LIT}|//[^\n]*|/\*.*?\*/', '\1' || chr(1), 'g'), '(?s){LIT}' || chr(1), '\1', 'g'), chr(1), ' ')"""
SMT_SQL = r"regexp_replace(code, ';[^\n]*', '', 'g')"
PY_SQL = r"""regexp_replace(regexp_replace(regexp_replace(code, '#[^\n]*', '', 'g'), '(?s)""\".*?""\"', '', 'g'), '(?s)''''''.*?''''''', '', 'g')""".replace('\\"', '"')
SRC = f"(SELECT doc_id, source, n_chars, text, {CODE} AS code, {LANGS} AS language FROM documents)"


def code(spark, sf_dir):
    c = F.col("text")
    for a, b in WORDS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    m = F.col("doc_id") % 5
    lang = F.when(m == 0, "cpp").when(m == 1, "smt2").when(m == 2, "python").when(m == 3, "go").otherwise("other")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text", c.alias("code"), lang.alias("language"))


def by_doc(name: str, sql: str, make) -> None:
    """A query of one column `out` for each document, and its SQL over the code."""
    query(name, f"SELECT doc_id, {sql} AS out FROM {SRC}")(lambda spark, sf_dir: code(spark, sf_dir).select("doc_id", make(F.col("code"), F.col("language")).alias("out")))


by_doc("x1_strip_c_comments", f"md5({C_SQL})", lambda c, g: F.md5(T.strip_c_comments(c)))
by_doc("x2_strip_smt_comments", f"md5({SMT_SQL})", lambda c, g: F.md5(T.strip_smt_comments(c)))
by_doc("x4_strip_python_comments", f"md5({PY_SQL})", lambda c, g: F.md5(T.strip_python_comments(c)))
STRIP_SQL = f"CASE language WHEN 'cpp' THEN {C_SQL} WHEN 'go' THEN {C_SQL} WHEN 'smt2' THEN {SMT_SQL} WHEN 'python' THEN {PY_SQL} ELSE code END"
by_doc("x3_strip_by_language", f"md5({STRIP_SQL})", lambda c, g: F.md5(T.strip_comments(c, g)))
by_doc(
    "x5_code_fence",
    "md5(CASE WHEN strpos(string_split(code, '```')[2], chr(10)) > 0 THEN substr(string_split(code, '```')[2], strpos(string_split(code, '```')[2], chr(10)) + 1) ELSE '' END)",
    lambda c, g: F.md5(T.fenced(c)),
)
OPEN = r"""(?s)(?:"(?:\\.|[^"\\])*(?:"|\\?\z)|''(?:\\.|[^''\\])*(?:''|\\?\z))"""
DEPTH = f"""list_reduce(list_prepend(0, list_transform(list_filter(string_split(regexp_replace(regexp_replace(code, '{OPEN}', '', 'g'), '[^{{}}]+', '', 'g'), ''), lambda x: x <> ''), lambda x: CASE x WHEN '{{' THEN 1 ELSE -1 END)), lambda s, x: greatest(s + x, 0))"""
by_doc("x8_brace_depth", f"CAST({DEPTH} AS BIGINT)", lambda c, g: T.open_braces(c).cast("long"))
by_doc("x8_close_braces", rf"md5(CASE WHEN {DEPTH} > 0 THEN regexp_replace(code, '\s+\z', '') || chr(10) || repeat('}}' || chr(10), CAST({DEPTH} AS BIGINT)) ELSE code END)", lambda c, g: F.md5(T.close_braces(c)))
NONBLANK = r"array_to_string(list_filter(string_split({0}, chr(10)), lambda x: regexp_matches(x, '\S')), chr(10))"
by_doc("x9_drop_blank_lines", f"md5({NONBLANK.format('code')})", lambda c, g: F.md5(T.drop_blank_lines(c)))
by_doc("x9_clean_code", f"md5({NONBLANK.format(STRIP_SQL)})", lambda c, g: F.md5(T.clean_code(c, g)))
#: A scaffold of two lines that some texts hold.
ECHO_LINES = ["And ornd.", "Les."]
ECHO_SQL = "'" + ECHO_LINES[0] + "' || chr(10) || '" + ECHO_LINES[1] + "'"
TRIMMED = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
SCAFFOLD_SQL = rf"""md5(array_to_string(list_filter(string_split({STRIP_SQL.replace('code', 'c2')}, chr(10)), lambda x: regexp_matches(x, '\S') AND NOT CASE WHEN language = 'cpp' THEN {TRIMMED} IN ('{ECHO_LINES[0]}', '{ECHO_LINES[1]}') ELSE {TRIMMED} = {ECHO_SQL} END), chr(10)))"""
query("x9_clean_code_scaffold", f"SELECT doc_id, {SCAFFOLD_SQL} AS out FROM (SELECT *, CASE WHEN language = 'go' THEN replace(code, {ECHO_SQL}, '') ELSE code END AS c2 FROM {SRC})")(
    lambda spark, sf_dir: code(spark, sf_dir).select("doc_id", F.md5(T.clean_code(F.col("code"), F.col("language"), "\n".join(ECHO_LINES))).alias("out"))
)
SMT_CLEAN = f"array_to_string(list_filter(string_split({SMT_SQL}, chr(10)), lambda x: NOT starts_with(x, '(set-option :') AND NOT starts_with(x, '(get-proof)')), chr(10))"
by_doc("x6_clean_smt", f"md5({SMT_CLEAN})", lambda c, g: F.md5(T.clean(c, F.lit("smt2"))))
STOPS = ["```", " } ", "***"]
by_doc("x10_cut_at_stops", "md5(left(code, least(10000, " + ", ".join(f"coalesce(nullif(strpos(code, '{s}'), 0) - 1, 10000)" for s in STOPS) + ")))", lambda c, g: F.md5(T.cut_at_stops(c, STOPS)))
by_doc("x11_all_stopped", "contains(code, '```') OR contains(code, ' } ')", lambda c, g: T.all_stopped(F.array(c), ["```", " } "]))
CONTROL = r"len(regexp_extract_all(code, '\b(?:if|else|for|while|switch|try|catch)\b'))"
INDENT = r"list_max(list_transform(string_split(code, chr(10)), lambda x: length(regexp_extract(x, '^(\s*)', 1)) // 4))"
by_doc("x12_complexity", f"CAST(CASE WHEN language = 'python' THEN {INDENT} ELSE {CONTROL} END AS BIGINT)", T.complexity)
by_doc("x13_excerpts", "md5(left(code, 800)) || md5(left(code, 1500)) || md5(left(code, 400))", lambda c, g: F.concat(*[F.md5(F.left(c, F.lit(n))) for n in (800, 1500, 400)]))
by_doc("x15_needed_headers", "array_to_string(list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(text, '\b(?:{'|'.join(n)})\b') THEN '{h}' END" for h, n in T.HEADERS.items()) + "], lambda x: x IS NOT NULL), ',')", lambda c, g: F.array_join(T.needed_headers(F.col("text")), ","))
by_doc("x18_with_hint", "md5(code || chr(10) || [" + ", ".join("'" + h + "'" for h in T.HINTS) + "][CAST(doc_id % 10 AS INTEGER) + 1])", lambda c, g: F.md5(T.with_hint(c, F.col("doc_id"))))
query("x19_rotation", "SELECT event_id, (event_id // 50) % 7 AS spec, (event_id // 5) % 10 AS hint FROM events")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", T.spec_index(F.col("event_id"), 7).alias("spec"), T.hint_index(F.col("event_id")).alias("hint"))
)
BULLET = r"list_filter(list_transform(list_filter(list_transform(string_split(replace(text, '. ', chr(10) || '- '), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: starts_with(x, '- ') OR starts_with(x, '* ')), lambda x: regexp_replace(substr(x, 3), '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
by_doc("x20_bullets", f"md5(array_to_string({BULLET}, '|'))", lambda c, g: F.md5(F.array_join(T.bullets(F.replace(F.col("text"), F.lit(". "), F.lit("\n- "))), "|")))
by_doc("x21_wrap_prompt", "md5(CASE language WHEN 'cpp' THEN '/* ' || code || ' */' WHEN 'go' THEN '// ' || code WHEN 'smt2' THEN '; ' || code WHEN 'python' THEN '''''''' || code || '''''''' ELSE code END || chr(10) || 'sep' || chr(10) || 'begin')", lambda c, g: F.md5(T.wrap_prompt(c, g, "sep", "begin")))
LINES = "array_to_string(list_transform(string_split(code, chr(10)), lambda x: '{0}' || x), chr(10))"
COMMENT = f"CASE language WHEN 'smt2' THEN {LINES.format('; ')} WHEN 'python' THEN {LINES.format('# ')} ELSE '/* ' || code || ' */' END"
by_doc("x22_as_comment", f"md5({COMMENT})", lambda c, g: F.md5(T.as_comment(c, g)))
by_doc("x23_swap_base", f"md5({COMMENT} || chr(10) || source)", lambda c, g: F.md5(T.swap_base(F.col("source"), c, g)))
by_doc(
    "x25_cloze_prompt",
    "md5('The following ' || language || ' program has some tokens replaced with \"___MASK___\". Fill in each blank with a syntactically and semantically valid replacement that preserves program structure. Return ONLY the completed program with no explanation.' || chr(10) || chr(10) || '```' || language || chr(10) || code || chr(10) || '```')",
    lambda c, g: F.md5(T.cloze_prompt(c, g)),
)
query("x26_bias_sentence", "SELECT n_name, 'When generating code, focus on ' || CASE n_nationkey % 3 WHEN 0 THEN '" + T.BIASES["concurrency"] + "' WHEN 1 THEN '" + T.BIASES["arithmetic"] + "' ELSE n_name END || '.' AS said FROM nation")(
    lambda spark, sf_dir: table(spark, sf_dir, "nation").select("n_name", T.bias_sentence(F.when(F.col("n_nationkey") % 3 == 0, "concurrency").when(F.col("n_nationkey") % 3 == 1, "arithmetic").otherwise(F.col("n_name"))).alias("said"))
)
HEAD = "'" + T.SPLICED.strip() + "' || chr(10)"
STRIPPED = r"regexp_replace(code, '^\s+|\s+$', '', 'g')"
by_doc(
    "x27_splice",
    rf"""md5(CASE WHEN {STRIPPED} = '' THEN source
      WHEN language = 'cpp' THEN {HEAD} || CASE WHEN regexp_matches({STRIPPED}, '\bmain\s*\(') THEN {STRIPPED} ELSE 'int main(void) {{' || chr(10) || {STRIPPED} || chr(10) || 'return 0;' || chr(10) || '}}' || chr(10) END
      WHEN language = 'go' THEN {HEAD} || CASE WHEN starts_with({STRIPPED}, 'package ') THEN {STRIPPED} ELSE 'package main' || chr(10) || chr(10) || 'func main() {{' || chr(10) || {STRIPPED} || chr(10) || '}}' || chr(10) END
      WHEN language = 'other' THEN {HEAD} || CASE WHEN contains({STRIPPED}, 'class ') AND contains({STRIPPED}, 'main') THEN {STRIPPED} ELSE 'public class SolverGenerated {{' || chr(10) || '  public static void main(String[] args) {{' || chr(10) || '    ' || {STRIPPED} || chr(10) || '  }}' || chr(10) || '}}' || chr(10) END
      ELSE {HEAD} || source || chr(10) || {STRIPPED} END)""",
    lambda c, g: F.md5(T.splice(F.col("source"), c, F.when(g == "other", "java").otherwise(g))),
)
by_doc("x28_context_lines", "md5(array_to_string(list_slice(string_split(code, chr(10)), CAST(greatest(doc_id % 7 - 3, 0) AS INTEGER) + 1, CAST(least(doc_id % 7 + 2, len(string_split(code, chr(10)))) AS INTEGER)), chr(10)))", lambda c, g: F.md5(T.context_lines(c, F.col("doc_id") % 7, 2)))
by_doc("x30_backend", "CASE WHEN starts_with(source, 'src1') THEN 'local:' || substr('ollama/' || source, 8) ELSE 'remote:' || source END", lambda c, g: F.concat(F.when(T.backend(F.when(F.startswith("source", F.lit("src1")), F.concat(F.lit("ollama/"), "source")).otherwise(F.col("source")))["local"], "local:").otherwise("remote:"), T.backend(F.when(F.startswith("source", F.lit("src1")), F.concat(F.lit("ollama/"), "source")).otherwise(F.col("source")))["name"]))
by_doc("x31_drop_last_line", "md5(array_to_string(list_slice(string_split(code, chr(10)), 1, len(string_split(code, chr(10))) - 1), chr(10)))", lambda c, g: F.md5(T.drop_last_line(c)))
query(
    "x32_chat_template",
    """SELECT item_id, md5('system: S' || chr(10) || 'user: ' || text || chr(10) || 'user: item ' || item_id || chr(10) || CASE WHEN item_id % 2 = 0 THEN 'user: go on' || chr(10) || 'assistant: ```' || chr(10) || text || chr(10) || '```' || chr(10) ELSE '' END || 'user: go on') AS chat FROM benchmark""",
)(
    lambda spark, sf_dir: table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.md5(F.array_join(F.transform(T.example_chat(F.lit("S"), F.col("text"), F.concat(F.lit("item "), "item_id"), F.lit("go on"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("")), lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")).alias("chat"),
    )
)
query("x32_conversations", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS chat FROM conversations GROUP BY conv_id")(
    lambda spark, sf_dir: table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")).alias("chat"))
)
SMT_OUT = "CASE doc_id % 6 WHEN 0 THEN 'sat' WHEN 1 THEN 'x' || chr(10) || ' unsat ' WHEN 2 THEN 'sat' || chr(10) || 'unknown' WHEN 3 THEN 'an invalid model was generated' || chr(10) || 'sat' WHEN 4 THEN 'unsupported' ELSE text END"
query("x34_smt_result", f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'sat' WHEN 1 THEN 'unsat' WHEN 2 THEN 'unknown' WHEN 3 THEN 'invalid model' WHEN 4 THEN 'unknown' ELSE '' END AS result FROM (SELECT doc_id, {SMT_OUT} AS o FROM documents)")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", T.smt_result(F.expr(SMT_OUT.replace("chr(10)", "'\\n'"))).alias("result"))
)
SPEC = "'" + T.SPEC.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{language}", "cpp") + "'"
query("x17_render_spec", f"SELECT item_id, md5(replace(replace(replace({SPEC}, '{{includes}}', '`#include <iostream>`'), '{{note}}', ' (inspired by the compiler''s gcc pass)'), '{{text}}', 'text ' || item_id)) AS spec FROM benchmark")(
    lambda spark, sf_dir: table(spark, sf_dir, "benchmark").select("item_id", F.md5(T.render_spec(F.concat(F.lit("text "), "item_id"), F.lit("gcc"))).alias("spec"))
)
NAMES = ["printf", "std::sort", "pow"]
SCAFFOLD = "#include <iostream>\n#include <cmath>\nint main() {\n"
HEADER_LIST = "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(t, '\b(?:{'|'.join(n)})\b') THEN '{h}' END" for h, n in T.HEADERS.items()) + "], lambda x: x IS NOT NULL)"
BEGIN_SQL = "'" + SCAFFOLD.replace("\n", "' || chr(10) || '") + "'"


@query(
    "x16_header_union",
    f"""WITH h AS (SELECT list_sort(list_distinct(flatten(list({HEADER_LIST})))) AS h FROM (SELECT text || ' ' || ['{"', '".join(NAMES)}'][CAST(doc_id % 3 AS INTEGER) + 1] AS t FROM documents))
    SELECT list_reduce(list_prepend({BEGIN_SQL}, h), lambda b, x: CASE WHEN contains(b, '#include ' || x) THEN b ELSE left(b, strpos(b, 'int main') - 1) || '#include ' || x || chr(10) || substr(b, strpos(b, 'int main')) END) AS begin FROM h""",
)
def header_union(spark, sf_dir):
    t = F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 3 + 1).cast("int")))
    headers = table(spark, sf_dir, "documents").select(F.explode(T.needed_headers(t)).alias("h")).agg(F.collect_set("h").alias("h"))  # as many as the table of headers has
    return headers.select(T.with_headers(F.lit(SCAFFOLD), F.col("h")).alias("begin"))


@query(
    "s3_functions",
    rf"""SELECT CAST(doc_id AS VARCHAR) AS file, name AS function_name, complexity, md5(left(code, 800)) AS snippet FROM (
      SELECT doc_id, name, code, CAST(len(regexp_extract_all(left(code, 1500), '\b(?:if|else|for|while|switch|try|catch)\b')) AS BIGINT) AS complexity FROM (
        SELECT doc_id, name, 'int ' || name || '(int x) {{' || chr(10) || replace(text, ' the ', ' if ') || chr(10) || '}}' || chr(10) AS code FROM (
          SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN 'fold' ELSE 'f' END || doc_id AS name FROM documents)))
    WHERE complexity >= 4 OR contains(name, 'fold')""",
)
def functions(spark, sf_dir):
    """The functions of files, here one for each text."""
    from corvane.sources.files import functions_of

    name = F.concat(F.when(F.col("doc_id") % 7 == 0, "fold").otherwise("f"), "doc_id")
    code = F.concat(F.lit("int "), name, F.lit("(int x) {\n"), F.replace("text", F.lit(" the "), F.lit(" if ")), F.lit("\n}\n"))
    found = functions_of(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), code.alias("text")), "/")
    return found.select("file", "function_name", "complexity", F.md5("snippet").alias("snippet"))


query("x14_category", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'portability and utility library' ELSE source END AS category FROM documents")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", T.category(F.concat(F.when(F.col("source") == "src1", "libiberty").otherwise(F.col("source")), F.lit("/a/b.c"))).alias("category"))
)
by_doc("x24_strategy", "CASE WHEN doc_id % 4 = 3 AND n_chars % 2 = 0 THEN 'combine' WHEN doc_id % 4 = 2 THEN 'equivalent' WHEN doc_id % 4 = 1 THEN 'mutate' ELSE 'new' END", lambda c, g: T.strategy(F.col("doc_id") % 4, F.when(F.col("n_chars") % 2 == 0, c)))
@query(
    "s2_whole_texts",
    r"""SELECT file, function_name, complexity, md5(left(code, 800)) AS snippet FROM (
      SELECT CAST(doc_id AS VARCHAR) AS file, 'g' || doc_id AS function_name, code, CAST(len(regexp_extract_all(code, '\b(?:if|else|for|while|switch|try|catch)\b')) AS BIGINT) AS complexity FROM (
        SELECT doc_id, 'int *A::g' || doc_id || '(int x) const {' || chr(10) || 'if (x) { /* ' || replace(replace(text, '*/', '* /'), ' the ', ' if ') || ' */ const char *s = "' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"; }' || chr(10) || '}' AS code FROM documents WHERE text IS NOT NULL))
    WHERE complexity >= 4""",
)
def whole_definitions(spark, sf_dir):
    """Definitions that hold whole texts, braces and quotes included, in a comment and in a literal."""
    from corvane.sources.files import functions_of

    d, text = table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("text")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    said = F.replace(F.replace("text", F.lit("*/"), F.lit("* /")), F.lit(" the "), F.lit(" if "))
    code = F.concat(F.lit("class A { public: int y; int *A::g"), "doc_id", F.lit("(int x) const {\nif (x) { /* "), said, F.lit(' */ const char *s = "'), text, F.lit('"; }\n} };\n'))
    found = functions_of(d.select(F.col("doc_id").cast("string").alias("path"), code.alias("text")), "/", structured=True)
    return found.select("file", "function_name", "complexity", F.md5("snippet").alias("snippet"))


@query(
    "s2_definitions",
    rf"""SELECT file, function_name, complexity, md5(left(code, 800)) AS snippet FROM (
      SELECT CAST(doc_id AS VARCHAR) AS file, name AS function_name, code, CAST(len(regexp_extract_all(code, '\b(?:if|else|for|while|switch|try|catch)\b')) AS BIGINT) AS complexity FROM (
        SELECT doc_id, 'g' || doc_id AS name, 'int *A::g' || doc_id || '(int x) const {{' || chr(10) || replace(text, ' the ', ' if ') || chr(10) || '}}' AS code FROM documents WHERE NOT regexp_matches(text, '["''#(){{}};/]')))
    WHERE complexity >= 4""",
)
def structured_functions(spark, sf_dir):
    """S2, S4 over texts without signs of structure of their own."""
    from corvane.sources.files import functions_of

    d = table(spark, sf_dir, "documents").where(~F.regexp_like("text", F.lit("[\"'#(){};/]")))
    code = F.concat(F.lit("class A { public: int y; int *A::g"), "doc_id", F.lit("(int x) const {\n"), F.replace("text", F.lit(" the "), F.lit(" if ")), F.lit("\n} };\n"))
    found = functions_of(d.select(F.col("doc_id").cast("string").alias("path"), code.alias("text")), "/", structured=True)
    return found.select("file", "function_name", "complexity", F.md5("snippet").alias("snippet"))


@query("x29_natural_order", "SELECT c_custkey, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT), c_custkey) AS rank FROM customer")
def natural_order(spark, sf_dir):
    from corvane.operators.ranking import global_rank

    return global_rank(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), T.natural_text(F.col("c_name")), "c_custkey").select("c_custkey", "rank")


BEGIN = "#include <x>\nint main() {\n"
ECHO = "CASE doc_id % 3 WHEN 0 THEN '#include <y>' || chr(10) || 'int main( ) {' WHEN 1 THEN 'struct s;' || chr(10) || '  int main(int a) {' ELSE 'x = 1;' END || left(source, 9)"
query("x7_mend_scaffold", rf"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '#include <x>' || chr(10) || 'int main() {{' || chr(10) || chr(10) || left(source, 9) WHEN 1 THEN '#include <x>' || chr(10) || 'struct s;' || chr(10) || '  int main(int a) {{' || left(source, 9) ELSE '#include <x>' || chr(10) || 'int main() {{' || chr(10) || 'x = 1;' || left(source, 9) END AS out FROM documents")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", T.mend_scaffold(F.concat(F.lit(BEGIN), F.expr(ECHO.replace("chr(10)", "'\\n'"))), BEGIN).alias("out"))
)


@query("v6_static_check", "SELECT doc_id, doc_id % 3 <> 2 AS ok FROM documents")
def static_check(spark, sf_dir):
    from corvane.functions.targets import parsed

    m = F.col("doc_id") % 3
    c = F.concat(F.lit("a = 1\n"), F.when(m == 0, "b = 2").when(m == 1, "b = (").otherwise("b = (\nc"))
    return table(spark, sf_dir, "documents").select("doc_id", parsed(c)["ok"].alias("ok"))


@query("u4_response_table", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'r' || page_id END AS response FROM pages")
def response_table(spark, sf_dir):
    from corvane.operators.agents import respond

    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), "page_id").alias("prompt"))
    known = p.where("page_id % 2 = 0").select(F.md5("prompt").alias("prompt_md5"), F.concat(F.lit("r"), "page_id").alias("response"))
    return respond(p, "prompt", known).select("page_id", "response")


# Predicates on texts.
query("f1_required_api", f"SELECT doc_id FROM {SRC} WHERE doc_id % 10 = 0 OR contains(trim(replace(code, ' if ', ''), ' ' || chr(10)), ' {{ ')")(
    lambda spark, sf_dir: code(spark, sf_dir).where(T.promoted_text(F.col("code"), F.when(F.col("doc_id") % 10 != 0, F.lit(" { ")), " if ")).select("doc_id")
)
query("f3_required_api_go", rf"SELECT doc_id FROM {SRC} WHERE contains(regexp_replace({C_SQL}, '^\s+|\s+$', '', 'g'), ' if ')")(lambda spark, sf_dir: code(spark, sf_dir).where(T.promoted_text(T.strip_c_comments(F.col("code")), F.lit(" if "))).select("doc_id"))
def _smt():
    from corvane.functions.targets import make_target

    return make_target("smt2")


query("f4_contains_assert", "SELECT doc_id FROM (SELECT doc_id, replace(text, 'est', 'assert') AS c FROM documents) WHERE contains(c, 'assert')")(lambda spark, sf_dir: table(spark, sf_dir, "documents").where(_smt().keep(F.replace("text", F.lit("est"), F.lit("assert")))).select("doc_id"))
query("f5_translatable", rf"SELECT doc_id, NOT regexp_matches(CASE WHEN strpos(code, '{{') > 0 THEN left(code, strpos(code, '{{') - 1) ELSE left(code, 400) END, '\b(?:thand|at|ore|edout)\b') AS ok FROM {SRC}")(
    lambda spark, sf_dir: code(spark, sf_dir).select("doc_id", T.translatable(F.col("code"), "thand at ore edout").alias("ok"))
)
query("f6_complexity_cap", f"SELECT doc_id FROM {SRC} WHERE {CONTROL} <= 200")(lambda spark, sf_dir: code(spark, sf_dir).where(T.complexity(F.col("code"), F.lit("cpp")) <= 200).select("doc_id"))
query("f9_prompt_score", f"SELECT source, count(DISTINCT {NONBLANK.format('code')}) FILTER (WHERE contains(code, ' if ')) AS score FROM {SRC} GROUP BY source")(
    lambda spark, sf_dir: prompt_score(code(spark, sf_dir), "source", T.drop_blank_lines(F.col("code")), F.contains("code", F.lit(" if ")))
)
query("f12_periodic", "SELECT event_id FROM events WHERE event_id % 50 = 0 AND event_id <> 0")(lambda spark, sf_dir: periodic(table(spark, sf_dir, "events"), "event_id", 50).select("event_id"))
query("k3_class_file", r"SELECT doc_id, coalesce(nullif(regexp_extract(c, 'public\s+class\s+([^\s{]+)', 1), ''), 'Main') || '.java' AS file FROM (SELECT doc_id, replace(text, 'The ', 'public class ') AS c FROM documents)")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", T.class_file(F.replace("text", F.lit("The "), F.lit("public class "))).alias("file"))
)
query("s7_next_link", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url END AS next FROM pages")(
    lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", T.next_link(F.concat(F.lit('<http://a>; rel="prev", <'), "url", F.lit(">; rel="), F.when(F.col("page_id") % 3 == 0, '"next"').otherwise('"last"'))).alias("next"))
)
query("s16_newest_standard", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2023 ELSE 1998 END AS newest FROM part")(
    lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", T.newest_standard(F.concat(F.lit("-std=c++98 -std=c++2a "), F.when(F.col("p_size") % 2 == 0, "-std=c++17 -std=c++23 ").otherwise(""))).alias("newest"))
)

"""Line dedup by a log-template tree, with Spark expressions only.

Every token of a line that holds a digit is masked at once, white space is made single spaces; a line that has no other
tokens stands as it is, as a row of numbers is no template. The tree then has a
fixed depth: token count, the first `lead` tokens, and under such a branch the rest of the line in up to FIELDS fields,
runs of tokens of equal number (single tokens where there are no more than FIELDS). In a branch a field is constant if
at least `steady` of the branch's distinct lines, and two of them, have it at its place; other fields vary and become
wildcards. A line whose fields are constant by `share` falls under the template of its branch and its constant fields,
beside the template that is the masked line itself. A template recurs if at least `min_docs` distinct texts have a line
under it, whatever surrounds it: texts that are equal when masked are one text, so copies count once. Lines of
recurring templates are dropped everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_hot, row_key, written

#: Any token with a digit in it is a variable field.
VARIABLE = r"(?<!\S)[^\s\d]*+\d\S*+"
#: White space in a line other than single spaces.
SPACING = r"[^\S\n]{2,}|[\t\x0B\f\r]"
FIELDS = 4


def masked(text: Column) -> Column:
    m = F.when(text.rlike("[0-9]"), F.regexp_replace(text, VARIABLE, "<*>")).otherwise(text)
    odd = F.contains(m, F.lit("  "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(m, F.lit(c))
    return F.when(odd, F.regexp_replace(m, SPACING, " ")).otherwise(m)


def parsed(docs: DataFrame, lead: int) -> DataFrame:
    """doc_id, t, text to one row for each line with a token: doc_id, t, digest of the masked text, i, hash of the
    line, its branch, hashes of the fields (null beyond them)."""
    m = docs.where("text IS NOT NULL").select("doc_id", "t", "text", masked(F.col("text")).alias("m"))
    bare = lambda x: F.replace(F.replace(x, F.lit("<*>"), F.lit("")), F.lit(" "), F.lit("")) == ""
    shown = F.zip_with(F.split("m", "\n"), F.split("text", "\n"), lambda x, own: F.when(bare(x), own).otherwise(x))
    each = F.when(F.contains("m", F.lit("<*>")), shown).otherwise(F.split("m", "\n"))
    lines = m.select("doc_id", "t", F.xxhash64("m").alias("digest"), F.posexplode(each).alias("i", "line"))
    tokens = lines.select("doc_id", "t", "digest", "i", F.trim("line").alias("line")).where("line <> ''").select("doc_id", "t", "digest", "i", F.xxhash64("line").alias("line"), F.split("line", " ").alias("k"))
    n = F.size("k")
    sized = tokens.withColumn("rest", F.greatest(n - lead, F.lit(0))).withColumn("fields", F.least("rest", F.lit(FIELDS)))
    branch = F.xxhash64(n, F.slice("k", 1, lead))
    at = lambda j: F.floor(F.lit(j) * F.col("rest") / F.col("fields")).cast("int")
    field = [F.when(F.col("fields") > j, F.xxhash64(F.slice("k", at(j) + lead + 1, at(j + 1) - at(j)))).alias(f"f{j}") for j in range(FIELDS)]
    return sized.select("doc_id", "t", "digest", "i", "line", branch.alias("branch"), *field)


PARTS = ["branch", *(f"f{j}" for j in range(FIELDS))]


def generalised(known: DataFrame, steady: float, share: float) -> DataFrame:
    """Of distinct lines (line, branch, f0, ...) those with enough constant fields: line, template."""
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("at"), F.col(f"f{j}").alias("f")) for j in range(FIELDS)])).alias("x")
    size = written(known.groupBy("branch").agg(F.count("*").alias("size")).where("size > 1"), "branches")
    told = join_hot(known.where("f2 IS NOT NULL").drop("n", "texts"), size, ["branch"], n="size")
    told = told.select("line", "branch", "size", F.when(F.col("f3").isNull(), 3).otherwise(4).alias("fields"), each).where("x.f IS NOT NULL")
    told = told.select("line", "branch", "size", "fields", "x.*", F.xxhash64("branch", "x.at", "x.f").alias("key"))
    told = written(told, "fields")
    often = written(told.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "frequent-fields")
    kept = join_hot(told, often, ["key"]).where(F.col("n") >= steady * F.col("size")).groupBy("line", "branch", "fields")
    kept = kept.agg(F.count("*").alias("k"), *[F.max(F.when(F.col("at") == j, F.col("f"))).alias(f"c{j}") for j in range(FIELDS)])
    template = F.xxhash64("branch", *[F.coalesce(f"c{j}", F.lit(0)) for j in range(FIELDS)])
    return kept.where((F.col("k") >= share * F.col("fields")) & (F.col("k") < F.col("fields"))).select("line", template.alias("template"))


def recurring(lines: DataFrame, min_docs: int, steady: float, share: float) -> DataFrame:
    """The lines to drop (line, n rows), from the rows of parsed()."""
    parts = [F.min(c).alias(c) for c in PARTS]
    pair = lines.groupBy("line", "digest").agg(F.count("*").alias("n"), *parts)
    known = written(pair.groupBy("line").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), *parts), "distinct-lines")
    under = written(generalised(known, steady, share).join(known.select("line", "n"), "line"), "generalised-lines")
    per_text = join_hot(lines.select("line", "digest"), under, ["line"]).select("template", "digest").distinct()
    good = per_text.groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_docs).select("template")
    more = under.join(good, "template", "left_semi").select("line", "n")
    return known.where(F.col("texts") >= min_docs).select("line", "n").unionByName(more).distinct()


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, lead: int = 2, steady: float = 0.2, share: float = 0.6) -> DataFrame:
    """Each row of `docs` as it is but for `text`, which loses the lines of recurring templates, under `row`; beside
    it n_lines and n_dropped.

    A null text stays null with no lines; an empty text is one empty line. Lines without tokens are never dropped.
    Rows with the same text count once, and rows that repeat a doc_id, or have none, are judged one by one. Other
    columns go along in `row`, whatever their names.
    """
    own = row_key(docs, F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"))
    lines = written(parsed(own.select("doc_id", "t", "text"), lead), "line-templates")
    gone = written(recurring(lines, min_docs, steady, share), "recurring-lines")
    per = join_hot(lines.select("doc_id", "t", "i", "line"), gone, ["line"]).groupBy("doc_id", "t").agg(F.collect_set("i").alias("gone"))
    t = own.join(per.hint("shuffle_hash"), ["doc_id", "t"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    cols = [kept.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return t.select(F.struct(*cols).alias("row"), F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))

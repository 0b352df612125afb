"""Readers of program corpora, bug ledgers, spec caches, logs and coverage listings."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.structure import definitions
from corvane.functions.text import category, complexity

#: Fixed values of the formats.
SUFFIXES = {"cpp": (".cpp", ".cxx", ".cc", ".hpp", ".h"), "c": (".c", ".h"), "python": (".py",)}
ENTRY_WORDS = ["fold", "expand", "emit", "gimplify", "optimize", "lower", "simplify", "parse", "analyze", "resolve", "check", "rewrite", "codegen", "generate"]
HEADER = re.compile(r"(?:^|\n)(?:[\w:<>*&\s]+)\s+(\w+)\s*\([^)]*\)\s*\{", re.M)
SLICE, EXCERPT = 1500, 800
#: Characters of the slices that go back to Spark at once.
BATCH = 1 << 20
LOG_LINE = r"^\[(INFO|TRACE|VERBOSE)\] (.*)$"


def stem_id(path: Column) -> Column:
    """The number a file is named by, else null."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1).try_cast("int")


def corpus(spark: SparkSession, folders: list[str], pattern: str = "*.fuzz") -> DataFrame:
    """Run, id, code of every program file right in the folders. Folders are listed, never single files."""
    t = spark.read.option("pathGlobFilter", pattern).text(folders, wholetext=True)
    path = F.col("_metadata.file_path")
    return t.select(F.element_at(F.split(path, "/"), -2).alias("run"), stem_id(path).alias("id"), F.col("value").alias("code"))


def resume_offset(programs: DataFrame) -> DataFrame:
    """One past the greatest id, 0 without any."""
    return programs.agg(F.coalesce(F.max("id") + 1, F.lit(0)).cast("long").alias("next_id"))


def source_files(spark: SparkSession, root: str, language: str = "cpp") -> DataFrame:
    """Path under root, text of every source file of the language at any depth; unreadable ones are passed over."""
    globs = "{" + ",".join(f"*{x}" for x in SUFFIXES.get(language, (".cpp",))) + "}"
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", globs).option("ignoreCorruptFiles", "true").text(root, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: What may stand before a parameter list in HEADER, and the name at its end.
RUN = re.compile(r"[\w:<>*&\s]+")
LAST_WORD = re.compile(r"\w+\Z")
OPENING = re.compile(r"\s*\{")


def headers(text: str) -> Iterator[re.Match]:
    """The matches of HEADER, found in one pass: it is tried only on runs that lead to a parameter list and a body."""
    closing = [m.start() for m in re.finditer(r"\)", text)]
    done = 0
    for run in RUN.finditer(text):
        s, e = run.span()
        i = bisect_right(closing, e)
        if e == len(text) or text[e] != "(" or i == len(closing):
            continue
        body = OPENING.match(text, closing[i] + 1)
        word = LAST_WORD.search(text, s, s + len(run.group().rstrip())) if body else None
        if word and word.start() > s and text[word.start() - 1].isspace() and (m := HEADER.search(text, max(s, done), body.end())):
            done = m.end()
            yield m


def slices(batches: Iterable[pa.RecordBatch], found_in: Callable[[str], list[tuple[int, int, str]]]) -> Iterator[pa.RecordBatch]:
    """file, at, function_name, slice of what is found in each text, in batches of about BATCH characters. Texts are taken
    one at a time, so a worker holds one batch of Spark's and little else."""
    types = {"file": pa.string(), "at": pa.int32(), "function_name": pa.string(), "slice": pa.string()}
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))
    rows, size = [], 0
    for b in batches:
        for path, text in zip(b["path"], b["text"]):
            t = text.as_py()
            for s, e, name in found_in(t) if t else ():
                rows.append((path.as_py(), s, name, t[s:e]))
                size += len(rows[-1][3])
                if size >= BATCH:
                    yield batch(rows)
                    rows, size = [], 0
        b = path = text = t = None  # before the next batch is read
    if rows:
        yield batch(rows)


def functions_of(files: DataFrame, root: str, language: str = "cpp", threshold: int = 4, structured: bool = False) -> DataFrame:
    """file, at, function_name, complexity, pass_category, snippet of each function that is complex enough or named like
    an optimizer's entry. S3 by a header pattern and a slice of fixed length; structured, S2 and S4: every definition
    at any depth, to the end of its body. The snippet is the start of either."""

    def found_in(text: str) -> list[tuple[int, int, str]]:
        if structured:
            return definitions(text, language)
        return [(m.start(), m.start() + SLICE, m.group(1)) for m in headers(text)]

    found = files.select("path", "text").mapInArrow(lambda batches: slices(batches, found_in), "file string, at int, function_name string, slice string")
    base = root.rstrip("/")
    rel = F.regexp_replace("file", "^(?:file:/*)?/?" + re.escape(base.lstrip("/")) + "/", "")
    named = F.exists(F.array(*map(F.lit, ENTRY_WORDS)), lambda w: F.contains(F.lower("function_name"), w))
    scored = found.select("*", F.explode(F.array(complexity(F.col("slice"), F.lit(language)))).alias("complexity"))  # counted once, not again in the filter
    return scored.where((F.col("complexity") >= threshold) | named).select("file", "at", "function_name", "complexity", category(rel).alias("pass_category"), F.left("slice", F.lit(EXCERPT)).alias("snippet"))


def bug_reports(raw: DataFrame, title=("short_desc", "short desc", "title"), body=("long_desc", "long desc", "body"), url=("url", "bug_url", "reported to"), symptom=("symptom", "status")) -> DataFrame:
    """Title, body, url, symptom, each the first non-empty of the columns that are there, else empty."""
    there = {c.lower(): c for c in raw.columns}

    def first(names: tuple[str, ...], alias: str) -> Column:
        own = [F.nullif(F.trim(F.col(f"`{there[n]}`").cast("string")), F.lit("")) for n in names if n in there]
        return F.coalesce(*own, F.lit("")).alias(alias)

    return raw.select(first(title, "title"), first(body, "body"), first(url, "url"), first(symptom, "symptom"))


def bug_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The reports of a ledger; cells span lines and double their quotes. Rows without title, body and url,
    among them blank rows and the totals, are dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return bug_reports(raw).where("title <> '' OR body <> '' OR url <> ''")


def open_issues(issues: DataFrame, limit: int) -> DataFrame:
    """S6, O-K8: issues (pos, title, body, html_url, pull_request) as reports, pull requests out, the first
    `limit` in order. Issues tell no symptom."""
    own = issues.where("pull_request IS NULL").orderBy("pos").limit(limit)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return own.select("pos", blank(F.col("title")).alias("title"), blank(F.col("body")).alias("body"), blank(F.col("html_url")).alias("url"), F.lit("").alias("symptom"))


def specs(df: DataFrame, text: str, delimiter: str) -> DataFrame:
    """spec_idx, spec of the non-blank parts between delimiters."""
    parts = F.filter(F.transform(F.split(F.col(text), F.lit(re.escape(delimiter))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return df.select("*", F.posexplode(parts).alias("spec_idx", "spec")).drop(text)


def join_specs(parts: Column, delimiter: str) -> Column:
    """K6."""
    return F.array_join(parts, f"\n\n{delimiter}\n\n")


def log_lines(df: DataFrame, order: str, line: str, run: str, bucket: int = 10_000) -> DataFrame:
    """Level and message of each entry; lines without a level continue the entry before them. Order values are
    whole numbers; ranges of `bucket` of them count their entries apart, so no task sees a whole run."""
    from pyspark.sql import Window as W

    head = F.regexp_like(F.col(line), F.lit(LOG_LINE)).cast("int")
    t = df.select(run, order, line, F.floor(F.col(order) / bucket).alias("_b"), head.alias("_h"))
    before = t.groupBy(run, "_b").agg(F.sum("_h").alias("_n")).withColumn("_n", F.coalesce(F.sum("_n").over(W.partitionBy(run).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum("_h").over(W.partitionBy(run, "_b").orderBy(order))
    t = t.withColumn("_own", own).join(before, [run, "_b"]).withColumn("_e", F.col("_own") + F.col("_n"))
    t = t.where("_e > 0").groupBy(run, "_e").agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x[line]), "\n")
    return t.select(run, F.col("_e").alias("seq"), F.regexp_extract(text, r"^\[(\w+)\]", 1).alias("level"), F.regexp_replace(text, r"^\[\w+\] ", "").alias("message"))


def coverage(df: DataFrame, file: str, seq: str, text: str) -> DataFrame:
    """File, line, branch, hit from rows of a coverage listing; a branch belongs to the line row before it.
    Rows that are neither, and lines that cannot be executed, are passed over."""
    from pyspark.sql import Window as W

    count, line = F.regexp_extract(text, r"^\s*([0-9]+\*?|#####|=====|-):\s*([0-9]+):", 1), F.regexp_extract(text, r"^\s*([0-9]+\*?|#####|=====|-):\s*([0-9]+):", 2)
    branch = F.regexp_extract(text, r"^branch\s+([0-9]+)\s", 1)
    w = W.partitionBy(file).orderBy(seq)
    t = df.select(file, seq, F.nullif(count, F.lit("")).alias("_c"), line.try_cast("int").alias("_l"), branch.try_cast("int").alias("branch"), F.regexp_extract(text, r"taken\s+([0-9]+)", 1).try_cast("long").alias("_t"))
    t = t.withColumn("line", F.last("_l", ignorenulls=True).over(w))
    hit = F.when(F.col("branch").isNotNull(), F.coalesce(F.col("_t"), F.lit(0)) > 0).otherwise(F.regexp_like("_c", F.lit("^[0-9]*[1-9][0-9]*\\*?$")))
    return t.where("line IS NOT NULL AND (branch IS NOT NULL OR (_c IS NOT NULL AND _c <> '-'))").select(file, "line", "branch", hit.alias("hit"))

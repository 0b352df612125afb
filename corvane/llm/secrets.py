r"""Secret scans over a trigram index, with Spark expressions only.

Each rule's regex gives a Boolean query: alternatives, each a set of lower-cased trigrams that a match cannot do
without. The trigrams that the rules ask for are indexed over all texts as postings (trigram, row), written with each
file sorted by trigram, so that no trigram's postings meet in one task. An alternative's postings are intersected by
row; rows that have all trigrams of an alternative are the rule's candidates, and only there its regex runs. A rule
with an alternative without trigrams is run over every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import row_key, written

SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Stands between literal runs of an alternative for anything.
GAP = "\0"


@dataclass(frozen=True)
class Rule:
    """Matches of `regex`, leftmost and non-overlapping, whose `group` has at least `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The base rules come first. Repeats that could meet again at every character are bounded.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]+"),
    Rule("url", r"://[A-Za-z0-9._%+-]{1,64}:[A-Za-z0-9._%+!*-]{3,64}@[A-Za-z0-9]"),
    Rule("bearer", r"(?i)bearer\x20{1,8}[A-Za-z0-9._~+/-]{20,}"),
)


def _joined(parts: list[set[str]], most: int) -> set[str]:
    out = {""}
    for p in parts:
        p = p if len(out) * len(p) <= most else {GAP}
        out = {a + b for a, b in product(out, p)}
    return out


def _runs(tree, most: int) -> set[str]:
    """What the parsed regex matches, as strings with gaps; never more than `most` of them, a gap asks for nothing."""
    parts: list[set[str]] = []
    for op, arg in tree:
        if op is C.LITERAL:
            parts.append({chr(arg)})
        elif op is C.IN and arg[0][0] is not C.NEGATE and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            parts.append({chr(a) for _, a in arg})
        elif op is C.SUBPATTERN:
            parts.append(_runs(arg[3], most))
        elif op is C.BRANCH:
            each = set().union(*(_runs(x, most) for x in arg[1]))
            parts.append(each if len(each) <= most else {GAP})
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            once = _runs(inner, most)
            if low == high and low <= 4:
                parts += [once] * low
            elif (low, high) == (0, 1):
                parts.append(once | {""})
            else:
                parts += [once, {GAP}, once] if low else [{GAP}]
        else:
            parts.append({GAP})
    return _joined(parts, most)


def trigram_query(regex: str, most: int = 256) -> list[frozenset[str]] | None:
    """Alternatives, each of trigrams that all stand in the lower-cased text of any match of it; None if one asks for
    none. Alternatives that ask for more than another one are left out."""
    each = {frozenset(run[i : i + 3] for run in x.lower().split(GAP) for i in range(len(run) - 2)) for x in _runs(_parser.parse(regex), most)}
    if frozenset() in each:
        return None
    return sorted((x for x in each if not any(y < x for y in each)), key=sorted)


def _table(spark: SparkSession, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*rows)))


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(gram, doc_id, t) for each of `trigrams` in the lower-cased text of each row."""
    low = F.lower("text")
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in trigrams)))
    return written(texts.select("doc_id", "t", F.explode(found).alias("gram")).sortWithinPartitions("gram"), "trigram-postings")


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, t, rules: the numbers of the rules whose trigram queries the row's text meets."""
    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.regex))}
    # At most 60 trigrams of an alternative are asked for, a bit each: asking for fewer only lets more be verified.
    terms = [(i, j, g, p, min(60, len(alternative))) for i, q in asked.items() for j, alternative in enumerate(q) for p, g in enumerate(sorted(alternative)[:60])]
    if not terms:
        return texts.limit(0).select("doc_id", "t", F.array().cast("array<int>").alias("rules"))
    index = postings(texts, sorted({g for _, _, g, _, _ in terms}))
    # As many rows as the rules have trigrams: a parameter, whatever the corpus.
    spec = _table(texts.sparkSession, [F.struct(F.lit(i).alias("rule"), F.lit(j).alias("alternative"), F.lit(g).alias("gram"), F.lit(1 << p).cast("long").alias("bit"), F.lit((1 << n) - 1).cast("long").alias("all")) for i, j, g, p, n in terms])
    met = index.join(F.broadcast(spec), "gram").groupBy("doc_id", "t", "rule", "alternative").agg(F.bit_or("bit").alias("has"), F.min("all").alias("all"))
    return met.where(F.col("has") == F.col("all")).groupBy("doc_id", "t").agg(F.collect_set("rule").alias("rules"))


def running(xs: Column, block: int = 512) -> Column:
    """For each number the sum of those before it: in blocks, so that long arrays are not copied for each element."""

    def before(x: Column, start: Column) -> Column:
        own = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, own, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, block))
    return F.flatten(F.zip_with(blocks, before(F.transform(blocks, total), F.lit(0)), before))


def spans_of(text: Column, rule: Column) -> Column:
    """The spans (start, kind, end) of a rule, a struct of kind, regex, group and least: between the matches stand the
    pieces of a split, so the lengths of both give the places, in code points."""
    found = F.regexp_extract_all(text, rule["regex"], F.lit(0))
    length = lambda xs: F.transform(xs, lambda x: F.length(x))
    told = F.struct(length(found).alias("whole"), length(F.slice(F.split(text, rule["regex"], -1), 1, F.greatest(F.size(found), F.lit(0)))).alias("gap"), length(F.regexp_extract_all(text, rule["regex"], rule["group"])).alias("inner"))

    def placed(x: Column) -> Column:
        at = running(F.zip_with(x["gap"], x["whole"], lambda g, w: g + w))
        start = lambda a, i: a + F.get(x["gap"], i)
        span = lambda a, i: F.struct(start(a, i).alias("start"), rule["kind"].alias("kind"), (start(a, i) + F.get(x["whole"], i)).alias("end"))
        kept = F.transform(at, lambda a, i: F.when(F.get(x["inner"], i) >= rule["least"], span(a, i)))
        return F.when(F.size(x["whole"]) > 0, F.array_compact(kept)).otherwise(F.array().cast(SPANS))

    return F.flatten(F.transform(F.array(told), placed))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row of `docs` under `row`, beside it `spans`: array<struct<start, kind, end>> by start, then the place of
    the kind in `rules`; code points, end exclusive.

    A null text has no spans, as an empty one. Rows that repeat a doc_id, or have none, are told apart by their texts;
    rows that repeat both get the same spans. Other columns go along in `row`, whatever their names. Each kind is
    matched by itself, so spans of different kinds may overlap.
    """
    for r in rules:
        re.compile(r.regex)
    own = row_key(docs, F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"))
    plain = [i for i, r in enumerate(rules) if not trigram_query(r.regex)]
    told = F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(r.regex).alias("regex"), F.lit(r.group).alias("group"), F.lit(r.least).alias("least")) for i, r in enumerate(rules)))
    found = candidates(own.where("text IS NOT NULL").select("doc_id", "t", "text"), rules)
    everywhere = F.array_compact(F.array(F.lit(None).cast("int"), *(F.when(F.col("text").rlike(rules[i].regex), F.lit(i)) for i in plain)))
    run = F.concat(F.coalesce("rules", F.array().cast("array<int>")), F.coalesce(everywhere, F.array().cast("array<int>")))
    t = own.join(found.hint("shuffle_hash"), ["doc_id", "t"], "left").select("row", "text", run.alias("run"))
    each = F.flatten(F.transform("run", lambda i: F.flatten(F.transform(F.slice(told, i + 1, 1), lambda r: spans_of(F.col("text"), r)))))
    t = t.select("row", "text", F.when(F.size("run") > 0, F.array_sort(each)).otherwise(F.array().cast(SPANS)).alias("spans"))
    cols = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    names = F.array(*(F.lit(r.kind) for r in rules))
    return t.select(F.struct(*cols).alias("row"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end"))).alias("spans"))


def digest(found: DataFrame, base: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """The columns of the contract from find_secrets()."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("row.doc_id", *map(count, base), F.sha2(text(own), 256).alias("base_sha256"), text("spans").alias("spans"))

"""Deterministic stand-ins for random choice: the order of a hash decides."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MASK = "___MASK___"
#: What may be masked, by language.
OPERATORS = re.compile(r"(?<![=!<>])(?:==|!=|<=|>=|&&|\|\||<<|>>|\+\+|--|[+\-*/%&|^~]|<(?!<)|>(?!>))(?![=])")
TYPES = {
    "cpp": ["int", "float", "double", "long", "short", "unsigned", "signed", "char", "bool", "void", "auto", "size_t"],
    "c": ["int", "float", "double", "long", "short", "unsigned", "signed", "char", "void", "size_t"],
    "java": ["int", "float", "double", "long", "short", "byte", "char", "boolean", "void", "String", "Object"],
    "go": ["int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "bool", "string", "byte", "rune"],
    "smt2": ["Int", "Real", "Bool", "BitVec", "Array"],
    "qiskit": ["int", "float", "complex", "bool", "str", "list", "dict", "tuple"],
}
NUMBERS = re.compile(r"\b\d+(?:\.\d+)?\b")


def gate_number(key: Column, seed: str) -> Column:
    """A number below 2^32 from a key, the same in any SQL dialect with md5."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("long")


def bernoulli(key: Column, percent: int, seed: str = "gate") -> Column:
    """F14, R5."""
    return gate_number(key, seed) % 100 < percent


def choice(key: Column, n: int, seed: str = "choice") -> Column:
    """One of 0 to n - 1."""
    return gate_number(key, seed) % n


def k_of_n(df: DataFrame, group: str, order: str, ratio: float, seed: str = "mask") -> DataFrame:
    """Of each group's n rows, max(1, floor(n * ratio)), by hash; back in their order with `picked`."""
    w = W.partitionBy(group).orderBy(gate_number(F.concat_ws(":", group, order), seed), order)
    n = F.count("*").over(W.partitionBy(group))
    return df.withColumn("picked", F.row_number().over(w) <= F.greatest(F.lit(1), F.floor(n * ratio)))


class MaskCandidates:
    """R2, O-D5 as a table function: start, end, token of all that may be masked in a program, one for each start."""

    def __init__(self):
        self.patterns: dict[str, list[re.Pattern]] = {}

    def eval(self, code: str, language: str) -> Iterator[tuple[int, int, str]]:
        if language not in self.patterns:
            words = re.compile(r"\b(?:" + "|".join(TYPES.get(language, TYPES["c"])) + r")\b")
            self.patterns[language] = {"smt2": [NUMBERS, words], "qiskit": []}.get(language, [OPERATORS, words])
        at: dict[int, tuple[int, str]] = {}
        for p in self.patterns[language]:
            for m in p.finditer(code or ""):
                at.setdefault(m.start(), (m.end(), m.group()))
        for s, (e, t) in sorted(at.items()):
            yield s, e, t


def mask_candidates(docs: DataFrame, language: str | Column = "cpp") -> DataFrame:
    """R2, O-D5: the columns of docs, code among them, and start, end, token of each candidate: a lateral join with an
    Arrow table function, so what is not asked for is pruned from either side."""
    found = F.udtf(MaskCandidates, returnType="start int, end int, token string", useArrow=True)
    named = F.lit(language) if isinstance(language, str) else language.outer()
    return docs.lateralJoin(found(F.col("code").outer(), named))


def mask(docs: DataFrame, ratio: float = 0.15, language: str = "cpp") -> DataFrame:
    """doc_id, masked, tokens: the picked candidates replaced, their texts in order."""
    found = k_of_n(mask_candidates(docs.select("doc_id", "code"), language).drop("code"), "doc_id", "start", ratio).where("picked")
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("spans"))
    joined = docs.select("doc_id", "code").join(spans, "doc_id", "left")
    step = F.aggregate(
        F.coalesce("spans", F.array()),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substr(F.col("code"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(MASK)).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(F.col("code"), acc["at"] + 1)),
    )
    return joined.select("doc_id", step.alias("masked"), F.coalesce(F.transform("spans", lambda x: x["token"]), F.array().cast("array<string>")).alias("tokens"))

"""Targets by language: what a program of each is cleaned, filtered and judged by."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import verdicts as V

LANGUAGES = ("cpp", "c", "qiskit", "smt2", "go", "java")


@dataclass(frozen=True)
class Target:
    """A language with its prompt ingredients; every method gives a Column."""

    language: str
    begin: str = ""
    separator: str = ""
    api: str | None = None
    ingredients: dict[str, str | None] = field(default_factory=dict)

    def wrap_prompt(self, c: Column) -> Column:
        return T.wrap_prompt(c, F.lit(self.language), self.separator, self.begin)

    def keep(self, c: Column) -> Column:
        if self.language == "smt2":
            return F.contains(c, F.lit("assert"))
        code = T.strip_c_comments(c) if self.language == "go" else c
        return T.promoted_text(code, F.lit(self.api).cast("string"), self.begin)

    def clean(self, c: Column) -> Column:
        if self.language == "cpp":
            return T.close_braces(T.mend_scaffold(T.strip_c_comments(c), self.begin))
        return T.clean(c, F.lit(self.language))

    def clean_code(self, c: Column) -> Column:
        return T.clean_code(c, F.lit(self.language), self.begin)

    def verdict(self, exit_code: Column, stderr: Column, timed_out: Column, retry_exit: Column | None = None) -> Column:
        if self.language == "qiskit":
            return V.crash_verdict(exit_code, stderr, "TranspilerError")
        return V.verdict(F.lit(self.language), exit_code, stderr, timed_out, retry_exit)


def make_target(language: str, **ingredients) -> Target:
    """An unknown language is an error."""
    if language not in LANGUAGES:
        raise ValueError(f"no target for {language!r}")
    return Target(language, ingredients.get("begin") or "", ingredients.get("separator") or "", ingredients.get("target_api"), ingredients)


def _parses(code: str) -> bool:
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _parsed(codes: pd.Series) -> pd.DataFrame:
    out = []
    for code in codes:
        code = code or ""
        shorter = "\n".join(code.split("\n")[:-1])
        out.append((True, code) if _parses(code) else (True, shorter) if _parses(shorter) else (False, shorter))
    return pd.DataFrame(out, columns=["ok", "code"])


def parsed(c: Column) -> Column:
    """V6: whether a Python program parses, as it is or without its last line, and the text that does."""
    return F.pandas_udf(_parsed, "struct<ok boolean, code string>")(c)

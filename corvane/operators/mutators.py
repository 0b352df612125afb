"""A fixed catalog of text mutators: total, deterministic Column functions from a program to a program."""

from __future__ import annotations

import signal
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import word
from corvane.operators.sampling import bernoulli, choice

Mutator = Callable[[Column], Column]
SMOKE = "int main() { return 0; }"


class TooSlow(Exception):
    pass


def guarded(f: Callable[[str], str], code: str, seconds: float) -> str | None:
    """f(code), or None if it fails, gives no text or takes longer than `seconds`."""

    def late(*_):
        raise TooSlow

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        out = f(code)
        return out if isinstance(out, str) else None
    except Exception:
        return None
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


class Registry:
    """Mutators by name, sorted; one is taken on only if it maps a smoke text to a text."""

    def __init__(self):
        self.known: dict[str, Mutator] = {}
        self.rule: dict[str, tuple[str, str]] = {}
        self.function: dict[str, Callable[[str], str]] = {}

    def add(self, name: str, f: Mutator, spark=None) -> bool:
        """the empty string is an acceptable result, null and failure are not."""
        if spark is not None:
            try:
                out = spark.range(1).select(f(F.lit(SMOKE)).alias("x"))
                if out.schema["x"].dataType.simpleString() != "string" or out.first()["x"] is None:
                    return False
            except Exception:
                return False
        self.known[name] = f
        return True

    def rules(self) -> list[tuple[str, str, str]]:
        """The mutators that are rules, by name: what they look for and what they put there."""
        return [(n, *self.rule[n]) for n in self.names() if n in self.rule]

    def add_rule(self, name: str, pattern: str, put: str, spark=None) -> bool:
        """A mutator as a pattern and its replacement; one that does not compile is not taken on."""
        taken = self.add(name, lambda c: F.regexp_replace(c, pattern, put), spark)
        if taken:
            self.rule[name] = (pattern, put)
        return taken

    def add_function(self, name: str, f: Callable[[str], str], seconds: float = 1.0) -> bool:
        """Any function from a text to a text. Where it fails, gives no text or takes longer than `seconds`, the
        row keeps its program; the other rows of its batch are not touched by that. One that fails on the smoke text is
        not taken on. It runs in batches, and only on the rows that it is chosen for."""
        if guarded(f, SMOKE, seconds) is None:
            return False

        @F.pandas_udf("string")
        def run(code: pd.Series) -> pd.Series:
            return pd.Series([None if c is None else guarded(f, c, seconds) for c in code], dtype=object)

        self.known[name] = run
        self.function[name] = f
        return True

    def save(self, spark, path: str) -> None:
        """K8: the rules as a table."""
        spark.createDataFrame(self.rules(), "name string, pattern string, put string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Registry:
        """The rules of a table in the order of their names, less those that are not acceptable."""
        r = cls()
        for row in spark.read.parquet(path).orderBy("name").toLocalIterator():
            r.add_rule(row["name"], row["pattern"], row["put"], spark)
        return r

    def names(self) -> list[str]:
        return sorted(self.known)

    def apply(self, code: Column, key: Column, percent: int = 20) -> Column:
        """To about `percent` of the rows one mutator chosen by the key's hash; an empty or null result
        leaves the program as it was."""
        names = self.names()
        if not names:
            return code
        at = choice(key, len(names), "mutator")
        out = F.lit(None).cast("string")
        for i, n in reversed(list(enumerate(names))):
            own = F.when(bernoulli(key, percent) & (at == i), code) if n in self.function else code
            out = F.when(at == i, self.known[n](own)).otherwise(out)
        return F.when(bernoulli(key, percent), F.coalesce(F.nullif(out, F.lit("")), code)).otherwise(code)


def builtin() -> Registry:
    r = Registry()
    r.add_rule("mutator_000", word("int"), "long")
    r.add_rule("mutator_001", "==", "!=")
    r.add_rule("mutator_002", word("for"), "while")
    r.add_rule("mutator_003", r"\z", "\n")
    return r

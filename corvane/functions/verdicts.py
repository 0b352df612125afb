"""Verdicts of program runs, as CASE expressions over (exit_code, stderr, timed_out, retry_exit)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the verdicts, fixed values.
CODES = {"SAFE": 1, "FAILURE": 2, "ERROR": 3, "LLM_WEAKNESS": 4, "TIMED_OUT": 10}
#: Linkers' words for a program without a main function.
NO_MAIN = "undefined reference to `main'"
LEVELS = {"INFO": 1, "TRACE": 2, "VERBOSE": 3}


def code_of(verdict: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), verdict)


def verdict(language: Column, exit_code: Column, stderr: Column, timed_out: Column, retry_exit: Column | None = None) -> Column:
    """V1-V5. A C or C++ program that only lacks a main is safe if it builds with an empty one."""
    late = F.coalesce(timed_out, F.lit(False))
    unreadable = stderr.isNull()
    c_family = language.isin("cpp", "c")
    mended = F.contains(stderr, F.lit(NO_MAIN)) & (retry_exit == 0) if retry_exit is not None else F.lit(False)
    return (
        F.when(late & c_family, "ERROR")
        .when(late, "TIMED_OUT")
        .when(unreadable & language.isin("c", "go", "smt2"), "FAILURE")
        .when((exit_code == 0), "SAFE")
        .when(language == "smt2", "FAILURE")
        .when((exit_code == 1) & c_family & F.coalesce(mended, F.lit(False)), "SAFE")
        .when(exit_code == 1, "FAILURE")
        .otherwise("ERROR")
    )


def crash_verdict(exit_code: Column, stderr: Column, marker: str) -> Column:
    """A clean exit is safe, stderr with the marker an error, anything else the program's failure."""
    return F.when(exit_code == 0, "SAFE").when(F.contains(F.coalesce(stderr, F.lit("")), F.lit(marker)), "ERROR").otherwise("FAILURE")


def differential_verdict(code: Column, left: Column, right: Column, needed: str = "qc.") -> Column:
    """V9: both sides must be there and equal."""
    return F.when(~F.contains(code, F.lit(needed)), "FAILURE").when(left.isNull() | right.isNull(), "ERROR").when(left == right, "SAFE").otherwise("ERROR")


def by_oracle(oracle: Column, crash: Column, diff: Column, metamorphic: Column) -> Column:
    """V7."""
    return F.when(oracle == "diff", diff).when(oracle.isin("metamorphic", "opt_and_qasm"), metamorphic).otherwise(crash)


def log_message(file: Column, verdict: Column, message: Column) -> Column:
    """K5: what is logged of a validation; failures and errors carry their message."""
    said = F.coalesce(message, F.lit(""))
    return (
        F.when(verdict == "SAFE", F.concat(file, F.lit(" is safe")))
        .when(verdict == "FAILURE", F.concat(file, F.lit(" failed validation with error message: "), said))
        .when(verdict == "ERROR", F.concat(file, F.lit(" has potential error!\nerror message:\n"), said))
        .when(verdict == "TIMED_OUT", F.concat(file, F.lit(" timed out")))
    )


def main_log(verdict: Column) -> Column:
    """Only errors go to the main log as well."""
    return verdict == "ERROR"


def main_log_message(file: Column) -> Column:
    """K5: what the main log says of an error."""
    return F.concat(file, F.lit(" has potential error!"))

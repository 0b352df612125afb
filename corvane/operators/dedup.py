"""Distinct rows under an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: Column, order: list[str], last: bool = False) -> DataFrame:
    """The first row of each key in the order of `order`, or the last. An aggregate, so a hot key is combined before
    the shuffle; null keys are dropped."""
    rank, row = F.struct(*order), F.struct(*df.columns)
    pick = F.max_by(row, rank) if last else F.min_by(row, rank)
    return df.withColumn("_key", key).where("_key IS NOT NULL").groupBy("_key").agg(pick.alias("_row")).select("_row.*")


def upsert(df: DataFrame, code: str, order: list[str]) -> DataFrame:
    """O-D1, K7: the last write of each content hash, with the hash as `id`."""
    return one_per_key(df, F.md5(code), order, last=True).withColumn("id", F.md5(code))


def first_reports(df: DataFrame, order: list[str]) -> DataFrame:
    """O-D2: the first report of each url, or title where the url is empty; neither, and it goes."""
    return one_per_key(df, F.coalesce(F.nullif("url", F.lit("")), F.nullif("title", F.lit(""))), order)


def distilled(df: DataFrame, fallbacks: DataFrame, at_least: int = 5) -> DataFrame:
    """F7, O-D3: distinct texts (pos, text) in order, unusable ones out, then fallbacks (pos, text) not among them
    until there are `at_least`."""
    good = df.where((F.col("text") != "") & ~F.upper("text").startswith("NO_TRANSLATION"))
    first = good.groupBy("text").agg(F.min("pos").alias("pos")).select("pos", "text", F.lit(0).alias("source"))
    n = first.agg(F.count("*").alias("n"))
    more = fallbacks.groupBy("text").agg(F.min("pos").alias("pos")).join(first.select("text"), "text", "left_anti")
    # fallbacks are a short fixed list, so one task ranks them
    ranked = more.select("pos", "text", F.lit(1).alias("source"), F.expr("row_number() OVER (ORDER BY pos)").alias("r"))
    padded = ranked.crossJoin(F.broadcast(n)).where(F.col("r") <= at_least - F.col("n"))  # n is one row
    return first.unionByName(padded.select("pos", "text", "source"))


def ordered_distinct(arrays: Column) -> Column:
    """O-D4: the texts of an array of arrays, each once, in order of first occurrence."""
    return F.array_distinct(F.flatten(arrays))

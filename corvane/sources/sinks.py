"""Writers of program corpora and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.dedup import upsert


def append_programs(programs: DataFrame, path: str) -> None:
    """K1: programs as rows under their ids, not as a file each."""
    programs.select("run", "id", "code").write.mode("append").parquet(path)


def merge_seeds(store_path: str, new: DataFrame, out_path: str) -> DataFrame:
    """K7: the store with new seeds (code, meta, seq) over it, last write wins, as a new version at out_path."""
    spark = new.sparkSession
    both = spark.read.parquet(store_path).select("code", "meta", "seq").unionByName(new.select("code", "meta", "seq"))
    upsert(both, "code", ["seq"]).write.mode("errorifexists").parquet(out_path)
    return spark.read.parquet(out_path)


def log_table(validations: DataFrame, path: str, most: int = 3) -> None:
    """K4: log lines up to a level."""
    from corvane.functions.verdicts import LEVELS

    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    validations.where(F.try_element_at(level, F.col("level")) <= most).select("level", "message").write.mode("append").parquet(path)

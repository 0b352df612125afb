"""Model calls as tables: a prompt's response is looked up, or an injected function gives it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def respond(prompts: DataFrame, prompt: str, responses: DataFrame) -> DataFrame:
    """U4: prompts with `response` from a table (prompt_md5, response); null where there is none. Where the table
    repeats a prompt the greatest response is taken."""
    one = responses.groupBy("prompt_md5").agg(F.max("response").alias("response"))
    return prompts.withColumn("prompt_md5", F.md5(prompt)).join(one, "prompt_md5", "left").drop("prompt_md5")


def respond_with(prompts: DataFrame, prompt: str, ask: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """U4 with a function from a batch of prompts to their responses."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(response=ask(f[prompt]))

    return prompts.mapInPandas(run, prompts.select("*", F.lit("").alias("response")).schema)

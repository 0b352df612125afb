"""Structured Streaming forms of the operators that keep state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gate_stream(verdicts: DataFrame, window: int = 50, threshold: float = 0.30) -> DataFrame:
    """Rows (run, seq, ok) to (run, seq, active). State: the last `window` results of a run."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        for f in frames:
            out = []
            for seq, ok in sorted(zip(f["seq"], f["ok"])):
                last = [*last, bool(ok)][-window:]
                out.append((key[0], seq, len(last) == window and sum(last) / window < threshold))
            yield pd.DataFrame(out, columns=["run", "seq", "active"])
        state.update((last,))

    return verdicts.groupBy("run").applyInPandasWithState(step, "run long, seq long, active boolean", "last array<boolean>", "append", GroupStateTimeout.NoTimeout)


def streak_stream(records: DataFrame) -> DataFrame:
    """Rows (branch, seq, hit, source, and cleared if there) to the branch's misses and last writer after each
    micro-batch. A row that clears starts the misses anew and keeps the writer."""
    clears = "cleared" in records.columns

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        misses, source = state.get if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values(["seq", "hit"], ascending=[True, False])
        for hit, src, clear in zip(rows["hit"], rows["source"], rows["cleared"] if clears else [False] * len(rows)):
            if clear:
                misses = 0
            else:
                misses, source = 0 if hit else misses + 1, src
        state.update((int(misses), source))
        yield pd.DataFrame([(key[0], misses, source)], columns=["branch", "misses", "source"])

    return records.groupBy("branch").applyInPandasWithState(step, "branch long, misses long, source string", "misses long, source string", "update", GroupStateTimeout.NoTimeout)


def carry_stream(programs: DataFrame) -> DataFrame:
    """Rows (run, seq, keep, code) to (run, seq, previous), the last kept code before each. State: that code."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, keep, code in zip(rows["seq"], rows["keep"], rows["code"]):
            out.append((key[0], seq, last))
            last = code if keep else last
        state.update((last,))
        yield pd.DataFrame(out, columns=["run", "seq", "previous"])

    return programs.groupBy("run").applyInPandasWithState(step, "run long, seq long, previous string", "last string", "append", GroupStateTimeout.NoTimeout)


def first_seen_stream(programs: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """O-D1 as the stream goes: each content once within the watermark."""
    return programs.withColumn("id", F.md5("code")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


def counts_stream(events: DataFrame, time: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Tumbling counts of verdicts."""
    w = events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "verdict").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "verdict", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """What has arrived, once; exactly once across restarts by the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()

"""W1-W4, W9 on transformWithState: list, map and value state of the RocksDB store, with time to live and a start from
a batch table.

Rows of a micro-batch are taken in the order of `seq`; a row that comes in a later batch than one after it is taken when
it comes. With a time to live batches come without rows too, so such a stream takes a trigger of time or `once`, as
under `availableNow` it would not end."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(frames: Iterator[pd.DataFrame], by: list[str], ascending: list[bool]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, ascending=ascending, kind="stable")


class Gate(StatefulProcessor):
    """List state: the last `window` results of a run."""

    def __init__(self, window: int, threshold: float, ttl: int | None):
        self.window, self.threshold, self.ttl = window, threshold, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "ok boolean", self.ttl)

    def _put(self, results: list[bool]) -> None:
        self.last.put([(bool(x),) for x in results[-self.window :]])

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._put([x for (x,) in self.last.get()] + initialState.sort_values("seq")["ok"].tolist())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = [x for (x,) in self.last.get()]
        out = []
        f = _ordered(rows, ["seq"], [True])
        for seq, ok in zip(f["seq"], f["ok"]):
            last = [*last, bool(ok)][-self.window :]
            out.append((key[0], seq, len(last) == self.window and sum(last) / self.window < self.threshold))
        self._put(last)
        yield pd.DataFrame(out, columns=["run", "seq", "active"])

    def close(self) -> None:
        pass


class Streaks(StatefulProcessor):
    """Map state: of each branch of a run its misses and who wrote last."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.branches = handle.getMapState("branches", "branch long", "misses long, source string", self.ttl)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for branch, misses, source in zip(initialState["branch"], initialState["misses"], initialState["source"]):
            self.branches.updateValue((int(branch),), (int(misses), source))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        f = _ordered(rows, ["seq", "hit"], [True, False])
        now: dict[int, tuple[int, str | None]] = {}
        for branch, hit, source, cleared in zip(f["branch"], f["hit"], f["source"], f["cleared"]):
            branch = int(branch)
            if branch not in now:
                now[branch] = self.branches.getValue((branch,)) if self.branches.containsKey((branch,)) else (0, None)
            misses, wrote = now[branch]
            now[branch] = (0, wrote) if cleared else (0 if hit else misses + 1, source)
        for branch, value in now.items():
            self.branches.updateValue((branch,), (int(value[0]), value[1]))
        yield pd.DataFrame([(key[0], b, m, s) for b, (m, s) in now.items()], columns=["run", "branch", "misses", "source"])

    def close(self) -> None:
        pass


class Carry(StatefulProcessor):
    """Value state: the last kept code of a run."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.code = handle.getValueState("code", "code string", self.ttl)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.code.update((initialState["code"].iloc[-1],))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.code.get()[0] if self.code.exists() else None
        out = []
        f = _ordered(rows, ["seq"], [True])
        for seq, keep, code in zip(f["seq"], f["keep"], f["code"]):
            out.append((key[0], seq, last))
            last = code if keep else last
        if last is not None:
            self.code.update((last,))
        yield pd.DataFrame(out, columns=["run", "seq", "previous"])

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, processor: StatefulProcessor, schema: str, mode: str, ttl: int | None, initial: DataFrame | None) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    start = None if initial is None else initial.groupBy("run")
    return rows.groupBy("run").transformWithStateInPandas(processor, schema, mode, "ProcessingTime" if ttl else "None", start)


def gate(verdicts: DataFrame, window: int = 50, threshold: float = 0.30, initial: DataFrame | None = None, ttl: int | None = None) -> DataFrame:
    """Rows (run, seq, ok) to (run, seq, active). `initial`: a batch table of the results before (run, seq, ok), of
    which the last `window` of a run count; `ttl`: milliseconds after which a run's results are forgotten."""
    return _stateful(verdicts.select("run", "seq", "ok"), Gate(window, threshold, ttl), "run long, seq long, active boolean", "append", ttl, initial)


def streaks(records: DataFrame, initial: DataFrame | None = None, ttl: int | None = None) -> DataFrame:
    """Rows (run, branch, seq, hit, source, cleared) to the misses and last writer of each branch that a micro-batch
    touches, (run, branch, misses, source); hits of a record come before its misses, and a row that clears starts the
    misses anew. `initial`: such rows from before."""
    return _stateful(records.select("run", "branch", "seq", "hit", "source", "cleared"), Streaks(ttl), "run long, branch long, misses long, source string", "update", ttl, initial)


def carry(programs: DataFrame, initial: DataFrame | None = None, ttl: int | None = None) -> DataFrame:
    """Rows (run, seq, keep, code) to (run, seq, previous), the last kept code before each. `initial`: (run, code)."""
    return _stateful(programs.select("run", "seq", "keep", "code"), Carry(ttl), "run long, seq long, previous string", "append", ttl, initial)

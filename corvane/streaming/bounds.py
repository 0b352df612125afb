"""A run that ends at a number of programs or after a time, looked at before each batch, so it overshoots by one
batch at most."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

BatchFunction = Callable[[DataFrame, int], None]
#: What a batch that comes too late fails with; it is not committed, and a later run takes it up.
ENOUGH = "the run has reached its bounds"


class Bounded:
    """A foreachBatch function that runs `handle` until `most` rows have come or `hours` are over."""

    def __init__(self, handle: BatchFunction, most: int | None = None, hours: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.handle, self.most, self.hours, self.clock = handle, most, hours, clock
        self.began, self.rows, self.batches = clock(), 0, 0

    def reached(self) -> bool:
        late = self.hours is not None and self.clock() - self.began >= self.hours * 3600
        return late or (self.most is not None and self.rows >= self.most)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.reached():
            raise RuntimeError(ENOUGH)
        n = batch.count()
        self.handle(batch, batch_id)
        self.rows, self.batches = self.rows + n, self.batches + 1


class Watch(StreamingQueryListener):
    """Tells of the batches of a run, and when it has reached its bounds or ended."""

    def __init__(self, bounded: Bounded):
        self.bounded, self.over, self.progress = bounded, threading.Event(), []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.progress.append((event.progress.batchId, event.progress.numInputRows))
        if self.bounded.reached():
            self.over.set()

    def onQueryIdle(self, event) -> None:
        if self.bounded.reached():
            self.over.set()

    def onQueryTerminated(self, event) -> None:
        self.over.set()


def run_bounded(stream: DataFrame, bounded: Bounded, checkpoint: str, every: str = "0 seconds") -> StreamingQuery:
    """Start a stream and stop it when `bounded` is reached, be it between batches; other failures are raised."""
    spark, watch = stream.sparkSession, Watch(bounded)
    spark.streams.addListener(watch)
    query = stream.writeStream.foreachBatch(bounded).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        while query.isActive and not bounded.reached():
            watch.over.wait(0.2)
            watch.over.clear()
        query.stop()
    finally:
        spark.streams.removeListener(watch)
    if query.exception() is not None and ENOUGH not in str(query.exception()):
        raise query.exception()
    return query

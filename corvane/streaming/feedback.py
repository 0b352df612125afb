"""W8 and K5 by micro-batch: what a batch of results changes, kept by batch id, so that a batch that comes again changes
nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.verdicts import log_message, main_log, main_log_message
from corvane.operators import islands as I
from corvane.operators.history import rolling_gate
from corvane.sources.store import SeedStore

RESULTS = "run long, seq long, verdict string, code string, language string, file string, message string"
TABLES = {"gate": "run long, seq long, active boolean", "tail": "run long, seq long, ok boolean", "islands": I.POPULATION, "log_validation": "level string, message string", "log": "level string, message string"}


@dataclass
class Feedback:
    """For writeStream.foreachBatch: results (RESULTS, and vec unless the store embeds) go through the gate, into the islands, what is safe into the seed
    store, and what is logged into two logs.

    Each table has a folder for each batch. A batch reads the state that the batch before it left, writes all its
    folders over, and is marked as done at last; a batch that is marked is passed over. One that was broken off is done
    again from the same state, and seeds are upserted, so it ends as if it had come once. Results of a run come in the
    order of their iterations."""

    spark: SparkSession
    path: str
    store: SeedStore | None = None
    islands: int = 8
    interval: int = 50
    window: int = 50
    threshold: float = 0.30

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def done(self) -> list[int]:
        """The batches that are whole."""
        if not self._exists(f"{self.path}/done"):
            return []
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        names = [s.getPath().getName() for s in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and self._exists(f"{self.path}/done/{n}/_SUCCESS"))

    def _of(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def _state(self, table: str, batch: int | None) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[table]) if batch is None else self.spark.read.schema(TABLES[table]).parquet(self._of(table, batch))

    def table(self, name: str) -> DataFrame:
        """gate, log_validation and log of all whole batches; islands and tail as the last one left them."""
        done = self.done()
        if name in ("islands", "tail") or not done:
            return self._state(name, done[-1] if done else None)
        return self.spark.read.schema(TABLES[name]).parquet(*[self._of(name, b) for b in done])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        done = self.done()
        if batch_id in done:
            return
        before = max((b for b in done if b < batch_id), default=None)
        cols = [x.split()[0] for x in RESULTS.split(", ")]
        r = batch.select(*cols, *[c for c in batch.columns if c == "vec"]).withColumn("ok", F.coalesce(F.col("verdict") == "SAFE", F.lit(False))).persist()
        write = lambda df, name: df.write.mode("overwrite").parquet(self._of(name, batch_id))
        tail = self._state("tail", before)
        both = tail.withColumn("_new", F.lit(False)).unionByName(r.select("run", "seq", "ok").withColumn("_new", F.lit(True)))
        write(rolling_gate(both, "run", "seq", F.col("ok"), self.window, self.threshold).where("_new").select("run", "seq", "active"), "gate")
        late = F.row_number().over(W.partitionBy("run").orderBy(F.desc("seq")))
        write(both.withColumn("_rn", late).where(F.col("_rn") < self.window).select("run", "seq", "ok"), "tail")
        write(I.evolved(r, self.islands, self.interval, population=self._state("islands", before)), "islands")
        if self.store is not None:
            meta = F.create_map(F.lit("language"), F.col("language"), F.lit("iteration"), F.col("seq").cast("string"), F.lit("island_id"), (F.col("seq") % self.islands).cast("string"))
            self.store.add(r.where("ok AND code IS NOT NULL").select("code", meta.alias("meta"), "seq", "language", *([F.col("vec")] if "vec" in r.columns else [])))
        level = F.lit("VERBOSE").alias("level")
        write(r.select(level, log_message(F.col("file"), F.col("verdict"), F.col("message")).alias("message")).where("message IS NOT NULL"), "log_validation")
        write(r.where(main_log(F.col("verdict"))).select(level, main_log_message(F.col("file")).alias("message")), "log")
        write(self.spark.range(1), "done")
        r.unpersist()

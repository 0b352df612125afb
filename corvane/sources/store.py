"""The seed store: programs with their vectors as Parquet tables, in buckets by content and folders by language."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.dedup import upsert
from corvane.operators.vector_index import VectorIndex

Embed = Callable[[pd.Series], list[list[float]]]
SCHEMA = "vec_id long, code string, vec array<float>, meta map<string,string>, seq long"
MANIFEST = "bucket int, version string, n long, buckets int"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of our own in the folder that the cluster shares, deleted when the driver ends: in spark.checkpoint.dir, or
    where that is unset in the warehouse, unless this is a folder of the driver's machine that executors do not see."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.conf.get("spark.sql.warehouse.dir")
        if place.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{place}/corvane-{name}-{uuid.uuid4().hex}"

    def drop(jvm=spark._jvm, conf=spark._jsc.hadoopConfiguration()):
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may be gone by then
            pass

    atexit.register(drop)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a path of our own: it is worked out once, and lost executors do not lose it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def embedded(df: DataFrame, text: str, embed: Embed) -> DataFrame:
    """`vec` by an injected function from a batch of texts to their vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(vec=list(embed(f[text])))

    return df.mapInPandas(run, df.select("*", F.lit(None).cast("array<float>").alias("vec")).schema)


@dataclass
class SeedStore:
    """Opened where there is one, else created with the first seeds. Without a path or a way to get vectors it is
    disabled: it takes nothing and gives nothing.

    Seeds lie in buckets by the first digits of md5(code). A version is a manifest that says in which version's folder
    each bucket lies, so adding seeds rewrites only the buckets they fall in, and readers of an older version are not
    disturbed. `buckets` counts for a new store; an old one has its own."""

    spark: SparkSession
    path: str | None
    embed: Embed | None = None
    buckets: int = 64

    @property
    def enabled(self) -> bool:
        return bool(self.path)

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def versions(self) -> list[str]:
        """Names of the whole versions, in order."""
        if not self.enabled or not self._exists(f"{self.path}/manifests"):
            return []
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)]
        return sorted(n for n in names if n.startswith("v") and self._exists(f"{self.path}/manifests/{n}/_SUCCESS"))

    def manifest(self, version: str | None = None) -> dict[int, tuple[str, int]]:
        """Of each bucket that has seeds the version whose folder holds it, and how many; that of the newest version
        unless another one is named."""
        found = [version] if version else self.versions()[-1:]
        if not found:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{found[0]}").collect()  # a row a bucket
        self.buckets = rows[0]["buckets"] if rows else self.buckets
        return {r["bucket"]: (r["version"], r["n"]) for r in rows}

    def _read(self, parts: dict[int, tuple[str, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], f"{SCHEMA}, language string")
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, (v, _) in sorted(parts.items())]
        t = self.spark.read.schema(f"{SCHEMA}, version string, bucket int, language string").option("basePath", f"{self.path}/data").parquet(*folders)
        return t.drop("version", "bucket")

    def seeds(self, language: str | None = None, version: str | None = None) -> DataFrame:
        """All seeds, or those of a language, whose folders alone are read then."""
        t = self._read(self.manifest(version))
        return t.where(F.col("language") == language) if language else t

    def count(self) -> int:
        """A3, from the manifest."""
        return sum(n for _, n in self.manifest().values())

    def add(self, new: DataFrame) -> int:
        """K7: new seeds (code, meta, seq, language, and vec unless the store embeds) over the old, the last write of a
        program winning. The number of seeds then."""
        if not self.enabled or ("vec" not in new.columns and self.embed is None):
            return 0
        if "vec" not in new.columns:
            new = embedded(new, "code", self.embed)
        cols = ["code", "vec", "meta", "seq", "language"]
        old, found = self.manifest(), self.versions()
        own = F.pmod(F.conv(F.substring(F.md5("code"), 1, 6), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")
        new = kept(new.select(*cols, own.alias("bucket")), "new-seeds")
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        if not touched:
            return self.count()
        both = new.select(cols).unionByName(self._read({b: p for b, p in old.items() if b in touched}).select(cols))
        out = upsert(both, "code", ["seq"]).withColumn("vec_id", F.xxhash64("code")).select("vec_id", "code", "vec", "meta", "seq", "language", own.alias("bucket"))
        name = f"v{len(found):06d}-{uuid.uuid4().hex[:8]}"
        out.repartition("bucket").write.partitionBy("bucket", "language").parquet(f"{self.path}/data/version={name}")
        n = self.spark.read.schema(f"{SCHEMA}, bucket int, language string").parquet(f"{self.path}/data/version={name}").groupBy("bucket").count().collect()
        rows = {b: p for b, p in old.items() if b not in touched} | {r["bucket"]: (name, r["count"]) for r in n}
        self.spark.createDataFrame([(b, v, c, self.buckets) for b, (v, c) in rows.items()], MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        return sum(c for _, c in rows.values())

    def index(self, language: str | None = None) -> VectorIndex:
        """The vector index of the newest version, made when it is first asked for."""
        path = f"{self.path}/index/{self.versions()[-1]}/{'of-' + language if language else 'all'}"
        if self._exists(f"{path}/cells/_SUCCESS"):
            return VectorIndex(self.spark, path)
        return VectorIndex.build(self.seeds(language).select("vec_id", "vec"), path)

    def similar(self, queries: DataFrame, n: int = 3, language: str | None = None) -> DataFrame:
        """O-K6 over the store: query_id, code, score, rank of the n seeds nearest to each query (query_id, and vec, or
        text if the store embeds)."""
        if "vec" not in queries.columns and self.embed is not None:
            queries = embedded(queries, "text", self.embed)
        if not self.versions() or "vec" not in queries.columns:
            return self.spark.createDataFrame([], "query_id long, code string, score double, rank int")
        found = self.index(language).search(queries, n).rows
        return found.join(self.seeds(language).select("vec_id", "code"), "vec_id").select("query_id", "code", "score", "rank")

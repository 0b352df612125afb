"""What the operators share: reading tables, shared folders, word hashes and digests."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id while rows are joined.
NO_ID = -(2**63)

#: ASCII white space, the delimiters of [^\x20\x09-\x0D]+, is what bytes.split() splits at.
#: For words of letters and digits: A-Z lower-cased, other ASCII made a space.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: For lower-casing A-Z alone.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset, as in tests, a folder in
    the warehouse, unless this is on the driver's machine and executors are elsewhere."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/corvane-shared"


def _delete(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM may be gone by then
        pass


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and lost executors do not lose it. It goes when the
    driver ends, or before that by discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    atexit.register(_delete, jvm, conf, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    spark = df.sparkSession
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), df._corvane_path)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n", most: int = 1000) -> DataFrame:
    """left joined with right, whose keys are unique and whose `n` tells how many rows of left each key has at least
    in proportion. Keys with a `most`-th of the sum of n or more are broadcast, `most` rows at most; the rest is shuffled."""
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.coalesce(F.col(n), F.lit(0)) * most >= max(total, most)
    marked = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(right.where(~hot), keys)
    return left.join(marked, keys).unionByName(rest)


def with_key(df: DataFrame, id_col: str, *cols: tuple[str, str]) -> DataFrame:
    """Only the id, never null, and the named columns under names of our own."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), *(F.col(c).alias(n) for c, n in cols))


def row_key(df: DataFrame, *cols: Column) -> DataFrame:
    """doc_id, never null, and t, a hash of the text: together they tell rows apart, but for rows that repeat both and
    so have the same text. Beside them text and other columns as given."""
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t"), F.col("text").alias("text"), *cols)


def id_out(c: str = "doc_id") -> Column:
    return F.when(F.col(c) != NO_ID, F.col(c)).alias(c)


_memory: list = [("", lambda: None)]


def take_memory(owner: str, release: Callable[[], None]) -> None:
    """What a worker remembers for one kind of work is let go when it turns to another: workers live for many stages,
    and what they keep adds up."""
    if _memory[0][0] != owner:
        _memory[0][1]()
        _memory[0] = (owner, release)


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered for up to `most` words at a time."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    take_memory("hashes", HASHES.clear)
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k units, from the units' hashes; empty if there are fewer."""
    n = w.size - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _M[0] + w[i : i + n]
    return mix(h)


def gram_hashes_of(rows: np.ndarray) -> np.ndarray:
    """gram_hashes of each row as one gram."""
    h = np.zeros(rows.shape[0], np.uint64)
    for i in range(rows.shape[1]):
        h = h * _M[0] + rows[:, i]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

"""Benchmark decontamination by winnowing.

Of the k-gram hashes in every window of a benchmark item and of a document the smallest is kept. A shared window has
the same smallest gram in both, so joining the two sets of fingerprints misses no shared window; around each joined
fingerprint the hits are extended to the exact windows. The benchmark is a stated query set: it is read in blocks of
bounded size, each broadcast to all documents, and a larger benchmark takes more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ALNUM_TABLE, gram_hashes, gram_hashes_of, id_out, text_bytes, with_key, word_hashes, written
from corvane.llm.repeats import slices

GRAM = 5
#: Blocks that rows pass before they are written, as each has a worker with its fingerprints.
BLOCKS_AT_ONCE = 4


def item_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased."""
    return text.translate(ALNUM_TABLE).split()


def fingerprints(g: np.ndarray, v: int) -> np.ndarray:
    """Places of the leftmost smallest of each v neighbouring gram hashes, in order, each once."""
    n = g.size - v + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(n)
    for i in range(1, v):
        best = np.where(g[i : i + n] < g[best], np.arange(i, i + n), best)
    return best[np.append(True, best[1:] != best[:-1])]


class Block:
    """Fingerprints and windows of some items. Items of fewer than w words are one window of their own length."""

    def __init__(self, items: list[tuple[str, bytes]], w: int, k: int):
        self.w, self.k, self.v = w, k, w - k + 1
        marks: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.ids = [i for i, _ in items]
        for j, (_, text) in enumerate(items):
            words = word_hashes(item_words(text))
            if not words.size:
                continue
            size = min(w, words.size)
            found.setdefault(size, []).append((gram_hashes(words, size), j))
            if size == w:
                g = gram_hashes(words, k)
                marks.append(g[fingerprints(g, self.v)])
        self.marks = np.unique(np.concatenate(marks)) if marks else np.empty(0, np.uint64)
        self.windows = {}
        for size, pairs in found.items():
            h = np.concatenate([x for x, _ in pairs])
            j = np.concatenate([np.full(x.size, i) for x, i in pairs])
            o = np.argsort(h, kind="stable")
            self.windows[size] = h[o], j[o]

    def items_at(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are windows of that size, and the items that have any of them."""
        known, item = self.windows[size]
        at = np.searchsorted(known, h)
        hit = known[np.minimum(at, known.size - 1)] == h
        own = np.unique(h[hit])
        lo, hi = np.searchsorted(known, own), np.searchsorted(known, own, side="right")
        return hit, np.unique(np.concatenate([item[x:y] for x, y in zip(lo, hi)])) if own.size else np.empty(0, np.int64)

    def hits(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Hit marks over the words of several texts, and (text, items) of those with hits."""
        n = words.size
        text = np.repeat(np.arange(ends.size), np.diff(ends, prepend=0))
        step, by_text = np.zeros(n + 1, np.int64), {}
        for size in self.windows:
            if n < size:
                continue
            if size == self.w:
                g = gram_hashes(words, self.k)
                f = fingerprints(g, self.v)
                at = np.minimum(np.searchsorted(self.marks, g[f]), max(0, self.marks.size - 1))
                f = f[self.marks[at] == g[f]] if self.marks.size else f[:0]
                # every window that holds a joined fingerprint
                s = np.unique((f[:, None] - np.arange(self.v)[None, :]).ravel())
                s = s[(s >= 0) & (s <= n - size)]
            else:
                s = np.arange(n - size + 1)
            s = s[text[s] == text[s + size - 1]]
            if not s.size:
                continue
            h = gram_hashes(words, size)[s] if s.size > n // 8 else gram_hashes_of(words[s[:, None] + np.arange(size)[None, :]])
            known = self.windows[size][0]
            s, h = (x[known[np.minimum(np.searchsorted(known, h), known.size - 1)] == h] for x in (s, h))
            np.add.at(step, s, 1)
            np.add.at(step, s + size, -1)
            owner = text[s]
            for t in np.unique(owner).tolist():
                by_text.setdefault(t, []).append(self.items_at(h[owner == t], size)[1])
        return np.cumsum(step[:-1]) > 0, [(t, np.unique(np.concatenate(x))) for t, x in sorted(by_text.items())]


HITS = "doc_id long, n_words long, hit array<struct<start:int,end:int>>, items array<string>"
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(docs: DataFrame, block, last: bool) -> DataFrame:
    """docs: doc_id, text, hit, items. The same rows with this block's hits and items beside those that they have;
    after the last block with n_words in place of the text."""
    names = ["doc_id", "n_words" if last else "text", "hit", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                words = [item_words(t) for t in text_bytes(part.column(1))]
                ends = np.cumsum([len(x) for x in words])
                hit, items = b.hits(np.concatenate([word_hashes(x) for x in words]), ends)
                spans, named = part.column(2).to_pylist(), part.column(3).to_pylist()
                for t, ids in items:
                    s, e = int(ends[t - 1]) if t else 0, int(ends[t])
                    for x in spans[t]:
                        hit[s + x["start"] : s + x["end"]] = True
                    d = np.diff(np.concatenate(([0], hit[s:e].astype(np.int8), [0])))
                    spans[t] = [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1))]
                    named[t] = sorted({*named[t], *(b.ids[j] for j in ids)})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends, prepend=0)) if last else part.column(1), pa.array(spans, SPAN), pa.array(named, pa.list_(pa.string()))], names)

    return docs.mapInArrow(run, HITS if last else HITS.replace("n_words long", "text string"))


def _blocks(benchmark: DataFrame, w: int, block_bytes: int) -> Iterator:
    """The benchmark's items as broadcast blocks of bounded size."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    share = benchmark.sparkSession.sparkContext.broadcast
    now: list[tuple[str, bytes]] = []
    size = 0
    for r in items.toLocalIterator():
        text = r["text"].encode()
        if now and size + len(text) > block_bytes:
            yield share(Block(now, w, min(GRAM, w)))
            now, size = [], 0
        now.append((r["id"], text))
        size += len(text) + 100
    yield share(Block(now, w, min(GRAM, w)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, w: int = 10, block_bytes: int = 32_000_000) -> DataFrame:
    """The rows of docs without any hit of decontaminate(), with all their columns; each block filters in turn."""
    at = docs.columns.index("text")
    for passed, block in enumerate(_blocks(benchmark, w, block_bytes)):
        if passed and passed % BLOCKS_AT_ONCE == 0:
            docs = written(docs, "winnowed")

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            b = block.value
            for batch in batches:
                for lo, hi in slices(batch.column(at)):
                    part = batch.slice(lo, hi - lo)
                    words = [item_words(t) for t in text_bytes(part.column(at))]
                    hit = b.hits(np.concatenate([word_hashes(x) for x in words]), np.cumsum([len(x) for x in words]))[1]
                    clean = np.ones(len(words), bool)
                    clean[[t for t, _ in hit]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, w: int = 10, block_bytes: int = 32_000_000) -> DataFrame:
    """doc_id, n_words, hit (spans of hit words), items (ids of items with occurring windows, sorted as strings), of
    every row of docs.

    A window is w consecutive words of an item, or the whole of an item of fewer; a word inside any occurrence of one
    is hit. Null texts have no words; items without words occur nowhere. Items that repeat an id are one item with
    the windows of all. A null item id counts as an empty string. The benchmark is fetched by blocks of at most
    block_bytes, whole items each; an item alone may be longer. Rows pass the blocks one after another and stay rows,
    whatever their ids and the number of blocks. Other columns are ignored.
    """
    hit, items = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    out = with_key(docs, "doc_id", ("text", "text")).withColumn("hit", hit).withColumn("items", items)
    blocks = iter(_blocks(benchmark, w, block_bytes))
    now, passed = next(blocks), 0
    while now is not None:
        then = next(blocks, None)
        out, passed = _scan(out, now, last=then is None), passed + 1
        if then is not None and passed % BLOCKS_AT_ONCE == 0:
            out = written(out, "winnowed")
        now = then
    return out.withColumn("doc_id", id_out())


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of decontaminate()'s rows."""
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

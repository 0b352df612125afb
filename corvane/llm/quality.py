"""Quality rules and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are counted for each order: the trusted target, documents labelled good (quality
1, toxic 0), and the raw corpus, every document. Each word of a document has the log ratio of the two for the n-grams
that start there, orders weighted; a document's score is their mean over all its words plus their mean over its worst
`window` words, so that a few bad words weigh as much in a long document as in a short one. It is kept if its base
rules hold and the score reaches the threshold. Raw counts cover all documents. What is learnt from labels comes from a
sample of at most `most_labels` labelled ids, the smallest by hash: one half makes the target, the other half fixes the
threshold, where the share of bad documents caught less `caution` times the share of good ones lost is largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import gram_hashes, id_out, mix, text_bytes, with_key, word_hashes
from corvane.llm.repeats import slices

SPACES = b" \t\n\v\f\r"
NOT_WORD_CHARS = SPACES + bytes(range(0x80, 0xC0))  # continuation bytes are no code points of their own
SYMBOLS = b"#*$%&|<>"


class Texts:
    """Word hashes of several texts, one after another, and the texts' ends among them."""

    def __init__(self, texts: list[bytes]):
        words = [t.split() for t in texts]
        self.texts = texts
        self.ends = np.cumsum([len(x) for x in words])
        self.hashes = np.concatenate([word_hashes(x) for x in words]) if words else np.empty(0, np.uint64)
        self.n = np.diff(self.ends, prepend=0)
        self.owner = np.repeat(np.arange(len(texts)), self.n)

    def sums(self, per_word: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.owner if owner is None else owner, per_word, len(self.texts))

    def buckets(self, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash bucket and place, its first word's, of every n-gram of an order."""
        h = mix(self.hashes) if order == 1 else gram_hashes(self.hashes, order)
        at = np.flatnonzero(self.owner[: h.size] == self.owner[order - 1 : order - 1 + h.size])
        return (h[at] >> np.uint64(64 - bits)).astype(np.int64), at

    def repeated_words(self, k: int = 3) -> np.ndarray:
        g = gram_hashes(self.hashes, k)
        inside = self.owner[: g.size] == self.owner[k - 1 : k - 1 + g.size]
        at = np.flatnonzero(inside)
        key = g[at] ^ mix(self.owner[at].astype(np.uint64) + np.uint64(1))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        at = at[count[which] > 1]
        step = np.zeros(self.hashes.size + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + k, -1)
        return self.sums(np.cumsum(step[:-1]) > 0).astype(np.int64)

    def base(self) -> dict[str, np.ndarray]:
        chars = np.array([len(t.translate(None, NOT_WORD_CHARS)) for t in self.texts], np.int64)
        symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in self.texts], np.int64)
        repeat = self.repeated_words()
        failed = (self.n < 50) | (100 * repeat > 50 * self.n)
        lines = np.array([dup_lines(t) for t in self.texts], np.int64)
        return {"n_words": self.n.astype(np.int64), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeat, "base_failed": failed}


def dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    worded = [x for x in lines if x.strip(SPACES)]
    return len(worded) - len(set(worded))


class Model:
    """Log ratio of each bucket, by order, and the score from which documents are kept."""

    def __init__(self, ratios: dict[int, np.ndarray], bits: int, window: int, threshold: float = -np.inf):
        self.ratios, self.bits, self.window, self.threshold = ratios, bits, window, threshold

    def scores(self, texts: Texts) -> np.ndarray:
        x = np.zeros(texts.hashes.size)
        for order, ratio in self.ratios.items():
            bucket, at = texts.buckets(order, self.bits)
            x[at] += ratio[bucket]
        mean = texts.sums(x) / np.maximum(1, texts.n)
        worst = mean.copy()  # a text of fewer words is one window
        if x.size >= self.window:
            total = np.append(0, np.cumsum(x))
            inside = np.flatnonzero(texts.owner[: x.size - self.window + 1] == texts.owner[self.window - 1 :])
            if inside.size:
                owner = texts.owner[inside]
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                worst[owner[first]] = np.minimum.reduceat(total[inside + self.window] - total[inside], first) / self.window
        return np.round(mean + worst, 9)


def log_ratios(target: np.ndarray, raw: np.ndarray, smooth: float) -> np.ndarray:
    """log(target / raw) after scaling raw to the target's size, with `smooth` added to both counts."""
    if not target.sum() or not raw.sum():
        return np.zeros(raw.size)
    return np.log((target + smooth) / (raw * (target.sum() / raw.sum()) + smooth))


def best_threshold(good: np.ndarray, bad: np.ndarray, caution: float) -> float:
    if not good.size or not bad.size:
        return -np.inf
    at = np.unique(np.append(good, bad))
    gain = np.searchsorted(np.sort(bad), at) / bad.size - caution * np.searchsorted(np.sort(good), at) / good.size
    return float(at[np.argmax(gain)])


def _halves(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64) + np.uint64(77)) >> np.uint64(63) == 1


#: Orders of n-grams and what their log ratios weigh in a score.
ORDERS = {1: 1.0, 2: 0.25}


def fit(
    docs: DataFrame, labels: DataFrame, orders: dict[int, float] = ORDERS, bits: int = 18, smooth: float = 1.0, window: int = 16, caution: float = 3.0, most_labels: int = 50_000
) -> Model:
    """docs: doc_id, text. Labels with a null id or null quality are passed over; null toxic counts as 0. Of labels
    that repeat an id the worst holds. Without good or without bad labels every document reaches the threshold."""
    spark = docs.sparkSession
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good.cast("int")).alias("good"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).collect()
    ids = np.array([r["doc_id"] for r in sample], np.int64)
    is_good = np.array([r["good"] == 1 for r in sample], bool)
    half = _halves(ids)
    trusted = spark.sparkContext.broadcast(np.sort(ids[is_good & ~half]))
    size = 1 << bits
    place = {order: i * size for i, order in enumerate(orders)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = (np.zeros(size * len(place), np.int64) for _ in range(2))
        for b in batches:
            for lo, hi in slices(b.column(1)):
                texts = Texts(text_bytes(b.column(1).slice(lo, hi - lo)))
                mine = np.isin(b.column(0).slice(lo, hi - lo).to_numpy(), trusted.value)
                for order, first in place.items():
                    bucket, at = texts.buckets(order, bits)
                    raw[first : first + size] += np.bincount(bucket, minlength=size)
                    target[first : first + size] += np.bincount(bucket[mine[texts.owner[at]]], minlength=size)
        i = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(raw[i]), pa.array(target[i])], ["bucket", "raw", "target"])

    counts = docs.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # 2^bits rows an order at most
    raw, target = np.zeros(size * len(place)), np.zeros(size * len(place))
    at = counts["bucket"].to_numpy()
    raw[at], target[at] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    part = lambda x, order: x[place[order] : place[order] + size]
    model = Model({k: weight * log_ratios(part(target, k), part(raw, k), smooth) for k, weight in orders.items()}, bits, window)
    held_good = dict(zip(ids[half].tolist(), is_good[half].tolist()))
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)) if b.num_rows else []:
                texts = Texts(text_bytes(b.column(1).slice(lo, hi - lo)))
                ok = pa.array(~texts.base()["base_failed"])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).filter(ok), pa.array(shared.value.scores(texts)).filter(ok)], ["doc_id", "score"])

    held = spark.createDataFrame([(i,) for i in held_good], "doc_id long")  # most_labels rows at most
    held_scores = docs.join(F.broadcast(held), "doc_id", "left_semi").mapInArrow(score, "doc_id long, score double").groupBy("doc_id").agg(F.min("score").alias("score")).toArrow()
    s, g = held_scores["score"].to_numpy(), np.array([held_good[i] for i in held_scores["doc_id"].to_pylist()], bool)
    model.threshold = best_threshold(s[g], s[~g], caution)
    return model


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _judged(texts: Texts, model: Model) -> dict[str, np.ndarray]:
    base = texts.base()
    score = model.scores(texts)
    return base | {"score": score, "kept": ~base["base_failed"] & (score >= model.threshold)}


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, the base counts, base_failed, score, kept of every row of docs. Null texts have no words, so they fail
    the base rules. Rows that repeat a doc_id are judged one by one. Other columns are ignored."""
    d = with_key(docs, "doc_id", ("text", "text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(d, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                x = _judged(Texts(text_bytes(b.column(1).slice(lo, hi - lo))), model.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(v) for v in x.values())], ["doc_id", *x])

    return d.mapInArrow(run, OUT).withColumn("doc_id", id_out())


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(with_key(docs, "doc_id", ("text", "text")), labels, **how))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(at)):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array(_judged(Texts(text_bytes(part.column(at))), model.value)["kept"]))

    return docs.mapInArrow(run, docs.schema)

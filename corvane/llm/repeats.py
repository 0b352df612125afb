"""Finding where long strings of a corpus recur, as the ground that the substring operators share.

A text is a row of units, bytes or words. Every window of W units has one anchor: the leftmost smallest of the
hashes of its K-unit grams. Equal windows have equal anchors at equal places, so windows that recur meet under
their anchor's hash. An anchor answers for a run of neighbouring windows; those windows' units are its context.
Equal contexts are combined before the shuffle: of those within a task all but the first are settled at once and
travel under keys of their own, so a hot anchor sends a few rows from each task. The rest are shuffled by hash and
streamed in sorted order, with memory for one group at a time and a bounded summary for large ones: unique anchors
end there, members of equal contexts are settled there, and one representative of each context, where an anchor has
several, goes on to an index. Contexts of anchors that have very many are not indexed but anchored anew by longer
grams, at last by whole windows, so that equal windows are settled by their hash in any number of tasks.

Rows of a text are told apart by doc_id and a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_hot, mix, written
from corvane.llm.substrings import contexts, contexts_within

_rng = np.random.default_rng(20240607)
BYTE_HASH = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_MUL = _rng.integers(2**40, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_STEP, _JOIN = (_rng.integers(2**40, 2**63, 32, dtype=np.uint64) | np.uint64(1) for _ in range(2))
#: Windows taken at once, and bits for a place among them.
BLOCK, BITS = 1 << 18, np.uint64(20)


def grams(u: np.ndarray, k: int) -> np.ndarray:
    """Scrambled hash of each run of k units, by doubling."""
    have, h, done, out = 1, u, 0, None
    i, left = 0, k
    while left:
        if left & 1:
            n = u.size - k + 1
            out = h[done : done + n] if out is None else out * _JOIN[i] + h[done : done + n]
            done += have
        left >>= 1
        if left:
            h = h[:-have] * _STEP[i] + h[have:]
            have *= 2
            i += 1
    out = (out ^ (out >> np.uint64(29))) * _MUL[14]
    return out ^ (out >> np.uint64(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _powers:
        b, inv = int(_MUL[7]), pow(int(_MUL[7]), -1, 2**64)
        p, q = (np.full(n, x, np.uint64) for x in (b, inv))
        p[0] = q[0] = 1
        _powers[n] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers[n]


def anchors(u: np.ndarray, ends: np.ndarray, w: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of unit hashes u, texts ending at `ends` one after another: the text's index, first window (from the
    start of u), number of windows, the anchor's place in the first window, hash of the anchor and of the context."""
    v, found = w - k + 1, []
    power, inverse = _pow(BLOCK + 2 * w)
    text_end = np.repeat(ends, np.diff(ends, prepend=0))
    for s in range(0, u.size - w + 1, BLOCK):
        g = grams(u[s : s + BLOCK + w - 1], k)
        n = g.size - v + 1
        key = np.full(-(-g.size // v) * v, np.uint64(2**64 - 1))
        key[: g.size] = (g >> BITS << BITS) | np.arange(g.size, dtype=np.uint64)
        rows = key.reshape(-1, v)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(after[:n], before[v - 1 : v - 1 + n]) & ((np.uint64(1) << BITS) - np.uint64(1))).astype(np.int64)
        whole = np.arange(s + w, s + w + n) <= text_end[s : s + n]
        cut = np.flatnonzero((least[1:] != least[:-1]) | (whole[1:] != whole[:-1]) | (text_end[s + 1 : s + n] != text_end[s : s + n - 1])) + 1
        a, b = np.append(0, cut), np.append(cut, n)
        ok = whole[a]
        a, b = a[ok], b[ok]
        p = least[a]
        total = np.append(np.uint64(0), np.cumsum(g * power[: g.size], dtype=np.uint64))
        c = (total[b - 1 + v] - total[a]) * inverse[a]
        c = (c ^ (c >> np.uint64(31))) * _MUL[13] + ((p - a) * 4096 + (b - a)).astype(np.uint64) * _MUL[12]
        found.append((a + s, b - a, p - a, g[p], c))
    if not found:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    a, n, p, h, c = (np.concatenate(x) for x in zip(*found))
    return np.searchsorted(ends, a, side="right"), a, n, p, h, c


ROW = "h long, c long, doc_id long, t long, a long"
NAMES = ["h", "c", "doc_id", "t", "a"]
#: `a` packs the first window, from the text's start, over 12 bits each of window count and anchor place.
FOUND = "rep boolean, " + ROW


def pack_place(a, n, p):
    return (a << 24) | (n << 12) | p


def unpack_place(x):
    return x >> 24, (x >> 12) & 4095, x & 4095


#: What is known of a row when it is shuffled, above the bits of its place: nothing, that its context occurs again,
#: that it is settled.
KIND = 60
OPEN, AGAIN, SETTLED = 0, 1, 2
PLACE = (1 << KIND) - 1


def combine(h: np.ndarray, c: np.ndarray, doc: np.ndarray, text: np.ndarray, place: np.ndarray, ordered: bool) -> tuple[np.ndarray, ...]:
    """Of each task's rows of equal context the first stays open for the shuffle; ordered, all of the first document.
    The others are settled, and their keys are spread by what they are."""
    o = np.lexsort((place, text, doc, c, h))
    h, c, doc, text, place = h[o], c[o], doc[o], text[o], place[o]
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])) if h.size else np.empty(0, bool)
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    if ordered:
        settled, again = doc != doc[first][run], np.zeros(h.size, bool)
    else:
        settled = ~new
        again = new & (np.diff(np.append(first, h.size)) > 1)[run]
    own = mix(doc.view(np.uint64) * _MUL[9] + text.view(np.uint64) * _MUL[10] + place.view(np.uint64))
    return np.where(settled, own, h), c, doc, text, place | np.where(settled, SETTLED, np.where(again, AGAIN, OPEN)) << KIND


Units = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def anchor_rows(docs: DataFrame, units: Units, w: int, k: int, ordered: bool) -> DataFrame:
    """docs: doc_id, t, text. units gives a batch's unit hashes and the texts' ends among them. Rows of equal context
    are combined, in a sense that `ordered` gives as in settle()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_numpy(), b.column("t").to_numpy()
            for lo, hi in slices(b.column("text")):
                u, ends = units(b.column("text").slice(lo, hi - lo))
                i, a, n, p, h, c = anchors(u, ends, w, k)
                if i.size:
                    place = pack_place(a - np.append(0, ends)[i], n, p)
                    yield _anchor_batch(combine(h, c, ids[lo:hi][i], texts[lo:hi][i], place, ordered))

    return docs.select("doc_id", "t", "text").mapInArrow(run, ROW)


def _anchor_batch(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], NAMES)


def context_rows(ctx: DataFrame, units: Units, w: int, k: int, ordered: bool) -> DataFrame:
    """anchor_rows() of contexts (doc_id, t, a, ctx)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, places = (b.column(x).to_numpy() for x in ("doc_id", "t", "a"))
            for lo, hi in slices(b.column("ctx"), 400_000):
                u, ends = units(b.column("ctx").slice(lo, hi - lo))
                i, a, n, p, h, c = anchors(u, ends, w, k)
                i = i + lo
                start = (places[i] >> 24) + a - np.append(0, ends)[i - lo]
                yield _anchor_batch(combine(h, c, ids[i], texts[i], pack_place(start, n, p), ordered))

    return ctx.select("doc_id", "t", "a", "ctx").mapInArrow(run, ROW)


def slices(col: pa.Array, most: int = 4_000_000) -> list[tuple[int, int]]:
    """Runs of a batch's texts of about `most` bytes, so that a batch of long texts is not held many times over."""
    import pyarrow.compute as pc

    at = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)) // most
    cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(col)]
    return [(x, y) for x, y in zip(cut, cut[1:]) if y > x]


def settle(rows: DataFrame, ordered: bool, limit: int = 200_000) -> DataFrame:
    """Anchors that recur, as rows of FOUND. rep false: all windows of this row recur. rep true: this context
    represents those like it in an index, and its own windows are to be looked up there.

    Unordered, a window recurs wherever another one like it starts. Ordered, only where one starts in a document of
    smaller id. A group over `limit` rows is reduced to a few rows as it streams by."""

    def judge(x: dict, part: slice) -> tuple[np.ndarray, np.ndarray]:
        h, c, d, kind = x["h"][part], x["c"][part], x["doc_id"][part], x["a"][part] >> KIND
        settled, n = kind == SETTLED, h.size
        new_h = np.append(True, h[1:] != h[:-1])
        new_c = new_h | np.append(True, c[1:] != c[:-1])
        run = np.cumsum(new_c) - 1
        first = np.flatnonzero(new_c)
        runs = np.diff(np.append(first, n))
        group = np.cumsum(new_h) - 1
        mixed = (np.bincount(group[first]) > 1)[group]
        if ordered:
            of_first = d == d[first][run]
            return ~of_first | settled, mixed & of_first & ~settled
        often = (runs > 1) | (np.bincount(run, kind == AGAIN, first.size) > 0)
        return often[run] | settled, mixed & new_c & ~settled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        names = NAMES

        def emit(x: dict, to: int) -> Iterator[pa.RecordBatch]:
            if to:
                whole, rep = judge(x, slice(0, to))
                whole, rep = whole & ~x["whole"][:to], rep & ~x["rep"][:to]
                x["whole"][:to] |= whole
                x["rep"][:to] |= rep
                i = np.append(np.flatnonzero(whole), np.flatnonzero(rep))
                if i.size:
                    kind = np.append(np.zeros(int(whole.sum()), bool), np.ones(int(rep.sum()), bool))
                    yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x[k][i] & PLACE if k == "a" else x[k][i]) for k in names)], ["rep", *names])

        for b in batches:
            if not b.num_rows:
                continue
            x = {k: b.column(i).to_numpy() for i, k in enumerate(names)} | {k: np.zeros(b.num_rows, bool) for k in ("whole", "rep")}
            if held:
                x = {k: np.concatenate((held[k], x[k])) for k in x}
            last = int(np.searchsorted(x["h"], x["h"][-1]))
            yield from emit(x, last)
            x = {k: y[last:].copy() for k, y in x.items()}
            if x["h"].size > limit:
                # Settle what is known, and keep the rows of the current context's first document and one row of
                # another context: they stand for all that went before.
                at = int(np.flatnonzero(np.append(True, x["c"][1:] != x["c"][:-1]))[-1])
                yield from emit(x, x["h"].size)
                keep = np.arange(at, x["h"].size)
                keep = keep[x["doc_id"][keep] == x["doc_id"][at]] if ordered else keep[:1]
                if at:
                    keep = np.append(at - 1, keep)
                    x["whole"][at - 1] = x["rep"][at - 1] = True
                x = {k: y[keep] for k, y in x.items()}
            held = x
        if held:
            yield from emit(held, held["h"].size)

    return rows.repartition("h").sortWithinPartitions(*NAMES).mapInArrow(run, FOUND)


def find(docs: DataFrame, units: Units, text_units: Callable, context_units: Units, unit: int, look: Callable, w: int, grams: tuple[int, ...], ordered: bool, shard_units: int, most_contexts: int) -> DataFrame:
    """(doc_id, t, a) of every run of windows of docs (doc_id, t, text) that recurs, in the sense of settle().

    text_units gives a text's units for contexts, of `unit` bytes each; look(rows) judges the contexts (h, doc_id, t, a,
    ctx) of one shard, an Arrow table. Contexts of anchors with over most_contexts of them go on to the next of the
    growing grams, the last of which is a window, so a shard holds a few times shard_units at most.
    """
    rows, out, parents = anchor_rows(docs, units, w, grams[0], ordered), None, None
    for longer in (*grams[1:], None):
        found = written(settle(rows, ordered), "anchors")
        known = found.where("NOT rep").select("doc_id", "t", "a")
        out = known if out is None else out.unionByName(known)
        if longer is None:
            break
        reps = found.where("rep").select(*NAMES)
        size = F.sum(F.expr(f"((a >> 12) & 4095) + {w}"))
        per = written(reps.groupBy("h").agg(F.count("*").alias("n"), size.alias("size")), "anchor-sizes")
        total = per.where(F.col("n") <= most_contexts).agg(F.sum("size")).first()[0] or 0
        hot = per.where(F.col("n") > most_contexts).select("h", "n")
        cut = contexts(docs, reps, text_units, w) if parents is None else contexts_within(parents, reps, w, unit)
        ctx = written(cut, "contexts", compression="zstd")
        shards = max(1, -(-total // shard_units))
        few = ctx.join(hot, "h", "left_anti").withColumn("shard", F.expr(f"pmod(h, {shards}L)"))
        out = out.unionByName(few.groupBy("shard").applyInArrow(look, "doc_id long, t long, a long"))
        if not hot.take(1):
            break
        parents = join_hot(ctx, hot, ["h"]).select("doc_id", "t", "a", "ctx")
        rows = context_rows(parents, context_units, w, longer, ordered)
    return out

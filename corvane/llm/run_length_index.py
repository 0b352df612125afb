"""Suffix-array dedup: bytes of long strings that occur more than once are removed.

Equal contexts (see repeats) are settled by their hash, and that is what most repeats of a corpus are. What differs in
part goes to a run-length index: the contexts are dealt into shards of bounded size, and each shard's texts get a
Burrows-Wheeler transform, of which the two ends of every run are sampled with their text places. Only there are
common prefixes with the neighbour in suffix order compared; inside a run they follow from the place before, one
shorter. One pass over the texts then streams every place's matching statistic against all the rest of the shard,
and matches of `w` bytes or more are marked. The transform is made from a suffix array, which a shard can afford.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import id_out, row_key
from corvane.llm.repeats import BYTE_HASH, find, pack_place, unpack_place
from corvane.llm.substrings import by_document, union_of

#: Bytes in a gram that anchors a window.
GRAM = 32


def byte_units(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    x = pc.fill_null(col, "").cast(pa.large_string())
    at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    return BYTE_HASH[data], at[1:] - at[0]


def suffix_array(sym: np.ndarray, distinct: int) -> np.ndarray:
    """Order of the suffixes of sym (values below `distinct`), by prefix doubling among those still tied."""
    n, bits = sym.size, max(1, int(distinct).bit_length())
    take = 62 // bits
    key = np.zeros(n, np.int64)
    for i in range(take):
        key <<= bits
        key[: max(0, n - i)] |= sym[i:] + 1
    sa = np.argsort(key)
    k = key[sa]
    new = np.append(True, k[1:] != k[:-1])
    start = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    rank[sa] = start[np.cumsum(new) - 1] + 1
    h, open_ = take, ~(new & np.append(new[1:], True))
    slots = np.flatnonzero(open_)
    while slots.size:
        s = sa[slots]
        r = rank[s]
        key = r * (n + 1) + rank[np.minimum(s + h, n)]
        o = np.argsort(key)
        s, key, r = s[o], key[o], r[o]
        sa[slots] = s
        new = np.append(True, key[1:] != key[:-1])
        rank[s] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def _common(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix at places i and j, at most `most`; words holds the 8 bytes from each place."""
    out = np.zeros(i.size, np.int64)
    live = np.flatnonzero(most > 0)
    while live.size:
        x = words[i[live] + out[live]] ^ words[j[live] + out[live]]
        low = (x & (~x + np.uint64(1))).astype(np.float64)
        same = np.where(x == 0, 8, (np.frexp(low)[1] - 1) >> 3)
        out[live] = np.minimum(out[live] + same, most[live])
        live = live[(same == 8) & (out[live] < most[live])]
    return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with the text places of both ends of every run."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.ends = np.cumsum(sizes)  # each text is followed by a separator of its own
        self.n = int(self.ends[-1])
        data = np.zeros(self.n, np.uint8)
        data[np.ones(self.n, bool) & ~np.isin(np.arange(self.n), self.ends - 1)] = np.frombuffer(b"".join(texts), np.uint8)
        sym = data.astype(np.int64) + len(texts)
        sym[self.ends - 1] = np.arange(len(texts))
        sa = suffix_array(sym, len(texts) + 256)
        bwt = sym[sa - 1]
        head = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.head_at, self.tail_at = sa[head], sa[np.append(head[1:] - 1, self.n - 1)]
        left = np.repeat(self.ends - 1, sizes) - np.arange(self.n)  # bytes up to the separator
        pad = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
        words = np.zeros(self.n + 1, np.uint64)
        for k in range(8):
            words |= pad[k : self.n + 1 + k] << np.uint64(8 * k)
        i, j = self.head_at[1:], self.tail_at[:-1]
        self.common = _common(words, i, j, np.minimum(left[i], left[j]))

    def matching_statistics(self) -> np.ndarray:
        """At each place, the longest match of what starts there with what starts anywhere else."""
        place = np.arange(self.n)
        best = np.zeros(self.n, np.int64)
        for at in (self.head_at[1:], self.tail_at[:-1]):
            reach = np.zeros(self.n, np.int64)
            reach[at] = at + self.common
            best = np.maximum(best, np.maximum.accumulate(reach) - place)
        return best


def mark(texts: list[bytes], w: int) -> list[np.ndarray]:
    """For each text, the starts of its windows of w bytes that start anywhere else among the texts."""
    if not texts:
        return []
    index = RunLengthIndex(texts)
    hits = index.matching_statistics() >= w
    starts = np.append(0, index.ends[:-1])
    return [np.flatnonzero(hits[s:e]) for s, e in zip(starts, index.ends)]


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of each run of consecutive numbers."""
    if not starts.size:
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(int(x[0]), x.size) for x in np.split(starts, cut)]


def context_units(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, np.uint8) for x in col.to_pylist()]
    return BYTE_HASH[np.concatenate(parts)], np.cumsum([x.size for x in parts])


def find_repeats(docs: DataFrame, w: int = 400, shard_bytes: int = 1_000_000, most_contexts: int = 5_000) -> DataFrame:
    """doc_id, t and packed place of every run of windows of docs (doc_id, t, text) that starts anywhere else too."""

    def look(key, rows):
        out: list[tuple[int, int, int]] = []
        for doc, t, place, starts in zip(rows["doc_id"].to_pylist(), rows["t"].to_pylist(), rows["a"].to_pylist(), mark(rows["ctx"].to_pylist(), w)):
            a, _, p = unpack_place(place)
            out += [(doc, t, pack_place(a + s, k, p)) for s, k in runs(starts)]
        return places_table(out)

    return find(docs, byte_units, lambda t: t, context_units, 1, look, w, (min(GRAM, w), -(-w // 2), w), False, shard_bytes, most_contexts)


def places_table(rows: list[tuple[int, int, int]]) -> pa.Table:
    return pa.table({name: pa.array([x[i] for x in rows], pa.int64()) for i, name in enumerate(("doc_id", "t", "a"))})


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<struct<start:long,end:long>>"


def remove_repeats(docs: DataFrame, w: int = 400, keep_text: bool = True, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the spans and the text that is left.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of w bytes over it starts anywhere else: in any
    row, repeated rows included, or at another place of its own text. Texts below w bytes lose nothing. Rows that
    share a doc_id, or have none, are judged one by one. A cut inside a character leaves its bytes: `kept` shows them
    as replacement characters. Other columns are ignored.
    """
    d = row_key(docs)

    def make(doc: int, text: bytes, places: np.ndarray) -> tuple:
        a, e = union_of(places, w, len(text))
        cut = [0, *np.stack((a, e), 1).ravel().tolist(), len(text)]
        kept = b"".join(text[x:y] for x, y in zip(cut[::2], cut[1::2]))
        row = (doc, len(text), int((e - a).sum()), a.size, hashlib.sha256(kept).hexdigest())
        return row + ((kept.decode(errors="replace"), [{"start": x, "end": y} for x, y in zip(a.tolist(), e.tolist())]) if keep_text else ())

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: 7 if keep_text else 5]
    schema = OUT if keep_text else OUT.partition(", kept string")[0]
    return by_document(d, find_repeats(d, w, **how), schema, make, names).withColumn("doc_id", id_out())

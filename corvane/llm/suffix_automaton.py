"""Substring dedup on words: later copies of long word sequences are removed, the first document keeps them.

Equal contexts (see repeats) are settled by their hash, and that is what most repeats of a corpus are. The rest goes to
suffix automata of reference shards, against which documents stream for matching statistics. What could recur is dealt into shards of bounded size rather than broadcast whole, since all of it grows
with the corpus: one task holds one shard's automaton and streams every context routed to that shard. Documents
pass in order of id; each streams through the automaton of those before it, and only then joins the reference.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import id_out, row_key, text_bytes, word_hashes
from corvane.llm.repeats import find, pack_place, unpack_place
from corvane.llm.run_length_index import places_table, runs
from corvane.llm.substrings import by_document, union_of

#: Words in a gram that anchors a window.
GRAM = 5


def word_units(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = [t.split() for t in text_bytes(col)]
    ends = np.cumsum([len(x) for x in words])
    return np.concatenate([word_hashes(x) for x in words]) if words else np.empty(0, np.uint64), ends


class SuffixAutomaton:
    """Automaton of all substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, seq: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in seq:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q  # the sequence so far is known
                continue
            p = last
            if q is None:
                last = len(nxt)
                nxt.append({})
                length.append(length[p] + 1)
                link.append(0)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = last
                    p = link[p]
                if p < 0:
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[last] = q
                    continue
                made = last
            else:
                made = None
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            if made is None:
                last = clone
            else:
                link[made] = clone

    def matches(self, seq: list[int], w: int) -> list[int]:
        """Ends (exclusive) of the places where the longest match that ends there has w words or more."""
        nxt, link, length = self.next, self.link, self.length
        out, s, n = [], 0, 0
        for i, c in enumerate(seq, 1):
            while (t := nxt[s].get(c)) is None and s:
                s = link[s]
                n = length[s]
            if t is not None:
                s, n = t, n + 1
                if n >= w:
                    out.append(i)
        return out


def stream(rows: list[tuple[int, list[int]]], w: int) -> list[np.ndarray]:
    """For each (doc_id, words), the starts of its windows that also start in a row of smaller doc_id."""
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    automaton, waiting, doc = SuffixAutomaton(), [], None
    for i in order:
        if rows[i][0] != doc:
            for seq in waiting:
                automaton.add(seq)
            waiting, doc = [], rows[i][0]
        found[i] = np.array(automaton.matches(rows[i][1], w), np.int64) - w
        waiting.append(rows[i][1])
    return found


def context_units(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, np.uint64) for x in col.to_pylist()]
    return np.concatenate(parts), np.cumsum([x.size for x in parts])


def find_later_copies(docs: DataFrame, w: int = 13, shard_words: int = 400_000, most_contexts: int = 10_000) -> DataFrame:
    """doc_id, t and packed place of every run of windows of docs (doc_id, t, text) known from a smaller doc_id."""

    def look(key, rows):
        ids, texts, places = (rows[x].to_pylist() for x in ("doc_id", "t", "a"))
        seqs = [np.frombuffer(x, np.uint64).tolist() for x in rows["ctx"].to_pylist()]
        out: list[tuple[int, int, int]] = []
        for doc, t, place, starts in zip(ids, texts, places, stream(list(zip(ids, seqs)), w)):
            a, _, p = unpack_place(place)
            out += [(doc, t, pack_place(a + s, k, p)) for s, k in runs(starts)]
        return places_table(out)

    return find(docs, word_units, lambda t: word_hashes(t.split()), context_units, 8, look, w, (min(GRAM, w), w), True, shard_words, most_contexts)


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:long,end:long>>"


def remove_later_copies(docs: DataFrame, w: int = 13, keep_text: bool = True, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with keep_text the kept words joined by spaces and the spans.

    Words are [^\\x20\\x09-\\x0D]+, null has none. A word goes if a window of w words over it also starts in a
    document of smaller doc_id; within one document nothing counts as a copy, nor between rows that repeat a doc_id.
    Rows without a doc_id come before all others. Rows that share a doc_id, or have none, are judged one by one. Other
    columns are ignored.
    """
    d = row_key(docs)

    def make(doc: int, text: bytes, places: np.ndarray) -> tuple:
        words = text.split()
        a, e = union_of(places, w, len(words))
        cut = [0, *np.stack((a, e), 1).ravel().tolist(), len(words)]
        kept = b" ".join([x for s, t in zip(cut[::2], cut[1::2]) for x in words[s:t]])
        row = (doc, len(words), int((e - a).sum()), hashlib.sha256(kept).hexdigest())
        return row + ((kept.decode(), [{"start": x, "end": y} for x, y in zip(a.tolist(), e.tolist())]) if keep_text else ())

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"][: 6 if keep_text else 4]
    schema = OUT if keep_text else OUT.partition(", kept string")[0]
    return by_document(d, find_later_copies(d, w, **how), schema, make, names).withColumn("doc_id", id_out())

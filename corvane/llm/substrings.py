"""Removal of spans from whole texts, given the windows that recur: what the substring operators share at their end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def union_of(places: np.ndarray, w: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of units under the windows of packed places, inside a text of `size` units."""
    a, n = places >> 24, (places >> 12) & 4095
    order = np.argsort(a, kind="stable")
    a, e = a[order], np.minimum((a + n - 1 + w)[order], size)
    ok = a < e
    a, e = a[ok], e[ok]
    if not a.size:
        return a, e
    far = np.maximum.accumulate(e)
    new = np.append(True, a[1:] > far[:-1])
    return a[new], far[np.append(np.flatnonzero(new)[1:] - 1, a.size - 1)]


def by_document(docs: DataFrame, spans: DataFrame, schema: str, make: Callable, names: list[str]) -> DataFrame:
    """make(doc_id, text bytes, packed places) for every row of docs (doc_id, t, text)."""
    per = spans.groupBy("doc_id", "t").agg(F.collect_list("a").alias("places"))
    joined = docs.join(per.hint("shuffle_hash"), ["doc_id", "t"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, places = b.column("doc_id").to_pylist(), b.column("places")
            rows = []
            for i, t in enumerate(b.column("text")):
                p = places[i].values.to_numpy() if places[i].is_valid else np.empty(0, np.int64)
                rows.append(make(ids[i], t.as_buffer().to_pybytes() if t.is_valid else b"", p))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return joined.select("doc_id", "text", "places").mapInArrow(run, schema)


def contexts(docs: DataFrame, reps: DataFrame, units: Callable[[bytes], np.ndarray | bytes], w: int) -> DataFrame:
    """The units of each representative's windows: h, doc_id, t, a, ctx (binary)."""
    per = reps.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "a")).alias("reps"))
    joined = docs.join(per.hint("shuffle_hash"), ["doc_id", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            ids, texts, reps = b.column("doc_id").to_pylist(), b.column("t").to_pylist(), b.column("reps")
            out: list[tuple] = []
            for i, text in enumerate(b.column("text")):
                if (ids[i], texts[i]) in seen:  # a repeated row, whose contexts are the same
                    continue
                seen.add((ids[i], texts[i]))
                u = units(text.as_buffer().to_pybytes() if text.is_valid else b"")
                r = reps[i].values
                for h, a in zip(r.field(0).to_pylist(), r.field(1).to_pylist()):
                    s, n = a >> 24, (a >> 12) & 4095
                    x = u[s : s + n - 1 + w]
                    out.append((h, ids[i], texts[i], a, x if isinstance(x, bytes) else x.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["h", "doc_id", "t", "a", "ctx"])

    return joined.select("doc_id", "t", "text", "reps").mapInArrow(run, "h long, doc_id long, t long, a long, ctx binary")


def contexts_within(parents: DataFrame, reps: DataFrame, w: int, unit: int) -> DataFrame:
    """contexts() of representatives that stand in contexts known already (doc_id, t, a, ctx), of `unit` bytes a unit."""
    known = parents.groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "ctx")).alias("known"))
    per = reps.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "a")).alias("reps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, known, reps = (b.column(x).to_pylist() for x in ("doc_id", "t", "known", "reps"))
            out: list[tuple] = []
            for doc, t, own, wanted in zip(ids, texts, known, reps):
                spans = [(x["a"] >> 24, (x["a"] >> 24) + ((x["a"] >> 12) & 4095) - 1 + w, x["ctx"]) for x in own]
                for r in wanted:
                    s, n = r["a"] >> 24, (r["a"] >> 12) & 4095
                    first, ctx = next((a, x) for a, e, x in spans if a <= s and s + n - 1 + w <= e)
                    out.append((r["h"], doc, t, r["a"], ctx[(s - first) * unit : (s - first + n - 1 + w) * unit]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["h", "doc_id", "t", "a", "ctx"])

    joined = per.join(known, ["doc_id", "t"]).select("doc_id", "t", "known", "reps")
    return joined.mapInArrow(run, "h long, doc_id long, t long, a long, ctx binary")

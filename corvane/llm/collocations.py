r"""Collocations: phrases of two and three words scored by their worst cut, over any number of documents.

Texts are tokenised once, to chunks of codes into a dictionary of their own, written as a table. Words, pairs and
triples are then counted level by level. A mapper counts the phrases of a chunk in numpy arrays; only phrases are
counted whose parts are frequent (a bitmap of the level before, of fixed size) and whose bucket is frequent enough in a
sketch: arrays of fixed size that the mappers bincount and that are summed as a tree. Neither filter loses a frequent
phrase, since both only overstate. Counts go to shards by hash, some 2^20 words of the corpus for each shard, so no
shard grows with the corpus; there a minimal perfect hash over the candidates, with their keys stored, gives the slots
at which the chunks' counts are added up. What is frequent is kept by slot, with a place in the corpus where it stands,
from which its words are read. The counts of the parts of a cut are read from their shards by slot; shards that are
asked very often are copied for parts of the asking.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import discard, mix, written
from corvane.llm.perfect_hash import SlotTable

#: Separators of pieces become a stop, which is one and so is never in a word; A-Z is lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
CHUNK = 1 << 20  # words of a chunk, about
SHARD = 1 << 20  # words of the corpus for a shard
SKETCH = 1 << 24  # buckets of a sketch
BITMAP = 1 << 27  # bits of the bitmap of frequent phrases
SLICES = 16  # parts in which sketches and bitmaps are summed
FAN = 32  # arrays that one task of the tree adds up
ASKED = 1 << 20  # questions that one copy of a shard answers

_TOKENS = "chunk long, lang string, words binary, codes binary, n long"
_COUNTS = "shard long, chunk long, a binary, b binary, n binary, at binary"
_INDEX = "shard long, size long, slots binary, a binary, b binary, n binary, chunk binary, at binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.strip().split() for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [f for f, _ in fields])


def _each(batches, n: int):
    """Rows of n columns, one at a time, as they may be large."""
    for b in batches:
        for j in range(b.num_rows):
            yield tuple(b.column(i)[j].as_py() for i in range(n))


def _packed(x: np.ndarray) -> bytes:
    """32-bit numbers as planes of bytes, of which the upper ones compress to little."""
    return x.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def tokenised(docs: DataFrame, lang: str, text: str, chunk: int) -> DataFrame:
    """(chunk, lang, words, codes, n): the words a line each, and the codes of all, their places in it. Code 0 is the stop
    that ends a piece."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held, size = {}, 0

        def flush():
            nonlocal made
            out = []
            for lang, (codes_of, codes) in held.items():
                c = np.concatenate(codes)
                out.append(((task << 24) + made, lang, b"\n".join(codes_of), _packed(c), int((c > 0).sum())))
                made += 1
            held.clear()
            return out

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
                words = (text or b"").translate(_TABLE).replace(b".", b" . ").split()
                if not words:
                    continue
                codes_of, codes = held.setdefault("und" if lang is None else lang, (_Codes(), []))
                codes.append(np.fromiter(map(codes_of.__getitem__, words), np.int32, len(words)))
                codes.append(np.zeros(1, np.int32))
                size += len(words)
                if size >= chunk:
                    yield from (_batch([r], _TOKENS) for r in flush())
                    size = 0
        yield from (_batch([r], _TOKENS) for r in flush())

    return docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(run, _TOKENS)


class _Codes(dict):
    """Words to 1, 2, ... as they come; the end of a piece is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _hashes(words: bytes) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words.split(b"\n")), np.uint64).reshape(-1, 2)


def _keys(lang: str, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each phrase, from its words' hashes."""
    start = np.frombuffer(xxhash.xxh3_128_digest(lang.encode()), np.uint64)
    a, b = (np.full(len(parts[0]), x, np.uint64) for x in start)
    for p in parts:
        a, b = mix(a * np.uint64(0x9E3779B97F4A7C15) + p[:, 0]), mix(b * np.uint64(0xC2B2AE3D27D4EB4F) + p[:, 1])
    return a, (b >> np.uint64(32)).astype(np.uint32)


class _Bits:
    """A bitmap that is asked for hashes; without one, all are there."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def __call__(self, a: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(a.size, bool)
        at = (a % np.uint64(8 * self.bits.size)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _places(codes: np.ndarray, hashes: np.ndarray, lang: str, m: int, parts: _Bits) -> np.ndarray:
    """Where in a chunk a phrase of m words begins whose parts of m - 1 words are in `parts`."""
    ok = codes > 0
    if m == 1:
        return np.flatnonzero(ok)
    known = np.zeros(codes.size, bool)
    if m == 2:
        of_word = parts(_keys(lang, [hashes])[0])
        known = ok & of_word[codes]
    else:
        at = np.flatnonzero(ok[:-1] & ok[1:])
        known[at] = parts(_keys(lang, [hashes[codes[at]], hashes[codes[at + 1]]])[0])
    return np.flatnonzero(known[:-1] & known[1:])


def _rows(batches):
    for chunk, lang, words, codes in _each(batches, 4):
        yield chunk, lang, _hashes(words), _unpacked(codes)


def _each_key(hashes: np.ndarray, codes: np.ndarray, lang: str, m: int, at: np.ndarray):
    return _keys(lang, [hashes[codes[at + i]] for i in range(m)])


def _tree(parts: DataFrame, leaves: int, add) -> DataFrame:
    """(slice, part, blob) to one blob a slice: FAN parts are added up at a time, as streams, until one is left."""

    def run(batches):
        now, held = None, None
        for s, p, blob in _each(batches, 3):
            x = np.frombuffer(blob, np.uint8)
            if (s, p) != now:
                if now:
                    yield _batch([(*now, held.tobytes())], "slice long, part long, blob binary")
                now, held = (s, p), x.copy()
            else:
                held = add(held, x)
        if now:
            yield _batch([(*now, held.tobytes())], "slice long, part long, blob binary")

    while True:
        leaves = -(-leaves // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).repartition("slice", "part").sortWithinPartitions("slice", "part").mapInArrow(run, "slice long, part long, blob binary")
        if leaves <= 1:
            return parts


def sketched(tokens: DataFrame, tasks: int, m: int, least: int, parts, buckets: int):
    """A bitmap of the buckets that `least` or more phrases of m words fall in: counts are cut at `least`, which changes
    no sum from `least` on, so a byte each is enough."""

    def run(batches):
        held = np.zeros(buckets, np.uint32)
        for _, lang, hashes, codes in _rows(batches):
            a, _ = _each_key(hashes, codes, lang, m, _places(codes, hashes, lang, m, _Bits(parts.value)))
            np.add.at(held, (a % np.uint64(buckets)).astype(np.int64), 1)
            np.minimum(held, least, out=held)
        cut = held.astype(np.uint8).reshape(SLICES, -1)
        yield _batch([(s, TaskContext.get().partitionId(), x.tobytes()) for s, x in enumerate(cut)], "slice long, part long, blob binary")

    add = lambda x, y: np.minimum(x.astype(np.uint16) + y, least).astype(np.uint8)
    total = _tree(tokens.mapInArrow(run, "slice long, part long, blob binary"), tasks, add)

    def bits(batches):
        for s, _, x in _each(batches, 3):
            yield _batch([(s, 0, np.packbits(np.frombuffer(x, np.uint8) >= least, bitorder="little").tobytes())], "slice long, part long, blob binary")

    return _gathered(total.mapInArrow(bits, "slice long, part long, blob binary"), buckets)


def _gathered(slices: DataFrame, bits: int):
    """The slices of a bitmap of fixed size, for all tasks."""
    found = {r["slice"]: np.frombuffer(r["blob"], np.uint8) for r in slices.collect()}
    whole = np.concatenate([found.get(s, np.zeros(bits // 8 // SLICES, np.uint8)) for s in range(SLICES)])
    return slices.sparkSession.sparkContext.broadcast(whole)


def counted(tokens: DataFrame, m: int, shards: int, parts, sketch) -> DataFrame:
    """For each chunk and shard the keys of the chunk's candidates, how often they occur in it, and where one stands."""

    def run(batches):
        for chunk, lang, hashes, codes in _rows(batches):
            at = _places(codes, hashes, lang, m, _Bits(parts.value))
            if m > 1:
                at = at[_Bits(sketch.value)(_each_key(hashes, codes, lang, m, at)[0])]
            # One number for each phrase, exact whatever the size of the dictionary.
            one = codes[at].astype(np.int64)
            for i in range(1, m):
                if i > 1:
                    one = np.unique(one, return_inverse=True)[1]
                one = (one << 31) + codes[at + i]
            _, first, n = np.unique(one, return_index=True, return_counts=True)
            a, b = _each_key(hashes, codes, lang, m, at[first])
            shard = (a % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
            a, b, n, at = a[order], b[order], n[order], at[first][order]
            for i, j in zip(cuts, [*cuts[1:], order.size]):
                yield _batch([(int(shard[order[i]]), chunk, a[i:j].tobytes(), b[i:j].tobytes(), _packed(n[i:j]), _packed(at[i:j]))], _COUNTS)

    return tokens.select("chunk", "lang", "words", "codes").mapInArrow(run, _COUNTS)


def frequent(counts: DataFrame, least: int) -> DataFrame:
    """For each shard the keys of `least` or more occurrences, by the slots of a minimal perfect hash, with the counts and
    a place for each. The chunks of a shard come in an order of its own, so that places spread over all chunks."""

    def settle(shard: int, rows: list[tuple]):
        a, b = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in ((2, np.uint64), (3, np.uint32)))
        n, at = (np.concatenate([_unpacked(r[i]) for r in rows]) for i in (4, 5))
        chunk = np.repeat([r[1] for r in rows], [len(r[5]) // 4 for r in rows])
        candidates = SlotTable(a, b)
        total = candidates.counts(candidates.slots(a, b), n)
        often = total >= least
        kept = SlotTable(candidates.a[often], candidates.b[often])
        place = candidates.first[often][kept.first]
        return (shard, kept.a.size, pickle.dumps((kept.seed, kept.hash)), kept.a.tobytes(), kept.b.tobytes(), total[often][kept.first].tobytes(), chunk[place].astype(np.int64).tobytes(), at[place].tobytes())

    def run(batches):
        now, rows = None, []
        for r in _each(batches, 6):
            if r[0] != now:
                if rows:
                    yield _batch([settle(now, rows)], _INDEX)
                now, rows = r[0], []
            rows.append(r)
        if rows:
            yield _batch([settle(now, rows)], _INDEX)

    own = F.xxhash64("shard", "chunk").alias("_o")
    return counts.select("*", own).repartition("shard").sortWithinPartitions("shard", "_o").drop("_o").mapInArrow(run, _INDEX)


def bitmap(index: DataFrame, bits: int):
    """A bitmap of the frequent keys: a false hit only lets more candidates in."""
    width = bits // SLICES

    def spread(batches):
        for (a,) in _each(batches, 1):
            at = np.sort((np.frombuffer(a, np.uint64) % np.uint64(bits)).astype(np.int64))
            cuts = np.searchsorted(at, np.arange(SLICES + 1) * width)
            yield _batch([(s, 0, (at[i:j] - s * width).astype(np.uint32).tobytes()) for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i], "slice long, part long, blob binary")

    def draw(batches):
        held = {}
        for s, _, x in _each(batches, 3):
            held.setdefault(s, np.zeros(width, bool))[np.frombuffer(x, np.uint32)] = True
        yield _batch([(s, 0, np.packbits(x, bitorder="little").tobytes()) for s, x in held.items()], "slice long, part long, blob binary")

    kind = "slice long, part long, blob binary"
    return _gathered(index.select("a").mapInArrow(spread, kind).repartition("slice").mapInArrow(draw, kind), bits)


_PLACES = "chunk long, m long, a binary, b binary, n binary, at binary"
_PHRASES = "lang string, phrase string, m long, a long, b long, n long, " + ", ".join(f"{x}{i} long" for i in range(4) for x in "ab")


def read_out(tokens: DataFrame, indexes: dict[int, DataFrame]) -> DataFrame:
    """Each frequent pair and triple with its words, read where its place says, and the keys of the parts of its cuts:
    first and rest of the first cut, then of the second, null for pairs."""

    def places(m: int):
        def run(batches):
            for a, b, n, chunk, at in _each(batches, 5):
                chunk = np.frombuffer(chunk, np.int64)
                order = np.argsort(chunk, kind="stable")
                fields = [np.frombuffer(x, kind)[order] for x, kind in ((a, np.uint64), (b, np.uint32), (n, np.int64), (at, np.int32))]
                cuts = np.flatnonzero(np.diff(chunk[order], prepend=-1))
                for i, j in zip(cuts, [*cuts[1:], order.size]):
                    yield _batch([(int(chunk[order[i]]), m, *(x[i:j].tobytes() for x in fields))], _PLACES)

        return run

    signed = lambda x: x.astype(np.uint64).view(np.int64)

    def run(batches):
        for row in _each(batches, 9):
            chunk, m, lang, words = row[:4]
            if m == 0:
                held = lang, _hashes(words), words.split(b"\n"), _unpacked(row[4])
                continue
            lang, hashes, words, codes = held
            a, b, n, at = (np.frombuffer(x, kind) for x, kind in zip(row[5:], (np.uint64, np.uint32, np.int64, np.int32)))
            c = [codes[at + i] for i in range(m)]
            text = [b" ".join(words[x] for x in w).decode() for w in zip(*(x.tolist() for x in c))]
            h = [hashes[x] for x in c]
            cuts = [x for k in range(1, m) for part in (h[:k], h[k:]) for x in _keys(lang, part)]
            cols = [pa.array([lang] * at.size, pa.string()), pa.array(text, pa.string()), pa.array(np.full(at.size, m, np.int64)), *(pa.array(signed(x)) for x in (a, b)), pa.array(n)]
            cols += [pa.array(signed(x)) for x in cuts] + [pa.nulls(at.size, pa.int64())] * (8 - len(cuts))
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _PHRASES.split(", ")])

    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    rows = tokens.select("chunk", F.lit(0).cast("long").alias("m"), "lang", "words", "codes", *none("binary", "a", "b", "n", "at"))
    for m, index in indexes.items():
        p = index.select("a", "b", "n", "chunk", "at").mapInArrow(places(m), _PLACES)
        rows = rows.unionByName(p.select("chunk", "m", *none("string", "lang"), *none("binary", "words", "codes"), "a", "b", "n", "at"))
    return rows.repartition("chunk").sortWithinPartitions("chunk", "m").mapInArrow(run, _PHRASES)


def answered(asked: DataFrame, indexes: dict[int, DataFrame], shards: int) -> DataFrame:
    """(m, a, b, and what is asked for) to the same rows with f, the count of the phrase of m words with this key, read by
    slot. A shard is copied once for every ASKED questions."""
    unsigned = F.pmod("a", F.lit(shards)) + F.when(F.col("a") < 0, F.lit((1 << 64) % shards)).otherwise(0)
    shard = F.pmod(unsigned, F.lit(shards)).cast("long")
    asked = written(asked.withColumn("shard", shard), "cut-questions")
    often = asked.groupBy("m", "shard").agg(F.count("*").alias("c")).where(F.col("c") > ASKED)
    often = F.broadcast(written(often.select("m", "shard", F.ceil(F.col("c") / ASKED).cast("int").alias("copies")), "asked-often"))  # a row for ASKED questions at least
    asked = asked.join(often, ["m", "shard"], "left").withColumn("copy", F.pmod(F.xxhash64("pa", "pb", "which"), F.coalesce("copies", F.lit(1))).cast("long")).drop("copies")
    index = None
    for m, x in indexes.items():
        x = x.select(F.lit(m).cast("long").alias("m"), "shard", "slots", "a", "b", "n")
        index = x if index is None else index.unionByName(x)
    index = index.join(often, ["m", "shard"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).withColumn("copy", F.col("copy").cast("long")).drop("copies")

    def run(key, asked: pa.Table, index: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("pa", "pb", "which", "f")})
        seed, h = pickle.loads(index["slots"][0].as_py())
        t = SlotTable.__new__(SlotTable)
        t.seed, t.hash, t.a, t.b = seed, h, np.frombuffer(index["a"][0].as_py(), np.uint64), np.frombuffer(index["b"][0].as_py(), np.uint32)
        slot = t.slots(asked["a"].to_numpy().view(np.uint64), asked["b"].to_numpy().astype(np.uint32))
        f = np.frombuffer(index["n"][0].as_py(), np.int64)[slot]
        return pa.table({"pa": asked["pa"], "pb": asked["pb"], "which": asked["which"], "f": pa.array(f)})

    by = ["m", "shard", "copy"]
    return asked.groupBy(*by).cogroup(index.groupBy(*by)).applyInArrow(run, "pa long, pb long, which long, f long")


def _score(a: str, first: str, rest: str) -> Column:
    d = lambda c: f"CAST({c} AS DECIMAL(15, 0))"  # noqa: E731  products fit 38 digits
    return F.expr(f"CAST({d(a)} * {d(a)} * CAST(1000000 AS DECIMAL(7, 0)) AS DECIMAL(38, 0)) DIV CAST({d(first)} * {d(rest)} AS DECIMAL(38, 0))")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, text: str = "text", lang: str = "lang", chunk: int = CHUNK, shard: int = SHARD, sketch: int = SKETCH, bits: int = BITMAP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of two and three words that occur
    `least` times or more, by the lowest score of their cuts, but for those inside a longer such phrase that has
    `share` % of their occurrences.

    Null texts have no words, a null language is `und`; a language without words has no rows. Rows are taken as they
    come, repeated ones again; other columns are ignored. Counts stay exact below 10^15.
    """
    tokens = written(tokenised(docs, lang, text, chunk), "tokens", "zstd")
    n = written(tokens.groupBy("lang").agg(F.sum("n").alias("n")), "words-by-lang")
    total = n.agg(F.sum("n")).first()[0] or 0
    shards, tasks = max(1, -(-total // shard)), tokens.rdd.getNumPartitions()
    sc = docs.sparkSession.sparkContext
    indexes, parts = {}, sc.broadcast(None)
    for m in (1, 2, 3):
        filtered = sketched(tokens, tasks, m, least, parts, sketch) if m > 1 else parts
        indexes[m] = written(frequent(counted(tokens, m, shards, parts, filtered), least), f"frequent-{m}")
        parts = bitmap(indexes[m], bits) if m < 3 else parts
    phrases = written(read_out(tokens, {m: indexes[m] for m in (2, 3)}), "phrases")
    discard(tokens)
    cut = lambda i, m: F.struct(F.lit(i).cast("long").alias("which"), m.cast("long").alias("m"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"))
    one, rest = F.lit(1), F.col("m") - 1
    asked = phrases.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.explode(F.array(cut(0, one), cut(1, rest), cut(2, rest), cut(3, one))).alias("x")).where("x.a IS NOT NULL").select("pa", "pb", "x.*")
    f = answered(asked, {m: indexes[m] for m in (1, 2)}, shards)
    f = f.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(*(F.max(F.when(F.col("which") == i, F.col("f"))).alias(f"f{i}") for i in range(4)))
    scored = phrases.join(f, ["a", "b"]).withColumn("s1", _score("n", "f0", "f1")).withColumn("s2", F.when(F.col("m") == 3, _score("n", "f2", "f3")))
    scored = written(scored.withColumn("second", F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))), "scored-phrases")
    inside = scored.where("m = 3").select(F.explode(F.array(*(F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"f{i}").alias("f")) for i in (1, 2)))).alias("x"), "n").where(100 * F.col("n") >= share * F.col("x.f"))
    kept = scored.where("m = 3").unionByName(scored.where("m = 2").join(inside.select("x.a", "x.b").distinct(), ["a", "b"], "left_anti"))
    pick = lambda x, y: F.when(F.col("second"), F.col(y)).otherwise(F.col(x))
    kept = kept.select("lang", "phrase", F.col("n").alias("a"), pick("f0", "f2").alias("l"), pick("f1", "f3").alias("r"), pick("s1", "s2").alias("score"))
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in (64, 8, 1):  # each part of a language is cut to its first ones before they meet
        salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
        kept = kept.withColumn("_p", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "_p").orderBy(*by))).where(F.col("rank") <= top).drop("_p")
    return kept.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))

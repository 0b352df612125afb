"""N-gram Jaccard join by count-vector R-trees.

A document's shingles are hashed into groups, and the group counts are its point. For two points the sum of the
coordinates' minima bounds the number of shared shingles, and for a node of the tree the largest coordinates in it do
so for all its points at once. Points meet under shared prefix shingles: sorted rare first, two sets that reach the
threshold share one of their first few. Each such meeting is indexed by a tree and leaves, for its points whose
bounds reach the threshold, a star of links; the stars' components are the candidate clusters. A meeting too large
for one task is a star as it stands. Clusters are verified on the full shingle sets, in blocks of bounded size: every
block of a large cluster first with its first block, then what is not in the cluster's largest component yet with all
blocks. So texts are copied about twice, and more only by the number of such leftovers. No list of pairs is ever made:
what goes on is one link for each document at most from every meeting. Documents with equal sets stand as one
throughout, as a node named by one of their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER_TABLE, NO_ID, gram_hashes, id_out, join_hot, mix, text_bytes, word_hashes, written
from corvane.llm.components import components
from corvane.llm.repeats import slices

#: Buckets (as bits) of the counts by which shingles are sorted rare first; a bucket counts as common from
#: COMMON times the mean on.
BITS, COMMON = 18, 1.5
#: Groups of a count vector for up to 1,000 shingles, and at most; they double as the set does.
GROUPS, MOST_GROUPS = 64, 1024
LEAF = 16


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words the whole sequence is one."""
    w = word_hashes(text.translate(LOWER_TABLE).split())
    return np.unique(gram_hashes(w, min(k, w.size))) if w.size else w


def groups_for(n: int) -> int:
    g = GROUPS
    while g < MOST_GROUPS and n > g * 1000 // GROUPS:
        g *= 2
    return g


def count_vector(s: np.ndarray, groups: int) -> np.ndarray:
    bits = groups.bit_length() - 1
    return np.minimum(np.bincount((mix(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=groups), 65535).astype(np.uint16)


def fold(v: np.ndarray, groups: int) -> np.ndarray:
    """The vector over fewer groups: each is the sum of its neighbours, so bounds hold."""
    return v if v.size == groups else np.minimum(v.reshape(groups, -1).sum(1), 65535).astype(np.uint16)


class CountTree:
    """Bulk-loaded R-tree of count vectors, sorted by set size. For each leaf: the largest coordinates, the least and
    the largest set size. A coordinate of 65535 stands for any number."""

    def __init__(self, n: np.ndarray, vec: np.ndarray, percent: int):
        self.n, self.percent = n.astype(np.int64), percent
        self.vec = np.where(vec == 65535, 2**30, vec.astype(np.int64)).astype(np.int32)
        at = np.arange(0, n.size, LEAF)
        self.top = np.maximum.reduceat(self.vec, at, axis=0)
        self.least, self.most = np.minimum.reduceat(self.n, at), np.maximum.reduceat(self.n, at)

    def _reach(self, x: int, tops: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        p, n = self.percent, self.n[x]
        fits = (100 * least <= -(-10000 * n // p)) & (100 * most >= p * n)
        out = np.zeros(fits.size, bool)
        i = np.flatnonzero(fits)
        shared = np.minimum(tops[i], self.vec[x]).sum(1, dtype=np.int64)
        out[i] = (100 + p) * shared >= p * (n + np.maximum(least[i], -(-p * n // 100)))
        return out

    def near(self, x: int, open_: np.ndarray) -> np.ndarray:
        """The points among open_ whose bound with x reaches the threshold."""
        leaves = self._reach(x, self.top, self.least, self.most)
        i = open_[leaves[open_ // LEAF]]
        return i[self._reach(x, self.vec[i], self.n[i], self.n[i])]

    def stars(self, accept=None) -> np.ndarray:
        """For each point the first point of its component, under `accept`ed near points. A point is looked up once,
        among those that no component has yet."""
        root = np.arange(self.n.size)
        open_ = np.arange(self.n.size)
        while open_.size:
            first, open_ = int(open_[0]), open_[1:]
            todo = [first]
            while todo and open_.size:
                x = todo.pop()
                got = self.near(x, open_)
                if accept is not None and got.size:
                    got = got[accept(x, got)]
                if got.size:
                    root[got] = first
                    todo += got.tolist()
                    open_ = open_[~np.isin(open_, got, assume_unique=True)]
        return root


def _common_buckets(docs: DataFrame, k: int) -> np.ndarray:
    """For each bucket of shingle hashes how common it is: 0, or more the oftener all documents have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for lo, hi in slices(b.column(0)):
                words = [t.translate(LOWER_TABLE).split() for t in text_bytes(b.column(0).slice(lo, hi - lo))]
                g = gram_hashes(np.concatenate([word_hashes(x) for x in words]), k)
                owner = np.repeat(np.arange(len(words)), [len(x) for x in words])
                g = g[owner[: g.size] == owner[k - 1 : k - 1 + g.size]]
                n += np.bincount((g >> np.uint64(64 - BITS)).astype(np.int64), minlength=n.size)
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(n[i])], ["bucket", "n"])

    t = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2^BITS rows at most
    n = np.zeros(1 << BITS)
    n[t["bucket"].to_numpy()] = t["n"].to_numpy()
    return np.maximum(0, np.floor(2 * np.log2(np.maximum(1e-9, n / max(1.0, n.mean() * COMMON)))) + 1).astype(np.uint8)


SETS = "uid long, doc_id long, n int, d1 long, d2 long, vec binary, keys array<long>"


def shingle_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of each row of docs (uid, doc_id, text): set size, 128-bit digest of the set, count vector, prefix shingles."""
    common = docs.sparkSession.sparkContext.broadcast(_common_buckets(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = common.value
        for b in (b.slice(lo, hi - lo) for b in batches for lo, hi in slices(b.column(2))):
            rows = []
            for text in text_bytes(b.column(2)):
                s = shingles(text, k)
                n = s.size
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                first = n - -(-percent * n // 100) + 1 if n else 0
                rare = level[(s >> np.uint64(64 - BITS)).astype(np.int64)]
                keys = s[:first] if not rare[:first].any() else s[np.argsort(rare, kind="stable")[:first]]
                rows.append((n, (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63, count_vector(s, groups_for(n)).tobytes() if n else b"", keys.view(np.int64)))
            if rows:
                made = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["uid", "doc_id", "n", "d1", "d2", "vec", "keys"])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, SETS)


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Batches sorted by a column, cut anew so that no group is split."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(column).to_numpy()
        if held and key[0] == key[-1] == held[-1].column(column)[-1].as_py():
            held.append(b)
            continue
        last = int(np.searchsorted(key, key[-1]))
        if held and last == 0:
            yield pa.Table.from_batches(held)
            held = [b]
            continue
        yield pa.Table.from_batches([*held, b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _shared_keys(rows: DataFrame) -> DataFrame:
    """key, node to (meeting, node) of the nodes that share a key. Keys that join the same documents are one meeting, named
    by a hash of its members; a key whose rows reach into another batch names its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, not yet sent
        for b in batches:
            if not b.num_rows:
                continue
            key, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            sent = False
            if held:
                key, doc, sent = np.append(held[0], key), np.append(held[1], doc), held[2]
            same = key[1:] == key[:-1]
            out = np.append(False, same) | np.append(same, False)
            if sent:
                out[0] = False
            held = (key[-1], doc[-1], bool(out[-1]) or (key.size == 1 and sent))
            start = np.flatnonzero(np.append(True, ~same))
            group = np.cumsum(np.append(True, ~same)) - 1
            name = np.add.reduceat(mix(doc.view(np.uint64)), start).view(np.int64)[group]
            edge = (group == 0) | (group == group[-1])
            name = np.where(edge, key, name)
            i = np.flatnonzero(out)
            if i.size:
                yield pa.RecordBatch.from_arrays([pa.array(name[i]), pa.array(doc[i])], ["meeting", "node"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "meeting long, node long").distinct()


def _stars(meetings: DataFrame, percent: int) -> DataFrame:
    """meeting, node, n, vec to links (a, b) under the bounds, at most one for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, "meeting"):
            key, doc, n = (t[c].to_numpy() for c in ("meeting", "node", "n"))
            vec = [np.frombuffer(v, np.uint16) for v in t["vec"].to_pylist()]
            cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), key.size)
            pairs = cut[:-1][np.diff(cut) == 2]
            i = _reaching(n, vec, pairs, percent)
            a, b = [doc[i + 1]], [doc[i]]
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if e - s > 2:
                    for i, j in _level_stars(n[s:e], vec[s:e], percent):
                        a.append(doc[s:e][i])
                        b.append(doc[s:e][j])
            if sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return meetings.repartition("meeting").sortWithinPartitions("meeting", "n", "node").mapInArrow(run, "a long, b long").distinct()


def _level_stars(n: np.ndarray, vec: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars of one meeting, sorted by n. Bounds are only as sharp as the groups are many for the set's size, so each
    length of vector has a tree of its own, joined by the points of longer vectors that may match its largest."""
    size = np.array([v.size for v in vec])
    for g in np.unique(size):
        m = np.flatnonzero((size == g) | (size > g) & (percent * n.astype(np.int64) <= 100 * int(n[size == g].max())))
        if m.size > 1:
            root = CountTree(n[m], np.stack([fold(vec[x], g) for x in m]), percent).stars()
            i = np.flatnonzero(root != np.arange(m.size))
            yield m[i], m[root[i]]


def _reaching(n: np.ndarray, vec: list[np.ndarray], first: np.ndarray, percent: int) -> np.ndarray:
    """Of the places whose row makes a meeting of two with the next row, those whose bound reaches the threshold."""
    size = np.array([min(vec[i].size, vec[i + 1].size) for i in first], np.int64)
    out = []
    for g in np.unique(size):
        i = first[size == g]
        u, v = (np.stack([fold(vec[x], g) for x in y]) for y in (i, i + 1))
        shared = np.where((u == 65535) | (v == 65535), 2**30, np.minimum(u, v)).sum(1, dtype=np.int64)
        out.append(i[(100 + percent) * shared >= percent * (n[i].astype(np.int64) + n[i + 1])])
    return np.concatenate(out) if out else first[:0]


class Verifier:
    """Full shingle sets of some documents, sorted by size."""

    def __init__(self, doc: np.ndarray, texts: list[bytes], k: int, percent: int):
        sets = [shingles(t, k) for t in texts]
        n = np.array([s.size for s in sets])
        o = np.lexsort((doc, n))
        self.doc, self.n, self.percent = doc[o], n[o], percent
        self.sets = [sets[i] for i in o]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A star over each component of the documents that link."""
        n, sets = self.n, self.sets
        if n.size == 2:
            shared = np.intersect1d(*sets, assume_unique=True).size
            ok = 100 * shared >= self.percent * (n.sum() - shared)
            return self.doc[1:][[ok]], self.doc[:1][[ok]]
        _, dense = np.unique(np.concatenate(sets), return_inverse=True)
        dense = dense.astype(np.int32)
        start = np.cumsum(n) - n
        mark = np.zeros(int(dense.max()) + 1, bool)

        def accept(x: int, got: np.ndarray) -> np.ndarray:
            own = dense[start[x] : start[x] + n[x]]
            mark[own] = True
            size = n[got]
            before = np.cumsum(size) - size
            shared = np.add.reduceat(mark[dense[np.repeat(start[got] - before, size) + np.arange(size.sum())]].astype(np.int64), before)
            mark[own] = False
            return 100 * shared >= self.percent * (n[x] + size - shared)

        g = GROUPS
        while g < MOST_GROUPS and 2 * g < n[-1]:
            g *= 2
        root = CountTree(n, np.stack([count_vector(s, g) for s in sets]), self.percent).stars(accept)
        i = np.flatnonzero(root != np.arange(n.size))
        return self.doc[i], self.doc[root[i]]


def _verify(members: DataFrame, k: int, percent: int) -> DataFrame:
    """task, node, text to verified links (a, b): all that join the nodes of a task, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, "task"):
            task, node = t["task"].to_numpy(), t["node"].to_numpy()
            texts = text_bytes(pa.chunked_array(t["text"].chunks, pa.string()).combine_chunks())
            cut = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), task.size).tolist()
            found = [Verifier(node[s:e], texts[s:e], k, percent).links() for s, e in zip(cut, cut[1:]) if e - s > 1]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # Tasks are named by a hash; should two share one, more is compared and nothing less.
    return members.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def candidates(own: DataFrame, percent: int, most_meeting: int) -> DataFrame:
    """Links (a, b) of the nodes in own (node, n, vec, keys) whose components no link leaves."""
    shared = written(_shared_keys(own.select(F.explode("keys").alias("key"), "node")), "meetings")
    large = shared.groupBy("meeting").agg(F.count("*").alias("n"), F.min("node").alias("root")).where(F.col("n") > most_meeting)
    large = written(large, "large-meetings")
    stars = _stars(shared.join(large, "meeting", "left_anti").join(own.select("node", "n", "vec"), "node").select("meeting", "node", "n", "vec"), percent)
    return stars.unionByName(join_hot(shared, large, ["meeting"]).select(F.col("node").alias("a"), F.col("root").alias("b")))


def verified(keyed: DataFrame, own: DataFrame, cluster: DataFrame, k: int, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """(node, component) of the nodes that link, from candidate clusters (node, component)."""
    weight = cluster.join(own.select("node", "n"), "node")
    blocks = weight.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"), F.count("*").alias("n"))
    placed = join_hot(cluster, blocks, ["component"]).select("node", F.col("component").alias("cluster"), "blocks", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("block"))
    placed = written(placed, "placed")

    def links(members: DataFrame) -> DataFrame:
        """members: node, task."""
        texts = keyed.select(F.col("uid").alias("node"), "text").join(members.hint("shuffle_hash"), "node")
        return written(_verify(texts, k, percent), "links")

    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    first = placed.withColumn("j", F.explode(F.when((F.col("block") == 0) & (F.col("blocks") > 1), F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("block"))))
    found = links(first.select("node", F.xxhash64("cluster", "j").alias("task")))
    comp = components(found)
    big = placed.where("blocks > 1").join(comp, "node", "left").select("node", "cluster", "blocks", "block", F.coalesce("component", "node").alias("root"))
    sizes = big.groupBy("cluster", "root").agg(F.count("*").alias("size")).groupBy("cluster").agg(F.max_by("root", F.struct("size", "root")).alias("top"), F.sum("size").alias("n"))
    rest = written(join_hot(big, sizes, ["cluster"]).where("root <> top").select("node", "cluster", "blocks", "block"), "leftovers")
    if not rest.take(1):
        return comp
    parts = rest.groupBy("cluster").agg(F.ceil(F.count("*") / block_docs).cast("int").alias("parts"))
    count = sizes.select("cluster", "n").join(parts, "cluster")
    task = lambda r, j: F.xxhash64("cluster", F.lit("rest"), r, j).alias("task")
    left = join_hot(rest, count, ["cluster"]).withColumn("r", F.expr("cast(pmod(xxhash64(node, 1), parts) as int)")).withColumn("j", F.explode(all_of("blocks")))
    right = join_hot(big.select("node", "cluster", "block"), count, ["cluster"]).withColumn("r", F.explode(all_of("parts")))
    met = left.select("node", task("r", "j")).unionByName(right.select("node", task("r", "block"))).distinct()
    return components(found.unionByName(links(met)))


def link_rows(keyed: DataFrame, k: int, percent: int, block_docs: int = 4000, block_shingles: int = 4_000_000, most_meeting: int = 20_000) -> DataFrame:
    """keyed: uid, doc_id (never null), text, written. uid, doc_id, n, component_id and root, a row of the component (null
    without words), of every row."""
    sets = written(shingle_sets(keyed, k, percent), "sets")
    some = sets.where("n > 0")
    # Each distinct set: its node, smallest doc_id and number of rows.
    rep = written(some.groupBy("d1", "d2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    own = written(sets.join(rep.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), "n", "vec", "keys"), "distinct-sets")
    cluster = components(candidates(own, percent, most_meeting))
    comp = verified(keyed, own, cluster, k, percent, block_docs, block_shingles)
    told = written(rep.join(comp, "node", "left").select("d1", "d2", "least", "n", F.coalesce("component", "node").alias("root")), "told")
    least = told.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    told = join_hot(told.withColumnRenamed("n", "rows"), least, ["root"]).select("d1", "d2", "root", "component_id", F.col("rows").alias("copies"))
    out = join_hot(some.select("uid", "doc_id", "n", "d1", "d2"), written(told, "told"), ["d1", "d2"], n="copies")
    alone = sets.where("n = 0").select("uid", "doc_id", "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return out.select("uid", "doc_id", "n", "root", "component_id").unionByName(alone)


def _keyed(docs: DataFrame, *cols: str) -> DataFrame:
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").alias("text"), *([F.struct(*cols).alias("row")] if cols else []))
    return written(own, "keyed", compression="zstd")


def link_documents(docs: DataFrame, k: int = 5, percent: int = 80, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: near duplicates share a component.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set is the distinct k-word shingles of the whole text, of
    fewer words the whole sequence; null and wordless texts have none and are linked with nothing. Two documents
    link when 100 * shared >= percent * united. component_id is the smallest doc_id reachable, null before all others.
    Rows that share a doc_id, or have none, are documents of their own. Other columns are ignored.
    """
    out = link_rows(_keyed(docs), k, percent, **how)
    return out.select(id_out(), F.col("n").cast("long").alias("n_shingles"), id_out("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, **how) -> DataFrame:
    """The rows of docs without near duplicates: of each component, as in link_documents(), the row of smallest doc_id
    stays, of several such rows one. Rows without words stay."""
    keyed = _keyed(docs, *docs.columns)
    rows = written(link_rows(keyed, k, percent, **how).select("uid", "doc_id", "root", "component_id"), "linked")
    first = rows.where("doc_id = component_id AND root IS NOT NULL").groupBy("root").agg(F.min("uid").alias("uid"))
    stay = first.select("uid").unionByName(rows.where("root IS NULL").select("uid"))
    return keyed.join(stay.hint("shuffle_hash"), "uid", "left_semi").select("row.*")

"""The prefix trie of conversations, by prefix doubling.

Turns get dense numbers as names, equal turns the same one; then, in as many rounds as the longest conversation has
binary digits, two neighbouring blocks of 2^k turns name the block of 2^(k+1) by the pair of their names. A prefix of
d turns is put together from the blocks of d's binary digits, longest first: the prefix before its last block is named
in an earlier round, and the pair of that name and the block's is the prefix's name. Rows of one name are the members
of a node. Sums over subtrees take logarithmic rounds as well: what a node knows of its next 2^k - 1 levels it gives
to its ancestor 2^k levels up, which its smallest member's own prefixes name.

Names are joined back to their rows; names that very many rows have are broadcast (join_hot). Turns are put in order
by ranges, so one long conversation is spread over tasks, and lists of members are hashed as a stream of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import discard, join_hot, written

WORD = r"[^\x20\x09-\x0D]+"
#: Ids in a block of a member list: ids are distinct, so no block has more.
BLOCK = 4096


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to conv, i (from 0), key (a digest of role and text) and words (of text): turns by
    (turn, role, text), null turns first. Conversations that reach over the bounds of ranges are told where they go on."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv IS NOT NULL")
    by = ["conv", "turn", "role", "text"]
    t = t.withColumn("_m", F.monotonically_increasing_id()).repartitionByRange(*by, "_m").sortWithinPartitions(*by)
    key = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256))
    t = written(t.select("conv", key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("seq")), "turns")
    n = written(t.groupBy("pid", "conv").agg(F.count("*").alias("n")), "turns-by-range")
    before = n.withColumn("before", F.sum("n").over(W.partitionBy("conv").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)))
    late = F.broadcast(before.where("before > 0").drop("n"))  # only a range's first conversation goes on from the one before
    own = F.row_number().over(W.partitionBy("pid", "conv").orderBy("seq")) - 1
    return t.withColumn("own", own).join(late, ["pid", "conv"], "left").select("conv", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias("i"), "key", "words")


def as_they_are(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv, i, key, words, last), and (conv, length)."""
    n = written(t.groupBy("conv").agg(F.count("*").alias("n")), "conversations")
    return join_hot(t, n, ["conv"]).select("conv", "i", "key", "words", (F.col("i") == F.col("n") - 1).alias("last")), n.select("conv", F.col("n").alias("length"))


def branched(t: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations c that begin as c - c % every does: its first h turns, h = crc32(decimal c) % most, or all if it has
    fewer, and then c's own turns after its first h. As as_they_are()."""
    n = written(t.groupBy("conv").agg(F.count("*").alias("n")), "conversations")
    c = n.select("conv", "n", (F.crc32(F.col("conv").cast("string")) % most).alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    c = c.join(n.select(F.col("conv").alias("base"), F.col("n").alias("_nb")), "base", "left").withColumn("m", F.least("h", F.coalesce("_nb", F.lit(0)))).drop("_nb")
    c = written(c, "branches")
    start = t.where((F.col("conv") % every == 0) & (F.col("i") < most - 1)).withColumnRenamed("conv", "base")
    lent = c.where("m > 0").join(start, "base").where("i < m").select("conv", "i", "key", "words", ((F.col("i") == F.col("m") - 1) & (F.col("n") <= F.col("h"))).alias("last"))
    own = join_hot(t, c, ["conv"]).where("i >= h").select("conv", (F.col("i") - F.col("h") + F.col("m")).alias("i"), "key", "words", (F.col("i") == F.col("n") - 1).alias("last"))
    return lent.unionByName(own), c.select("conv", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def dense(rows: DataFrame, keys: list[str], start: int, *more: Column) -> tuple[DataFrame, int]:
    """The distinct keys, with n rows each, the columns `more` and a dense number `name` from `start`; how many there
    are. Partitions number their own, after those of the partitions before them: one count a partition is collected."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), *more)
    g = written(g.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_s")), "names")
    at, offset = start, []
    for r in sorted(g.groupBy("_p").agg(F.count("*").alias("c"), F.min("_s").alias("s")).collect()):
        offset.append((r["_p"], at - r["s"]))
        at += r["c"]
    told = F.broadcast(rows.sparkSession.createDataFrame(offset, "_p int, _o long"))
    return g.join(told, "_p").withColumn("name", F.col("_s") + F.col("_o")).drop("_p", "_s", "_o"), at - start


def blocks_of(rows: DataFrame, rounds: int) -> list[DataFrame]:
    """For k = 0, 1, ... the blocks (conv, j, name, words, last) of the turns from j * 2^k on; words and last are those of
    the block's last turn."""
    names, _ = dense(rows, ["key"], 0)
    out = [written(join_hot(rows, names, ["key"]).select("conv", F.col("i").alias("j"), "name", "words", "last"), "blocks")]
    odd = F.col("j") % 2 == 1
    for _ in range(rounds):
        pair = out[-1].groupBy("conv", F.floor(F.col("j") / 2).alias("j")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), *(F.max(F.when(odd, F.col(c))).alias(x) for c, x in (("name", "b"), ("words", "words"), ("last", "last"))))
        pair = written(pair.where("b IS NOT NULL"), "pairs")
        names, _ = dense(pair, ["a", "b"], 0)
        out.append(written(join_hot(pair, names, ["a", "b"]).select("conv", "j", "name", "words", "last"), "blocks"))
        discard(pair)
    return out


def prefixes_of(blocks: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Each prefix (conv, depth, node, first, n, last), and each node (conv_id, depth, n_convs, words): first is the
    smallest member of the prefix's node and n its members."""
    paths, nodes, total = [], [], 0
    for k in reversed(range(len(blocks))):
        own = blocks[k].where("j % 2 = 0").select("conv", F.shiftleft(F.col("j"), k).alias("_d"), "name", "words", "last")
        head = own.where("_d = 0").withColumn("node", F.lit(-1).cast("long"))
        if paths:
            earlier = paths[0].select("conv", F.col("depth").alias("_d"), "node")
            for p in paths[1:]:
                earlier = earlier.unionByName(p.select("conv", F.col("depth").alias("_d"), "node"))
            head = head.unionByName(own.where("_d > 0").join(earlier, ["conv", "_d"]))
        rows = written(head.select("conv", (F.col("_d") + (1 << k)).alias("depth"), F.col("node").alias("a"), F.col("name").alias("b"), "words", "last"), "prefixes")
        names, n = dense(rows, ["depth", "a", "b"], total, F.min("conv").alias("first"), F.max("words").alias("words"))
        total += n
        nodes.append(names.select(F.col("first").alias("conv_id"), "depth", F.col("n").alias("n_convs"), "words"))
        paths.append(written(join_hot(rows, names.drop("words"), ["depth", "a", "b"]).select("conv", "depth", F.col("name").alias("node"), "first", "n", "last"), "paths"))
        discard(rows)
    path, node = paths[0], nodes[0]
    for p, v in zip(paths[1:], nodes[1:]):
        path, node = path.unionByName(p), node.unionByName(v)
    return path, node


def over_subtrees(shared: DataFrame, path: DataFrame, root: int, deepest: int) -> DataFrame:
    """leaves and saved of (conv_id, depth, leaves, saved), summed over what of these is below each row, itself too."""
    up = path.where("n > 1").select(F.col("conv").alias("conv_id"), F.col("depth").alias("_d"), "first")
    step = 1
    while step <= deepest:
        moved = shared.where(F.col("depth") >= step).withColumn("_d", F.col("depth") - step)
        to = moved.where("_d > 0").join(up, ["conv_id", "_d"]).select("first", "_d", "leaves", "saved").unionByName(moved.where("_d = 0").select(F.lit(root).cast("long").alias("first"), "_d", "leaves", "saved"))
        more = to.groupBy(F.col("first").alias("conv_id"), F.col("_d").alias("depth")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        old, shared = shared, written(shared.join(more, ["conv_id", "depth"], "left").select("conv_id", "depth", *((F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("leaves", "_l"), ("saved", "_s")))), "subtrees")
        discard(old)
        step *= 2
    return shared


def member_hashes(members: DataFrame) -> DataFrame:
    """(conv_id, depth, conv) to conv_id, depth, sha256 of the members' decimal ids, ascending and comma-joined. Blocks of
    ids are joined first; the blocks of a node pass one after another."""
    block = F.col("conv") - F.pmod(F.col("conv"), F.lit(BLOCK))
    text = F.array_join(F.sort_array(F.collect_list("conv")), ",")
    rows = members.groupBy("conv_id", "depth", block.alias("block")).agg(text.alias("ids")).repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")

    def run(batches):
        now, h = None, None
        for b in batches:
            out = []
            for node in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if node[:2] != now:
                    if now:
                        out.append((*now, h.hexdigest()))
                    now, h = node[:2], hashlib.sha256(node[2].encode())
                else:
                    h.update(b"," + node[2].encode())
            yield _hashes(out)
        if now:
            yield _hashes([(*now, h.hexdigest())])

    return rows.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "depth", "ends_sha256"])


def prefix_trie(turns: DataFrame, shape: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = as_they_are) -> DataFrame:
    """The nodes of the trie of all conversations (conv_id, turn, role, text), as `shape` makes them of the turns in
    order: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty ones; turns with the same number, or none, are ordered by role and text, and
    repeated rows are turns of their own. Rows of a null conv_id belong to no conversation. Without conversations there
    is no node, not even the root. Other columns are ignored.
    """
    spark = turns.sparkSession
    rows, convs = shape(written(ordered(turns), "ordered"))
    rows, convs = written(rows, "rebuilt"), written(convs, "lengths")
    n_convs, root, longest = convs.agg(F.count("*"), F.min("conv"), F.max("length")).first()
    if not n_convs:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    path, nodes = prefixes_of(blocks_of(rows, max(0, longest.bit_length() - 1)))
    nodes = nodes.unionByName(spark.range(1).select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words")))
    up = path.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("first").alias("parent_conv_id"))
    parent = F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("parent_conv_id")).cast("long")
    nodes = written(nodes.join(up, ["conv_id", "depth"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, parent)), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("single"))
    nodes = written(nodes.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children", "single"]), "nodes")
    # A node of one member has one leaf below it, or is one, and saves nothing: only the others meet in rounds.
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("single"))
    shared = written(nodes.where("n_convs > 1 OR depth = 0").select("conv_id", "depth", leaves.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "subtrees")
    shared = over_subtrees(shared, path, root, shared.agg(F.max("depth")).first()[0])
    ends = path.where("last").select(F.col("first").alias("conv_id"), "depth", "conv").unionByName(convs.where("length = 0").select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "conv"))
    out = nodes.join(shared, ["conv_id", "depth"], "left").join(member_hashes(ends), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))

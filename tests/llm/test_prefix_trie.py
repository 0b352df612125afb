"""The prefix trie against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import prefix_trie as P
from tests.llm import brute

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(seed, convs, longest):
    r = random.Random(seed)
    said = ["hello", "how are you", "", "yes", " a  b\tc ", "日本 é"]
    out = []
    for c in convs:
        for turn in range(r.choice([1, 2, 3, 4, longest])):
            out.append((c, turn, r.choice(["user", "user", "assistant"]), said[min(int(r.expovariate(1.2)), 5)]))
    return out


def nodes(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


@pytest.fixture(scope="module")
def odd():
    """Nulls everywhere, ties, repeated rows, missing turns and bases, conversations that lose all their turns."""
    t = turns_of(5, [*range(0, 60, 2), *range(1000, 1020), 2007, 2008, 3001, *range(5000, 5040)], 9)
    t += [(None, 0, "user", "lost"), (None, None, None, None), (7, None, None, None), (7, None, None, None), (7, 1, None, "x"), (7, 1, "a", None), (9, 3, "user", "hello"), (9, 3, "user", "hello"), (9, 3, "tool", "z"), (20, None, "user", "hello")]
    t += [(40, i, "user", f"turn {i}") for i in range(37)] + [(c, 0, "user", "same") for c in range(6000, 6050)]
    random.Random(1).shuffle(t)
    return t


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts).withColumns({c: F.lit(2) for c in ("i", "n", "conv", "name", "first", "words", "depth")})


def test_branched(spark, odd):
    assert nodes(P.prefix_trie(frame(spark, odd), P.branched)) == sorted(brute.trie(odd))


def test_as_they_are(spark, odd, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 3)
    assert nodes(P.prefix_trie(frame(spark, odd))) == sorted(brute.trie(odd, 0))


def test_no_rows(spark):
    assert nodes(P.prefix_trie(frame(spark, []), P.branched)) == []
    assert nodes(P.prefix_trie(frame(spark, [(None, 1, "user", "x")]))) == []


def test_one_row(spark):
    assert nodes(P.prefix_trie(frame(spark, [(5, None, None, "a b")], 1))) == sorted(brute.trie([(5, None, None, "a b")], 0))


def test_long_conversation_is_spread(spark):
    """A conversation over several ranges keeps its order, and repeated rows are split too."""
    rows = [(1, i // 2, "user", "x") for i in range(500)] + [(2, 0, "user", "x")]
    t = P.ordered(frame(spark, rows).repartition(4))
    assert sorted((r["conv"], r["i"]) for r in t.collect()) == [(1, i) for i in range(500)] + [(2, 0)]


def test_dense_names(spark):
    names, n = P.dense(spark.range(1000).select((F.col("id") % 37).alias("a")).repartition(7), ["a"], 5)
    assert n == 37 and sorted(r["name"] for r in names.collect()) == list(range(5, 42))

"""Perfect hashes, and collocations against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import collocations as C
from corvane.llm.perfect_hash import PerfectHash, SlotTable
from tests.llm import brute

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("n", [0, 1, 2, 9, 5000])
def test_perfect_hash(n):
    import pickle

    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 2**64, n, np.uint64))
    h = pickle.loads(pickle.dumps(PerfectHash(keys)))
    assert sorted(h(keys)) == list(range(keys.size))
    assert all(-1 <= x < keys.size for x in h(r.integers(0, 2**64, 100, np.uint64)))


def test_slot_table():
    a = np.array([7, 7, 8, 9, 7, 8], np.uint64)
    b = np.array([1, 2, 1, 1, 1, 1], np.uint32)
    t = SlotTable(a, b)
    slots = t.slots(a, b)
    assert t.a.size == 4 and len(set(slots)) == 4 and slots.min() == 0 and slots.max() == 3
    assert slots[0] == slots[4] and slots[2] == slots[5]
    assert list(t.counts(slots, np.array([1, 10, 100, 1000, 5, 2]))[slots[[0, 1, 2, 3]]]) == [6, 10, 102, 1000]
    assert list(t.slots(np.array([9, 10], np.uint64), np.array([2, 1], np.uint32))) == [-1, -1]
    assert SlotTable(a[:0], b[:0]).slots(a, b).tolist() == [-1] * 6


@pytest.fixture(scope="module")
def docs():
    r = random.Random(4)
    words = ["the", "of", "New", "york", "city", "é", "日本", "x-1", "(a)", "und", "\x1c", " b", "AÉ"]
    ends = [" ", " ", " ", " ", "\t", "  ", ", ", ". ", "\n", ";", "\x0b"]
    prose = lambda n: "".join((r.choice(["new york city", "of the"]) if r.random() < 0.15 else r.choice(words)) + r.choice(ends) for _ in range(n))
    out = [(prose(r.randint(0, 120)), r.choice(["en", "en", "de", None, "und"])) for _ in range(60)]
    return out + [(None, "en"), ("", "fr"), (" \n ..", "es"), ("one two", None), ("w " * 50_000, "long"), ("a b c d e " * 9, "rare"), *[(out[3])] * 30]


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def frame(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string").repartition(5).withColumns({c: F.lit(3) for c in ("n", "a", "chunk", "m", "shard", "rank", "phrase")})


@pytest.mark.parametrize("sizes", [{}, {"chunk": 300, "shard": 500, "sketch": 1 << 10, "bits": 1 << 10}, {"top": 3, "least": 2, "share": 80}])
def test_collocations(spark, docs, sizes, monkeypatch):
    """With the sizes as they are; with small ones, where filters let nearly all through and shards are copied; cut."""
    if "chunk" in sizes:
        monkeypatch.setattr(C, "ASKED", 7)
        monkeypatch.setattr(C, "FAN", 2)
    want = brute.collocations(docs, **{k: v for k, v in sizes.items() if k in ("top", "least", "share")})
    assert len(want) > 5 and rows(C.collocations(frame(spark, docs), **sizes)) == sorted(want)


def test_no_rows(spark):
    assert rows(C.collocations(frame(spark, []))) == []
    assert rows(C.collocations(frame(spark, [(None, None), ("a b", "en")]))) == []


def test_scores_past_64_bits(spark):
    n = 3 * 10**11
    df = spark.createDataFrame([(n, n + 1, 2 * n)], "n long, x long, y long").select(C._score("n", "x", "y").alias("s"))
    assert df.first()["s"] == 10**6 * n * n // ((n + 1) * 2 * n)

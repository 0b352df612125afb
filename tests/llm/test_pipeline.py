"""The pipeline's stages, each on its own input, and the queries' SQL."""

import duckdb
import pytest

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corvane.llm import queries
from corvane.llm.common import table, written
from corvane.llm.quality import ORDERS
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert out.columns == columns
            assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
            assert 0 < out.count() <= docs.count()
            docs = out
    assert out.select("doc_id").distinct().count() == docs.count()


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_each_stage_against_brute_force(spark):
    """Each stage on its own input: what the stages before it keep of a table with repeated ids and rows, nulls and a
    very long text."""
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SF, "documents")
    first = docs.orderBy("doc_id").limit(3).collect()
    odd = [(None, None, None, None, None), (None, first[0]["text"], "en", "s", 1), (first[1]["doc_id"], first[1]["text"], "en", "s", 1), (first[2]["doc_id"], "other words of the same id " * 30, "en", "s", 1), (9999, " ".join(f"word{i}" for i in range(60_000)), "en", "s", 1), (9998, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    labels = [tuple(r) for r in table(spark, SF, "labels").select("doc_id", "quality", "toxic").collect()]
    key = lambda x: sorted(x, key=repr)

    got = written(stages["quality_rules"](spark, docs, SF), "t")
    own = rows_of(docs)
    assert key(rows_of(got)) == key([r for r, (_, kept) in zip(own, brute.verdicts(own, labels, ORDERS)) if kept]) and got.columns == docs.columns

    for given in (docs, got):
        out = stages["line_dedup"](spark, given, SF)
        assert key(rows_of(out)) == key(brute.recurring_lines(rows_of(given))) and out.columns == docs.columns
        assert out.where("n_chars <> length(text)").count() == 0

    lines = written(stages["line_dedup"](spark, got, SF), "t")
    for given in (docs, lines):
        out = stages["near_duplicates"](spark, given, SF)
        own = rows_of(given)
        named = [(i, t) for i, (_, t) in enumerate(own)]
        part = {i: c for i, n, c in brute.linked(named, 5, 80) if n}
        groups = {}
        for i, c in part.items():
            groups.setdefault(c, []).append(i)
        least = lambda i: (own[i][0] is not None, own[i][0] or 0)
        want = [min(least(i) for i in g) for g in groups.values()] + [least(i) for i in range(len(own)) if i not in part]
        assert sorted((d is not None, d or 0) for d, _ in rows_of(out)) == sorted(want) and out.columns == docs.columns

    near = written(stages["near_duplicates"](spark, lines, SF), "t")
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for given in (docs, near):
        out = stages["decontamination"](spark, given, SF)
        own = rows_of(given)
        assert key(rows_of(out)) == key([r for r, x in zip(own, brute.contaminated(own, items, 10)) if not x[-1]]) and out.columns == docs.columns

    clean = written(stages["decontamination"](spark, near, SF), "t")
    for given in (docs, clean):
        packed = stages["packing"](spark, given, SF).collect()
        t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        size = [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows_of(given)]
        assert sum(r["length"] for r in packed) == sum(size) and sum(r["piece"] == 0 for r in packed) == len(size)
        bins = {}
        for r in packed:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= -(-sum(size) // 2048) + 1


def test_stages_of_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (i == 4 or out.columns == docs.columns)


def test_line_dedup_counts_texts(spark):
    """A licence block in 6 texts goes whole; a line in 10 texts goes, though one of them has 40 copies; copies alone stay."""
    words = "ant bee cat dog elk fox gnu hen ibis jay".split()
    licence = "licence says\nfirst of all\nthen the rest"
    data = [(i, f"{w} begins\n{licence}\n{w} ends") for i, w in enumerate(words[:6])]
    data += [(100 + i, f"{w} opens\nsee also\n{w} closes") for i, w in enumerate(words)]
    data += [(200 + i, "ant opens\nsee also\nant closes") for i in range(40)] + [(300 + i, "only\ncopies\nhere") for i in range(9)]
    got = dict(corpus_pipeline.line_dedup(spark, spark.createDataFrame(data, "doc_id long, text string"), SF).collect())
    assert got[0] == "ant begins\nant ends" and got[109] == "jay opens\njay closes" and got[239] == "ant opens\nant closes"
    assert got[308] == "only\ncopies\nhere"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    said = c.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(said)

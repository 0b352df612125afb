"""Issues by pages: links, errors, limits, filters."""

import json

import pytest

from corvane.sources import issues


def page(folder, name, issues_, link=None, status=200):
    d = folder / name
    d.mkdir(parents=True)
    (d / "part-0.json").write_text(json.dumps({"status": status, "link": link, "issues": issues_}))


def issue(n, **more):
    return {"number": n, "title": f"t{n}", "body": None, "html_url": f"u{n}", "state": "closed" if n % 2 else "open", "labels": ["bug"] if n % 3 else ["x", "bug"]} | more


@pytest.fixture
def folder(spark, tmp_path):
    issues.register(spark)
    page(tmp_path, "page=0", [issue(1), issue(2, pull_request={}), issue(3)], '<page=9>; rel="last", <page=b>; rel="next"')
    page(tmp_path, "page=b", [issue(4), issue(5, labels=None), issue(6, body="b")], '<page=2>; rel="next"')
    page(tmp_path, "page=2", [issue(7)], '<page=3>; rel="next"')
    page(tmp_path, "page=3", [issue(8)], '<page=0>; rel="next"', 500)
    return tmp_path


def numbers(df):
    return [r["number"] for r in df.orderBy("pos").collect()]


def test_links_are_followed_until_an_error(spark, folder):
    df = spark.read.format("issues").option("path", str(folder)).load()
    assert numbers(df) == [1, 3, 4, 5, 6, 7] and df.rdd.getNumPartitions() == 3
    assert {(r["symptom"], r["body"]) for r in df.collect()} == {("", ""), ("", "b")}


@pytest.mark.parametrize("limit,want,pages", [(1, [1], 1), (2, [1, 3], 1), (4, [1, 3, 4, 5], 2), (0, [], 1), (99, [1, 3, 4, 5, 6, 7], 3)])
def test_limit_reads_no_further(spark, folder, limit, want, pages):
    df = spark.read.format("issues").option("path", str(folder)).option("limit", limit).load()
    assert numbers(df) == want and df.rdd.getNumPartitions() == pages


def test_filters_are_pushed(spark, folder):
    df = spark.read.format("issues").option("path", str(folder)).load()
    assert numbers(df.where("state = 'closed'")) == [1, 3, 5, 7] and numbers(df.where("state = 'open' AND number > 4")) == [6]
    assert numbers(df.where("label = 'x'")) == [3, 6] and numbers(df.where("state = 'open' AND state = 'closed'")) == []
    reader = issues.IssueReader({"path": str(folder)})
    assert list(reader.pushFilters([issues.EqualTo(("state",), "open"), issues.EqualTo(("title",), "t")])) == [issues.EqualTo(("title",), "t")] and reader.wanted == {"state": "open"}
    limited = spark.read.format("issues").option("path", str(folder)).option("limit", 3).load()
    assert numbers(limited.where("state = 'open'")) == [4]  # of the first three


def test_no_pages_and_circles(spark, folder, tmp_path):
    assert numbers(spark.read.format("issues").option("path", str(tmp_path / "none")).load()) == []
    page(folder, "page=c", [issue(9)], '<page=c>; rel="next"')
    assert numbers(spark.read.format("issues").option("path", str(folder)).option("first", "page=c").load()) == [9]
    (folder / "page=2" / "part-0.json").write_text("{broken")
    assert numbers(spark.read.format("issues").option("path", str(folder)).load()) == [1, 3, 4, 5, 6]


def packed(spark, folder, path, block, **options):
    """The rows of the stored pages, packed, and the number of partitions they are read in."""
    issues.packed(issues.stored(spark, str(folder)), str(path), options.get("first", "page=0"), block)
    df = spark.read.format("issues").options(path=str(path), packed=True, **options).load()
    return [tuple(r) for r in df.orderBy("pos").collect()], df.rdd.getNumPartitions()


def test_packed_pages_are_read_as_stored_ones(spark, folder, tmp_path_factory):
    own = lambda **o: [tuple(r) for r in spark.read.format("issues").options(path=str(folder), **o).load().orderBy("pos").collect()]
    new = lambda: tmp_path_factory.mktemp("packed") / "p"
    assert packed(spark, folder, new(), 2) == (own(), 2) and len(own()) == 6
    for limit in (0, 1, 4, 99):
        assert packed(spark, folder, new(), 1, limit=limit)[0] == own(limit=limit)
    assert packed(spark, folder, new(), 9, state="open", label="x")[0] == own(state="open", label="x")
    path = new()
    issues.packed(issues.stored(spark, str(folder)), str(path))
    assert numbers(spark.read.format("issues").options(path=str(path), packed=True).load().where("state = 'closed'")) == [1, 3, 5, 7]
    (folder / "page=b" / "part-0.json").write_text('{"status": 200,\n "link": "<page=c>; rel=\\"next\\"", "issues": [{"number": 4}]}')
    page(folder, "page=c", [issue(9)], '<page=b>; rel="next"')  # a circle, met after page=0
    assert packed(spark, folder, new(), 1) == (own(), 3) and [r[1] for r in own()] == [1, 3, 4, 9]
    assert packed(spark, folder, new(), 1, first="page=none")[0] == []
    (folder / "page=0" / "part-0.json").write_text("{broken")
    assert packed(spark, folder, new(), 1)[0] == []


def test_links_of_many_pages_are_followed_in_joins(spark):
    """Names in no order, a page of an error at the end of the way, and pages that no link leads to."""
    names = [f"p{(i * 37) % 101}" for i in range(101)]
    value = lambda i: json.dumps({"status": 500 if i == 90 else 200, "link": f'<{names[(i + 1) % 101]}>; rel="next"', "issues": []})
    pages = spark.createDataFrame([(n, value(i)) for i, n in enumerate(names)], "page string, value string")
    assert {r["page"]: r["place"] for r in issues.followed(pages, names[5]).collect()} == {n: i for i, n in enumerate(names[5:90])}
    assert issues.followed(pages, names[90]).count() == 0 and issues.followed(pages, names[91]).count() == 100


def test_the_query_reads_many_pages_a_partition(spark):
    from corvane.plans.state_queries import s6_paged

    assert s6_paged(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 1  # of 10 pages and more

import json

import pytest
from pyspark.sql import functions as F

from loomsearch.operators.filters import And, Dynamic, Eq, Exists, Geo, In, Ne, Not, Or, Range, Text, Typed, parse_filter

DOCS = [
    ("a1", {"tag": "news", "val": 10, "title": "Vector Search"}),
    ("a2", {"tag": "blog", "val": 20.5, "title": ""}),
    ("a3", {"tag": "news", "val": 15, "place": {"lat": 48.85, "lng": 2.35}}),
    ("a4", {"tag": None, "val": "15", "flag": True, "list": [1, 2], "place": {"lat": "x", "lng": 2}}),
    ("a5", {}),
]


@pytest.fixture(scope="module")
def dynamic(spark):
    return spark.createDataFrame([(i, json.dumps(m)) for i, m in DOCS], "id string, m string").withColumn("v", F.parse_json("m")).cache()


@pytest.fixture(scope="module")
def typed(spark):
    rows = [("a1", "news", 10.0, True, "Vector Search", (48.85, 2.35)), ("a2", "blog", 20.5, None, "", (None, 1.0)), ("a3", "news", 15.0, False, None, None), ("a4", None, None, None, None, None)]
    return spark.createDataFrame(rows, "id string, tag string, val double, flag boolean, title string, place struct<lat: double, lng: double>").cache()


def dyn(df, tree):
    got = sorted(r["id"] for r in df.where(tree.column(Dynamic(F.col("v")))).collect())
    assert got == sorted(r["id"] for r in df.where(tree.where(Dynamic(F.col("v")))).collect())
    return got


def typ(df, tree):
    got = sorted(r["id"] for r in df.where(tree.column(Typed(df))).collect())
    assert got == sorted(r["id"] for r in df.where(tree.where(Typed(df))).collect())
    return got


def test_dynamic_leaves(dynamic):
    assert dyn(dynamic, Eq("tag", "news")) == ["a1", "a3"]
    assert dyn(dynamic, Eq("val", 15)) == ["a3"]
    assert dyn(dynamic, Eq("val", 15.0)) == ["a3"]
    assert dyn(dynamic, Eq("val", "15")) == ["a4"]
    assert dyn(dynamic, Eq("tag", None)) == ["a4"]
    assert dyn(dynamic, Eq("list", [1, 2])) == ["a4"]
    assert dyn(dynamic, Ne("tag", "news")) == ["a2", "a4", "a5"]
    assert dyn(dynamic, Range("val", 12, 21)) == ["a2", "a3"]
    assert dyn(dynamic, Range("val", 10, 15)) == ["a1", "a3"]
    assert dyn(dynamic, In("tag", ("blog", None))) == ["a2", "a4"]
    assert dyn(dynamic, In("tag", ())) == []
    assert dyn(dynamic, Exists("tag")) == ["a1", "a2", "a3", "a4"]
    assert dyn(dynamic, Text("title", "vECTOR s")) == ["a1"]
    assert dyn(dynamic, Text("title", "")) == ["a1"]
    assert dyn(dynamic, Geo("place", 48.85, 2.35, 10)) == ["a3"]
    assert dyn(dynamic, Eq("flag", True)) == ["a4"]
    assert dyn(dynamic, Eq("flag", 1)) == []


def test_combinators(dynamic, typed):
    every = ["a1", "a2", "a3", "a4", "a5"]
    assert dyn(dynamic, And(())) == every and dyn(dynamic, Or(())) == []
    assert dyn(dynamic, Not(Eq("nothing", 1))) == every
    assert dyn(dynamic, Eq("tag", "news") & Range("val", 12, None)) == ["a3"]
    assert typ(typed, ~Range("val", 12, None)) == ["a1", "a4"]
    assert typ(typed, Eq("tag", "blog") | Eq("flag", False)) == ["a2", "a3"]


def test_typed_leaves(typed):
    assert typ(typed, Eq("tag", "news")) == ["a1", "a3"]
    assert typ(typed, Eq("val", 10)) == ["a1"]
    assert typ(typed, Eq("val", "10")) == [] and typ(typed, Eq("val", True)) == []
    assert typ(typed, Ne("tag", "news")) == ["a2", "a4"]
    assert typ(typed, Ne("absent", 1)) == ["a1", "a2", "a3", "a4"]
    assert typ(typed, Exists("flag")) == ["a1", "a3"] and typ(typed, Exists("absent")) == []
    assert typ(typed, Text("title", "SEARCH")) == ["a1"]
    assert typ(typed, Geo("place", 48.85, 2.35, 0)) == ["a1"]


def test_no_filter_is_null(dynamic, typed):
    leaves = [Eq("tag", "news"), Ne("val", 3), Range("val", 1, 2), In("val", (1,)), Exists("x"), Text("title", "a"), Geo("place", 0, 0, 1)]
    for tree in leaves:
        for df, at in ((dynamic, Dynamic(F.col("v"))), (typed, Typed(typed))):
            assert df.where(tree.column(at).isNull()).count() == 0


def test_json_language(dynamic):
    assert parse_filter(None) is None and parse_filter({}) is None and parse_filter([1]) is None
    assert dyn(dynamic, parse_filter({"tag": "news", "val": {"$gt": 12}})) == ["a3"]
    assert dyn(dynamic, parse_filter('{"val": {"$gt": 10, "$lt": 15}}')) == ["a1", "a3"]
    assert dyn(dynamic, parse_filter({"val": {"$lt": 15, "$ne": 10}})) == ["a3"]
    assert dyn(dynamic, parse_filter({"tag": {"$in": ["blog"]}})) == ["a2"]
    assert dyn(dynamic, parse_filter({"title": {"$text": "vector"}})) == ["a1"]
    assert dyn(dynamic, parse_filter({"place": {"$geo": {"lat": 48.85, "lng": 2.35, "radius": 1}}})) == ["a3"]
    assert parse_filter({"val": {"$gt": 1e18}}).high is None
    for bad in ({"a": {"$gte": 1}}, {"a": {"$gt": "x"}}, {"a": {}}, {"a": {"$in": 3}}):
        with pytest.raises(ValueError):
            parse_filter(bad)
        assert parse_filter(bad, strict=False) is None


def test_dates_and_sets(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE '2020-01-02', TIMESTAMP '2020-01-02 03:04:05', 'a', 1.5D), (2, DATE '2021-01-01', NULL, 'b', 2.0D) AS t(n, d, t, s, x)").withColumn("n", F.col("n").cast("long"))
    found = lambda f: [r["n"] for r in df.where(f.where(Typed(df))).orderBy("n").collect()]
    assert found(Eq("d", "2020-01-02")) == [1] and found(Eq("t", "2020-01-02 03:04:05")) == [1] and found(Eq("d", "no date")) == []
    assert found(Range("d", 1_577_923_200, 1_600_000_000)) == [1] and found(Range("t", None, 1_577_934_245)) == [1] and found(Range("t", 1_577_934_246, None)) == []
    assert found(In("n", (1, 2.0, 3))) == [1, 2] and found(In("n", (1.5, "1"))) == [] and found(In("s", ("b", 1))) == [2] and found(In("x", (2, 1.5))) == [1, 2] and found(In("s", ())) == []
    plan = df.where(In("s", ("a", "b", "c")).where(Typed(df)))._jdf.queryExecution().optimizedPlan().toString()
    assert " OR " not in plan.split("Project")[0]

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsearch.operators import hnsw, ivf, recall, search
from loomsearch.operators.filters import Eq
from loomsearch.plans.database import Database
from loomsearch.plans.schema import Field, Schema
from loomsearch.sources import changelog, files, ndjson
from loomsearch.streaming import ingest


def doc(i, v, **metadata):
    return {"id": i, "vector": [float(x) for x in v], "metadata": metadata}


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_life_cycle(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_collection("test", "cosine")
    with pytest.raises(ValueError):
        db.create_collection("test")
    with pytest.raises(ValueError):
        db.create_collection("")
    with pytest.raises(KeyError):
        db.search("absent", [1.0])
    assert db.search("test", [1.0, 0, 0], 5).count() == 0
    assert db.batch_upsert("test", [doc(f"d{i}", [i / 10, 1 - i / 10, 0], seq=i) for i in range(10)]) == 10
    with pytest.raises(ValueError):
        db.upsert("test", doc("x", [1, 2]))
    with pytest.raises(ValueError):
        db.upsert("test", doc("", [1, 2, 3]))
    with pytest.raises(ValueError):
        db.batch_upsert("test", [])
    assert db.batch_remove("test", ["d1", "d2", "d3", "nobody"]) == 4
    assert db.stats("test") == {"doc_count": 7, "dimension": 3, "metric": "cosine", "index_type": "none"}
    assert ids(db.search("test", [1.0, 0, 0], 2)) == ["d9", "d8"]
    assert ids(db.search("test", [1.0, 0, 0], 5, {"seq": {"$gt": 4, "$lt": 6}})) == ["d6", "d5", "d4"]
    assert db.search("test", [], 5).count() == 0 and db.search("test", [1.0], 5).count() == 0
    with pytest.raises(ValueError):
        db.search("test", [1.0, 0, 0], 0)
    db.upsert("test", doc("d9", [0, 1, 0], seq=99))
    again = Database(spark, str(tmp_path / "db"))
    assert again.stats("test")["doc_count"] == 7 and ids(again.search("test", [0.0, 1, 0], 1, Eq("seq", 99))) == ["d9"]
    again.truncate("test")
    assert again.stats("test")["doc_count"] == 0 and again.stats("test")["dimension"] == 3
    again.delete_collection("test")
    assert again.list_collections() == [] and again.index_info("test") == "none" and again.ping()["collections"] == 0


def test_recovery_of_a_logged_change(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_collection("c", "l2")
    db.upsert("c", doc("a", [0, 1]))
    changelog.append(spark, str(tmp_path / "db" / "log"), [{"action": "upsert", "collection": "c", "document": doc("b", [1, 1])}], db.seq + 1)
    assert ids(Database(spark, str(tmp_path / "db")).search("c", [1.0, 1.0], 2)) == ["b", "a"]


def test_typed_collection_and_hybrid(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    schema = Schema((Field("tag", "string", True), Field("price", "float"), Field("active", "bool"), Field("title", "text"), Field("n", "int"), Field("at", "geo")))
    db.create_collection("typed", "cosine", schema)
    db.upsert("typed", doc("a", [1, 0, 0], tag="news", price=10.5, active=True, title="vector database engine", n=3.0, at={"lat": 1, "lng": 2}))
    for bad in ({"tag": 123}, {"price": "x"}, {"active": 1}, {"n": 3.5}, {"at": {"lat": 1}}, {"title": None}):
        with pytest.raises(ValueError):
            db.upsert("typed", doc("b", [1, 0, 0], **bad))
        with pytest.raises(ValueError):
            schema.check(bad)
    with pytest.raises(ValueError):
        db.batch_upsert("typed", [doc("ok", [0, 1, 0]), doc("b", [1, 0, 0], tag=1)])
    assert db.stats("typed")["doc_count"] == 1
    db.batch_upsert("typed", [doc("b", [0, 1, 0], title="SQL database query"), doc("c", [0.7, 0.3, 0], title="machine learning with vectors")])
    assert ids(db.hybrid_search("typed", [0.9, 0.1, 0], "vector database"))[0] == "a"
    with pytest.raises(ValueError):
        db.hybrid_search("typed", [1.0], "vector")
    assert Schema.parse(schema.to_json()) == schema
    for raw in ('{"fields": 3}', '{"fields": [{"type": "string"}]}', '{"fields": [{"name": "a"}, {"name": "a"}]}', '{"fields": [{"name": "a", "type": "date"}]}'):
        with pytest.raises(ValueError):
            Schema.parse(raw)


@pytest.mark.parametrize("kind", ["hnsw", "ivf"])
def test_indexes(spark, tmp_path, kind):
    db = Database(spark, str(tmp_path / "db"))
    db.create_collection("c", index_type=kind)
    db.batch_upsert("c", [doc(f"d{i:02}", [i / 40, 1 - i / 40, (i % 7) / 7], tag="news" if i % 3 == 0 else "blog") for i in range(40)])
    q = [0.9, 0.1, 0.3]
    assert ids(db.search("c", q, 3)) == ids(db.search("c", q, 3, exact=True)) and db.recall("c", q, 3)["recall"] == 1.0
    hits = db.search("c", q, 5, {"tag": "news"}).collect()
    assert hits and all(json.loads(r["metadata"])["tag"] == "news" for r in hits)
    db.upsert("c", doc("best", q, tag="news"))
    assert ids(db.search("c", q, 1)) == ["best"] and db.index_info("c") == kind
    said = db.explain("c", q, 2)
    assert said.index_type == kind and said.results.count() == 2 and 0 < said.scanned <= 41 and "Plan" in said.plan
    db.drop_index("c")
    assert db.index_info("c") == "none" and db.recall("c", q, 2) == {"recall": 1.0, "ann_searched": False}
    with pytest.raises(ValueError):
        db.build_index("c", "tree")


def test_snapshot_and_ndjson(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_collection("c", "ip", Schema((Field("t", "text"),)))
    db.batch_upsert("c", [doc("a", [1, 2], t='say "hi"\n'), doc("é", [0, 1], t="x")])
    db.snapshot(str(tmp_path / "snap"))
    db.export_ndjson("c", str(tmp_path / "out"))
    db.create_collection("other")
    db.restore(str(tmp_path / "snap"))
    assert db.list_collections() == ["c"] and db.stats("c")["doc_count"] == 2 and db.meta["c"].typed.text_field == "t"
    db.create_collection("copy", "ip")
    assert db.import_ndjson("copy", str(tmp_path / "out")) == 2
    assert {tuple(r) for r in db.documents("copy").select("id", "metadata").collect()} == {tuple(r) for r in db.documents("c").select("id", "metadata").collect()}
    (tmp_path / "bad.ndjson").write_text('# head\n/ note\n\n{"id":"z","vector":[1,2],"metadata":{}}\n{"id":"","vector":[1,2]}\n')
    with pytest.raises(ValueError, match="line 5"):
        db.import_ndjson("copy", str(tmp_path / "bad.ndjson"))
    assert db.stats("copy")["doc_count"] == 2
    assert ndjson.read(spark, str(tmp_path / "out")).count() == 2


def lines(spark, events):
    return spark.createDataFrame(list(enumerate(events)), "seq long, line string")


def test_changelog_replay(spark):
    log = [
        {"action": "create_collection", "collection": "t", "metric": "cosine"},
        {"action": "upsert", "collection": "t", "document": doc("d1", [1, 0.5], tag="news")},
        {"action": "batch_upsert", "collection": "t", "documents": [doc("d2", [1, 2]), doc("d3", [3, 4]), doc("d2", [9, 9])]},
        {"action": "delete", "collection": "t", "id": "d3"},
        {"action": "create_collection", "collection": "u", "metric": "l2"},
        {"action": "upsert", "collection": "u", "document": doc("x", [1, 1])},
        {"action": "delete_collection", "collection": "u"},
        {"action": "upsert", "collection": "v", "document": doc("old", [1])},
        {"action": "truncate_collection", "collection": "v"},
        {"action": "batch_delete", "collection": "t", "ids": ["nobody"]},
    ]
    text = [changelog.encode(e) for e in log]
    got = {(r["collection"], r["id"]): (r["vector"], r["metadata"]) for r in changelog.replay(lines(spark, text[:3] + ["", *text[3:]])).collect()}
    assert got == {("t", "d1"): ([1.0, 0.5], '{"tag":"news"}'), ("t", "d2"): ([9.0, 9.0], "{}")}
    broken = [*text[:2], text[2].replace("d2", "dX"), *text[3:]]
    assert [r["id"] for r in changelog.replay(lines(spark, broken)).collect()] == ["d1"]
    assert changelog.valid_prefix(lines(spark, [text[0], "{oops", text[1]])).count() == 1
    unchecked = text[1].replace(text[1].split('"crc32":')[1].split(",")[0], "0", 1)
    assert changelog.replay(lines(spark, [unchecked])).count() == 1
    assert changelog.replay(lines(spark, [])).count() == 0
    with pytest.raises(ValueError):
        changelog.encode({"action": "dance"})


def test_streaming_upserts(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    schema = "id string, seq long, action string, value long"
    batch = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    run = lambda: ingest.upserts(spark.readStream.schema(schema).json(source), table, state, ["id"], ["seq"]).awaitTermination()
    batch([("a", 1, "upsert", 10), ("b", 2, "upsert", 20), ("a", 5, "upsert", 11)])
    run()
    batch([("b", 3, "delete", None), ("a", 4, "upsert", 99), ("c", 6, "upsert", 30)])
    run()
    run()
    rows = {r["id"]: r["value"] for r in ingest.live(ingest.current(spark, table)).collect()}
    assert rows == {"a": 11, "c": 30}
    ingest.merge(spark.createDataFrame([("z", 9, "upsert", 1)], schema), 0, table, ["id"], ["seq"])
    assert ingest.current(spark, table).where(F.col("id") == "z").count() == 0


def test_upserts_are_deltas_and_old_versions_go(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_collection("c", "l2")
    db.load("c", spark.range(20_000).selectExpr("cast(id as string) as id", "array(cast(id as double), rand(1), rand(2), rand(3)) as vector", "concat('{\"n\":', id, '}') as metadata"))
    size = files.size(spark, str(tmp_path / "db" / "data" / "c"))
    base = db.meta["c"].version
    for i in range(12):
        db.upsert("c", doc(str(i), [i + 0.5, 0, 0, 0], n=-i))
        if i == 3:
            assert db.meta["c"].version == base and len(db.meta["c"].deltas) == 4
    db.batch_remove("c", ["5", "19999", "nobody"])
    assert files.size(spark, str(tmp_path / "db" / "data" / "c")) <= 3 * size
    assert db.meta["c"].version != base
    for one in (db, Database(spark, str(tmp_path / "db"))):
        assert one.stats("c")["doc_count"] == 19_998
        assert ids(one.search("c", [7.5, 0, 0, 0], 1)) == ["7"] and one.search("c", [5.5, 0, 0, 0], 3).where("id = '5'").count() == 0


def test_crash_before_the_catalog_is_replaced(spark, tmp_path, monkeypatch):
    db = Database(spark, str(tmp_path / "db"))
    db.create_collection("c")
    db.load("c", spark.createDataFrame([("a", [1.0, 0.0], "{}"), ("b", [0.0, 1.0], "{}")], "id string, vector array<double>, metadata string"))
    whole = files.write_text
    monkeypatch.setattr(files, "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        db.upsert("c", doc("x", [1, 1]))
    monkeypatch.setattr(files, "write_text", whole)
    (tmp_path / "db" / "meta.json.new").write_text('{"seq":')  # as when it ended while writing
    again = Database(spark, str(tmp_path / "db"))
    assert {r["id"] for r in again.documents("c").collect()} == {"a", "b", "x"}
    files.write_text(spark, str(tmp_path / "t"), "1")
    files.write_text(spark, str(tmp_path / "t"), "2")
    assert files.read_text(spark, str(tmp_path / "t")) == "2"


@pytest.mark.parametrize("kind", ["hnsw", "ivf"])
def test_index_takes_changes_without_a_rebuild(spark, tmp_path, kind, monkeypatch):
    db = Database(spark, str(tmp_path / "db"))
    db.create_collection("c", index_type=kind)
    db.batch_upsert("c", [doc(f"d{i:03}", [i / 300, 1 - i / 300, (i % 7) / 7, (i % 11) / 11], tag="news" if i % 3 == 0 else "blog") for i in range(300)])
    q = [0.9, 0.1, 0.3, 0.5]
    first = ids(db.search("c", q, 5))
    for module, name in ((ivf, "train"), (hnsw, "build")):
        monkeypatch.setattr(module, name, lambda *a, **k: pytest.fail("built again"))
    db.batch_remove("c", [first[0]])
    db.batch_upsert("c", [doc("best", q, tag="news"), doc(first[1], [-1, 0, 0, 0], tag="blog")])
    assert ids(db.search("c", q, 4)) == ["best", *first[2:5]] and ids(db.search("c", q, 1, {"tag": "news"})) == ["best"]
    hits, truth = (ids(db.search("c", q, 20, {"tag": "blog"}, exact=x)) for x in (False, True))
    assert len(set(hits) & set(truth)) >= 18
    if kind == "ivf":
        version = db.meta["c"].version
        for i in range(8):
            db.upsert("c", doc(f"x{i}", [0.9, 0.1, 0.3, 0.5 + (i + 1) / 1000]))
        m = db.meta["c"]
        assert m.version != version and m.index_version == m.version
        assert ids(db.search("c", q, 4)) == ["best", "x0", "x1", "x2"]


def test_filtered_graph_recall(spark):
    r = np.random.default_rng(11)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.uniform(-1, 1, (3000, 16)))], "id long, vector array<double>")
    graph, asked = hnsw.build(df, shards=1).cache(), df.where("id % 100 = 0")
    for share in ("id % 2 = 0", "id % 5 = 0"):
        got = hnsw.search_batch(asked, graph, 10, allowed=df.where(share).select("id"))
        assert got.where(f"not (id % {share.split()[2]} = 0)").count() == 0
        assert recall.recall_at_k(got, search.search_batch(asked, df.where(share), 10)).first()["recall"] >= 0.9
    graph.unpersist()
    assert hnsw.shard_count(100, 8) == 1 and hnsw.shard_count(2000, 8) == 8 and hnsw.shard_count(10**9, 8) == 50_000


def test_replay_has_no_window_by_collection(spark):
    log = lines(spark, [changelog.encode({"action": "upsert", "collection": "t", "document": doc("d", [1])})])
    assert "Window" not in changelog.replay(log)._jdf.queryExecution().executedPlan().toString()

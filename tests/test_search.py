import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsearch.plans.queries import QUERIES
from loomsearch.operators import bm25, hnsw, hybrid, ivf, metadata_index, recall, search
from loomsearch.operators.filters import Eq, Typed


def frame(spark, v, **more):
    rows = [(i, [float(y) for y in x], *[c[i] for c in more.values()]) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id long, vector array<double>" + "".join(f", {k} string" for k in more))


@pytest.fixture(scope="module")
def uniform():
    return np.random.default_rng(42).uniform(-1, 1, (100, 128))


def truth(v, q, k, metric):
    s = {"cosine": v @ q / np.linalg.norm(v, axis=1) / np.linalg.norm(q), "l2": -np.linalg.norm(v - q, axis=1), "ip": v @ q}[metric]
    return np.lexsort((np.arange(len(v)), -np.round(s, 9)))[:k].tolist()


def test_order_ties_and_limits(spark):
    df = frame(spark, [[1, 0, 0], [0.99, 0.01, 0], [-1, 0, 0], [1, 0, 0]])
    got = search.search(df, [1.0, 0, 0], 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 3, 1, 2] and abs(got[0]["score"] - 1) < 1e-6
    assert [r["rank"] for r in got] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        search.search(df, [1.0, 0, 0], 0)
    assert search.search(df, [1.0, 0], 3).count() == 0
    assert search.search(df.where("false"), [1.0, 0, 0], 3).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_batch_equals_brute_force(spark, uniform, metric):
    df = frame(spark, uniform)
    got = {}
    for r in search.search_batch(df.repartition(3), df, 5, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {i: truth(uniform, q, 5, metric) for i, q in enumerate(uniform)}


def test_batch_blocks(spark, uniform, monkeypatch):
    df = frame(spark, uniform[:40])
    a = {tuple(r) for r in search.search_batch(df, df, 4).select("query_id", "rank", "id").collect()}
    b = {tuple(r) for r in search.search_batch(df, df.repartition(7), 4).select("query_id", "rank", "id").collect()}
    assert a == b and len(a) == 160


def test_filtered_and_oversampled(spark, uniform):
    tags = ["news" if i % 3 == 0 else "blog" for i in range(100)]
    df = frame(spark, uniform, tag=tags)
    where = Eq("tag", "news").column(Typed(df))
    want = [i for i in truth(uniform, uniform[1], 100, "cosine") if i % 3 == 0][:10]
    assert [r["id"] for r in search.search(df, uniform[1], 10, where=where).orderBy("rank").collect()] == want
    assert [r["id"] for r in search.search_oversampled(df, uniform[1], where, 10).orderBy("rank").collect()] == want
    rare = F.col("id") == 99
    assert [r["id"] for r in search.search_oversampled(df, uniform[1], rare, 2).collect()] == [99]


CORPUS = [("vector database engine",), ("database query optimization",), ("machine learning with vector embeddings",), ("...",), (None,), ("",)]


def test_bm25(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(CORPUS)], "id long, text string")
    got = bm25.search(df, "vector database database", 10).orderBy("rank").collect()
    assert got[0]["id"] == 0 and {r["id"] for r in got} == {0, 1, 2}
    s = bm25.stats(df).first()
    assert s["n_docs"] == 3 and abs(s["avg_len"] - 11 / 3) < 1e-9
    idf = np.log(1 + (3 - 2 + 0.5) / 2.5)
    one = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / (11 / 3)))
    assert abs(got[0]["score"] - 2 * one) < 1e-9
    assert bm25.search(df, "absent", 5).count() == 0 and bm25.search(df, "", 5).count() == 0
    assert {(r["term"], r["df"]) for r in bm25.document_frequencies(df).collect()} >= {("vector", 2), ("engine", 1)}


def hybrid_docs(spark):
    rows = [(1, [1.0, 0, 0], "vector database engine"), (2, [0.0, 1, 0], "SQL database query"), (3, [0.7, 0.3, 0], "machine learning with vectors"), (4, [0.0, 0, 1], None)]
    return spark.createDataFrame([(i, [float(x) for x in v], t) for i, v, t in rows], "id long, vector array<double>, text string")


def test_hybrid_modes(spark):
    docs, q = hybrid_docs(spark), [0.9, 0.1, 0]
    run = lambda **o: hybrid.search(docs, q if o.pop("v", True) else [], o.pop("t", "vector database"), o.pop("k", 10), **o).orderBy("rank").collect()
    assert run()[0]["id"] == 1
    plain = run(t="")
    assert [r["id"] for r in plain] == [1, 3, 2, 4] and plain[0]["combined_score"] == plain[0]["vector_score"] and plain[0]["text_score"] == 0
    only = run(v=False, alpha=0.0)
    assert [r["id"] for r in only] == [1, 2, 3, 4] and {r["vector_score"] for r in only} == {1.0} and only[2]["combined_score"] == 0
    rrf = {r["id"]: r for r in run(alpha=-1.0)}
    assert abs(rrf[1]["combined_score"] - (1 / 61 + 1 / 61)) < 1e-12
    assert abs(rrf[2]["combined_score"] - (1 / 63 + 1 / 62)) < 1e-12
    assert abs(rrf[4]["combined_score"] - 1 / 64) < 1e-12
    text_rrf = {r["id"]: r["combined_score"] for r in run(v=False, alpha=-1.0)}
    assert abs(text_rrf[1] - 1 / 61) < 1e-12 and text_rrf[4] == 0
    far = run(metric="l2")
    assert {r["vector_score"] for r in far} == {1.0}
    kept = run(where=F.col("id") != 1)
    assert 1 not in [r["id"] for r in kept] and max(r["vector_score"] for r in kept) < 1


def test_global_rank(spark):
    v = np.round(np.random.default_rng(1).uniform(0, 1, 300), 2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, s double").repartition(5)
    got = {r["id"]: r["n"] for r in hybrid.global_rank(df, "s", "id", "n").collect()}
    order = np.lexsort((np.arange(300), -v))
    assert got == {int(x): i + 1 for i, x in enumerate(order)}
    assert hybrid.global_rank(df.where("false"), "s", "id", "n").count() == 0


def clustered():
    r = np.random.default_rng(99)
    centres = r.uniform(-1, 1, (5, 128))
    return np.concatenate([c + r.normal(0, 0.2, (80, 128)) for c in centres])


def test_ivf_recall_and_filter(spark):
    v = clustered()
    df = frame(spark, v, tag=["news" if i % 3 == 0 else "blog" for i in range(400)])
    centroids = ivf.train(df, k=20)
    lists = ivf.assign(df, centroids)
    near = ivf.search_batch(df, lists, centroids, 10)
    share = recall.recall_at_k(near, search.search_batch(df, df, 10)).first()
    assert share["queries"] == 400 and share["recall"] >= 0.85
    full = ivf.search_batch(df, lists, centroids, 10, n_probe=20)
    assert recall.recall_at_k(full, search.search_batch(df, df, 10)).first()["recall"] == 1.0
    both = lists.join(df.select("id", "tag"), "id")
    hits = ivf.search(both, centroids, v[0], 10, where=Eq("tag", "news").column(Typed(both))).collect()
    assert hits and all(r["id"] % 3 == 0 for r in hits)


def test_ivf_lloyd_keeps_empty_lists(spark):
    df = frame(spark, [[0, 0], [1, 0], [0, 1]])
    c = np.array([[0.0, 0], [1, 0], [50, 50]])
    lists = ivf.assign(df, c)
    assert {r["id"]: r["cid"] for r in lists.collect()} == {0: 0, 1: 1, 2: 0}
    got = {(r["cid"], r["pos"]): r["value"] for r in ivf.lloyd_step(lists, c).collect()}
    assert got[(2, 0)] == 50 and got[(0, 1)] == 0.5


def test_hnsw_recall_delete(spark, uniform):
    df = frame(spark, uniform)
    graph = hnsw.build(df, shards=2).cache()
    exact = search.search_batch(df, df, 10)
    assert recall.recall_at_k(hnsw.search_batch(df, graph, 10), exact).first()["recall"] >= 0.95
    layer = graph.where("layer = 0")
    assert layer.count() == 100 and layer.agg(F.max(F.size("neighbors"))).first()[0] <= hnsw.M_BASE
    gone = df.where("id < 50").select("id")
    assert hnsw.search_batch(df, graph, 10, deleted=gone).where("id < 50").count() == 0
    assert recall.recall_at_k(exact.where("false"), exact.where("false")).first()["recall"] == 1.0


def test_metadata_index(spark):
    df = spark.createDataFrame([("a", '{"k": 5, "s": "x", "b": true, "n": null}'), ("b", '{"k": 5.0, "f": 1.25, "l": [1]}'), ("c", "{}"), ("d", None)], "id string, metadata string")
    index = metadata_index.postings(df).cache()
    keys = {(r["field"], r["key"], r["id"]) for r in index.collect()}
    assert {("k", "i:5", "a"), ("s", "s:x", "a"), ("b", "b:true", "a"), ("f", "f:1.250000", "b"), ("l", "?:[1]", "b"), ("n", "?:null", "a")} <= keys
    assert [r["id"] for r in metadata_index.match(index, "s", "x").collect()] == ["a"]
    assert {r["id"] for r in metadata_index.match_range(index, "k", 5, 6).collect()} == {"a", "b"}
    assert {r["id"] for r in metadata_index.match_in(index, "k", [5, 7]).collect()} >= {"a"}
    assert {r["id"] for r in metadata_index.all_ids(index).collect()} == {"a", "b"}
    assert metadata_index.size(metadata_index.remove(index, df.where("id = 'a'"))) == 3


def test_recall_of_registered_ivf_query(spark):
    row = QUERIES["recall_at_k"](spark, "/root/testdata/sf0.01").first()
    assert row["queries"] == 500 and row["recall"] >= 0.9


def test_blocks_keep_the_best_with_ties():
    r = np.random.default_rng(3)
    s, ids = r.integers(0, 4, (30, 50)) / 4, r.permutation(50)
    row, at = search.best_of_block(s, ids, 7)
    for i in range(30):
        assert list(at[row == i]) == list(np.lexsort((ids, -s[i]))[:7])
    assert len(search.best_of_block(s[:, :3], ids[:3], 7)[0]) == 90


def test_list_with_most_rows_is_cut_over_tasks(spark):
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(0, 0.01, (6000, 8)), r.normal(5, 1, (200, 8))])
    df = frame(spark, v)
    c = np.array([[0.0] * 8, [5.0] * 8])
    lists = ivf.assign(df, c)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are put together again
    parts = ivf._blocks(lists).withColumn("p", F.spark_partition_id()).where("cid = 0").select("p").distinct().count()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts > 1
    asked = df.where("id % 500 = 0")
    got = {(x["query_id"], x["rank"]): x["id"] for x in ivf.search_batch(asked, lists, c, 5, 2, "l2").collect()}
    assert got == {(x["query_id"], x["rank"]): x["id"] for x in search.search_batch(asked, df, 5, "l2").collect()}


def test_stored_text_index(spark, tmp_path):
    rows = [(1, "vector database engine"), (2, "database query, the database"), (3, "machine learning with vectors"), (4, None), (5, "..."), (None, "database")]
    docs = spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path / "index")
    bm25.add(docs, path)
    exact = lambda d, q: {r["id"]: round(r["score"], 9) for r in bm25.scores(d.where("id is not null"), q).collect()}
    stored = lambda q: {r["id"]: round(r["score"], 9) for r in bm25.stored_scores(spark, path, q).collect()}
    for q in ("database", "vector engine", "nothing", ""):
        assert stored(q) == exact(docs, q)
    bm25.add(spark.createDataFrame([(2, "a vector"), (6, "engine")], "id long, text string"), path)
    bm25.remove(spark.createDataFrame([(3,), (99,)], "id long"), path)
    now = spark.createDataFrame([(1, "vector database engine"), (2, "a vector"), (6, "engine")], "id long, text string")
    for q in ("database", "vector engine", "machine"):
        assert stored(q) == exact(now, q)
    assert [r["id"] for r in bm25.stored_search(spark, path, "engine", 1).collect()] == [6]


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("lists", [0, 40])
def test_a_task_keeps_the_best_over_all_blocks_that_it_meets(monkeypatch, metric, lists):
    r = np.random.default_rng(6)
    v = r.normal(0, 1, (900, 16)) * np.repeat([1.0, 1e-3, 1e4], 300)[:, None]
    v[100:140], v[200] = v[50], 0
    ids, cid = r.permutation(900), r.integers(0, 40, 900).astype(np.int32)
    probed = r.random((900, 40)) < 0.7
    kind = search.Metric.parse(metric)
    whole = []
    monkeypatch.setattr(search, "pair_scores", lambda q, d, m, f=search.pair_scores: (whole.append(len(d)), f(q, d, m))[1])
    rows = []
    for b, at in enumerate(range(0, 900, 300)):
        for x in range(0, 900, 300):
            q, d = (slice(y, y + 300) for y in (at, x))
            bits = np.packbits(probed[q], axis=1, bitorder="little").tobytes() if lists else b""
            rows.append((b, ids[q].astype(np.int64).tobytes(), v[q].tobytes(), bits, ids[d].astype(np.int64).tobytes(), v[d].tobytes(), cid[d].tobytes() if lists else b""))
    batch = search.pa.RecordBatch.from_arrays([search.pa.array(c) for c in zip(*rows)], list("abcdefg"))
    out = search.pa.Table.from_batches(search._meet(7, kind, lists)(iter([batch]))).to_pydict()
    assert len(out["id"]) == 900 * 7  # not 7 for each pair of blocks
    assert sum(whole) < 9 * 300
    s = search.pair_scores(v, v, kind)
    if lists:
        s = np.where(probed[:, cid], s, -np.inf)
    row, at = search.best_of_block(s, ids, 7)
    assert set(zip(out["query_id"], out["id"])) == set(zip(ids[row].tolist(), ids[at].tolist()))


def test_queries_walk_a_graph_together(spark, uniform):
    for metric in search.Metric:
        graph = hnsw.Graph(uniform, metric)
        for i, level in enumerate(hnsw.levels(len(uniform))):
            graph.insert(i, int(level))
        row, node, score = graph.many(uniform, 5)
        alone = [graph.search(q, 5) for q in uniform]
        assert np.allclose(score.reshape(100, 5), [[s for s, _ in x] for x in alone]) and (np.diff(row) >= 0).all()
    built = spark.sparkContext.accumulator(0)

    def count(rows):
        for b in rows:
            built.add(b.num_rows)
            yield b

    df = frame(spark, uniform)
    graph = hnsw.build(df, shards=2)
    counted = graph.mapInArrow(count, graph.schema)
    asked = df.unionByName(df).unionByName(df)
    assert hnsw.search_batch(asked, counted, 3).count() and built.value == graph.count()

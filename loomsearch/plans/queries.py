"""The registered queries of the search engine, each over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import bm25, hnsw, hybrid, ivf, metadata_index, recall, search
from ..operators.filters import And, Dynamic, Eq, Exists, Filter, Geo, In, Ne, Not, Or, Range, Text, Typed, parse_filter
from ..session import scratch_dir
from ..sources import changelog, ndjson
from .database import Database
from .schema import Field, Schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TERMS = "the and der que la nicht"
K = 10
#: The IVF queries take the first vectors as centroids, as many as ivf.list_count says, and probe as many lists as hold this share of the true neighbours of the rows whose id is divisible by 20.
RECALL = 0.92


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def first_vectors(spark: SparkSession, sf_dir: str, n: int) -> np.ndarray:
    return np.array([r["vector"] for r in vectors(spark, sf_dir).orderBy("id").limit(n).collect()], np.float64)


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# SQL parts

V = "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings"
Q = f"SELECT v AS q FROM ({V}) ORDER BY id LIMIT 1"
SQL_SCORE = {
    "cosine": "CASE WHEN list_dot_product(v, v) = 0 OR list_dot_product(q, q) = 0 THEN 0.0 ELSE list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) END",
    "l2": "-list_distance(v, q)",
    "ip": "list_dot_product(v, q)",
}


def top_sql(metric: str, where: str = "true") -> str:
    return f"""SELECT row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank, id, round(s, 6) + 0.0 AS score
FROM (SELECT id, {SQL_SCORE[metric]} AS s FROM ({V}), ({Q}) WHERE {where}) ORDER BY rank LIMIT {K}"""


def batch_sql(metric: str) -> str:
    return f"""SELECT query_id, rank, id, round(s, 6) + 0.0 AS score FROM (
SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank
FROM (SELECT a.id AS query_id, b.id AS id, {SQL_SCORE[metric]} AS s FROM (SELECT id, v AS q FROM ({V})) a, ({V}) b)) WHERE rank <= {K}"""


TOKENS = f"list_filter(string_split_regex(translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^A-Za-z0-9\\x{{{{80}}}}-\\x{{{{10FFFF}}}}]+'), lambda x: x <> '')"
DOC_TOKENS = TOKENS.format("text")


def bm25_sql(source: str) -> str:
    """CTEs up to hits(id, s) of documents of source(id, text)."""
    terms = ", ".join(f"('{t}')" for t in dict.fromkeys(TERMS.split()))
    return f"""tok AS (SELECT id, {DOC_TOKENS} AS w FROM {source} WHERE text IS NOT NULL),
doc AS (SELECT id, w, len(w) AS dl FROM tok WHERE len(w) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS adl FROM doc),
tf AS (SELECT id, dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM doc, (VALUES {terms}) AS t(term)),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
hits AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / adl))) AS s FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY id)"""


# Vector math and exact search


@query(f"SELECT id, round(list_dot_product(v, q), 6) + 0.0 AS dot FROM ({V}), ({Q})")
def vec_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = metrics.vector(first_vectors(spark, sf_dir, 1)[0])
    return six(vectors(spark, sf_dir).select("id", metrics.dot(F.col("vector"), q).alias("dot")), "dot")


@query(f"SELECT id, round(list_dot_product(v, v), 6) AS squared_norm FROM ({V})")
def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(vectors(spark, sf_dir).select("id", metrics.squared_norm(F.col("vector")).alias("squared_norm")), "squared_norm")


@query(f"SELECT id, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - q[i]) * (v[i] - q[i]))), 6) AS squared_l2 FROM ({V}), ({Q})")
def vec_l2sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = metrics.vector(first_vectors(spark, sf_dir, 1)[0])
    return six(vectors(spark, sf_dir).select("id", metrics.squared_l2(F.col("vector"), q).alias("squared_l2")), "squared_l2")


def _top(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    return six(search.search(vectors(spark, sf_dir), first_vectors(spark, sf_dir, 1)[0], K, metric), "score")


@query(top_sql("cosine"))
def search_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "cosine")


@query(top_sql("l2"))
def search_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "l2")


@query(top_sql("ip"))
def search_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "ip")


@query(top_sql("cosine", "label IN (2, 5)"))
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return six(search.search(docs, first_vectors(spark, sf_dir, 1)[0], K, "cosine", In("label", (2, 5)).where(Typed(docs))), "score")


@query(top_sql("l2", "label <> 3"))
def search_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return six(search.search(docs, first_vectors(spark, sf_dir, 1)[0], K, "l2", parse_filter({"label": {"$ne": 3}}).where(Typed(docs))), "score")


@query(
    f"""WITH s AS (SELECT id, label, {SQL_SCORE["cosine"]} AS s FROM ({V}), ({Q})),
near AS (SELECT id, s FROM (SELECT * FROM s ORDER BY round(s, 9) DESC, id LIMIT {3 * K}) WHERE label = 4),
pick AS (SELECT id, s FROM near WHERE (SELECT count(*) FROM near) >= {K} UNION ALL SELECT id, s FROM s WHERE label = 4 AND (SELECT count(*) FROM near) < {K})
SELECT row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank, id, round(s, 6) + 0.0 AS score FROM pick ORDER BY rank LIMIT {K}"""
)
def search_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return six(search.search_oversampled(docs, first_vectors(spark, sf_dir, 1)[0], Eq("label", 4).column(Typed(docs)), K), "score")


def _batch(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return six(search.search_batch(docs, docs, K, metric), "score")


@query(batch_sql("cosine"))
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, "cosine")


@query(batch_sql("l2"))
def search_batch_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, "l2")


@query(batch_sql("ip"))
def search_batch_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, "ip")


# Filters over documents and their partial labels

DL = "documents d LEFT JOIN labels l USING (doc_id)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def _filter(name: str, tree: Filter, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _labelled(spark, sf_dir)
        return docs.where(tree.where(Typed(docs))).select("doc_id", "lang")

    run.__name__ = name
    query(f"SELECT doc_id, lang FROM {DL} WHERE {sql}")(run)


_filter("filter_eq", Eq("quality", 1), "coalesce(quality = 1, false)")
_filter("filter_ne", Ne("toxic", 1), "NOT coalesce(toxic = 1, false)")
_filter("filter_in", In("lang", ("fr", "de", 7)), "coalesce(lang IN ('fr', 'de'), false)")
_filter("filter_range", Range("n_chars", 500, 2000), "coalesce(n_chars BETWEEN 500 AND 2000, false)")
_filter("filter_exists", Exists("quality"), "quality IS NOT NULL")
_filter("filter_text", Text("text", "THE "), f"coalesce(contains(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), 'the ') AND length(text) > 0, false)")
_filter("filter_and", And((Eq("lang", "en"), Range("n_chars", 1000, None), Ne("quality", 0))), "coalesce(lang = 'en', false) AND coalesce(n_chars >= 1000, false) AND NOT coalesce(quality = 0, false)")
_filter("filter_or", Or((Eq("toxic", 1), Eq("lang", "es"))), "coalesce(toxic = 1, false) OR coalesce(lang = 'es', false)")
_filter("filter_not", Not(Or((Eq("quality", 1), Text("source", "SRC1")))), "NOT (coalesce(quality = 1, false) OR coalesce(contains(lower(source), 'src1') AND length(source) > 0, false))")

_filter("filter_plain_value", parse_filter({"lang": "en", "toxic": 0}), "coalesce(lang = 'en', false) AND coalesce(toxic = 0, false)")
_filter("filter_eq_operator", parse_filter({"lang": {"$eq": "de"}}), "coalesce(lang = 'de', false)")
_filter("filter_text_operator", parse_filter('{"text": {"$text": "LICENSE"}, "n_chars": {"$gt": 100}}'), f"coalesce(contains(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), 'license'), false) AND coalesce(n_chars >= 100, false)")
_filter("filter_unknown_ignored", parse_filter({"lang": {"$ne": "en", "$like": "x"}, "n_chars": {"$near": 3, "$lt": 900}}, strict=False), "NOT coalesce(lang = 'en', false) AND coalesce(n_chars <= 900, false)")

SUPPLIERS = "SELECT s_suppkey, (s_suppkey * 37 % 180 - 90)::DOUBLE AS lat, (s_suppkey * 73 % 360 - 180)::DOUBLE AS lng FROM supplier"
KM = "2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a))"
HAV = f"SELECT *, sin(radians(48.85 - lat) / 2) ^ 2 + cos(radians(lat)) * cos(radians(48.85)) * sin(radians(2.35 - lng) / 2) ^ 2 AS a FROM ({SUPPLIERS})"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.struct((k * 37 % 180 - 90).cast("double").alias("lat"), (k * 73 % 360 - 180).cast("double").alias("lng")).alias("place"))


@query(f"SELECT s_suppkey, round({KM}, 6) AS km FROM ({HAV})")
def geo_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("s_suppkey", F.round(metrics.haversine_km(F.col("place.lat"), F.col("place.lng"), F.lit(48.85), F.lit(2.35)), 6).alias("km"))


@query(f"SELECT s_suppkey FROM ({HAV}) WHERE {KM} <= 5000")
def filter_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _places(spark, sf_dir)
    return places.where(Geo("place", 48.85, 2.35, 5_000_000).where(Typed(places))).select("s_suppkey")


@query(f"SELECT s_suppkey FROM ({HAV}) WHERE {KM} <= 3000 AND s_suppkey >= 10")
def filter_geo_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _places(spark, sf_dir)
    return places.where(parse_filter({"place": {"$geo": {"lat": 48.85, "lng": 2.35, "radius": 3_000_000}}, "s_suppkey": {"$gt": 10}}).where(Typed(places))).select("s_suppkey")


@query("SELECT vec_id AS id, label FROM embeddings")
def filter_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No filter leaves all rows."""
    docs = vectors(spark, sf_dir)
    return docs.where(F.lit(True) if parse_filter(None) is None and parse_filter({}) is None else F.lit(False)).select("id", "label")


@query("SELECT event_id, props FROM events WHERE coalesce((props ->> '$.k')::DOUBLE BETWEEN 10 AND 60, false) AND event_type IN ('click', 'view')")
def filter_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    inside = parse_filter('{"k": {"$gt": 10, "$lt": 60}}').where(Dynamic(F.try_parse_json("props")))
    return events.where(inside & parse_filter({"event_type": {"$in": ["click", "view"]}}).where(Typed(events))).select("event_id", "props")


# Metadata postings

POSTS = "SELECT key AS field, CASE WHEN json_type(value) IN ('UBIGINT', 'BIGINT') THEN 'i:' || (value ->> '$') ELSE '?:' || value::VARCHAR END AS key, event_id AS id, CASE WHEN json_type(value) IN ('UBIGINT', 'BIGINT') THEN (value ->> '$')::DOUBLE END AS num FROM (SELECT event_id, unnest(json_keys(props)) AS key, json_extract(props, '$.' || unnest(json_keys(props))) AS value FROM events)"


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_index.postings(table(spark, sf_dir, "events"), "event_id", "props")


@query(POSTS)
def meta_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir)


@query(f"SELECT DISTINCT id FROM ({POSTS}) WHERE field = 'k' AND key = 'i:7'")
def meta_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_index.match(_postings(spark, sf_dir), "k", 7)


@query(f"SELECT DISTINCT id FROM ({POSTS}) WHERE field = 'k' AND key IN ('i:3', 'i:11')")
def meta_match_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_index.match_in(_postings(spark, sf_dir), "k", [3, 11])


@query(f"SELECT DISTINCT id FROM ({POSTS}) WHERE field = 'k' AND num BETWEEN 20 AND 40")
def meta_match_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_index.match_range(_postings(spark, sf_dir), "k", 20, 40)


# Text


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


TEXTS = "(SELECT doc_id AS id, text FROM documents)"


@query(f"SELECT id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT id, {DOC_TOKENS} AS w FROM {TEXTS} WHERE text IS NOT NULL)")
def text_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.tokens(F.col("text"))
    return _texts(spark, sf_dir).where("text is not null").select("id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("digest"))


@query(f"SELECT term, id, count(*) AS tf FROM (SELECT id, unnest({DOC_TOKENS}) AS term FROM {TEXTS}) GROUP BY term, id")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.postings(_texts(spark, sf_dir))


@query(f"SELECT count(*) AS n_docs, round(avg(len(w)), 6) AS avg_len FROM (SELECT {DOC_TOKENS} AS w FROM {TEXTS}) WHERE len(w) > 0")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(bm25.stats(_texts(spark, sf_dir)), "avg_len")


@query(f"WITH src AS (SELECT * FROM {TEXTS}), {bm25_sql('src')} SELECT row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank, id, round(s, 6) AS score FROM hits ORDER BY rank LIMIT 100")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(bm25.search(_texts(spark, sf_dir), TERMS, 100), "score")


@query(f"WITH src AS (SELECT * FROM {TEXTS}), {bm25_sql('src')} SELECT id, round(s, 6) AS score FROM hits")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(bm25.scores(_texts(spark, sf_dir), TERMS), "score")


# Hybrid


def hybrid_sql(alpha: float, where: str = "true", has_vector: bool = True) -> str:
    score = SQL_SCORE["cosine"] if has_vector else "0.0"
    if alpha >= 0:
        combined = f"{alpha} * vn + {1 - alpha} * tn"
    else:
        combined = "1.0 / (60 + vr) + coalesce(1.0 / (60 + tr), 0.0)"
    return f"""WITH src AS (SELECT doc_id AS id, text, lang, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id),
q AS ({Q}), raw AS (SELECT id, lang, {score} AS raw FROM src, q), {bm25_sql("src")},
u AS (SELECT id, lang, raw, greatest(raw, 0.0) AS c, s, row_number() OVER (ORDER BY round(raw, 9) DESC, id) AS vr, CASE WHEN s IS NOT NULL THEN row_number() OVER (PARTITION BY s IS NULL ORDER BY round(s, 9) DESC, id) END AS tr FROM raw LEFT JOIN hits USING (id)),
m AS (SELECT min(c) AS c0, max(c) AS c1, min(s) AS s0, max(s) AS s1 FROM u),
n AS (SELECT id, lang, vr, tr, CASE WHEN c1 = c0 THEN 1.0 ELSE (c - c0) / (c1 - c0) END AS vn, CASE WHEN s IS NULL THEN 0.0 WHEN s1 = s0 THEN 1.0 ELSE (s - s0) / (s1 - s0) END AS tn FROM u, m),
f AS (SELECT id, vn, tn, {combined} AS x FROM n WHERE {where})
SELECT row_number() OVER (ORDER BY round(x, 9) DESC, id) AS rank, id, round(vn, 6) + 0.0 AS vector_score, round(tn, 6) + 0.0 AS text_score, round(x, 6) + 0.0 AS combined_score FROM f ORDER BY rank LIMIT {K}"""


def _hybrid(spark: SparkSession, sf_dir: str, alpha: float, lang: str | None = None, has_vector: bool = True, words: str = TERMS) -> DataFrame:
    both = _texts(spark, sf_dir).join(vectors(spark, sf_dir), "id")
    where = Eq("lang", lang).column(Typed(both)) if lang else None
    found = hybrid.search(both, first_vectors(spark, sf_dir, 1)[0].tolist() if has_vector else [], words, K, alpha, where=where)
    return six(found, "vector_score", "text_score", "combined_score")


@query(
    f"""SELECT row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank, id, round(s, 6) + 0.0 AS vector_score, 0.0::DOUBLE AS text_score, round(s, 6) + 0.0 AS combined_score
FROM (SELECT doc_id AS id, {SQL_SCORE["cosine"]} AS s FROM (SELECT doc_id, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id), ({Q})) ORDER BY rank LIMIT {K}"""
)
def hybrid_vector_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, 0.5, words="")


@query(hybrid_sql(0.5))
def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, 0.5)


@query(hybrid_sql(-1.0))
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, -1.0)


@query(hybrid_sql(0.25, "lang = 'en'"))
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, 0.25, lang="en")


@query(hybrid_sql(0.0, has_vector=False))
def hybrid_text_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, 0.0, has_vector=False)


# Inverted file

CENTROIDS = f"SELECT n AS cid, v AS c FROM (SELECT v, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS rows FROM ({V})) WHERE n < least(rows, greatest({ivf.FEWEST}, floor(sqrt(rows - 1)) + 1))"
NEAR = f"SELECT id, v, label, cid, row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, c), 9), cid) AS nth FROM ({V}), ({CENTROIDS})"
ASKED = batch_sql("cosine").replace(f"WHERE rank <= {K}", f"WHERE rank <= {K + 1} AND query_id % 20 = 0")
#: CTEs near and probe(n)
PROBE = f"""near AS ({NEAR}), place AS (SELECT q.nth AS p FROM ({ASKED}) t JOIN near d ON t.id = d.id AND d.nth = 1 JOIN near q ON q.id = t.query_id AND q.cid = d.cid WHERE t.query_id <> t.id),
probe AS (SELECT min(p) AS n FROM (SELECT p, row_number() OVER (ORDER BY p) AS seen, count(*) OVER () AS whole FROM place) WHERE seen >= {RECALL} * whole)"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray]:
    docs = vectors(spark, sf_dir)
    centroids = first_vectors(spark, sf_dir, ivf.list_count(docs.count()))
    return ivf.assign(docs, centroids), centroids


def _probed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray, int]:
    docs, (lists, centroids) = vectors(spark, sf_dir), _lists(spark, sf_dir)
    return lists, centroids, ivf.measured_probes(docs, centroids, "cosine", K, RECALL, asked=docs.where("id % 20 = 0"), least=1)


@query(f"SELECT id, cid FROM ({NEAR}) WHERE nth = 1")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir)[0].select("id", F.col("cid").cast("long").alias("cid"))


@query(
    f"""SELECT cid, pos, round(coalesce(m, c), 6) + 0.0 AS value FROM (SELECT cid, unnest(range(0, len(c))) AS pos, unnest(c) AS c FROM ({CENTROIDS}))
LEFT JOIN (SELECT cid, pos, avg(x) AS m FROM (SELECT cid, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM ({NEAR}) WHERE nth = 1) GROUP BY cid, pos) USING (cid, pos)"""
)
def ivf_lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, centroids = _lists(spark, sf_dir)
    return six(ivf.lloyd_step(lists, centroids).select(F.col("cid").cast("long").alias("cid"), F.col("pos").cast("long").alias("pos"), "value"), "value")


IVF_BATCH = f"""SELECT query_id, rank, id, s FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank
FROM (SELECT p.id AS query_id, d.id AS id, {SQL_SCORE["cosine"].replace("v,", "d.v,").replace(" v)", " d.v)").replace("(q", "(p.v").replace(" q)", " p.v)")} AS s
FROM near p JOIN near d ON p.cid = d.cid AND d.nth = 1 WHERE p.nth <= (SELECT n FROM probe))) WHERE rank <= {K}"""


@query(f"WITH {PROBE} SELECT query_id, rank, id, round(s, 6) + 0.0 AS score FROM ({IVF_BATCH})")
def search_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, centroids, n_probe = _probed(spark, sf_dir)
    return six(ivf.search_batch(vectors(spark, sf_dir), lists, centroids, K, n_probe), "score")


@query(
    f"""WITH {PROBE}, q AS (SELECT v AS q, id AS qid FROM ({V}) ORDER BY id LIMIT 1)
SELECT row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank, id, round(s, 6) + 0.0 AS score FROM (
SELECT d.id, {SQL_SCORE["cosine"].replace("v,", "d.v,").replace(" v)", " d.v)")} AS s FROM near d, q WHERE nth = 1 AND label <> 3
AND cid IN (SELECT cid FROM near WHERE id = (SELECT qid FROM q) AND nth <= (SELECT n FROM probe))) ORDER BY rank LIMIT {K}"""
)
def search_ivf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, centroids, n_probe = _probed(spark, sf_dir)
    both = lists.join(vectors(spark, sf_dir).select("id", "label"), "id")
    return six(ivf.search(both, centroids, first_vectors(spark, sf_dir, 1)[0], K, n_probe, "cosine", Ne("label", 3).where(Typed(both))), "score")


@query(
    f"""WITH {PROBE}, a AS ({IVF_BATCH}), e AS ({batch_sql("cosine")})
SELECT count(DISTINCT e.query_id) AS queries, count(*) AS wanted, count(a.id) AS found, round(count(a.id) / count(*), 6) AS recall
FROM e LEFT JOIN a ON a.query_id = e.query_id AND a.id = e.id"""
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, centroids, n_probe = _probed(spark, sf_dir)
    docs = vectors(spark, sf_dir)
    return six(recall.recall_at_k(ivf.search_batch(docs, lists, centroids, K, n_probe), search.search_batch(docs, docs, K)), "recall")


@query()
def ivf_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = ivf.train(vectors(spark, sf_dir))
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cid int, centroid array<double>")


@query()
def hnsw_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.build(vectors(spark, sf_dir)).select("shard", "id", "level", "layer", "neighbors")


@query()
def search_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return six(hnsw.search_batch(docs, hnsw.build(docs), K), "score")


# Writes, sources and sinks


@query("SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.last_wins(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return changelog.delete(table(spark, sf_dir, "documents"), gone, "doc_id").select("doc_id", "lang")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, line): events as a changelog of users, in which an error deletes its user."""
    user = F.col("user_id").cast("string")
    head = F.when(F.col("event_type") == "error", '{"action":"delete","collection":"users","crc32":').otherwise('{"action":"upsert","collection":"users","crc32":')
    tail = F.when(F.col("event_type") == "error", F.concat(F.lit(',"id":"'), user, F.lit('"}'))).otherwise(
        F.concat(F.lit(',"document":{"id":"'), user, F.lit('","metadata":{"event":'), F.col("event_id").cast("string"), F.lit(',"type":"'), F.col("event_type"), F.lit('"},"vector":[1.0,'), user, F.lit("]}}"))
    )
    rows = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null").select(F.col("event_id").alias("seq"), head.alias("head"), tail.alias("tail"))
    return rows.select("seq", F.concat("head", F.crc32(F.concat("head", F.lit("0"), "tail").cast("binary")).cast("string"), "tail").alias("line"))


@query("SELECT event_id AS seq, true AS ok FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def wal_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("seq", changelog.checksum_ok(F.col("line")).alias("ok"))


@query(
    """SELECT 'users' AS collection, user_id::VARCHAR AS id, event_id AS event, event_type AS type, user_id::DOUBLE AS second FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL) WHERE n = 1 AND event_type <> 'error'"""
)
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = changelog.replay(event_log(spark, sf_dir))
    return docs.select("collection", "id", F.get_json_object("metadata", "$.event").cast("long").alias("event"), F.get_json_object("metadata", "$.type").alias("type"), F.col("vector")[1].alias("second"))


@query(
    """SELECT 'source' AS field, count(source) AS violations FROM documents HAVING count(source) > 0
UNION ALL SELECT 'n_chars', count(*) FROM documents WHERE source IS NULL AND n_chars IS NOT NULL HAVING count(*) > 0"""
)
def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema((Field("lang", "string"), Field("text", "text"), Field("source", "int"), Field("n_chars", "bool")))
    meta = F.parse_json(F.to_json(F.struct("lang", "text", "source", "n_chars")))
    return table(spark, sf_dir, "documents").select(schema.violation(meta).alias("field")).where("field is not null").groupBy("field").agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT count(*) AS doc_count, max(len(embedding))::BIGINT AS dimension, 'cosine' AS metric, 'none' AS index_type FROM embeddings")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("doc_count"), F.max(F.size("vector")).cast("long").alias("dimension"), F.lit("cosine").alias("metric"), F.lit("none").alias("index_type"))


def _collection(spark: SparkSession, sf_dir: str) -> Database:
    """Embeddings as a collection in the shared folder, with changes on top: a batch of upserts, one upsert, and a batch of removals."""
    db = Database(spark, f"{scratch_dir(spark)}/queries-{uuid.uuid4().hex}")
    db.create_collection("e", "l2")
    docs = vectors(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector", F.to_json(F.struct("label")).alias("metadata"))
    size = len(docs.select("vector").first()["vector"])
    db.load("e", docs)
    db.batch_upsert("e", [{"id": str(i), "vector": [float(i)] * size, "metadata": {"label": 100 + i}} for i in range(-5, 20)])
    db.upsert("e", {"id": "3", "vector": [0.5] * size, "metadata": {"label": 1}})
    db.batch_remove("e", [str(i) for i in range(20, 40)])
    return db


CHANGED = f"""SELECT id::VARCHAR AS id, label, round(v[1], 6) + 0.0 AS first FROM ({V}) WHERE id NOT BETWEEN -5 AND 39
UNION ALL SELECT i::VARCHAR, CASE WHEN i = 3 THEN 1 ELSE 100 + i END, CASE WHEN i = 3 THEN 0.5 ELSE i END FROM range(-5, 20) AS t(i)"""


def _documents(db: Database) -> DataFrame:
    return db.documents("e").select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"), F.round(F.col("vector")[0], 6).alias("first"))


@query(f"SELECT id, label::INT AS label, first::DOUBLE AS first FROM ({CHANGED})")
def batch_upsert_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(_collection(spark, sf_dir))


@query(f"SELECT id, label::INT AS label, first::DOUBLE AS first FROM ({CHANGED})")
def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a database that is restored from a snapshot of another."""
    db = _collection(spark, sf_dir)
    db.snapshot(db.path + "-snapshot")
    other = Database(spark, db.path + "-restored")
    other.restore(db.path + "-snapshot")
    return _documents(other)


@query("""SELECT '{"id":"' || doc_id || '","vector":[' || n_chars || '.0],"metadata":{"lang":"' || lang || '"}}' AS line FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL""")
def export_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("lang is not null and n_chars is not null")
    return ndjson.to_lines(rows.select(F.col("doc_id").alias("id"), F.array("n_chars").alias("vector"), F.to_json(F.struct("lang")).alias("metadata")))


@query(f"SELECT id::VARCHAR AS id, len(v) AS dimension, round(list_sum(v), 6) + 0.0 AS total, label FROM ({V})")
def import_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ndjson.to_lines(vectors(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label"))))
    docs = ndjson.parse(lines.withColumn("n", F.monotonically_increasing_id()))
    return six(docs.select("id", F.size("vector").cast("long").alias("dimension"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get_json_object("metadata", "$.label").cast("int").alias("label")), "total")

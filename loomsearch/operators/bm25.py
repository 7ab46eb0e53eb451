"""BM25 full-text ranking over one text column.

A search without an index reads the text twice, once for the collection's statistics
and once for the scores; each time one pass over the bytes counts all query terms.
Nothing but (id, length, counts) leaves it, and nothing is shuffled but one row of
statistics.

A stored index has postings (term, id, tf, len) in folders by a hash of the term, so
that a search reads the folders of its terms only, and lengths (id, len). Both carry
the number of the change that wrote them: adding a document again or removing it is an
append, and of every id the last change counts.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernel
from ..functions.text import tokenize, tokens
from ..session import ship
from .search import ranked

K1, B = 1.2, 0.75
FOLDERS = 64


def tokenized(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, words) of texts that have a token; others are not indexed."""
    return docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words")).where(F.size("words") > 0)


def _given(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows, dict(rows.dtypes)["id"]


def counted(docs: DataFrame, terms: Sequence[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, len, tf): the number of tokens and of each term, of texts that have a token."""
    rows, kind = _given(docs, id_col, text_col)
    return rows.mapInArrow(kernel.term_counts(list(terms)), f"id {kind}, len int, tf array<int>")


def _postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows, kind = _given(docs, id_col, text_col)
    return rows.mapInArrow(kernel.postings, f"term string, id {kind}, tf long, len int")


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf)."""
    return _postings(docs, id_col, text_col).groupBy("term", "id").agg(F.sum("tf").alias("tf"))


def stats(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row (n_docs, avg_len)."""
    return counted(docs, (), id_col, text_col).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))


def document_frequencies(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, df)."""
    return postings(docs, id_col, text_col).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _terms(query: str | Sequence[str]) -> list[str]:
    return list(dict.fromkeys(tokenize(query) if isinstance(query, str) else query))


def scores(docs: DataFrame, query: str | Sequence[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document with a query term. Query terms count once."""
    terms = _terms(query)
    rows = counted(docs, terms, id_col, text_col)
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).where("false")
    rows = rows.select("id", "len", *[F.col("tf")[i].alias(f"tf{i}") for i in range(len(terms))])
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    both = rows.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(known))  # one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        total = total + F.when(F.col(f"tf{i}") > 0, _part(F.col(f"tf{i}"), F.col(f"df{i}"))).otherwise(0.0)
    return both.select("id", total.alias("score"))


def _part(tf, df):
    """A term's share of the score; n, len and avg are columns."""
    norm = F.lit(K1) * (1 - B + F.lit(B) * F.col("len") / F.col("avg"))
    return F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * (tf * (K1 + 1)) / (tf + norm)


def search(docs: DataFrame, query: str | Sequence[str], k: int = 10, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(rank, id, score) of the k best documents."""
    return ranked(scores(docs, query, id_col, text_col), k, F.col("score"), "id").select("rank", "id", "score")


# Stored index


def _folder(term):
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def add(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    """Index documents of distinct ids; those of ids that are there already take their place."""
    nth = F.lit(time.time_ns())
    kept = docs.where(F.col(id_col).isNotNull())
    rows = _postings(kept, id_col, text_col).withColumn("nth", nth).withColumn("folder", _folder("term"))
    rows.repartition("folder").sortWithinPartitions("folder", "term").write.mode("append").partitionBy("folder").parquet(f"{path}/postings")
    counted(kept, (), id_col, text_col).select("id", "len", nth.alias("nth")).write.mode("append").parquet(f"{path}/lengths")


def remove(ids: DataFrame, path: str, id_col: str = "id") -> None:
    """Forget documents; unknown ids are ignored."""
    ids.select(F.col(id_col).alias("id"), F.lit(None).cast("int").alias("len"), F.lit(time.time_ns()).alias("nth")).write.mode("append").parquet(f"{path}/lengths")


def live(spark: SparkSession, path: str) -> DataFrame:
    """(id, len, nth) of the documents that are there."""
    rows = spark.read.parquet(f"{path}/lengths").groupBy("id").agg(F.max(F.struct("nth", "len")).alias("x"))
    return rows.select("id", "x.len", "x.nth").where("len is not null")


def stored_scores(spark: SparkSession, path: str, query: str | Sequence[str]) -> DataFrame:
    """(id, score) as scores() gives them, from a stored index."""
    terms, there = _terms(query), live(spark, path)
    known = there.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").withColumn("folder", _folder("term"))
    folders = [r["folder"] for r in wanted.collect()]  # one for each query term
    hits = spark.read.parquet(f"{path}/postings").where(F.col("folder").isin(folders) & F.col("term").isin(terms)).select("term", "id", "tf", "len", "nth")
    hits = hits.join(there.select("id", "nth"), ["id", "nth"], "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(known))  # a row for each query term, and one row
    return rows.groupBy("id").agg(F.sum(_part(F.col("tf"), F.col("df"))).alias("score"))


def stored_search(spark: SparkSession, path: str, query: str | Sequence[str], k: int = 10) -> DataFrame:
    """(rank, id, score) of the k best documents of a stored index."""
    return ranked(stored_scores(spark, path, query), k, F.col("score"), "id").select("rank", "id", "score")

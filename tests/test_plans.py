"""The physical plans that searches are meant to have."""

import pytest
from pyspark.sql import functions as F

from loomsearch.operators import bm25, search
from loomsearch.operators.filters import And, Eq, Ne, Range, Typed

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_and_pushdown(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet")
    where = And((Eq("label", 3), Range("vec_id", 10, None), Ne("label", 7))).where(Typed(docs))
    text = plan(search.search(docs, [0.1] * 64, 5, where=where, id_col="vec_id", vector_col="embedding"))
    assert "TakeOrderedAndProject" in text and "Exchange hashpartitioning" not in text and "Python" not in text
    pushed = text.split("PushedFilters: [")[1]
    assert "EqualTo(label,3)" in pushed and "GreaterThanOrEqual(vec_id,10)" in pushed


def test_bm25_reads_two_columns_and_shuffles_only_statistics(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "id")
    text = plan(bm25.scores(docs, "the and"))
    assert "n_chars" not in text and "Exchange hashpartitioning" not in text and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_stored_lists_are_pruned(spark, tmp_path):
    rows = spark.range(100).select(F.col("id"), F.array(F.lit(1.0), F.lit(0.5)).alias("v"), (F.col("id") % 7).cast("int").alias("cid"))
    rows.write.partitionBy("cid").parquet(str(tmp_path / "lists"))
    lists = spark.read.parquet(str(tmp_path / "lists"))
    text = plan(lists.where(F.col("cid").isin([1, 2])))
    assert "PartitionFilters: [cid" in text.replace("#", " #").replace("cid #", "cid#") or "PartitionFilters: [cid" in text


def test_batch_search_keeps_k_before_the_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    text = plan(search.search_batch(docs, docs, 5))
    assert "WindowGroupLimit" in text


@pytest.mark.parametrize("k", [0, -1])
def test_k_must_be_positive(spark, k):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet")
    with pytest.raises(ValueError):
        search.search_batch(docs, docs, k, query_id_col="vec_id", id_col="vec_id", vector_col="embedding")

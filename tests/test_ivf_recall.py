"""An IVF collection on the real embeddings, with its defaults."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomsearch.operators import ivf, recall, search
from loomsearch.plans.database import Database


def test_default_recall(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_collection("e")
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    db.load("e", rows.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.lit("{}").alias("metadata")))
    db.build_index("e", "ivf")
    m = db.meta["e"]
    n_probe = getattr(m, "n_probe", ivf.N_PROBE)
    docs = db.documents("e").select(F.col("id").cast("long").alias("id"), "vector")
    centroids = np.array(m.centroids)
    found = ivf.search_batch(docs, ivf.assign(docs, centroids), centroids, 10, n_probe).cache()
    share = recall.recall_at_k(found, search.search_batch(docs, docs, 10)).first()
    assert share["queries"] == docs.count() and share["recall"] >= 0.9, (n_probe, share)
    one = docs.orderBy("id").first()
    assert {int(r["id"]) for r in db.search("e", one["vector"], 10).collect()} == {r["id"] for r in found.where(F.col("query_id") == one["id"]).collect()}
    print("n_probe", n_probe, "of", len(centroids), "recall", share["recall"])

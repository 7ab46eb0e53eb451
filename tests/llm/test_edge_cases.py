"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline

from loomsearch.llm import bloom_lm, kk_sharding, line_crf, packing, pii_tagger, sentence_spans, simhash_forest, toxicity, url_filter, winnowing

LONG = "word another thing. " * 30_000 + "\nYou idiot moron, write to jo.12@mail.example.com now."
PROSE = "The river rose after three days of rain, and the lower fields were under water by noon. She closed the book and looked out of the window for a long while before she spoke again."
ROWS = [
    (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 2), (2, PROSE, "en", "a", 2), (None, PROSE, None, None, None), (None, None, None, None, None), (3, "", "en", "b", 0),
    (4, None, "en", "b", 0), (5, " \n\t ", "en", "b", 3), (6, "...!?", "en", "b", 5), (7, "one", "en", "b", 3), (8, LONG, "en", "c", len(LONG)), (9, "é" * 5000, "fr", "c", 5000), (10, "1234567890" * 400, "xx", "c", 4000),
    (11, "a b c\n\n\nd", None, "c", None), (12, "\x00\x01 odd   bytes \U0001f600", "en", "c", 9), (-5, PROSE + " And more.", "en", "a", 3),
]
NAMES = ("id", "th", "t", "h", "g", "n", "node", "label", "gone", "row", "part", "kept", "title", "k", "words", "text_hash", "__row", "__id", "__hash", "__kept", "spans", "bytes", "group_id")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({name: F.lit(f"extra {name}") for name in NAMES}).cache()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE), (1, PROSE), (None, PROSE), (2, None), (3, ""), (4, "short")], "item_id int, text string")


@pytest.fixture(scope="module")
def net():
    return pii_tagger.default_net()


def test_sharding(docs, none):
    rows = kk_sharding.sharded(docs, 4).collect()
    assert len(rows) == len(ROWS) and {r["shard"] for r in rows} <= {0, 1, 2, 3}
    assert len({r["shard"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert kk_sharding.sharded(none, 4).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_language_model(docs, none, limit):
    rows = bloom_lm.scored(docs, broadcast_bytes=limit).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r["perplexity"] is None) == (r["n_words"] == 0)
    assert {r["n_words"] for r in rows if r["doc_id"] in (3, 4, 5, 6)} == {0}
    assert len({r["perplexity"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert bloom_lm.scored(none, broadcast_bytes=limit).count() == 0


def test_personal_data(docs, none, net):
    kept = pii_tagger.redacted(docs, net)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) and kept.where("text is null").count() == 2
    assert kept.where("doc_id = 1").first()["text"] == PROSE
    long = kept.where("doc_id = 8").first()["text"]
    assert long == LONG.replace("jo.12@mail.example.com", "[EMAIL]")
    assert pii_tagger.tagged(docs, net).where("doc_id in (3, 4, 5, 6, 7)").count() == 0
    assert pii_tagger.tagged(none, net).count() == 0 and pii_tagger.redacted(none, net).count() == 0


def test_url_filter(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://" + "ab" * 3000 + ".com/x", "word " * 50_000), (4, "no host at all", "x"), (5, "https://casinowin.com/play", None), (5, "https://casinowin.com/play", None), (None, "//u:p@www.example.org:80/a?b=1", "<p>a</p>"), (6, "http://www.münchen.de/", "x"), (7, "http://-/", "x"), (8, "http://1.2.3.4/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(1) for n in ("host", "name", "word", "n", "words", "rest")})
    got = url_filter.filtered(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["host"] is None and by[2]["host"] is None and by[4]["host"] is None and by[1]["host_words"] == ""
    assert by[5]["blocked"] and by[5]["host_words"] == "casino win" and not by[1]["blocked"] and by[None]["host"] == "www.example.org"
    assert by[8]["host_words"] == ""
    assert url_filter.filtered(pages.where("false")).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, None), (7, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    kept = line_crf.retained(docs, labels).collect()
    assert {1, 2, -5} <= {r["doc_id"] for r in kept} and not {3, 4, 5, 6} & {r["doc_id"] for r in kept}
    assert sum(r["doc_id"] == 2 for r in kept) == 2
    assert line_crf.retained(none, labels.where("false")).count() == 0 and line_crf.retained(docs, None).count() > 0


def test_sentence_spans(docs, none):
    got = {r["doc_id"]: r for r in sentence_spans.changed(docs).collect()}
    assert got[1]["text"] == "" or 1 not in got or got[1]["n_removed"] == 0 or got[-5]["n_removed"] == 0
    assert -5 not in got and got[1]["text"] == "" and got[2]["n_removed"] == 2 and got[8]["n_removed"] > 1000
    assert sentence_spans.changed(none).count() == 0


def test_toxicity(docs, none):
    assert [r["doc_id"] for r in toxicity.rejected(docs).collect()] == [8]
    kept = toxicity.detoxified(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1
    labels = docs.selectExpr("doc_id", "if(doc_id = 8, 1, 0) as toxic", "1 as label_id")
    assert [r["doc_id"] for r in toxicity.rejected(docs, labels).collect()] == [8]
    assert toxicity.rejected(docs, labels.where("false")).count() == 1 and toxicity.rejected(none, labels).count() == 0
    assert toxicity.rejected(none).count() == 0 and toxicity.detoxified(none).count() == 0


@pytest.mark.parametrize("limit", [5_000_000, 0])
def test_decontamination(docs, none, bench, limit):
    rows = winnowing.contaminated_spans(docs, bench, broadcast_words=limit).collect()
    assert len(rows) == 5 * 3 and {r["doc_id"] for r in rows} == {1, 2, None, -5} and {r["item_id"] for r in rows} == {1, None}
    kept = winnowing.decontaminated(docs, bench, broadcast_words=limit)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 5
    assert winnowing.contaminated_spans(none, bench, broadcast_words=limit).count() == 0
    assert winnowing.contaminated_spans(docs, bench.where("false"), broadcast_words=limit).count() == 0
    assert winnowing.decontaminated(docs, bench.where("false"), broadcast_words=limit).count() == len(ROWS)


def test_near_duplicates(docs, none):
    rows = simhash_forest.near_duplicates(docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, None, -5} and {r["group_id"] for r in rows} == {-5} and {r["group_size"] for r in rows} == {5}
    kept = simhash_forest.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert kept.where("doc_id in (-5, 1, 2)").count() == 1
    assert simhash_forest.near_duplicates(none).count() == 0 and simhash_forest.deduplicated(none).count() == 0


def test_packing(docs, none):
    bins = packing.packed(docs, 64).collect()
    assert len({b["bin_id"] for b in bins}) == len(bins) and all(b["fill"] == sum(p["length"] for p in b["pieces"]) <= 64 for b in bins)
    assert sum(p["start"] == 0 for b in bins for p in b["pieces"]) == len(ROWS)
    assert packing.packed(none).count() == 0
    zero = packing.packed(docs, 8, length=F.lit(None).cast("int")).collect()
    assert sorted(b["fill"] for b in zero) == [8, 8]


def test_pipeline_stages(spark, docs, none, tmp_path, monkeypatch, net):
    monkeypatch.setattr(pii_tagger, "default_net", lambda *a: net)
    spark.createDataFrame([(1, "nothing of the kind")], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (8, None, None), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, none):
        now = start
        for nth, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            path = str(tmp_path / f"{start is none}-{nth}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
            if nth < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == docs.columns
    assert now.count() == 0

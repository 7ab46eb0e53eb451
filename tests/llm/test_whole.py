"""Whole results, against brute force over the texts rather than over an operator's own limits."""

from __future__ import annotations

import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomsearch.llm import _text as T
from loomsearch.llm import bloom_lm, packing, pii_tagger, queries, simhash_forest

SF = "/root/testdata/sf0.01"


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return set(zip(w, w[1:], w[2:]))


def test_near_copies_by_jaccard(spark):
    sets = {r["doc_id"]: shingles(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    holds: dict[tuple[str, ...], list[int]] = {}
    for i, s in sets.items():
        for x in s:
            holds.setdefault(x, []).append(i)
    common: dict[tuple[int, int], int] = {}
    for ids in holds.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                common[i, j] = common.get((i, j), 0) + 1
    near = [(i, j) for (i, j), n in common.items() if n >= 0.6 * (len(sets[i]) + len(sets[j]) - n) and sets[i] != sets[j]]
    got = {r["doc_id"]: r["group_id"] for r in queries.op9_simhash_forest(spark, SF).collect()}
    assert len(near) > 50 and sum(i in got and got[i] == got.get(j) for i, j in near) >= 0.95 * len(near)


def test_a_text_of_many_spans_costs_in_proportion():
    began = time.thread_time()
    found = [(10 * i, 10 * i + 8, i % 6, 3.0, True) for i in range(50_000)]
    assert pii_tagger.reconciled(found) == [(a, b, kind) for a, b, kind, _, _ in found]
    assert time.thread_time() - began < 10


def test_tags_of_many_windows_at_once():
    """Viterbi over whole windows, ties too, against one that keeps every way back."""
    net, r = pii_tagger.new_net(7, 4, 5), np.random.default_rng(4)
    for trial in range(4):
        e = r.normal(size=(50, 30, pii_tagger.TAGS)).astype(np.float32)
        if trial % 2:
            e, net.trans, net.begin = np.round(e), np.round(net.trans), np.round(net.begin)
        for own, got in zip(e, pii_tagger.viterbi(net, e)):
            best, back = net.begin + own[0], []
            for x in own[1:]:
                options = best[:, None] + net.trans
                back.append(options.argmax(0))
                best = options.max(0) + x
            tags = [int(best.argmax())]
            for b in reversed(back):
                tags.append(int(b[tags[-1]]))
            assert tags[::-1] == got.tolist()


def test_every_half_full_bin_finds_its_host(spark):
    """One partition has 100 bins of 1,200 and each of 99 others one bin of 800: each of these goes into one of those."""
    pool = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.pmod(F.xxhash64("id", F.xxhash64(F.lit("")), F.lit(0).cast("long")), F.lit(100)).alias("at")).collect()
    of: dict[int, list[int]] = {}
    for r in pool:
        of.setdefault(r["at"], []).append(r["doc_id"])
    docs = [(i, "", 1199) for i in of[0][:100]] + [(of[k][0], "", 799) for k in range(1, 100)]
    bins = packing.packed(spark.createDataFrame(docs, "doc_id long, text string, n long"), 2048, length=F.col("n"), items_per_part=2, fan_in=100).collect()
    assert sum(len(b["pieces"]) for b in bins) == 199
    assert sorted(b["fill"] for b in bins) == [1200] + [2000] * 99


def test_emitted_bins_would_save_none():
    """Bins of merges up a tree are as many as if every bin rose."""
    r = np.random.default_rng(6)
    for trial in range(200):
        capacity, fan_in = 100, int(r.integers(2, 12))
        low = int(r.integers(1, 60))
        leaves = [r.integers(low, int(r.integers(low, 90)) + 1, r.integers(0, 30)).tolist() for _ in range(int(r.integers(1, 30)))]

        def bins(cut: bool) -> int:
            parts, total = leaves, 0
            while True:
                out = []
                for own in parts:
                    own = sorted(own, reverse=True)
                    where = packing.best_fit(own, capacity)
                    fill = [0] * (max(where, default=-1) + 1)
                    for x, at in zip(own, where):
                        fill[at] += x
                    done = packing.finished(fill, capacity, capacity, len(parts) - 1 if cut else 10**9)
                    out.append([x for x, d in zip(fill, done) if not d])
                    total += sum(done)
                if len(parts) == 1:
                    return total + len(out[0])
                parts = [sum(out[k : k + fan_in], []) for k in range(0, len(out), fan_in)]

        assert bins(True) == bins(False)


def test_a_filter_too_large_to_broadcast_moves_no_texts(spark, monkeypatch):
    """It is mapped from the shared folder, with the scores of a broadcast one and of one that answers by parts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).localCheckpoint()

    def scores(**limits: int) -> dict[int, tuple]:
        return {r["doc_id"]: (r["n_words"], r["log10_prob"]) for r in bloom_lm.scored(docs, part_bytes=40_000, **limits).collect()}

    whole, by_parts = scores(), scores(broadcast_bytes=0, mapped_bytes=0)
    monkeypatch.setattr(bloom_lm, "_joined", None)
    mapped = scores(broadcast_bytes=0)
    assert mapped == whole
    assert by_parts.keys() == whole.keys() and all(by_parts[i] == pytest.approx(whole[i]) for i in whole if whole[i][0])


def test_a_filter_is_mapped_and_not_broadcast_where_it_can_be(spark, monkeypatch):
    """Neither the driver nor an executor's JVM holds it; a broadcast one gives the same scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).localCheckpoint()

    def scores(**limits: int) -> dict[int, tuple]:
        return {r["doc_id"]: (r["n_words"], r["log10_prob"]) for r in bloom_lm.scored(docs, part_bytes=40_000, **limits).collect()}

    by_broadcast = scores(mapped_bytes=0)
    monkeypatch.setattr(bloom_lm, "Streamed", None)
    monkeypatch.setattr(bloom_lm, "_joined", None)
    assert scores() == by_broadcast
    wordless = spark.createDataFrame([(1, "... !"), (2, None)], "doc_id long, text string")
    monkeypatch.undo()
    assert [r["n_words"] for r in bloom_lm.scored(wordless).collect()] == [0, 0]


def test_a_task_builds_one_part_of_the_filter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).localCheckpoint()
    table, parts = bloom_lm.filters(docs, 1, "text", 40_000)
    assert parts > 8
    by_task = table.groupBy(F.spark_partition_id()).agg(F.countDistinct("part").alias("parts")).collect()
    assert len(by_task) == parts and {r["parts"] for r in by_task} == {1}


def test_memory_to_count_and_build(monkeypatch):
    """Blobs and batches are small, and a part takes less than 50 bytes a hash besides its blobs."""
    monkeypatch.setattr(bloom_lm, "HELD", 300_000)
    text = pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, range(x, x + 2000))) for x in range(0, 800_000, 2000)])], ["t"])
    counted = list(bloom_lm._count(1)(iter([text])))
    assert max(len(h) for b in counted for h in b["h"].to_pylist()) <= 150_000 and max(b.nbytes for b in counted) < 3 << 20
    own = [b for b in counted if b["n"][0].as_py() == 3]
    held = sum(b.nbytes for b in own)
    tracemalloc.start()
    built = list(bloom_lm._build(1)(iter(own)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    distinct = sum(b["distinct"][0].as_py() for b in built)
    assert distinct == 400 * 1998 and peak < held + 50 * distinct


def test_an_ngram_is_probed_once_in_many_texts_and_from_its_sure_level():
    h = T.mix(np.arange(1, 4001, dtype=np.uint64) << np.uint64(20))
    c = np.arange(4000) % 40 + 1
    f = bloom_lm.loaded([{"part": 0, "bits": (x := bloom_lm.built(h, c, 1)).tobytes(), "size": len(x)}], 1)
    assert np.array_equal(f.levels(h, bloom_lm.surely(np.minimum(c, 5), 1)), f.levels(h))
    assert bloom_lm.surely(c, 2) is None
    text = pa.array(["the same five words here", "the same five words here", "and other words"], pa.string())
    asked = []
    lookup = lambda order, h, times: (asked.append((order, len(h), len(np.unique(h)), int(times.sum()))), np.full(len(h), 3))[1]
    n, total = bloom_lm.log_probabilities(next(T.slices(text)), lookup, 100)
    assert n.tolist() == [5, 5, 3] and total[0] == total[1]
    assert asked == [(1, 7, 7, 13), (2, 6, 6, 10), (3, 4, 4, 7)]


@pytest.mark.parametrize("crowd", [20, 10_000])
def test_pairs_of_subtrees_are_compared_by_tiles(monkeypatch, crowd):
    monkeypatch.setattr(simhash_forest, "CROWD", crowd)
    r = np.random.default_rng(5)
    key = np.concatenate([r.integers(0, 1 << 63, 500).astype(np.uint64), np.uint64(1 << 40) ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64))])[r.permutation(700)]
    key[:300] ^= key[0] ^ (np.uint64(1) << r.integers(0, 60, 300).astype(np.uint64))
    key, seq, run = key & np.uint64(0xFFFFFF0000), key & np.uint64(0xFF00), np.sort(r.integers(0, 3, 700))
    asked = []
    monkeypatch.setattr(simhash_forest, "side_by_side", lambda begin, size: (asked.extend(size.tolist()), iter(()))[1])
    found = list(simhash_forest.edges_of(key, seq, run, 4, 3, True))
    assert not asked  # only small runs are listed pair by pair
    i, j = np.triu_indices(700, 1)
    own = run[i] == run[j]
    i, j = i[own], j[own]
    lex, two = np.bitwise_count(key[i] ^ key[j]), np.bitwise_count(seq[i] ^ seq[j])
    sure = (lex <= 4) & (two <= 3)
    label = simhash_forest.joined(700, i[sure], j[sure])[0]
    a, b = (np.concatenate([x[k] for x in found if x[0]]) for k in (1, 2))
    assert len(a) == 700 - len(np.unique(label)) and (simhash_forest.joined(700, a, b)[0] == label).all()
    rest = ~sure & (lex <= simhash_forest.WIDE) & (two <= simhash_forest.WIDE_SEQ) & (label[i] != label[j])
    assert {(int(x), int(y)) for s, a, b in found if not s for x, y in zip(a, b)} == set(zip(i[rest].tolist(), j[rest].tolist()))

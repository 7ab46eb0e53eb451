"""Benchmark decontamination by winnowing.

Every run of `k` words has a hash; of every `window` consecutive ones the
smallest is kept as a fingerprint (the rightmost of equal ones). A span of
k + window - 1 words that a document shares with a benchmark item therefore
shares a fingerprint with it. Fingerprints of both sides are joined, and each
hit is extended to both sides as far as the words agree. Spans that come to
at least k + window - 1 words are reported, which is all of them. An item of fewer words,
but at least k, can share no such span; it is reported where a document holds all of it, for
which its first k words are looked up among all runs of the document.

The benchmark's fingerprints and words are broadcast while they are at most
`broadcast_words` words. Beyond that both sides' fingerprints are joined by a
shuffle, and only documents and items that share one meet, for the extension.

Words are as in _text, of the lower-cased text. Defined results: null or empty
texts and texts of fewer than k words have no hit; each of
several equal rows has its own hits; ids may be null and stay so; an item that
occurs twice hits twice; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, fresh, hinted, ship
from . import _text as T

SPANS = "doc_id long, item_id long, start_word long, n_words long"


def winnow(hashes: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the fingerprints among k-gram hashes that are ordered by row.

    A row of fewer hashes than the window is one window.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(first, n))
    at = np.arange(n)
    best = at.copy()
    left = np.repeat(first + size, size) - at  # hashes from here to the row's end
    for step in range(1, window):
        a = np.flatnonzero(left > step)
        better = hashes[a + step] <= hashes[best[a]]
        best[a[better]] = a[better] + step
    begins = (left >= window) | (at == np.repeat(first, size))
    return np.unique(best[begins])


def extend(a: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far words of a before p and from p on agree with those of b at q, within the rows' borders."""
    back, on = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live):
        x, y = p[live] - back[live] - 1, q[live] - back[live] - 1
        ok = (x >= a_lo[live]) & (y >= b_lo[live])
        ok[ok] = a[x[ok]] == b[y[ok]]
        live = live[ok]
        back[live] += 1
    live = np.arange(len(p))
    while len(live):
        x, y = p[live] + on[live], q[live] + on[live]
        ok = (x < a_hi[live]) & (y < b_hi[live])
        ok[ok] = a[x[ok]] == b[y[ok]]
        live = live[ok]
        on[live] += 1
    return back, on


def _meet(ours: np.ndarray, at: np.ndarray, theirs: np.ndarray, their_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal hashes on both sides; theirs are ordered."""
    lo, hi = np.searchsorted(theirs, ours, "left"), np.searchsorted(theirs, ours, "right")
    hit = hi > lo
    lo, n = lo[hit], (hi - lo)[hit]
    return np.repeat(at[hit], n), their_at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


class Target:
    """The words of some items, and an index of their fingerprints."""

    def __init__(self, text: pa.Array, k: int, window: int):
        words, ptr = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for s in T.slices(text):
            w = T.words(s)
            ptr.append(w.ptr[1:] + ptr[-1][-1])
            words.append(w.h)
        self.k, self.window = k, window
        self.h, self.ptr = np.concatenate(words), np.concatenate(ptr)
        none = np.zeros(0, np.int64)
        w = T.Words(self.ptr, none, none, self.h)
        grams, begin = T.ngrams(w, k)
        pick = winnow(grams, np.searchsorted(self.ptr, begin, "right"), window)
        order = np.argsort(grams[pick], kind="stable")
        self.fp, self.at = grams[pick][order], begin[pick][order]
        size = np.diff(self.ptr)
        first = begin[np.isin(begin, self.ptr[:-1][(size >= k) & (size < k + window - 1)])]
        heads = grams[np.searchsorted(begin, first)]
        order = np.argsort(heads, kind="stable")
        self.short, self.short_at = heads[order], first[order]

    def spans(self, w: T.Words) -> tuple[np.ndarray, ...]:
        """Row, item, first word in its row, and length of the maximal shared spans of the rows of w."""
        none = np.zeros(0, np.int64)
        grams, begin = T.ngrams(w, self.k)
        if not len(grams) or not len(self.fp):
            return none, none, none, none
        pick = winnow(grams, np.searchsorted(w.ptr, begin, "right"), self.window)
        both = [_meet(grams[pick], begin[pick], self.fp, self.at)]
        if len(self.short):
            both.append(_meet(grams, begin, self.short, self.short_at))
        p, q = (np.concatenate(x) for x in zip(*both))
        if not len(p):
            return none, none, none, none
        row, item = np.searchsorted(w.ptr, p, "right") - 1, np.searchsorted(self.ptr, q, "right") - 1
        back, on = extend(w.h, w.ptr[row], w.ptr[row + 1], self.h, self.ptr[item], self.ptr[item + 1], p, q)
        found = np.unique(np.stack([row, item, p - back - w.ptr[row], q - back, back + on]), axis=1)
        row, item, start, _, length = found[:, (found[4] >= self.k + self.window - 1) | (found[4] == np.diff(self.ptr)[found[1]])]
        return row, item, start, length


def _fingerprints(k: int, window: int, every: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(2)):
                w = T.words(s)
                grams, begin = T.ngrams(w, k)
                row = np.searchsorted(w.ptr, begin, "right") - 1
                pick = np.arange(len(grams)) if every else winnow(grams, row, window)
                at = pa.array(row[pick] + s.first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(grams[pick].view(np.int64))], ["id", "th", "fp"])

    return run


def _short(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.concatenate([np.diff(T.words(s).ptr) for s in T.slices(b.column(0))] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([int(((n >= k) & (n < k + window - 1)).sum())], pa.int64())], ["n"])

    return run


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.lower(F.col(text_col)).alias("t")).where(F.col("t").isNotNull())


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, k: int = 8, window: int = 6, broadcast_words: int = 5_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words) of every maximal span of at least k + window - 1 words that a document shares with a benchmark item."""
    spark = docs.sparkSession
    ship(spark)
    rows, items = _keyed(docs, id_col, text_col), _keyed(benchmark, item_col, item_text_col)
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    if size <= 6 * broadcast_words:
        got = items.select("id", "t").toArrow()
        target = spark.sparkContext.broadcast((Target(got["t"].combine_chunks(), k, window), np.array(got["id"].to_pylist(), object)))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, ids = target.value
            for b in batches:
                for s in T.slices(b.column(1)):
                    row, item, start, length = index.spans(T.words(s))
                    if len(row):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + s.first)), pa.array(ids[item], pa.int64()), pa.array(start), pa.array(length)], ["doc_id", "item_id", "start_word", "n_words"])

        return rows.select("id", "t").mapInArrow(find, SPANS)

    marks = "id long, th long, fp long"
    short = items.select("t").mapInArrow(_short(k, window), "n long").agg(F.sum("n").alias("n")).first()["n"]
    ours = rows.mapInArrow(_fingerprints(k, window, bool(short)), marks).select("th", "fp").distinct()
    theirs = items.mapInArrow(_fingerprints(k, window), marks).select(F.col("th").alias("item_th"), "fp").distinct()
    pairs = cut(ours.join(theirs, "fp").select("th", "item_th").distinct())
    texts = items.groupBy(F.col("th").alias("item_th"), F.col("t").alias("item_t")).agg(F.collect_list(F.struct("id")).alias("items"))
    both = rows.join(pairs, "th").join(texts, "item_th").select("id", "t", "items", "item_t")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            built: dict[str, Target] = {}
            for i in range(b.num_rows):
                text = b.column(3)[i].as_py()
                index = built.get(text) or built.setdefault(text, Target(b.column(3).slice(i, 1), k, window))
                _, _, start, length = index.spans(T.words(next(T.slices(b.column(1).slice(i, 1)))))
                out += [(b.column(0)[i].as_py(), x["id"], int(p), int(n)) for x in b.column(2)[i].as_py() for p, n in zip(start, length)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "item_id", "start_word", "n_words"])

    return both.mapInArrow(compare, SPANS)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that share no span with the benchmark, with all their columns. A row of a null id goes with its text."""
    key = fresh("__row", docs)
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    pair = keyed.select(F.col(key).alias("k"), F.col(text_col).alias("t"))
    bad = contaminated_spans(pair, benchmark, id_col="k", text_col="t", **options)
    bad = cut(bad.select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(hinted(bad), key, "left_anti").select(*docs.columns)


WORDS = "regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS i, item_id, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
bp AS (SELECT i, item_id, w, unnest(range(1, len(w) - 11)) AS q FROM b WHERE len(w) >= 13),
dg AS (SELECT r, doc_id, p, array_to_string(w[p:p+12], ' ') AS g FROM dp),
bg AS (SELECT i, item_id, q, array_to_string(w[q:q+12], ' ') AS g FROM bp),
hit AS (SELECT r, doc_id, i, item_id, p, q FROM dg JOIN bg USING (g)),
run AS (SELECT *, p - row_number() OVER (PARTITION BY r, i, p - q ORDER BY p) AS island FROM hit)
SELECT doc_id, item_id, min(p) - 1 AS start_word, count(*) + 12 AS n_words
FROM run GROUP BY r, doc_id, i, item_id, p - q, island
UNION ALL SELECT doc_id, item_id, p - 1, n FROM (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) BETWEEN 8 AND 12) ON len(w) >= n))
JOIN (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS g FROM b) USING (n, g)
"""

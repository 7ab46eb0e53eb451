"""Substring deduplication by sliding sentence spans.

From every sentence on, and back from every sentence, the shortest run of at least
`size` consecutive sentences that has at least `min_words` words is hashed (its
words, lower-cased, in order), so that runs slide over the whole text and short
sentences are covered too; a sentence of `long_words` words is a run by itself as well. The hashes of all documents are joined, and every sentence
that a non-first occurrence of a repeated span covers is removed. The first occurrence is that of the smallest doc_id (nulls last),
then of the smallest text hash, then the earliest in the text.

A sentence ends at a newline, or at '.', '!' or '?' before white space, or at
the end of the text; a stretch without a word belongs to the sentence before it
(at the beginning, to the first one). What is kept is kept byte for byte.

Defined results: a null text stays null and an empty one empty; a text of one
short sentence is never changed; rows of equal doc_id and equal text are
one document (all of them are changed alike); columns of other names are not
read; documents that are not listed stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, hinted, ship
from . import _text as T


def span_hashes(s: T.Slice, size: int, min_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of its first sentence, number of sentences, and hash of every span of some lower-cased rows."""
    w = T.words(s)
    border, row = T.sentences(s, w)
    n = len(row)
    none = np.zeros(0, np.int64)
    if n == 0:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n)
    alone = at[np.diff(border) >= long_words]
    end = np.maximum(np.searchsorted(border, border[:-1] + min_words), at + size)
    begin = np.minimum(np.searchsorted(border, border[1:] - min_words, "right") - 1, at + 1 - size)
    begin, end = np.concatenate([at, begin, alone]), np.concatenate([end, at + 1, alone + 1])
    ok = (begin >= 0) & (end <= n)
    ok[ok] = row[begin[ok]] == row[end[ok] - 1]
    both = np.unique(begin[ok] * (n + 1) + end[ok])
    begin, end = both // (n + 1), both % (n + 1)
    nth = at - np.searchsorted(row, row)
    return row[begin], nth[begin], end - begin, T.run_hash(w.h, border[begin], border[end])


def _spans(size: int, min_words: int, long_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(2)):
                row, nth, n, h = span_hashes(s, size, min_words, long_words)
                at = pa.array(row + s.first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(nth.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64))], ["id", "th", "nth", "n", "h"])

    return run


def cut_points(text: bytes) -> np.ndarray:
    """Byte offsets at which the sentences of one text begin, with its length at the end."""
    s = T.Slice(0, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    w = T.words(s)
    border, _ = T.sentences(s, w)
    stop = np.zeros(len(text), bool)
    stop[:-1] = T.IS_END[s.buf[:-1]] & T.IS_BLANK[s.buf[1:]]
    stop |= s.buf == 10
    at = np.flatnonzero(stop)
    begin = at[np.searchsorted(at, w.start[border[1:-1]]) - 1] + 1
    return np.concatenate([[0], begin, [len(text)]])


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their sentences to remove; the cuts are found in the text as it is, since case moves none."""
    for b in batches:
        out, n_all, n_gone = [], [], []
        for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            at = cut_points(raw)
            drop = set(gone)
            out.append(b"".join(raw[at[i] : at[i + 1]] for i in range(len(at) - 1) if i not in drop).decode("utf-8", "surrogatepass"))
            n_all.append(len(at) - 1)
            n_gone.append(len(drop))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n_all, pa.int32()), pa.array(n_gone, pa.int32())], ["row", "text", "n_sentences", "n_removed"])


def removals(docs: DataFrame, size: int = 2, min_words: int = 8, long_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, gone): documents by id and text hash, and the numbers of their sentences to remove."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.lower(F.col(text_col)).alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    spans = rows.mapInArrow(_spans(size, min_words, long_words), "id long, th long, nth int, n int, h long")
    place = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "th", "nth")
    repeated = spans.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("h", "first")
    again = spans.join(repeated, "h").where(place != F.col("first"))
    covered = again.select("id", "th", F.explode(F.sequence("nth", F.col("nth") + F.col("n") - 1)).alias("nth"))
    return covered.groupBy("id", "th").agg(F.collect_set("nth").alias("gone"))


def changed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) of every document from which sentences are removed, its text without them."""
    gone = cut(removals(docs, id_col=id_col, text_col=text_col, **options))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    hit = rows.join(hinted(gone), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th"))).select("doc_id", "text", "gone")
    return hit.mapInArrow(_removal, "row long, text string, n_sentences int, n_removed int").withColumnRenamed("row", "doc_id")


WORDS = "regexp_extract_all(lower({}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"

SQL = f"""
WITH p AS (
  SELECT doc_id, text AS whole, ord, piece, {WORDS.format("piece")} AS w FROM (
    SELECT doc_id, text, unnest(cuts) AS piece, unnest(range(1, len(cuts) + 1)) AS ord FROM (
      SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '([.!?])([ \\t\\r\\f\\v])', '\\1' || chr(1) || '\\2', 'g'), '\\n', chr(10) || chr(1), 'g'), chr(1)) AS cuts
      FROM documents WHERE text IS NOT NULL AND text <> ''))),
n AS (SELECT *, (greatest(sum(CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, whole ORDER BY ord), 1) - 1)::BIGINT AS nth FROM p),
s AS (SELECT doc_id, whole, nth, string_agg(piece, '' ORDER BY ord) AS raw, string_agg(array_to_string(w, ' '), ' ' ORDER BY ord) FILTER (len(w) > 0) AS norm, sum(len(w)) AS words FROM n GROUP BY ALL),
c AS (SELECT doc_id, whole, nth, words, sum(words) OVER (PARTITION BY doc_id, whole ORDER BY nth) AS total FROM s WHERE words > 0),
all_norms AS (SELECT doc_id, whole, list(norm ORDER BY nth) AS norms FROM s GROUP BY ALL),
reach AS (SELECT a.doc_id, a.whole, a.nth AS i, b.nth AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.whole = b.whole AND b.nth BETWEEN a.nth + 1 AND a.nth + 7 AND b.total - a.total + a.words >= 8),
ij AS (SELECT doc_id, whole, i, min(j) AS j FROM reach GROUP BY doc_id, whole, i UNION SELECT doc_id, whole, max(i) AS i, j FROM reach GROUP BY doc_id, whole, j UNION SELECT doc_id, whole, nth, nth FROM c WHERE words >= 25),
rk AS (SELECT doc_id, whole, i, j, row_number() OVER (PARTITION BY array_to_string(norms[i + 1:j + 1], ' ') ORDER BY doc_id, i) AS occurrence FROM ij JOIN all_norms USING (doc_id, whole)),
gone AS (SELECT DISTINCT doc_id, whole, unnest(range(i, j + 1)) AS nth FROM rk WHERE occurrence > 1)
SELECT s.doc_id, coalesce(string_agg(s.raw, '' ORDER BY s.nth) FILTER (g.nth IS NULL), '') AS text,
  count(*)::INT AS n_sentences, count(g.nth)::INT AS n_removed
FROM s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.whole = g.whole AND s.nth = g.nth
GROUP BY s.doc_id, s.whole HAVING count(g.nth) > 0
"""

"""Line labels, content or boilerplate, by a linear-chain conditional random field.

A line with a word has a handful of yes-or-no features (its length, its ending,
its shares of symbols, digits, capitals and repeated words, and so on). A
conditional random field over the lines of a text weighs them and the labels of
neighbouring lines; Viterbi decoding gives the labels. A text is retained when
content lines hold at least `min_share` of its bytes.

The field is fitted in numpy on all lines of at most `train_docs` labelled
documents of at most `train_bytes` bytes, cut into sequences of `SEQUENCE` lines: those of a
document of quality 1 are content but for lines of legal or navigation words, those of
quality 0 are boilerplate. A few built-in lines are always among them, so that the fit is
defined without labels. Everything else works on all lines of all texts.

Defined results: a null, empty or wordless text has no content and isn't
retained; every row, repeated or not, is judged by itself (rows of equal text
alike); null ids are passed on, and null labels leave a document out of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from . import _text as T

FEATURES = ("any", "words < 3", "words < 9", "words >= 30", "ends a sentence", "pipes", "symbols > 4 %", "symbols > 15 %", "digits > 20 %", "capitals > 50 %", "repeated words > 50 %", "repeated words > 80 %", "legal or navigation word", "line repeated", "long words", "first", "last")
MARKED = ("licensed", "license", "copyright", "reserved", "cookie", "cookies", "privacy", "login", "subscribe", "javascript", "newsletter", "sitemap", "disclaimer", "trademark")
LEGAL = 1 << 12
SEQUENCE = 100

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#$%&*+<=>@[\\]^_`{}~|/!"]] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True
IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_LOWER = np.zeros(256, bool)
IS_LOWER[97:123] = True


@dataclass
class Lines:
    """ptr[r]:ptr[r+1] are row r's lines that have a word; size is in bytes, bits has bit f for FEATURES[f]."""

    ptr: np.ndarray
    size: np.ndarray
    bits: np.ndarray


def _marked() -> np.ndarray:
    forms = [f for x in MARKED for f in (x, x.capitalize(), x.upper())]
    return np.unique(T.words(next(T.slices(pa.array([" ".join(forms)])))).h)


def lines(s: T.Slice, marked: np.ndarray) -> Lines:
    none = np.zeros(0, np.int64)
    w = T.words(s)
    if not len(w.h):
        return Lines(np.zeros(s.rows + 1, np.int64), none, none)
    start = np.unique(np.concatenate([s.offs[:-1], np.flatnonzero(s.buf == 10) + 1]))
    start = start[start < len(s.buf)]
    end = np.append(start[1:], len(s.buf))
    word_ptr = np.searchsorted(w.start, np.append(start, len(s.buf)))
    has = np.diff(word_ptr) > 0
    start, end, first_word, n = start[has], end[has], word_ptr[:-1][has], np.diff(word_ptr)[has]
    row = np.searchsorted(s.offs, start, "right") - 1
    ptr = np.searchsorted(row, np.arange(s.rows + 1))
    size = end - start

    def counted(kind: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(kind[s.buf]))
        return total[end] - total[start]

    line_of = np.repeat(np.arange(len(n)), n)
    key = np.sort((line_of.astype(np.uint64) << np.uint64(32)) | (w.h >> np.uint64(32)))
    new = np.append(True, key[1:] != key[:-1])
    distinct = np.bincount((key[new] >> np.uint64(32)).astype(np.int64), minlength=len(n))
    repeated = 1 - distinct / n
    legal = np.bincount(line_of, weights=np.isin(w.h, marked), minlength=len(n)) > 0
    same = T.mix(T.run_hash(w.h, first_word, first_word + n) + T.mix(row.astype(np.uint64)))
    _, which, often = np.unique(same, return_inverse=True, return_counts=True)
    last_byte = s.buf[w.end[first_word + n - 1] - 1]
    after = np.minimum(w.end[first_word + n - 1], len(s.buf) - 1)
    ends = (T.IS_END[s.buf[after]] & (after < end)) | T.IS_END[last_byte]
    symbols, digits, upper, lower = counted(IS_SYMBOL), counted(IS_DIGIT), counted(IS_UPPER), counted(IS_LOWER)
    pipe = np.zeros(256, bool)
    pipe[ord("|")] = True
    given = (
        np.ones(len(n), bool), n < 3, n < 9, n >= 30, ends, counted(pipe) * 3 >= n, symbols * 25 > size, symbols * 20 > 3 * size, digits * 5 > size, upper > lower,
        (repeated > 0.5) & (n >= 6), (repeated > 0.8) & (n >= 6), legal, often[which] > 1, size > 14 * n, start == s.offs[row], np.arange(len(n)) == ptr[row + 1] - 1,
    )
    bits = np.zeros(len(n), np.int64)
    for f, x in enumerate(given):
        bits |= x.astype(np.int64) << f
    return Lines(ptr, size, bits)


@dataclass
class Field:
    """Scores: weight[label, feature], move[from, to], begin[label]; label 1 is content."""

    weight: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def emissions(self, bits: np.ndarray) -> np.ndarray:
        return ((bits[:, None] >> np.arange(len(FEATURES))) & 1) @ self.weight.T

    def viterbi(self, ptr: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The best label of each line; of equally good ones boilerplate."""
        e = self.emissions(bits)
        n = np.diff(ptr)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        back = np.zeros((len(bits), 2), np.int8)
        out = np.zeros(len(bits), np.int8)
        if not len(order):
            return out
        first, count = ptr[:-1][order], n[order]
        best = self.begin + e[first]
        final = np.zeros((len(order), 2))
        live = len(order)
        for j in range(1, int(count[0])):
            still = int(np.searchsorted(-count, -j))
            final[still:live] = best[still:live]
            live = still
            at = first[:live] + j
            from_0, from_1 = best[:live, :1] + self.move[0], best[:live, 1:] + self.move[1]
            back[at] = from_1 > from_0
            best = np.maximum(from_0, from_1) + e[at]
        final[:live] = best[:live]
        label = (final[:, 1] > final[:, 0]).astype(np.int8)
        for j in range(int(count[0]) - 1, -1, -1):
            live = int(np.searchsorted(-count, -j))
            at = first[:live] + j
            out[at] = label[:live]
            label[:live] = back[at, label[:live]]
        return out


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; a sequence is the feature bits and the labels of some lines. Equal ones are one with a weight."""
    often: dict[tuple[bytes, bytes], int] = {}
    for bits, label in sequences:
        if len(bits):
            key = np.asarray(bits, np.int64).tobytes(), np.asarray(label, np.int64).tobytes()
            often[key] = often.get(key, 0) + 1
    sequences = [(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)) for a, b in often]
    times = np.array(list(often.values()), float)
    size, longest, f = len(sequences), max(len(x[0]) for x in sequences), len(FEATURES)
    x, y, on = np.zeros((size, longest, f)), np.zeros((size, longest), np.int64), np.zeros((size, longest), bool)
    for i, (bits, label) in enumerate(sequences):
        x[i, : len(bits)] = (bits[:, None] >> np.arange(f)) & 1
        y[i, : len(bits)] = label
        on[i, : len(bits)] = True
    lines_n = (on * times[:, None]).sum()
    each = on * times[:, None]
    theta = np.zeros(2 * f + 4 + 2)
    gold = np.zeros_like(theta)
    for label in (0, 1):
        gold[label * f : (label + 1) * f] = np.einsum("sl,slf->f", (y == label) * each, x)
        gold[2 * f + 4 + label] = ((y[:, 0] == label) * times).sum()
        for to in (0, 1):
            gold[2 * f + 2 * label + to] = (((y[:, :-1] == label) & (y[:, 1:] == to)) * each[:, 1:]).sum()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        weight, move, begin = theta[: 2 * f].reshape(2, f), theta[2 * f : 2 * f + 4].reshape(2, 2), theta[2 * f + 4 :]
        e = x @ weight.T
        alpha, beta = np.zeros((size, longest, 2)), np.zeros((size, longest, 2))
        alpha[:, 0] = begin + e[:, 0]
        for j in range(1, longest):
            a = np.logaddexp(alpha[:, j - 1, :1] + move[0], alpha[:, j - 1, 1:] + move[1]) + e[:, j]
            alpha[:, j] = np.where(on[:, j, None], a, alpha[:, j - 1])
        whole = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for j in range(longest - 2, -1, -1):
            b = e[:, j + 1] + beta[:, j + 1]
            beta[:, j] = np.where(on[:, j + 1, None], np.logaddexp(move[:, 0] + b[:, :1], move[:, 1] + b[:, 1:]), 0)
        single = np.exp(alpha + beta - whole[:, None, None]) * each[..., None]
        got = np.zeros_like(theta)
        got[: 2 * f] = np.einsum("slk,slf->kf", single, x).ravel()
        got[2 * f + 4 :] = single[:, 0].sum(0)
        if longest > 1:
            pair = alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - whole[:, None, None, None]
            got[2 * f : 2 * f + 4] = (np.exp(np.where(on[:, 1:, None, None], pair, -np.inf)) * times[:, None, None, None]).sum((0, 1)).ravel()
        step = (gold - got) / lines_n - decay * theta
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(theta[: 2 * f].reshape(2, f), theta[2 * f : 2 * f + 4].reshape(2, 2), theta[2 * f + 4 :])


_PROSE = (
    "The river rose after three days of rain, and the lower fields were under water by noon.", "She closed the book and looked out of the window for a long while.", "Nobody had expected the vote to be so close.",
    "It is not known how many of the letters survived, since the archive burned in the last year of the war.", "Prices fell again in spring.", "We walked along the shore until it was dark, then turned back towards the lights of the town.",
)
_JUNK = (
    "Start | Products | Prices | Support | Imprint", "Copyright 2021 All rights reserved.", "!!! $$$ >>> ONLY TODAY <<< $$$ !!!", "This work is licensed under the terms of the agreement below.", "deal deal deal deal deal deal offer offer offer offer offer offer", "Login",
    "FREE!! CALL!! NOW!! FREE!! CALL!! NOW!! FREE!! CALL!! NOW!! FREE!! CALL!! NOW!! FREE!!", "Share | Print | Mail | Older | Newer | Top", "12 34 556 7788 90 123 4456 77",
)


def built_in(marked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for texts, label in ((("\n".join(_PROSE), *_PROSE), 1), (("\n".join(_JUNK), *_JUNK), 0)):
        for s in T.slices(pa.array(list(texts))):
            own = lines(s, marked)
            out += [(own.bits[a:b], np.full(b - a, label)) for a, b in zip(own.ptr[:-1], own.ptr[1:])]
    return out


def trained(docs: DataFrame, labels: DataFrame | None, train_docs: int = 1000, train_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field fitted on the labelled documents of smallest id hash and the built-in lines."""
    marked = _marked()
    data = built_in(marked)
    if labels is not None:
        pick = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("label"))
        pick = cut(pick.orderBy(F.xxhash64("label_id"), "label").limit(train_docs))
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where(F.octet_length("t") <= train_bytes)
        both = rows.join(F.broadcast(pick), F.col("id") == F.col("label_id")).select("id", "label", "t")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in T.slices(b.column(2)):
                    own = lines(s, marked)
                    cuts = [own.bits[a:z].tolist() for a, z in zip(own.ptr[:-1], own.ptr[1:])]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.rows), b.column(1).slice(s.first, s.rows), pa.array(cuts, pa.list_(pa.int64()))], ["id", "label", "bits"])

        got = both.mapInArrow(run, "id long, label int, bits array<long>").collect()
        for r in sorted(got, key=lambda r: (r["id"], r["label"], r["bits"])):
            bits = np.array(r["bits"], np.int64)
            label = np.where(bits & LEGAL > 0, 0, r["label"])
            data += [(bits[a : a + SEQUENCE], label[a : a + SEQUENCE]) for a in range(0, len(bits), SEQUENCE)]
    return fit(data)


def judged(docs: DataFrame, field: Field, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_lines, n_content, content_share) of every retained row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((field, _marked()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, marked = shared.value
        for b in batches:
            for s in T.slices(b.column(2)):
                own = lines(s, marked)
                label = model.viterbi(own.ptr, own.bits)
                row = T.row_of(own.ptr)
                size = np.bincount(row, weights=own.size, minlength=s.rows)
                good = np.bincount(row, weights=own.size * label, minlength=s.rows)
                at = np.flatnonzero((size > 0) & (good >= min_share * size))
                rows = pa.array(at + s.first)
                content = np.bincount(row, weights=label, minlength=s.rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.diff(own.ptr)[at].astype(np.int64)), pa.array(content[at]), pa.array(good[at] / size[at])], ["doc_id", "text_hash", "n_lines", "n_content", "content_share"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    return rows.where("t is not null").mapInArrow(run, "doc_id long, text_hash long, n_lines long, n_content long, content_share double")


def retained(docs: DataFrame, labels: DataFrame | None, **options) -> DataFrame:
    """(doc_id, n_lines, n_content, content_share) of every retained row."""
    ship(docs.sparkSession)
    return judged(docs, trained(docs, labels), **options).drop("text_hash")

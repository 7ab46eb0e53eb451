"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The terms of the lexicon form a trie. Its product with the Levenshtein automata
of all terms is made deterministic: one table that reads a word letter by letter
and tells at its end the nearest term within that term's number of edits (0 up
to 3 letters, 1 up to 9, 2 beyond; any letter may be wrong). All words of a batch run
through the table together. A near form doesn't count where it is an ordinary word: one of
a short built-in list, or one that at least two clean labelled documents have (one, near a
learned word), unless it is far more frequent in toxic ones.

Beside a built-in lexicon there are words learned from labelled documents: those that
occur far more often in toxic than in clean ones, of up to `train_docs` each. Copies would
make every word of theirs look so, hence of documents with the same three longest words,
or the same first three long words in order, one teaches. Learned words may be of any
script and of at least 4 characters; those of 6 letters a to z and more are also found with
one edit. They count 0.6, near forms 0.3, and only as far as they are more than ten times
as many as in as long a clean text.

Each hit is scored by its context, `window` words to either side: it counts 0.3
where quotation marks stand on both sides or a reporting word comes before it,
else 1.5 where somebody is addressed, else 1. Terms weigh their severity, however
they are spelled. A text is rejected when its hits sum to `threshold`, so that one
unquoted term of full severity does it; three terms that also have a harmless sense
weigh less.

Texts are lower-cased, accents and digits that stand for letters are folded, and
typographic quotation marks made plain. Near forms are sought among words of the letters
a to z. Scores are sums of whole thousandths.

Labels of null, or of a null doc_id, teach nothing; of several for a document the toxic
one counts. Defined results: null, empty and wordless texts have score 0 and stay; every row,
repeated or not, is judged by itself; null ids are passed on; other columns too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, fresh, hinted, ship
from . import _text as T

#: Terms and their severity in tenths.
LEXICON: dict[str, int] = {
    "idiot": 10, "idiots": 10, "idiotic": 10, "moron": 10, "morons": 10, "moronic": 10, "scum": 10, "scumbag": 10, "trash": 10, "stupid": 10,
    "worthless": 10, "disgusting": 10, "pathetic": 10, "clown": 10, "clowns": 10, "loser": 10, "losers": 10, "imbecile": 10, "dumbass": 10,
    "asshole": 10, "bastard": 10, "bitch": 10, "retard": 10, "retarded": 10, "vermin": 10, "subhuman": 10, "degenerate": 8, "cretin": 10,
    "dimwit": 10, "halfwit": 10, "jackass": 10, "douchebag": 10, "shithead": 10, "fuckwit": 10, "lowlife": 8, "parasite": 6,
}
ORDINARY = (
    "idiom", "idioms", "boron", "moran", "mormon", "mormons", "morton", "moon", "moons", "moroni", "scam", "sum", "slum", "scud", "cum", "swum", "scrum", "acum", "thrash", "crash", "rash", "brash", "trish", "crown", "crowns", "blown", "flown", "clow",
    "lover", "lovers", "loses", "lose", "loner", "loners", "lower", "lowers", "closer", "laser", "lasers", "poser", "posers", "dastard", "batch", "botch", "birch", "pitch", "witch", "ditch", "hitch", "itch", "fitch", "mitch", "regard", "reward", "petard", "regarded", "rewarded",
    "verein", "termin", "vermis", "cretan", "creatin", "generate", "regenerate", "regenerated", "decelerate", "discussing", "disputing", "disrupting", "disguising", "distrusting", "digesting", "apathetic", "bathetic", "jackals", "parasites", "parasitic",
)
REPORTING = ("said", "says", "called", "calls", "calling", "quote", "quoted", "quoting", "wrote", "writes", "insult", "slur")
ADDRESSED = ("you", "your", "youre", "yourself", "yall", "ur")
ACCENTS = ("àáâãäåèéêëìíîïòóôõöùúûüýÿñç013457“”„«»", 'aaaaaaeeeeiiiiooooouuuuyyncoieast"""""')


def edits(term: str) -> int:
    return 0 if len(term) <= 3 else 1 if len(term) <= 9 else 2


def learned_edits(word: str) -> int:
    return int(len(word) >= 6 and _plain(word))


def _plain(word: str) -> bool:
    return all("a" <= c <= "z" for c in word)


@dataclass
class Automaton:
    """table[state, letter] is the next state (0: dead, 1: start); at a word's end, term[state] (-1: none) at distance[state]."""

    table: np.ndarray
    term: np.ndarray
    distance: np.ndarray
    longest: int


def automaton(terms: list[str], limits: list[int] | None = None) -> Automaton:
    limits = [edits(t) for t in terms] if limits is None else limits
    child: list[dict[int, int]] = [{}]
    ends, allow = [-1], [0]
    for i, term in enumerate(terms):
        if not term or not _plain(term):
            raise ValueError(f"terms are lower-case letters: {term!r}")
        at, path = 0, [0]
        for c in term:
            key = ord(c) - 97
            if key not in child[at]:
                child[at][key] = len(child)
                child.append({})
                ends.append(-1)
                allow.append(0)
            at = child[at][key]
            path.append(at)
        ends[at] = i
        for node in path:
            allow[node] = max(allow[node], limits[i])

    def closed(state: dict[int, int]) -> frozenset[tuple[int, int]]:
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            if state.get(node, 99) < e:
                continue
            for to in child[node].values():
                if e + 1 <= allow[to] and state.get(to, 99) > e + 1:
                    state[to] = e + 1
                    todo.append((to, e + 1))
        return frozenset(state.items())

    def step(state: frozenset[tuple[int, int]], letter: int) -> frozenset[tuple[int, int]]:
        out: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= allow[node] and out.get(node, 99) > e:
                out[node] = e

        for node, e in state:
            put(node, e + 1)
            for key, to in child[node].items():
                put(to, e if key == letter else e + 1)
        return closed(out)

    names: dict[frozenset[tuple[int, int]], int] = {frozenset(): 0}
    states, rows = [frozenset()], [np.zeros(27, np.int32), np.zeros(27, np.int32)]
    states.append(frozenset([(0, 0)]))

    def name(s: frozenset[tuple[int, int]]) -> int:
        if s not in names:
            names[s] = len(states)
            states.append(s)
            rows.append(np.zeros(27, np.int32))
        return names[s]

    states[1] = closed({0: 0})
    names[states[1]] = 1
    at = 1
    while at < len(states):
        other = name(step(states[at], 26))
        rows[at][:] = other
        for key in {k for node, _ in states[at] for k in (*child[node], *(k for to in child[node].values() for k in child[to]), *(k for to in child[node].values() for x in child[to].values() for k in child[x]))}:
            rows[at][key] = name(step(states[at], key))
        at += 1
    term, distance = np.full(len(states), -1, np.int32), np.zeros(len(states), np.int32)
    for i, s in enumerate(states):
        best = min(((e, ends[node]) for node, e in s if ends[node] >= 0 and e <= limits[ends[node]]), default=None)
        if best:
            distance[i], term[i] = best
    return Automaton(np.stack(rows), term, distance, max((len(t) + n for t, n in zip(terms, limits)), default=0))


LETTER = np.full(256, 26, np.uint8)
LETTER[97:123] = np.arange(26)


def run_words(a: Automaton, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The state in which each word ends; words with bytes other than letters end dead."""
    state = np.zeros(len(start), np.int32)
    live = np.flatnonzero(end - start <= a.longest)
    now = np.ones(len(live), np.int32)
    for j in range(a.longest):
        more = end[live] - start[live] > j
        state[live[~more]] = now[~more]
        live, now = live[more], now[more]
        if not len(live):
            break
        letter = LETTER[buf[start[live] + j]]
        now = np.where(letter == 26, 0, a.table[now, letter])
        keep = now > 0
        live, now = live[keep], now[keep]
    state[live] = np.where(end[live] - start[live] <= a.longest, now, 0)
    return state


def _hashes(words: Sequence[str]) -> np.ndarray:
    """The hashes of some words, in their order."""
    return T.words(next(T.slices(pa.array([" ".join(words)])))).h if len(words) else np.zeros(0, np.uint64)


@dataclass
class Learned:
    """Words learned from labels, ordinary words that are near a term, and how often learned words occur in so many words of clean documents."""

    words: list[str] = field(default_factory=list)
    common: list[str] = field(default_factory=list)
    hits: int = 0
    total: int = 1


@dataclass
class Judge:
    """The automaton of the terms of a to z of both lexicons, and the number of each; the hashes of the other terms, ordered, and their numbers. From term `known` on they are learned."""

    automaton: Automaton
    number: np.ndarray
    exact: np.ndarray
    exact_number: np.ndarray
    weight: np.ndarray
    known: int
    learned: Learned
    marks: tuple[np.ndarray, ...]

    def match(self, w: T.Words, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest term of each word (-1: none) and its distance; ordinary words are near none."""
        state = run_words(self.automaton, buf, w.start, w.end)
        near = self.automaton.term[state]
        term, distance = np.where(near >= 0, self.number[near], -1), self.automaton.distance[state]
        bad = np.flatnonzero((term >= 0) & (distance > 0))
        term[bad[np.isin(w.h[bad], self.marks[2])]] = -1
        if len(self.exact):
            at = np.minimum(np.searchsorted(self.exact, w.h), len(self.exact) - 1)
            same = self.exact[at] == w.h
            term[same], distance[same] = self.exact_number[at[same]], 0
        return term, distance


LEARNED_WEIGHT, USUAL = 6, 10


def judge(lexicon: dict[str, int], learned: Learned) -> Judge:
    own = [w for w in learned.words if w not in lexicon]
    terms = [*lexicon, *own]
    limits = [edits(t) for t in lexicon] + [learned_edits(w) for w in own]
    weight = np.array([*lexicon.values(), *[LEARNED_WEIGHT] * len(own)], np.int64)
    plain = [i for i, t in enumerate(terms) if _plain(t)]
    other = [i for i, t in enumerate(terms) if not _plain(t)]
    h = _hashes([terms[i] for i in other])
    order = np.argsort(h)
    marks = tuple(np.unique(_hashes(x)) for x in (REPORTING, ADDRESSED, (*ORDINARY, *learned.common)))
    return Judge(automaton([terms[i] for i in plain], [limits[i] for i in plain]), np.array([*plain, -1]), h[order], np.array(other, np.int64)[order], weight, len(lexicon), learned, marks)


def learn(docs: DataFrame, labels: DataFrame, lexicon: dict[str, int] | None = None, train_docs: int = 4000, min_docs: int = 4, least_share: int = 6, odds: int = 12, id_col: str = "doc_id", text_col: str = "text") -> Learned:
    """Words in at least min_docs and least_share thousandths of the toxic documents, and odds times as often there as in clean ones.

    The documents are the labelled ones of smallest MD5 of their id, up to train_docs toxic and as many clean ones.
    """
    lexicon = LEXICON if lexicon is None else lexicon
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.md5(F.col("label_id").cast("string").cast("binary")), F.col("label_id")]
    pick = cut(known.where("toxic = 1").orderBy(*order).limit(train_docs).unionByName(known.where("toxic = 0").orderBy(*order).limit(train_docs)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    words = F.filter(F.split(prepared("text"), "[^a-z0-9\\x{80}-\\x{10FFFF}]+"), lambda x: x != "")
    taken = cut(rows.join(F.broadcast(pick), F.col("id") == F.col("label_id")).select("toxic", "label_id", "text"))  # at most 2 * train_docs ids
    sample = taken.select("toxic", "label_id", words.alias("words"))
    distinct = F.array_distinct("words")
    longest = F.slice(F.array_sort(F.transform(distinct, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("w")))), 1, 3)
    first = F.slice(F.array_sort(F.filter(distinct, lambda x: F.length(x) > 5)), 1, 3)
    for key in (longest, first):
        nth = F.row_number().over(Window.partitionBy("toxic", "key").orderBy(*order, F.md5(F.array_join("words", " ").cast("binary"))))
        sample = sample.withColumn("key", key).withColumn("nth", nth).where("nth = 1").drop("key", "nth")
    sample = cut(sample)
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    each = sample.select("toxic", F.explode(F.array_distinct("words")).alias("word")).where(F.col("word").rlike("^[^0-9]{4,}$"))
    df = cut(each.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    often = F.col("t") * clean >= odds * (F.col("c") + 1) * toxic
    found = sorted(r["word"] for r in df.where((F.col("t") >= min_docs) & (F.col("t") * 1000 >= least_share * toxic) & often).select("word").collect() if r["word"] not in lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(judge(lexicon, Learned(found)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(0)):
                w = T.words(s)
                term, distance = shared.value.match(w, s.buf)
                at = np.flatnonzero(term >= 0)
                own = pa.array(at + s.first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(distance[at] > 0), pa.array(term[at] >= shared.value.known)], ["word", "usual", "near", "learned"])

    forms = df.select("word", F.when(often, 0).otherwise(F.col("c")).cast("int").alias("usual")).mapInArrow(near, "word string, usual int, near boolean, learned boolean").collect()
    common = sorted(r["word"] for r in forms if r["near"] and r["usual"] >= (1 if r["learned"] else 2))
    counted = sorted({r["word"] for r in forms if r["learned"]} - set(common))
    base = sample.where("toxic = 0").agg(F.sum(F.size(F.filter("words", lambda x: x.isin(counted)))).alias("hits"), F.sum(F.size("words")).alias("total")).first()
    return Learned(found, common, base["hits"] or 0, max(1, base["total"] or 0))


def _fold_tables() -> tuple[np.ndarray, dict[bytes, np.ndarray]]:
    """What a byte becomes, and what a last byte after the given first ones makes of the whole character (0: nothing)."""
    one, more = np.arange(256, dtype=np.uint8), {}
    for char, to in zip(*ACCENTS):
        raw = char.encode()
        if len(raw) == 1:
            one[raw[0]] = ord(to)
        else:
            more.setdefault(raw[:-1], np.zeros(256, np.uint8))[raw[-1]] = ord(to)
    return one, more


_ONE, _MORE = _fold_tables()


def folded(s: T.Slice) -> T.Slice:
    """Lower-cased rows with what prepared() makes of them, without the JVM's character by character translation."""
    buf, keep = _ONE[s.buf], np.ones(len(s.buf), bool)
    lead = s.buf >= 0xC2
    if lead.any():
        at_lead = np.flatnonzero(lead)
        for head, table in _MORE.items():
            at = at_lead[at_lead + len(head) < len(buf)]
            for j, byte in enumerate(head):
                at = at[s.buf[at + j] == byte]
            to = table[s.buf[at + len(head)]]
            at, to = at[to > 0], to[to > 0]
            buf[at] = to
            for j in range(1, len(head) + 1):
                keep[at + j] = False
    place = np.append(0, np.cumsum(keep))
    return T.Slice(s.first, buf[keep], place[s.offs])


def scores(s: T.Slice, j: Judge, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits, misspelled hits and thousandths of score of each row of folded text."""
    marks = j.marks
    w = T.words(s)
    term, distance = j.match(w, s.buf)
    hit = np.flatnonzero(term >= 0)
    row = np.searchsorted(w.ptr, hit, "right") - 1
    n = np.bincount(row, minlength=s.rows)
    if not len(hit):
        return n, n, n
    term, distance = term[hit], distance[hit]
    lo, hi = w.ptr[row], w.ptr[row + 1]
    quotes = np.append(0, np.cumsum(s.buf == 34))
    before = np.where(hit - window >= lo, w.end[np.maximum(hit - window, 0)], s.offs[row])
    after = w.start[np.minimum(hit + window, hi - 1)]
    quoted = (quotes[w.start[hit]] > quotes[before]) & (quotes[np.maximum(after, w.end[hit])] > quotes[w.end[hit]])
    told = np.append(0, np.cumsum(np.isin(w.h, marks[0])))
    quoted |= told[hit] > told[np.maximum(hit - window, lo)]
    named = np.append(0, np.cumsum(np.isin(w.h, marks[1])))
    addressed = named[np.minimum(hit + window + 1, hi)] > named[np.maximum(hit - window, lo)]
    own = term >= j.known
    factor = np.where(quoted, 3, np.where(addressed, 15, 10))
    points = j.weight[term] * np.where(own & (distance > 0), 5, 10) * factor
    given = np.bincount(row, weights=points * ~own, minlength=s.rows).astype(np.int64)
    taught = np.bincount(row, weights=points * own, minlength=s.rows).astype(np.int64)
    usual = USUAL * LEARNED_WEIGHT * 100 * j.learned.hits * np.diff(w.ptr).astype(np.int64) // j.learned.total
    return n, np.bincount(row[distance > 0], minlength=s.rows), given + np.maximum(taught - usual, 0)


def prepared(text_col: str) -> Column:
    return F.translate(F.lower(F.col(text_col)), *ACCENTS)


def judged(docs: DataFrame, labels: DataFrame | None = None, window: int = 8, threshold: float = 1.0, lexicon: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", train_docs: int = 4000) -> DataFrame:
    """(doc_id, text_hash, n_hits, n_misspelled, score) of every rejected row."""
    spark = docs.sparkSession
    ship(spark)
    lexicon = LEXICON if lexicon is None else lexicon
    learned = Learned() if labels is None else learn(docs, labels, lexicon, train_docs, id_col=id_col, text_col=text_col)
    shared = spark.sparkContext.broadcast(judge(lexicon, learned))
    least = max(1, round(threshold * 1000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(2)):
                n, bad, points = scores(folded(s), shared.value, window)
                at = np.flatnonzero(points >= least)
                if len(at):
                    rows = pa.array(at + s.first)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(n[at], pa.int64()), pa.array(bad[at], pa.int64()), pa.array(points[at] / 1000)], ["doc_id", "text_hash", "n_hits", "n_misspelled", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.lower(F.col(text_col)).alias("t"))
    return rows.where("t is not null").mapInArrow(run, "doc_id long, text_hash long, n_hits long, n_misspelled long, score double")


def rejected(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """(doc_id, n_hits, n_misspelled, score) of every rejected row."""
    return judged(docs, labels, **options).drop("text_hash")


def detoxified(docs: DataFrame, labels: DataFrame | None = None, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    key = fresh("__row", docs)
    bad = cut(judged(docs, labels, text_col=text_col, **options).select(F.col("text_hash").alias(key)).distinct())
    return docs.withColumn(key, F.xxhash64(text_col)).join(hinted(bad), key, "left_anti").select(*docs.columns)


def _values(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_POINTS = f"sev * CASE WHEN e > 0 AND k >= {len(LEXICON)} THEN 5 ELSE 10 END * CASE WHEN quoted THEN 3 WHEN addressed THEN 15 ELSE 10 END"

SQL = f"""
WITH given(i, term, sev, lim) AS (VALUES {", ".join(f"({i}, '{t}', {s}, {edits(t)})" for i, (t, s) in enumerate(LEXICON.items()))}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(lower(text), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]*[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS pieces FROM documents WHERE text IS NOT NULL),
w AS (SELECT r, doc_id, pieces, list_transform(pieces, lambda x: regexp_extract(x, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+$')) AS words FROM d),
t AS (SELECT r, doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
pick AS (SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) AS n FROM (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IN (0, 1) GROUP BY doc_id)) WHERE n <= 4000),
s0 AS (SELECT r, doc_id, toxic, words, list_sort(list_transform(list_distinct(words), lambda x: struct_pack(l := -length(x), w := x)))[1:3] AS longest, list_sort(list_filter(list_distinct(words), lambda x: length(x) > 5))[1:3] AS first FROM w JOIN pick USING (doc_id)),
s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY toxic, longest ORDER BY md5(doc_id::VARCHAR), doc_id, md5(array_to_string(words, ' '))) = 1),
sample AS (SELECT r, toxic, words FROM s1 QUALIFY row_number() OVER (PARTITION BY toxic, first ORDER BY md5(doc_id::VARCHAR), doc_id, md5(array_to_string(words, ' '))) = 1),
size AS (SELECT count(*) FILTER (toxic = 1) AS nt, count(*) FILTER (toxic = 0) AS nc FROM sample),
df AS (SELECT word, count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic = 0) AS c FROM (SELECT DISTINCT r, toxic, word FROM (SELECT r, toxic, unnest(words) AS word FROM sample)) WHERE regexp_full_match(word, '[^0-9]{{4,}}') GROUP BY word),
much AS (SELECT word, t, c, t * nc >= 12 * (c + 1) * nt AS often, nt FROM df, size),
learned AS (SELECT word FROM much WHERE t >= 4 AND t * 1000 >= 6 * nt AND often AND word NOT IN (SELECT term FROM given)),
lex AS (SELECT * FROM given UNION ALL SELECT {len(LEXICON)} - 1 + row_number() OVER (ORDER BY word), word, {LEARNED_WEIGHT}, CASE WHEN regexp_full_match(word, '[a-z]{{6,}}') THEN 1 ELSE 0 END FROM learned),
v AS (SELECT word, min(struct_pack(e := e, k := k)) AS best FROM (
    SELECT word, levenshtein(word, term) AS e, i AS k FROM (SELECT DISTINCT word FROM t WHERE regexp_full_match(word, '[a-z]+')) JOIN lex ON regexp_full_match(term, '[a-z]+') AND abs(length(word) - length(term)) <= lim AND levenshtein(word, term) <= lim
    UNION ALL SELECT word, 0, i FROM (SELECT DISTINCT word FROM t) JOIN lex ON word = term) GROUP BY word
  HAVING min(e) = 0 OR NOT list_contains({_values(ORDINARY)}, word) AND word NOT IN (SELECT word FROM much WHERE c >= 2 AND NOT often) AND (min(struct_pack(e := e, k := k)).k < {len(LEXICON)} OR word NOT IN (SELECT word FROM much WHERE c >= 1 AND NOT often))),
base AS (SELECT count(*) FILTER (word IN (SELECT word FROM v WHERE best.k >= {len(LEXICON)})) AS hits, greatest(count(*), 1) AS total FROM (SELECT unnest(words) AS word FROM sample WHERE toxic = 0)),
h AS (SELECT r, doc_id, t.i AS i, best.e AS e, best.k AS k, sev FROM t JOIN v USING (word) JOIN lex ON lex.i = best.k),
c AS (SELECT h.*, len(words) AS n_words, (contains(array_to_string(pieces[greatest(h.i - 7, 1):h.i], ''), '"') AND contains(array_to_string(pieces[h.i + 1:h.i + 8], ''), '"'))
    OR list_has_any(words[greatest(h.i - 8, 1):h.i - 1], {_values(REPORTING)}) AS quoted,
  list_has_any(words[greatest(h.i - 8, 1):h.i + 8], {_values(ADDRESSED)}) AS addressed FROM h JOIN w USING (r)),
p AS (SELECT r, doc_id, count(*) AS n_hits, count(*) FILTER (e > 0) AS n_misspelled, coalesce(sum({_POINTS}) FILTER (k < {len(LEXICON)}), 0)::BIGINT AS of_given, coalesce(sum({_POINTS}) FILTER (k >= {len(LEXICON)}), 0)::BIGINT AS of_learned, any_value(n_words) AS n_words FROM c GROUP BY r, doc_id),
x AS (SELECT doc_id, n_hits, n_misspelled, of_given + greatest(of_learned - {USUAL * LEARNED_WEIGHT * 100} * hits * n_words // total, 0) AS points FROM p, base)
SELECT doc_id, n_hits, n_misspelled, points::BIGINT / 1000.0::DOUBLE AS score FROM x WHERE points >= 1000
"""

"""URL filtering by host word segmentation and naive Bayes.

The labels of a host but for the last one are cut at hyphens and digits into names.
A unigram Viterbi search splits every name into words: a word's probability is the
mean of its share in a built-in list of ordinary words (by rank) and its share in
the words of all pages; a stretch of n letters that is no known word costs
10 / 10**n of a single occurrence. Of equally likely splits the one with fewer
words wins, then the one whose last word is longer.

A multinomial naive Bayes model, with add-one smoothing and fitted on labelled
URLs (a table of them, or invented ones from lists of words by topic), scores the words of the host and of the path; numbers are one
token and words that the model has never seen say nothing. A page is blocked when
the log odds are above `threshold`; in doubt it stays.

Substrings of distinct names are joined with the word counts, so that no
vocabulary is broadcast. Defined results: a null, empty or hostless URL has no host
words (host null) and is scored by its path alone; null pages count no words; every
row, repeated or not, has a result; null ids are passed on.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, hinted, ship
from . import _text as T

LONGEST = 20
#: Ordinary words of host names by falling frequency.
WORDS = """the of and to in for is on that by this with you it not or be are from at as your all have new more an was we will home can us about if page my has search free but our one other
do no information time they site he up may what which their news out use any there see only so his when contact here business who web also now help get view online first am been would how were services
some these click its like service than find price date back top people had list name just over state year day into email two health world next used go work last most products music buy data make them should
product system post her city add policy number such please available copyright support message after best software then good video well where info rights public books high school through each links she review
years order very privacy book items company read group need many user said de does set under general research university mail full map reviews program life know games way days management part could great united
hotel real item international center store travel comments made development report off member details line terms before hotels did send right type because local those using results office education national car
design take posted internet address community within states area want phone shipping reserved subject between forum family long based code show even black check special prices website index being women much sign
file link open today technology south case project same pages version section own found sports house related security both county american photo game members power while care network down computer systems three
total place end following download him without per access think north resources current posts big media law control water history pictures size art personal since including guide shop directory board location
change white text small rating rate government children during return students shopping account times sites level digital profile previous form events love old john main call hours image department title""".split()
#: Words of hosts and paths that a filter blocks, by topic.
TOPICS = {
    "gambling": "casino bet bets betting bettor poker slots slot jackpot roulette bingo blackjack baccarat craps keno lottery lotto wager gamble gambler gambling odds bookie bookmaker sportsbook spins spin dice payout win",
    "adult": "adult porn porno sex sexy sexual xxx cam cams webcam nude nudes naked escort escorts erotic erotica fetish hentai milf hookup hookups strip stripper babes girls lonely horny swinger swingers lingerie brothel",
    "drugs": "pills pill viagra cialis levitra tramadol xanax valium oxycodone steroid steroids hormone weed kush cannabis opiate meds pharmacy prescription generic",
    "loans": "payday loan loans lender lenders lending cash advance debt credit bailout cashloan quick instant",
    "piracy": "warez crack cracks cracked keygen keygens serials torrent torrents nulled pirate pirated leak leaks cheats hack hacks hacked hacker exploit",
    "malware": "malware trojan spyware phishing phish botnet ransomware virus infected login verify wallet giveaway airdrop doubler",
    "spam": "spam spammer farm links linkfarm backlink backlinks ads ad adserver advert adverts track tracker trackers tracking pixel popup popunder click clicks clickbait bait traffic redirect",
    "fakes": "replica replicas fake fakes knockoff counterfeit imitation watches handbags rolex diploma",
}
#: Words that stand beside any others, and ordinary ones beside those of WORDS.
FILLERS = "best top online free live hot new cheap buy shop store club world my the get go web site net zone hub now deal deals".split()
PLAIN = """river garden science kitchen weather museum library journal daily bread market press cloud code learn photo music school history sport sports travel health family church valley mountain lake forest city town village county
street bridge harbor island coast farmers bakery coffee tea wine recipe cooking cook book books reader poetry theater cinema film art gallery paint design build house home room office paper print letter mail post news times herald
tribune gazette report review research institute academy college university teacher student class course lesson math physics chemistry biology medicine doctor nurse clinic hospital dental care animal dog cat horse bird fish
plant flower tree wood stone metal steel engine car auto bike train plane flight hotel tour guide map atlas ocean sea beach sun moon star sky space data open source software computer network phone radio video game chess
football tennis run walk dance song guitar piano band choir law legal bank finance tax insurance energy water solar wind green blue red north south east west national public community council foundation society union""".split()
#: Paths of no meaning, which either kind of host has.
NEUTRAL = ("", "/", "/index.html", "/page/2", "/a/1?id=3", "/en/4", "/fr/5", "/de/6", "/es/7", "/it/8", "/archive/2019/05#top")


def built_in() -> tuple[list[str], list[str]]:
    """Invented hosts and paths, those that a filter blocks and others."""
    blocked, ordinary = [], []
    for words in (x.split() for x in TOPICS.values()):
        for i, w in enumerate(words):
            near = words[(i + 1) % len(words)]
            blocked += [f"{w}-{near}.com/{words[(i + 5) % len(words)]}", f"{w}-{FILLERS[i % len(FILLERS)]}.net", f"{FILLERS[(7 * i + 3) % len(FILLERS)]}-{w}.org"]
    for i, w in enumerate(PLAIN):
        ordinary += [f"{w}-{PLAIN[(i + 7) % len(PLAIN)]}.org/{PLAIN[(i + 31) % len(PLAIN)]}", f"{w}-{FILLERS[i % len(FILLERS)]}.com", f"{FILLERS[(5 * i + 1) % len(FILLERS)]}-{w}.net"]
    paths = lambda urls: [u if "/" in u else u + NEUTRAL[i % len(NEUTRAL)] for i, u in enumerate(urls)]
    return paths(blocked), paths(ordinary)


def split_url(url: str | None) -> tuple[str | None, str]:
    """Host and the rest, lower-cased."""
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(.*)", (url or "").lower(), re.S)
    if not m:
        return None, (url or "").lower()
    return m[1] or None, m[2]


def names_of(host: str | None) -> list[str]:
    """The names of a host: letters only, without the last label and a leading www."""
    labels = (host or "").split(".")
    kept = labels[:-1] if len(labels) > 1 else labels
    if kept and kept[0] == "www":
        kept = kept[1:]
    return [x for label in kept for x in re.findall(r"[a-z]+", label)]


def path_tokens(rest: str) -> list[str]:
    return ["#" if x.isdigit() else x for x in re.findall(r"[a-z]+|[0-9]+", rest)]


def prior() -> dict[str, float]:
    """Shares of the built-in words."""
    words = list(dict.fromkeys([*WORDS, *PLAIN, *FILLERS, *(w for x in TOPICS.values() for w in x.split())]))
    raw = [1 / (i + 10) for i in range(len(words))]
    whole = sum(raw)
    return {w: x / whole for w, x in zip(words, raw)}


def segment(name: str, share: dict[str, float], once: float) -> list[str]:
    """The likeliest split; share has the probabilities of the known words, once that of a single occurrence."""
    n = len(name)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, n + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            p = share.get(name[start:end])
            cost = -math.log(p) if p else -math.log(once * 10) + (end - start) * math.log(10)
            before = best[start]
            options.append((round(before[0] + cost, 9), before[1] + 1, start))
        best.append(min(options))
    out, end = [], n
    while end:
        start = best[end][2]
        out.append(name[start:end])
        end = start
    return out[::-1]


def bayes(blocked: list[list[str]], ordinary: list[list[str]]) -> tuple[float, dict[str, float]]:
    """Prior log odds and each token's log ratio."""
    bad, good = Counter(t for x in blocked for t in x), Counter(t for x in ordinary for t in x)
    known = bad.keys() | good.keys()
    n_bad, n_good = sum(bad.values()) + len(known), sum(good.values()) + len(known)
    return math.log((len(blocked) + 1) / (len(ordinary) + 1)), {t: math.log((bad[t] + 1) / n_bad) - math.log((good[t] + 1) / n_good) for t in sorted(known)}


def model(blocked: list[str] | None = None, ordinary: list[str] | None = None) -> tuple[float, dict[str, float]]:
    """Naive Bayes fitted on labelled hosts and paths, by default the built-in ones, whose names are split by the built-in words. The prior odds are even."""
    share = prior()

    def tokens(url: str) -> list[str]:
        host, rest = split_url(url if "//" in url else "//" + url)
        return [w for name in names_of(host) for w in segment(name, share, 1e-9)] + path_tokens(rest)

    given = built_in() if blocked is None or ordinary is None else (blocked, ordinary)
    _, ratio = bayes(*([tokens(u) for u in urls] for urls in given))
    return 0.0, ratio


def examples(labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked", train_urls: int = 20_000) -> tuple[list[str], list[str]]:
    """Blocked and other URLs of a labelled table, of each those of smallest MD5, up to train_urls; nulls teach nothing."""
    rows = labelled.select(F.col(url_col).alias("url"), F.col(blocked_col).cast("boolean").alias("bad")).where("url is not null and bad is not null").distinct()
    return tuple([r["url"] for r in rows.where("bad" if bad else "not bad").orderBy(F.md5(F.col("url").cast("binary")), "url").limit(train_urls).collect()] for bad in (True, False))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of 2 to LONGEST letters with their counts, combined by slice."""
    letter = np.zeros(256, bool)
    letter[97:123] = True
    for b in batches:
        for s in T.slices(b.column(0), 4 << 20):
            w = T.words(s)
            size = w.end - w.start
            odd = np.append(0, np.cumsum(~letter[s.buf]))
            ok = np.flatnonzero((size >= 2) & (size <= LONGEST) & (odd[w.end] == odd[w.start]))
            _, first, n = np.unique(w.h[ok], return_index=True, return_counts=True)
            raw = s.buf.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[w.start[i] : w.end[i]].decode() for i in ok[first]], pa.string()), pa.array(n.astype(np.int64))], ["word", "n"])


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) over the whole text of all pages."""
    text = pages.select(F.lower(F.col(html_col)).alias("t")).where("t is not null and t <> ''")
    return text.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [split_url(u) for u in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in got], pa.string()), pa.array([r for _, r in got], pa.string())], ["page_id", "host", "rest"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def some(names: list[str], words: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.string())], ["name", "word"])

    for b in batches:
        names, words, held = [], [], 0
        for name in b.column(0).to_pylist():
            spans = list(dict.fromkeys(name[i:j] for i in range(len(name)) for j in range(i + 2, min(len(name), i + LONGEST) + 1))) or [name]
            names += [name] * len(spans)
            words += spans
            held += len(spans) * (len(name) + LONGEST)
            if held > 4 << 20:
                yield some(names, words)
                names, words, held = [], [], 0
        yield some(names, words)


def _split(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = prior()
        for b in batches:
            names = b.column(0).to_pylist()
            out = []
            for name, edges in zip(names, b.column(1).to_pylist()):
                share = {x["word"]: x["n"] / (2 * total) for x in edges}
                for i in range(len(name)):
                    for j in range(i + 1, min(len(name), i + LONGEST) + 1):
                        if (p := given.get(name[i:j])) is not None:
                            share[name[i:j]] = p / 2 + (share.get(name[i:j], 0.0))
                out.append(segment(name, share, 1 / (2 * max(total, 1_000_000))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return run


def segmented(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(name, words) of distinct names."""
    pieces = names.mapInArrow(_pieces, "name string, word string")
    known = pieces.join(counts, "word", "left").groupBy("name").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("edges"))
    return known.mapInArrow(_split(max(total, 1)), "name string, words array<string>")


def filtered(pages: DataFrame, threshold: float = 1.0, labelled: tuple[list[str], list[str]] | DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, host_words, log_odds, blocked) of every row."""
    spark = pages.sparkSession
    ship(spark)
    counts = cut(word_counts(pages, html_col))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(_hosts, "page_id long, host string, rest string")
    hosts = cut(rows.select("host").where("host is not null").distinct())
    named = hosts.mapInArrow(_host_names, "host string, nth int, name string")
    words = segmented(named.select("name").distinct(), counts, total)
    by_host = cut(named.join(words, "name").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "words"))), lambda x: x["words"])).alias("words")))
    shared = spark.sparkContext.broadcast(model(*(examples(labelled) if isinstance(labelled, DataFrame) else labelled or (None, None))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ratio = shared.value
        for b in batches:
            words = [x or [] for x in b.column(3).to_pylist()]
            odds = [round(base + sum(ratio.get(t, 0.0) for t in (*w, *path_tokens(rest or ""))), 9) for w, rest in zip(words, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(w) for w in words], pa.string()), pa.array(odds, pa.float64()), pa.array([x > threshold for x in odds], pa.bool_())], ["page_id", "host", "host_words", "log_odds", "blocked"])

    both = rows.join(hinted(by_host), "host", "left").select("page_id", "host", "rest", "words")
    return both.mapInArrow(score, "page_id long, host string, host_words string, log_odds double, blocked boolean")


def _host_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(h, i, x) for h in b.column(0).to_pylist() for i, x in enumerate(names_of(h))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string()))], ["host", "nth", "name"])

"""Personal data by a character-level bidirectional LSTM with CRF transitions, all in numpy.

The tagger reads the bytes of a text in windows of `WINDOW`, each beginning `STRIDE`
after the last, tags them B/I by kind or O, and is trained from labelled spans (those
that are given, by default those that `examples` makes: invented prose in which invented
addresses, numbers and tokens, with and without digits, stand beside harmless ones).
Every window of every text goes through the network, and is decoded by Viterbi but where
the emissions alone prove that the best path is O throughout (`quiet`).
Then a text's spans are reconciled as a whole: overlapping ones of a kind are one,
with the borders that a window saw entirely if any did, and of overlapping ones of
different kinds the set with the greatest total score stays.

Defined results: null, empty and harmless texts have no spans and stay as they are;
every row, repeated or not, is tagged by itself; null ids are passed on; other columns
are passed on, and n_chars is set anew where a text has changed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "SECRET")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WINDOW, STRIDE, TRAIN_WINDOW, PAD = 512, 448, 128, 64
_PUNCTUATION = " .@-+():/_=\"',#|!?;$%&*\n<>[]{}~"
SLICE = 4 << 20
SYMBOLS = np.full(256, 1, np.uint8)  # 0: beyond the text, 1: any other byte
SYMBOLS[0x80:] = 2
SYMBOLS[48:58] = 3
SYMBOLS[65:91] = 4
SYMBOLS[97:123] = np.arange(5, 31)
for _i, _c in enumerate(_PUNCTUATION):
    SYMBOLS[ord(_c)] = 31 + _i
N_SYMBOLS = 31 + len(_PUNCTUATION)


@dataclass
class Net:
    """Weights; the first axis of wx, wh and b is the direction."""

    emb: np.ndarray
    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    trans: np.ndarray
    begin: np.ndarray


def new_net(seed: int, dim: int, hidden: int, dtype: type = np.float32) -> Net:
    r = np.random.default_rng(seed)
    b = np.zeros((2, 1, 4 * hidden))
    b[:, :, hidden : 2 * hidden] = 1
    raw = (r.normal(0, 0.3, (N_SYMBOLS, dim)), r.normal(0, dim**-0.5, (2, dim, 4 * hidden)), r.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)), b, r.normal(0, 0.2, (2 * hidden, TAGS)), np.zeros(TAGS), r.normal(0, 0.1, (TAGS, TAGS)), np.zeros(TAGS))
    return Net(*(x.astype(dtype) for x in raw))


def soft(x: np.ndarray) -> np.ndarray:
    """The activation, x / (1 + |x|) in place of tanh, which costs ten times as much in numpy; (1 + soft) / 2 takes the place of the sigmoid."""
    return x / (1 + np.abs(x))


def _forward(net: Net, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Emissions [window, place, tag], and what the gradient needs."""
    n, length = ids.shape
    hidden = net.wh.shape[1]
    x = net.emb[ids].transpose(1, 0, 2)
    both = np.stack([x, x[::-1]], 1)  # place, direction, window, dim
    pre = np.matmul(both, net.wx) + net.b
    h, c = np.zeros((2, n, hidden), net.emb.dtype), np.zeros((2, n, hidden), net.emb.dtype)
    hs, cs, gates = np.empty((length, 2, n, hidden), h.dtype), np.empty((length, 2, n, hidden), h.dtype), np.empty((length, 2, n, 4 * hidden), h.dtype)
    for t in range(length):
        y = soft(pre[t] + np.matmul(h, net.wh))
        i, f, o = (0.5 + 0.5 * y[..., k * hidden : (k + 1) * hidden] for k in range(3))
        c = f * c + i * y[..., 3 * hidden :]
        h = o * soft(c)
        hs[t], cs[t], gates[t] = h, c, y
    out = np.concatenate([hs[:, 0], hs[::-1, 1]], 2)
    return (out @ net.wo + net.bo).transpose(1, 0, 2), (both, hs, cs, gates, out)


def emissions(net: Net, ids: np.ndarray) -> np.ndarray:
    """Emissions [place, tag, window] only: the input's share of the gates is looked up by symbol, and no state is kept.

    c and the three gates are held twice as large and h's weights half, which spares passes over the
    gates; factors of two round nothing.
    """
    n, length = ids.shape
    hidden = net.wh.shape[1]
    kind = net.emb.dtype
    out = np.empty((length, net.wo.shape[1], n), kind)
    places = np.ascontiguousarray(ids.T).astype(np.intp)
    z, size = np.empty((4, n, hidden), kind), np.empty((4, n, hidden), kind)
    h, c, own = np.empty((n, hidden), kind), np.empty((n, hidden), kind), np.empty((net.wo.shape[1], n), kind)
    i, f, o, g = z
    for d in (0, 1):
        table = np.ascontiguousarray((net.emb @ net.wx[d] + net.b[d]).reshape(-1, 4, hidden).transpose(1, 0, 2))
        wh = np.ascontiguousarray(0.5 * net.wh[d].reshape(hidden, 4, hidden).transpose(1, 0, 2))
        wo = np.ascontiguousarray(0.5 * net.wo[d * hidden : (d + 1) * hidden].T)
        h[...] = c[...] = 0
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            table.take(places[t], axis=1, out=z, mode="clip")
            np.matmul(h, wh, out=size)
            np.add(z, size, out=z)
            np.abs(z, out=size)
            np.add(size, 1, out=size)
            np.divide(z, size, out=z)
            np.add(z[:3], 1, out=z[:3])
            np.multiply(c, f, out=c)
            np.multiply(i, g, out=i)
            np.add(c, i, out=c)
            np.abs(c, out=h)
            np.add(h, 2, out=h)
            np.divide(c, h, out=h)
            np.multiply(h, o, out=h)
            np.multiply(c, 0.5, out=c)
            if d == 0:
                np.matmul(wo, h.T, out=out[t])
            else:
                np.matmul(wo, h.T, out=own)
                np.add(out[t], own, out=out[t])
    out += net.bo[:, None]
    return out


def quiet(net: Net, e: np.ndarray) -> np.ndarray:
    """Windows of emissions [place, tag, window] whose best path is surely O throughout.

    Against O throughout, a stretch of other tags gains at most its best emissions over O's,
    the best transition inwards, between, and (but at the window's end) outwards, each over
    that of O to O. If no stretch can gain, every other path loses.
    """
    base = net.trans[0, 0]
    enter = max(net.trans[0, 1:].max() - base, net.begin[1:].max() - net.begin[0])
    leave, inner = net.trans[1:, 0].max() - base, net.trans[1:, 1:].max() - base
    over = e[:, 1:].max(1) - e[:, 0] + inner
    best = run = over[0]
    for t in range(1, len(over)):
        run = np.maximum(run, 0) + over[t]
        best = np.maximum(best, run)
    return (best + enter + leave - inner < -1e-3) & (run + enter - inner < -1e-3)


def loss_and_gradient(net: Net, ids: np.ndarray, tags: np.ndarray) -> tuple[float, Net]:
    """Mean negative log-likelihood of the tags of some windows, and its gradient."""
    n, length = ids.shape
    hidden = net.wh.shape[1]
    e, (both, hs, cs, gates, out) = _forward(net, ids)
    w, p = np.arange(n)[:, None], np.arange(length)[None, :]
    top, move = e.max(2), np.exp(net.trans)
    near = np.exp(e - top[..., None])
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty_like(top)  # forward and backward, scaled at each place
    for t in range(length):
        now = (np.exp(net.begin - net.begin.max()) if t == 0 else alpha[:, t - 1] @ move) * near[:, t]
        scale[:, t] = now.sum(1)
        alpha[:, t] = now / scale[:, t, None]
    for t in range(length - 2, -1, -1):
        beta[:, t] = (near[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]) @ move.T
    whole = np.log(scale).sum(1) + top.sum(1) + net.begin.max()
    gold = net.begin[tags[:, 0]] + e[w, p, tags].sum(1) + net.trans[tags[:, :-1], tags[:, 1:]].sum(1)
    loss = float((whole - gold).mean())
    de = alpha * beta
    pair = move * (alpha[:, :-1].reshape(-1, TAGS).T @ (near * beta / scale[..., None])[:, 1:].reshape(-1, TAGS))
    np.subtract.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    de[w, p, tags] -= 1
    de /= n
    d_begin = de[:, 0].sum(0)
    de_t = de.transpose(1, 0, 2)
    d_wo, d_bo = out.reshape(-1, 2 * hidden).T @ de_t.reshape(-1, TAGS), de_t.sum((0, 1))
    d_out = de_t @ net.wo.T
    dh_all = np.stack([d_out[..., :hidden], d_out[::-1, :, hidden:]], 1)
    d_pre = np.empty_like(gates)
    dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
    for t in range(length - 1, -1, -1):
        y = gates[t]
        i, f, o = (0.5 + 0.5 * y[..., k * hidden : (k + 1) * hidden] for k in range(3))
        dh = dh + dh_all[t]
        th = soft(cs[t])
        dc = dc + dh * o * (1 - np.abs(th)) ** 2
        before = cs[t - 1] if t else np.zeros_like(dc)
        d_pre[t] = np.concatenate([0.5 * dc * y[..., 3 * hidden :], 0.5 * dc * before, 0.5 * dh * th, dc * i], 2) * (1 - np.abs(y)) ** 2
        dh = np.matmul(d_pre[t], net.wh.transpose(0, 2, 1))
        dc = dc * f
    d_wx = np.stack([both[:, d].reshape(-1, both.shape[3]).T @ d_pre[:, d].reshape(-1, 4 * hidden) for d in (0, 1)])
    d_wh = np.stack([hs[:-1, d].reshape(-1, hidden).T @ d_pre[1:, d].reshape(-1, 4 * hidden) for d in (0, 1)])
    dx = np.matmul(d_pre, net.wx.transpose(0, 2, 1))
    d_emb = np.zeros_like(net.emb)
    np.add.at(d_emb, ids.T, dx[:, 0] + dx[::-1, 1])
    return loss, Net(d_emb, d_wx, d_wh, d_pre.sum((0, 2))[:, None, :], d_wo, d_bo, pair / n, d_begin)


def viterbi(net: Net, e: np.ndarray) -> np.ndarray:
    """The best tags [window, place]; only the way back looks at which tag came before."""
    n, length, _ = e.shape
    e = np.ascontiguousarray(e.transpose(1, 2, 0))
    best, options = np.empty_like(e), np.empty((TAGS, TAGS, n), e.dtype)
    best[0] = net.begin[:, None] + e[0]
    for t in range(1, length):
        np.add(best[t - 1][:, None], net.trans[..., None], out=options)
        np.add(options.max(0), e[t], out=best[t])
    out = np.empty((n, length), np.int8)
    out[:, -1] = best[-1].argmax(0)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = (best[t - 1] + net.trans[:, out[:, t]]).argmax(0)
    return out


_ONSET = ("b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "y", "z", "bl", "br", "ch", "cl", "dr", "fl", "gr", "pl", "pr", "qu", "sch", "sh", "sl", "sp", "st", "str", "th", "tr", "wh", "")
_VOWEL = ("a", "e", "i", "o", "u", "a", "e", "i", "o", "u", "ai", "au", "ea", "ee", "ei", "ie", "io", "ou", "é", "è", "ê", "ç", "á", "í", "ó", "ú", "ä", "ö", "ü", "å", "ø")
_CODA = ("", "", "", "", "b", "ck", "d", "ft", "g", "l", "ll", "m", "n", "nd", "ng", "nt", "p", "r", "rt", "s", "ss", "st", "t", "x", "ß", "ñ")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def examples(n: int, seed: int) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """Invented texts with labelled spans (begin, end, kind), in bytes."""
    r = np.random.default_rng(seed)

    def pick(options: str | tuple) -> str:
        return options[r.integers(len(options))]

    def some(chars: str, low: int, high: int) -> str:
        return "".join(chars[i] for i in r.integers(0, len(chars), r.integers(low, high + 1)))

    def digits(k: int) -> str:
        return some(_DIGITS, k, k)

    def word() -> str:
        w = "".join(pick(_ONSET) + pick(_VOWEL) + pick(_CODA) for _ in range(pick((1, 1, 2, 2, 2, 3, 3, 4, 6))))
        x = r.random()
        return w.capitalize() if x < 0.14 else w.upper() if x < 0.18 else w

    def plain() -> str:
        return "".join(c for c in word().lower() if ord(c) < 128) or some(_LOWER, 2, 6)

    def email() -> str:
        name = pick((plain(), plain() + pick("._-+") + plain(), plain() + pick((".", "", "_", "-")) + digits(r.integers(1, 5)), some(_LOWER, 1, 9), plain().capitalize() + "." + plain().capitalize(), some(_LOWER + _DIGITS + "._", 4, 14).strip("._") or "a"))
        host = ".".join(pick((plain(), plain() + digits(r.integers(1, 3)), plain() + "-" + plain())) for _ in range(pick((1, 1, 1, 2, 2, 3))))
        return name + "@" + host + "." + pick(("com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "it", "nl", "co.uk", "com.br", "io", "dev", "ac.jp"))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        land = some(_DIGITS, 1, 3)
        return pick((f"+{land} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{land} {a} {b} {digits(3)}", f"+{land}-{a}-{b}-{c}", f"+{land} {a} {b} {c}", f"{a}.{b}.{c}", f"0{digits(2)} {c} {digits(4)}", f"+{land} {digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(1)}", f"+{land}{digits(10)}", f"0{digits(4)}/{digits(6)}"))

    def ip() -> str:
        return ".".join(str(r.integers(0, 256)) for _ in range(4))

    def card() -> str:
        d = pick("3456") + digits(15)
        return pick((d, d, " ".join(d[i : i + 4] for i in (0, 4, 8, 12)), "-".join(d[i : i + 4] for i in (0, 4, 8, 12)), d[:15], f"{d[:4]} {d[4:10]} {d[10:15]}"))

    def ssn() -> str:
        return f"{digits(3)}-{digits(2)}-{digits(4)}"

    def secret() -> tuple[str, str, str]:
        own = r.random() < 0.3
        hexes = _DIGITS + pick(("abcdef", "abcdef", "ABCDEF"))
        value = pick((some(hexes, 16, 64), some(hexes, 16, 40), some(_LOWER + _UPPER + _DIGITS, 16, 48), some(_LOWER + _UPPER + _DIGITS, 16, 48), some(_LOWER + _UPPER, 20, 40), pick(("AKIA", "ASIA")) + some(_UPPER + "234567", 16, 16), pick(("sk-", "ghp_", "pk_live_", "xoxb-")) + some(_LOWER + _UPPER + _DIGITS, 20, 40), some(_LOWER + _UPPER + _DIGITS + "+/", 24, 44) + pick(("", "=", "=="))))
        if own:
            q = pick(('"', "'", "", ""))
            return q, value, q
        if r.random() < 0.4:
            value = pick((some(_LOWER, 8, 20), some(_LOWER + _UPPER, 8, 24), some(_LOWER + _DIGITS, 8, 16), plain() + plain() + plain() + "xyz", some(_LOWER + _UPPER + _DIGITS + "!#%_-", 9, 18)))
        q = pick(('"', '"', "'", "", ""))
        name = pick(("token", "api_key", "secret", "key", "password", "passwd", "pwd", "access_token", "apikey", "auth", "client_secret", "private_key", "API_KEY", "SECRET", "Password", "Token"))
        return name + pick((" = ", "=", ": ", ":", " := ")) + q, value, q

    def harmless() -> str:
        w = plain()
        return pick((str(r.integers(0, 100_000)), digits(r.integers(1, 8)), f"{r.integers(1900, 2100)}", f"{r.integers(1, 999)}.{digits(2)}", f"{r.integers(1, 13)}/{r.integers(1, 29)}/{r.integers(1990, 2030)}", f"{r.integers(1990, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}", f"{r.integers(0, 24)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}%", f"${digits(3)},{digits(3)}", "@" + w, "@ " + w, f"({r.integers(1900, 2100)})", w + digits(2), f"{digits(2)}-{digits(2)}", f"No. {digits(4)}", digits(3) + " " + digits(3), f"p. {digits(3)}", f"{w} {digits(1)}.{digits(1)}.", f"{w.upper()}-{digits(1)}.{digits(1)}", f"https://www.{w}.com/{plain()}/{digits(3)}", f"{w}.org", f"/{w}/{plain()}.txt", f"{w}_{plain()}", f"{w}{plain().capitalize()}{plain().capitalize()}", w.upper() + plain().upper(), "#" + some(_DIGITS + "abcdef", 6, 6), f"the {pick(('password', 'token', 'key', 'secret'))} of {w}", f"a {pick(('secret', 'key', 'token'))} {w}", f"{w}: {plain()}", f"{w} = {digits(2)}", f'"{w} {plain()}"', f"{w}({digits(1)})", f"<{w}>", f"{w}-{plain()}-{plain()}", f"1,{digits(3)},{digits(3)}", pick(("*", "-", "=", "%", "#", "~", ".")) * int(r.integers(3, 12)), f"{digits(3)} x {digits(4)}", f"ISBN {digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", w + plain() + plain() + plain(), pick(_LOWER + _UPPER) * int(r.integers(3, 70)), some(_LOWER, 2, 3) * int(r.integers(2, 20))))

    out = []
    for _ in range(n):
        text, spans = b"", []
        gap = " " if r.random() < 0.92 else pick((" | ", ", ", "\t", "; ", "\n"))
        noise = 0.97 if r.random() < 0.9 else 0.4
        for _ in range(r.integers(6, 30)):
            x = r.random()
            if x < 0.11:
                kind = int(r.choice(len(KINDS), p=(0.17, 0.15, 0.12, 0.13, 0.11, 0.32)))
                lead, value, tail = secret() if kind == 5 else ("", (email, phone, ip, card, ssn)[kind](), "")
                raw = value.encode()
                text += lead.encode()
                spans.append((len(text), len(text) + len(raw), kind))
                text += raw + tail.encode()
                text += pick(("", "", "", "", ".", ",", ")", ";")).encode()
            elif x < 0.22:
                text += harmless().encode()
            else:
                text += word().encode() + (pick(("", "", "", "", "", "", "", ".", ",", "!", ":", "?", ".", '"', ")")) if r.random() < noise else some("*%$#&~^=+|<>!?-_", 1, 4)).encode()
            text += pick((gap,) * 12 + ("\n",)).encode()
        out.append((text, spans))
    return out


def windows_of(data: list[tuple[bytes, list[tuple[int, int, int]]]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of a window at a random place of each text."""
    size = TRAIN_WINDOW
    ids, tags = np.zeros((len(data), size), np.uint8), np.zeros((len(data), size), np.int8)
    for k, (text, spans) in enumerate(data):
        at = int(rng.integers(0, max(1, len(text) - size // 2)))
        piece = np.frombuffer(text[at : at + size], np.uint8)
        ids[k, : len(piece)] = SYMBOLS[piece]
        for a, b, kind in spans:
            lo, hi = max(a - at, 0), min(b - at, size)
            if lo < hi:
                tags[k, lo:hi] = 2 + 2 * kind
                if a >= at:
                    tags[k, lo] = 1 + 2 * kind
    return ids, tags


def train(data: list[tuple[bytes, list[tuple[int, int, int]]]], steps: int = 800, batch: int = 64, rate: float = 0.015, seed: int = 3, dim: int = 12, hidden: int = 20) -> Net:
    """Adam, with a rate that falls to a tenth, over random windows of the labelled texts."""
    rng = np.random.default_rng(seed)
    net = new_net(seed, dim, hidden)
    names = [f.name for f in fields(Net)]
    m, v = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    for t in range(1, steps + 1):
        ids, tags = windows_of([data[i] for i in rng.integers(0, len(data), batch)], rng)
        _, grad = loss_and_gradient(net, ids, tags)
        norm = np.sqrt(sum(float((getattr(grad, k) ** 2).sum()) for k in names))
        now = rate * (1 - 0.9 * t / steps)
        for k in names:
            g = getattr(grad, k) * min(1.0, 5.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            getattr(net, k)[...] -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


_trained: dict[tuple[int, int], Net] = {}


def default_net(size: int = 10_000, steps: int = 800) -> Net:
    """The tagger fitted on the built-in examples, once per process."""
    key = (size, steps)
    if key not in _trained:
        _trained[key] = train(examples(size, 11), steps)
    return _trained[key]


def reconciled(found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """Spans (begin, end, kind) without overlap from those of all windows of a text (begin, end, kind, score, whole)."""
    joined: list[list] = []
    for kind in sorted({x[2] for x in found}):
        group: list[tuple[int, int, int, float, bool]] = []
        edge = -1
        for x in sorted(y for y in found if y[2] == kind):
            if group and x[0] >= edge:
                joined.append(_one(group))
                group = []
            group.append(x)
            edge = max(edge, x[1]) if len(group) > 1 else x[1]
        if group:
            joined.append(_one(group))
    joined.sort(key=lambda x: (x[1], x[0], x[2]))
    best: list[tuple[float, list]] = [(0.0, [])]
    ends = [x[1] for x in joined]
    for i, (a, b, kind, score) in enumerate(joined):
        before = bisect_right(ends, a, 0, i)
        with_it = (best[before][0] + score, (best[before][1], (a, b, kind)))
        best.append(max(best[i], with_it, key=lambda x: x[0]))
    out, at = [], best[-1][1]
    while at:
        at, x = at
        out.append(x)
    return out[::-1]


def _one(group: list[tuple[int, int, int, float, bool]]) -> tuple[int, int, int, float]:
    whole = [x for x in group if x[4]] or group
    return min(x[0] for x in whole), max(x[1] for x in whole), group[0][2], max(x[3] for x in group)


def find(net: Net, s: T.Slice, most: int = 1200) -> dict[int, list[tuple[int, int, int]]]:
    """Spans (begin, end, kind), in bytes, of the rows that have any."""
    size = np.diff(s.offs)
    count = np.where(size > 0, 1 + np.maximum(-(-(size - WINDOW) // STRIDE), 0), 0)
    of = np.repeat(np.arange(s.rows), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin = s.offs[of] + nth * STRIDE
    stop = np.minimum(begin + WINDOW, s.offs[of + 1])
    padded_to = -(-(stop - begin) // PAD) * PAD  # what a window sees depends on itself alone
    order = np.argsort(padded_to, kind="stable")
    of, begin, stop, padded_to = of[order], begin[order], stop[order], padded_to[order]
    border = np.unique(np.concatenate([np.arange(0, len(of), most), np.searchsorted(padded_to, np.arange(0, WINDOW + 1, PAD), "right"), [len(of)]]))
    found: dict[int, list[tuple[int, int, int, float, bool]]] = {}
    symbols = np.zeros(len(s.buf) + WINDOW, np.uint8)
    np.take(SYMBOLS, s.buf, out=symbols[: len(s.buf)])
    for k, z in zip(border[:-1], border[1:]):
        lo, hi, row, length = begin[k:z], stop[k:z], of[k:z], int(padded_to[k])
        at = lo[:, None] + np.arange(length)
        ids = np.lib.stride_tricks.sliding_window_view(symbols, length)[lo]
        ids[at >= hi[:, None]] = 0
        e = emissions(net, ids)
        loud = np.flatnonzero(~quiet(net, e))
        if not len(loud):
            continue
        lo, hi, row, at, e = lo[loud], hi[loud], row[loud], at[loud], np.ascontiguousarray(e[:, :, loud].transpose(2, 0, 1))
        tags = viterbi(net, e)
        tags[at >= hi[:, None]] = 0
        kind = np.where(tags > 0, (tags - 1) // 2, -1)
        padded = np.concatenate([np.full((len(lo), 1), -1), kind], 1)
        starts = (kind >= 0) & ((padded[:, :-1] != kind) | (tags % 2 == 1))
        for i, j in np.argwhere(starts):
            end = j + 1
            while end < length and kind[i, end] == kind[i, j] and not starts[i, end]:
                end += 1
            a, b, r = int(lo[i] + j), int(lo[i] + end), int(row[i])
            base = int(s.offs[r])
            score = float((e[i, np.arange(j, end), tags[i, j:end]] - e[i, j:end, 0]).sum())
            whole = (j > 0 or a == base) and (b < int(hi[i]) or b == int(s.offs[r + 1]))
            found.setdefault(r, []).append((a - base, b - base, int(kind[i, j]), score, bool(whole)))
    return {r: reconciled(x) for r, x in found.items()}


def _aligned(text: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """Borders moved outwards to borders of characters."""
    while a > 0 and text[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(text) and text[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def redact(text: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[str, list[dict]]:
    """The text with its spans replaced by their kinds, and the spans in characters of the old text."""
    out, marks, at = [], [], 0
    chars = np.append(0, np.cumsum(text & 0xC0 != 0x80))
    for a, b, kind in spans:
        a, b = _aligned(text, a, b)
        a = max(a, at)
        out += [text[at:a].tobytes(), f"[{KINDS[kind]}]".encode()]
        marks.append({"start": int(chars[a]), "end": int(chars[b]), "kind": KINDS[kind]})
        at = b
    out.append(text[at:].tobytes())
    return b"".join(out).decode("utf-8", "replace"), marks


SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def tagged(docs: DataFrame, net: Net | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) of every row with a span: the redacted text, and begin, end and kind of each in characters of the old one."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(default_net() if net is None else net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for s in T.slices(b.column(1), SLICE):
                got = sorted(find(model, s).items())
                if got:
                    done = [redact(s.buf[s.offs[r] : s.offs[r + 1]], spans) for r, spans in got]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([s.first + r for r, _ in got])), pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], SPAN_TYPE)], ["doc_id", "text", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.where("text is not null").mapInArrow(run, "doc_id long, text string, spans array<struct<start: long, end: long, kind: string>>")


def redacted(docs: DataFrame, net: Net | None = None, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with their texts redacted, and all other columns as they are."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(default_net() if net is None else net)
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col in docs.columns else -1
    size_type = pa.int64() if size_at < 0 or dict(docs.dtypes)[size_col] == "bigint" else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            new: dict[int, str] = {}
            for s in T.slices(b.column(at), SLICE):
                for r, spans in find(model, s).items():
                    new[s.first + r] = redact(s.buf[s.offs[r] : s.offs[r + 1]], spans)[0]
            if new:
                columns = list(b.columns)
                texts = columns[at].to_pylist()
                for r, text in new.items():
                    texts[r] = text
                columns[at] = pa.array(texts, columns[at].type)
                if size_at >= 0:
                    sizes = columns[size_at].to_pylist()
                    for r, text in new.items():
                        sizes[r] = len(text)
                    columns[size_at] = pa.array(sizes, size_type)
                b = pa.RecordBatch.from_arrays(columns, names=b.schema.names)
            yield b

    return docs.mapInArrow(run, docs.schema)

"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions trained in numpy.

Base findings are e-mail and IP addresses, card and phone numbers by pattern, with their checks. The network
learns from labelled spans in generated sentences, which hold the patterns' forms and others that no pattern has
(national phone numbers, addresses with "(at)"), beside dates, versions, prices and codes that are none. It reads
overlapping windows around every digit and at-sign: a span of its kinds without one is not accepted, so that
windows without one could add nothing. Each window is decoded by Viterbi; where windows overlap, a character takes
its tag from the window in which it lies deepest, and spans are then read off the whole text. A span of the network
is added where no pattern has matched. Where one has matched but its check failed, none is added either, except that
a run of 12 or more digits that is no card bars cards only: national phone numbers look like the runs of a card, or
are parts of longer ones.

Defined results: null texts count as empty; a text without findings has zero counts and empty spans. Whole texts
are read, whatever their length; the memory is that of one batch of windows and of some bytes a character of the
texts that it touches. Rows that repeat are read each, alike. detect() reads no other columns; mask() hands them on,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, strings

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, SURE = 64, 32, 0.9
HIDDEN, EMBED, STEPS, BATCH, SEED = 16, 8, 520, 48, 5

_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive: giving back characters never helps these to match
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile("[^0-9]")
_anchor = re.compile(r"[0-9@]|[\[(]\x20?at\x20?[\])]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


#: Kinds of the network's spans that a match bars.
ALL, CARDS = frozenset(range(len(KINDS))), frozenset([2])


def patterns(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, frozenset[int]]]]:
    """Base spans as (start, kind, end), and all matches, failed checks too, with the kinds that they bar."""
    found, tried = [], []
    if "@" in text:
        last = 0
        for m in _domain.finditer(text):
            s = m.start()
            while s > last and text[s - 1] in _local:
                s -= 1
            if s < m.start():
                found.append((s, 0, m.end()))
                tried.append((s, m.end(), ALL))
                last = m.end()
    for m in _ip.finditer(text):
        tried.append((*m.span(), ALL))
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _card.finditer(text):
        digits = _digit.sub("", m[0])
        card = 12 <= len(digits) <= 19 and luhn(digits)
        if len(digits) >= 12:
            tried.append((*m.span(), ALL if card else CARDS))
        if card:
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            tried.append((*m.span(), ALL))
            if 9 <= len(_digit.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found), tried


# ---- the network ----------------------------------------------------------------------------------------

#: Characters by class: 0 pads, then lower, upper, digit, other letters, other characters, and these alone.
_ALONE = "@.-_+()[] \n,:;/\"'=#%"
N_CLASSES = 6 + len(_ALONE)
TAGS = 1 + 2 * len(KINDS)


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 128, _ascii[np.minimum(codes, 127)], 4)


_ascii = np.full(128, 5)
_ascii[ord("a") : ord("z") + 1] = 1
_ascii[ord("A") : ord("Z") + 1] = 2
_ascii[ord("0") : ord("9") + 1] = 3
for _i, _c in enumerate(_ALONE):
    _ascii[ord(_c)] = 6 + _i


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Embedding, two LSTMs, a linear layer, and CRF transitions. Windows are rows of classes, 0 where they end."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        g = lambda *s: r.standard_normal(s) * (1 / np.sqrt(s[0]))
        self.p = {"emb": r.standard_normal((N_CLASSES, EMBED)) * 0.5, "out": g(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p |= {f"x{d}": g(EMBED, 4 * HIDDEN), f"h{d}": g(HIDDEN, 4 * HIDDEN), f"c{d}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        p, (b, t, _) = self.p, x.shape
        gates = x @ p[f"x{d}"] + p[f"c{d}"]
        h, c = np.zeros((b, HIDDEN), x.dtype), np.zeros((b, HIDDEN), x.dtype)
        out, saved = np.empty((b, t, HIDDEN), x.dtype), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = gates[:, k] + h @ p[f"h{d}"]
            s = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            u = np.tanh(a[:, 3 * HIDDEN :])
            before, was = c, h
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            out[:, k] = h
            if keep:
                saved.append((k, i, f, o, u, before, was, tc))
        return out, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        e = self.p["emb"][x]
        hf, sf = self._lstm(e, "f", keep)
        hb, sb = self._lstm(e, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        out = h @ self.p["out"] + self.p["bias"]
        return (out, (e, h, sf, sb)) if keep else out

    def _both_ways(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the CRF, scaled place by place: forward and backward sums, emissions as factors, the scales, the log of the total."""
        trans, (b, t, _) = np.exp(self.p["trans"]), em.shape
        top = em.max(axis=2, keepdims=True)
        factor = np.exp(em - top)
        alpha, beta, scale = np.empty_like(em), np.ones_like(em), np.empty((b, t), em.dtype)
        for k in range(t):
            a = (alpha[:, k - 1] @ trans if k else 1) * factor[:, k]
            scale[:, k] = a.sum(1)
            alpha[:, k] = a / scale[:, k, None]
        for k in range(t - 2, -1, -1):
            beta[:, k] = (factor[:, k + 1] * beta[:, k + 1]) @ trans.T / scale[:, k + 1, None]
        return alpha, beta, factor, scale, np.log(scale).sum(1) + top[:, :, 0].sum(1)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch of full windows."""
        p = self.p
        em, (e, h, sf, sb) = self.emissions(x, True)
        b, t, n = em.shape
        alpha, beta, factor, scale, z = self._both_ways(em)
        unary = alpha * beta
        into = factor[:, 1:] * beta[:, 1:] / scale[:, 1:, None]
        d_trans = np.exp(p["trans"]) * (alpha[:, :-1].reshape(-1, n).T @ into.reshape(-1, n))
        np.subtract.at(d_trans, (y[:, :-1], y[:, 1:]), 1)
        at = (np.arange(b)[:, None], np.arange(t)[None, :], y)
        loss = (z - em[at].sum(1) - p["trans"][y[:, :-1], y[:, 1:]].sum(1)).mean()
        unary[at] -= 1
        d_em = unary / b
        g = {"trans": d_trans / b, "out": h.reshape(-1, 2 * HIDDEN).T @ d_em.reshape(-1, n), "bias": d_em.sum((0, 1))}
        d_h = d_em @ p["out"].T
        d_e = np.zeros_like(e)
        for d, saved, part in (("f", sf, d_h[:, :, :HIDDEN]), ("b", sb, d_h[:, :, HIDDEN:])):
            gx, gh, gc = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"h{d}"]), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN))
            for k, i, f, o, u, before, was, tc in reversed(saved):
                dh = dh + part[:, k]
                dc = dc + dh * o * (1 - tc**2)
                da = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], axis=1)
                gx += e[:, k].T @ da
                gh += was.T @ da
                gc += da.sum(0)
                d_e[:, k] += da @ p[f"x{d}"].T
                dh = da @ p[f"h{d}"].T
                dc = dc * f
            g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], x.ravel(), d_e.reshape(-1, EMBED))
        return float(loss), g

    def fit(self, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> list[float]:
        """Train by Adam on generated sentences with labelled spans."""
        r = random.Random(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for n in range(1, steps + 1):
            pairs = [sentence(r) for _ in range(batch)]
            loss, g = self.step(np.stack([a for a, _ in pairs]), np.stack([b for _, b in pairs]))
            losses.append(loss)
            norm = np.sqrt(sum((x**2).sum() for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x**2
                self.p[k] = self.p[k] - 0.02 * (1 - 0.7 * n / steps) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags and the tag's marginal probability, of each character of each window."""
        em = self.emissions(x)
        b, t, _ = em.shape
        back = np.empty(em.shape, np.int8)
        best = em[:, 0]
        for k in range(1, t):
            s = best[:, :, None] + self.p["trans"]
            back[:, k] = s.argmax(1)
            best = s.max(1) + em[:, k]
        tags = np.empty((b, t), np.int8)
        tags[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[np.arange(b), k, tags[:, k]]
        # how sure a tag is matters where something was found
        share = np.ones((b, t))
        some = tags.any(axis=1)
        if some.any():
            alpha, beta, *_ = self._both_ways(em[some])
            share[some] = np.take_along_axis(alpha * beta, tags[some][:, :, None].astype(int), 2)[:, :, 0]
        return tags, share


def _word(r: random.Random) -> str:
    w = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, 9)))
    return w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.05 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def sample(r: random.Random) -> tuple[str, int]:
    """A piece of text and its kind, or -1."""
    d = functools.partial(_digits, r)
    pick = r.randrange(26)
    if pick < 5:
        user = (_word(r) + r.choice(["", ".", "_", "-"]) + r.choice([_word(r), d(2), ""])).strip("._-")
        host = _word(r).lower() + r.choice(["", d(1)]) + "." + r.choice(["com", "org", "net", "example.com", "co.uk", "de"])
        gap = r.choice([" ", ""])
        return (f"{user}@{host}" if pick < 3 else f"{user}{gap}{r.choice(['(at)', '[at]', '( at )'])}{gap}{host}"), 0
    if pick < 7:
        return ".".join(str(r.randrange(256)) for _ in range(4)), 1
    if pick < 9:
        return r.choice(["", " ", "-"]).join(d(4) for _ in range(4)), 2
    if pick < 11:
        return f"+{r.randint(1, 99)} {r.choice(['(' + d(3) + ')', d(3)])} {d(3)}{r.choice(['-', ' '])}{d(4)}", 3
    if pick < 14:
        return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"({d(4)}) {d(6)}"]), 3
    if pick < 18:
        return r.choice([f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(8)}", f"0{d(2)} {d(4)} {d(4)}", f"({d(3)}) {d(r.randint(7, 10))}"]), 3
    if pick < 20:
        return r.choice([f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/19{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(1)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}"]), -1
    if pick < 22:
        return r.choice([f"{d(1)}.{d(1)}", f"v{d(1)}.{d(2)}.{d(1)}", f"version {d(1)}.{d(1)}", f"{d(2)}.{d(2)} EUR", f"${d(3)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}"]), -1
    if pick < 24:
        return r.choice([d(r.randint(1, 8)), d(r.randint(9, 12)), "0x" + d(6), "".join(r.choices("0123456789abcdef", k=r.randint(20, 40))), f"#{d(4)}", f"{d(5)}-{d(4)}", f"{d(1)}-{d(2)}-{d(5)}-{d(3)}", " ".join(d(r.randint(1, 4)) for _ in range(r.randint(4, 8)))]), -1
    return r.choice(["@" + _word(r), "(" + _word(r) + ")", "%%%", "***", "A" + d(3) + "-" + d(2)]), -1


def sentence(r: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """One window of classes and tags."""
    text, tags = "", []
    while len(text) < 2 * WINDOW:
        piece, kind = sample(r) if r.random() < 0.25 else (_word(r), -1)
        end = r.choice([" ", " ", " ", ", ", ". ", "\n", "! ", ": "])
        tags += ([0] * len(piece) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)) + [0] * len(end)
        text += piece + end
    at = r.randrange(len(text) - WINDOW + 1)
    return classes(text[at : at + WINDOW]), np.array(tags[at : at + WINDOW])


@functools.lru_cache(maxsize=1)
def trained(steps: int = STEPS) -> Tagger:
    """The model, trained once in this process; the seed is fixed, so that every process has the same."""
    model = Tagger()
    model.fit(steps)
    return model


def windows(text: str) -> list[int]:
    """Starts of overlapping windows that cover every anchor and what surrounds it."""
    starts: list[int] = []
    last = max(0, len(text) - WINDOW)
    for m in _anchor.finditer(text):
        for k in (m.start() // STRIDE - 1, m.start() // STRIDE):
            s = min(last, max(0, k * STRIDE))
            if not starts or s > starts[-1]:
                starts.append(s)
    return starts


def added(texts: list[str], tried: list[list[tuple[int, int, frozenset[int]]]], model: Tagger, chunk: int = 512) -> list[list[tuple[int, int, int]]]:
    """The network's spans of each text that no match bars, as (start, kind, end)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = [windows(t) for t in texts]
    queue = [(i, s) for i, own in enumerate(starts) for s in own]
    state: dict[int, _Held] = {}
    for a in range(0, len(queue), chunk):
        part = queue[a : a + chunk]
        x = np.zeros((len(part), WINDOW), int)
        for k, (i, s) in enumerate(part):
            if i not in state:
                state[i] = _Held(texts[i])
            piece = state[i].codes[s : s + WINDOW]
            x[k, : len(piece)] = piece
        tags, share = model.decode(x)
        for k, (i, s) in enumerate(part):
            state[i].take(s, tags[k], share[k])
        last = queue[a + chunk][0] if a + chunk < len(queue) else len(texts)
        for i in [i for i in state if i < last]:
            out[i] = state.pop(i).spans(texts[i], tried[i])
    return out


class _Held:
    """What the windows have said so far of each character of a text."""

    def __init__(self, text: str):
        self.codes = classes(text).astype(np.int8)
        self.tags, self.depth, self.share = np.zeros(len(text), np.int8), np.full(len(text), -1, np.int8), np.ones(len(text), np.float32)

    def take(self, start: int, tags: np.ndarray, share: np.ndarray) -> None:
        """A window's word counts where it is deeper than those before it; the ends of a text are no edges."""
        end = min(start + WINDOW, len(self.tags))
        at, edge = np.arange(end - start), np.full(end - start, WINDOW)
        depth = np.minimum(at if start else edge, at[::-1] if end < len(self.tags) else edge).astype(np.int8)
        deeper = depth > self.depth[start:end]
        for have, new in ((self.tags, tags), (self.share, share), (self.depth, depth)):
            have[start:end][deeper] = new[: end - start][deeper]

    def spans(self, text: str, tried: list[tuple[int, int, frozenset[int]]]) -> list[tuple[int, int, int]]:
        at = np.flatnonzero(self.tags)
        if not len(at):
            return []
        tag = self.tags[at].astype(int)
        kind = (tag - 1) // 2
        fresh = np.r_[True, (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1]) | (tag[1:] % 2 == 1)]
        first = np.flatnonzero(fresh)
        stop = np.r_[first[1:], len(at)]
        sure = np.add.reduceat(self.share[at], first) / (stop - first)
        spans = []
        barred = sorted(tried, key=lambda x: x[0])
        reach = list(itertools.accumulate((e for _, e, _ in barred), max))
        for i in np.flatnonzero((tag[first] % 2 == 1) & (sure >= SURE)).tolist():
            s, e, k = int(at[first[i]]), int(at[stop[i] - 1]) + 1, int(kind[first[i]])
            piece = text[s:e]
            digits = len(_digit.sub("", piece))
            whole = {0: _anchor.search(piece) is not None and ("@" in piece or "at" in piece), 1: piece.count(".") >= 3 and digits > 0, 2: digits >= 12, 3: 9 <= digits <= 15}[k]
            # of the matches that start before the span's end, those back to the last that can reach it
            j = bisect.bisect_left(barred, e, key=lambda x: x[0]) - 1
            while whole and j >= 0 and reach[j] > s:
                if k in barred[j][2] and s < barred[j][1]:
                    whole = False
                j -= 1
            if whole:
                spans.append((s, k, e))
        return spans


# ---- DataFrame operators --------------------------------------------------------------------------------


def _found(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    base, tried = [], []
    some = [bool(_anchor.search(t)) for t in texts]
    for text, s in zip(texts, some):
        b, t = patterns(text) if s else ([], [])
        base.append(b)
        tried.append(t)
    more = added([t if s else "" for t, s in zip(texts, some)], tried, model)
    return list(zip(base, more))


def detect(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (base and the network's) as arrays of (s, kind, e)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _found(strings(b.column(1)), sent.value)
            as_rows = lambda spans: [dict(zip("ske", x)) for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_rows(x) for x, _ in found], kind), pa.array([as_rows(sorted(x + y)) for x, y in found], kind)], names=["doc_id", "base", "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(lean(run), f"doc_id {id_type}, base array<struct<s:int,k:int,e:int>>, spans array<struct<s:int,k:int,e:int>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of detect()."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws(":", F.get(names, r["k"]), r["s"].cast("string"), r["e"].cast("string"))), ",")
    # F.filter gives the position in the array to a second parameter, even to one with a default
    count = lambda kind: F.size(F.filter("base", lambda r: r["k"] == kind)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind."""
    out, at, i = [], 0, 0
    spans = sorted(spans)
    while i < len(spans):
        s, kind, e = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, spans[i][2])
            i += 1
        out += [text[at:s], f"<{KINDS[kind]}>"]
        at = e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Tagger, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with personal data masked in the text, and the size column, if there is one, as long as the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            raw = b.column(at).to_pylist()
            texts = [x or "" for x in raw]
            out = [None if r is None else masked(t, x + y) for r, t, (x, y) in zip(raw, texts, _found(texts, sent.value))]
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    out = docs.mapInArrow(lean(run), StructType(docs.schema.fields))
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col(size_col)).cast(docs.schema[size_col].dataType))
    return out

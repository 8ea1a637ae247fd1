"""Operator 10: secrets by fixed patterns and a linear-chain conditional random field.

Base spans come from three patterns. The random field tags tokens (runs of
letters, digits, _ + / -) as outside, begin or inside a secret, and adds what it
finds outside the base spans. Its features are the token's shape (length, kinds
of characters, changes between them), the word before and what stands between,
known words a little further back, the neighbours' shapes, and the file (how many
digits, whether it names a credential).

It is trained in numpy, by gradient on the exact likelihood, on a bounded sample
of documents into which made secrets of many shapes are planted, next to keywords
and alone, along with decoys (dates, numbers, paths, names, unique ids) that are
no secrets. What the sample holds itself is tagged by the patterns.

Decoding is Viterbi's. A token whose score for outside leads by more than any
transitions could make up is outside on the best path, so only the runs between
such tokens are searched; the tags are those of the search over the whole text.

Nulls: a null text is empty and has no spans; doc_id may be null. Repeated rows
are scanned each. An empty table gives no rows. Other columns pass through, but
for one named `spans`, which is replaced. Texts above BLOCK bytes meet the random
field in blocks that overlap and never cut a token, with the file features of the
whole text; the patterns always see them whole."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnline.llm.common import pieces
from burnline.llm.words import INVERSE, LOWER, SPACE, U, mix, powers, prefix

# The base patterns (their least lengths: 6 characters of group 2; 20; 24).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones may be passed over at once
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Words before a secret that the random field knows.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "pwd", "auth", "bearer", "credential", "private", "access")
#: Sampled documents and bytes of the longest; training sequences aimed at, and tokens of one; rounds; least characters of a span.
SAMPLE, LONGEST, SEQUENCES, SEQUENCE, ROUNDS, LEAST = 400, 1 << 16, 2_500, 32, 100, 8
#: Bytes of a block of a long text, and of the text that it sees on either side.
BLOCK, AROUND = 1 << 19, 1 << 12
OUT, BEGIN, INSIDE = 0, 1, 2

_is = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
DIGIT, UPPER, LOWERCASE, SIGN = _is(b"0123456789"), _is(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is(b"abcdefghijklmnopqrstuvwxyz"), _is(b"_+/-")
WIDE = np.arange(256) >= 128
TOKEN, HEXED = DIGIT | UPPER | LOWERCASE | SIGN | WIDE, _is(b"0123456789abcdef")
CLASS = (DIGIT * 1 + UPPER * 2 + LOWERCASE * 3 + SIGN * 4 + WIDE * 5).astype(np.int8)
LENGTHS = np.array([4, 8, 12, 16, 20, 24, 32, 40, 64])
SIZES = (1600, 50, 14 * 8, 50, 50, 64, 16, 28)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _hash(total: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((total[e] - total[s]) * powers(INVERSE, len(total))[s] + (e - s).astype(U))


def _known() -> tuple[np.ndarray, np.ndarray]:
    h = []
    for w in WORDS:
        raw = np.frombuffer(w.encode(), np.uint8)
        h.append(_hash(prefix(raw), np.array([0]), np.array([len(raw)]))[0])
    order = np.argsort(np.array(h, U))
    return np.array(h, U)[order], order + 1


KNOWN, KNOWN_ID = _known()


def tokens(raw: np.ndarray, starts: np.ndarray, file: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, feature codes (tokens x 8) and text numbers of the tokens in `raw`.

    A space stands before each text; text i begins at starts[i]; file[i] is its file code."""
    inside = TOKEN[raw]
    step = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    s, e = step[::2], step[1::2]
    n = len(s)
    if not n:
        return s, e, np.zeros((0, len(SIZES)), np.int32), s

    def count(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
        return c[e] - c[s]

    size = e - s
    digits, uppers, lowers, signs, wides, hexed = (count(t[raw]) for t in (DIGIT, UPPER, LOWERCASE, SIGN, WIDE, HEXED))
    kind = CLASS[raw]
    changes = np.concatenate([[0], np.cumsum(np.concatenate([[False], kind[1:] != kind[:-1]]), dtype=np.int32)])
    changes = changes[e] - changes[np.minimum(s + 1, len(raw))]
    long = np.searchsorted(LENGTHS, size, side="right")
    share = np.where(digits == 0, 0, np.where(digits == size, 4, 1 + np.minimum((5 * digits) // (2 * size), 2)))
    letters = np.where(uppers == 0, np.where(lowers == 0, 3, 0), np.where(lowers == 0, 1, 2))
    shape = ((((long * 5 + share) * 4 + letters) * 2 + (signs > 0)) * 2 + (wides > 0)) * 2 + (hexed == size)
    rate = changes / size
    change = long * 5 + np.searchsorted([0.01, 0.1, 0.25, 0.5], rate, side="right")
    coarse = long * 5 + share
    total = prefix(LOWER[raw])
    h = _hash(total, s, e)
    at = np.minimum(np.searchsorted(KNOWN, h), len(KNOWN) - 1)
    word = np.where(KNOWN[at] == h, KNOWN_ID[at], 0)
    # What stands between a token and the one before: 4 for = or :, 2 for a quote, 1 for white space; 7 where a text begins.
    bits = (np.isin(raw, [58, 61]) * 4 + np.isin(raw, [34, 39]) * 2 + SPACE[raw] * 1).astype(np.uint8)
    gap = np.zeros(n, np.int32)
    for k in (4, 2, 1):
        c = np.concatenate([[0], np.cumsum((bits & k) > 0, dtype=np.int32)])
        gap[1:] += k * ((c[s[1:]] - c[e[:-1]]) > 0)
    text = np.searchsorted(starts, s, side="right") - 1
    fresh = np.concatenate([[True], text[1:] != text[:-1]])
    gap[fresh] = 7
    before = lambda x: np.where(fresh, 0, np.concatenate([[0], x[:-1]]))
    last = np.concatenate([fresh[1:], [True]])
    after = lambda x, none: np.where(last, none, np.concatenate([x[1:], [none]]))
    back = lambda k: np.concatenate([np.zeros(min(k, n), np.int64), np.where(text[k:] == text[:-k], word[:-k], 0)])
    near = back(2)
    far = np.where(near > 0, near, back(3)) * 2 + (before(size) <= 4)
    codes = np.stack([shape, change, before(word) * 8 + gap, before(coarse), after(coarse, 0), gap * 8 + after(gap, 7), file[text], far], axis=1)
    return s, e, codes.astype(np.int32), text


def file_codes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A code for each text: how many digits, how many = and :, and whether a quote stands in it."""
    a, b = offsets[:-1], offsets[1:]
    count = lambda flag: (lambda c: c[b] - c[a])(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)]))
    size = np.maximum(b - a, 1)
    digits, sets, quotes = count(DIGIT[raw]) / size, count(np.isin(raw, [58, 61])) / size, count(raw == 34)
    return (np.searchsorted([0.002, 0.02, 0.1], digits, side="right") * 2 + (sets > 0.004)) * 2 + (quotes > 0)


@dataclass
class Field:
    """Scores of feature codes (concatenated tables x 3), transitions and first states."""

    weights: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        at, out = 0, np.zeros((len(codes), 3))
        for k, size in enumerate(SIZES):
            out += self.weights[at + codes[:, k]]
            at += size
        return out

    def lead(self) -> float:
        """By how much transitions can at most favour another state over outside, whatever its neighbours."""
        t, f = self.step, self.first
        into = [t[a] for a in range(3)] + [f]
        out = [t[:, c] for c in range(3)] + [np.zeros(3)]
        return max(i[s] + o[s] - i[OUT] - o[OUT] for i in into for o in out for s in (BEGIN, INSIDE))

    def tags(self, codes: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best tags of each text's tokens."""
        tag = np.zeros(len(codes), np.int8)
        if not len(codes):
            return tag
        e = self.emissions(codes)
        open_ = np.flatnonzero(e[:, OUT] - e[:, 1:].max(axis=1) <= self.lead())
        for run in np.split(open_, np.flatnonzero((np.diff(open_) > 1) | (np.diff(text[open_]) > 0)) + 1) if len(open_) else []:
            a, b = run[0], run[-1] + 1
            whole = a == 0 or text[a - 1] != text[a]
            best, back = e[a] + (self.first if whole else self.step[OUT]), []
            for i in range(a + 1, b):
                both = best[:, None] + self.step
                back.append(both.argmax(axis=0))
                best = both.max(axis=0) + e[i]
            if b < len(text) and text[b] == text[a]:  # outside comes next
                best = best + self.step[:, OUT]
            tag[b - 1] = state = best.argmax()
            for i, prev in zip(range(b - 2, a - 1, -1), reversed(back), strict=True):
                tag[i] = state = prev[state]
        return tag


def train(sequences: list[tuple[np.ndarray, np.ndarray]], seed: int = 3) -> Field:
    """Fit to (codes, tags) sequences of at most SEQUENCE tokens by Adam on the likelihood."""
    n = len(sequences)
    width, base = sum(SIZES), np.concatenate([[0], np.cumsum(SIZES)])[:-1]
    theta = np.zeros((width, 3))
    step, first = np.zeros((3, 3)), np.zeros(3)
    theta[: SIZES[0], OUT] = 1.0
    step[OUT, INSIDE] = -4.0
    if not n:
        return Field(theta, step, first)
    codes, tags, mask = np.zeros((n, SEQUENCE, len(SIZES)), np.int64), np.zeros((n, SEQUENCE), np.int64), np.zeros((n, SEQUENCE), bool)
    for i, (c, t) in enumerate(sequences):
        codes[i, : len(c)], tags[i, : len(c)], mask[i, : len(c)] = c + base, t, True
    drop = np.random.default_rng(seed).random(n) < 0.3
    codes[drop, :, 2], codes[drop, :, 7] = base[2], base[7]
    gold = np.eye(3)[tags] * mask[:, :, None]
    params = [theta, step, first]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pairs = np.einsum("nti,ntj->ij", gold[:, :-1] * mask[:, 1:, None], gold[:, 1:])
    for r in range(1, ROUNDS + 1):
        theta, step, first = params
        e = theta[codes].sum(axis=2) * mask[:, :, None]
        alpha, beta = np.zeros((n, SEQUENCE, 3)), np.zeros((n, SEQUENCE, 3))
        alpha[:, 0] = first + e[:, 0]
        for t in range(1, SEQUENCE):
            x = alpha[:, t - 1, :, None] + step
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(SEQUENCE - 2, -1, -1):
            x = step + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            top = x.max(axis=2)
            new = top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = alpha[:, -1].max(axis=1) + np.log(np.exp(alpha[:, -1] - alpha[:, -1].max(axis=1, keepdims=True)).sum(axis=1))
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        over = np.exp(alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        error = p - gold
        grads = [np.zeros_like(theta), over.sum(axis=(0, 1)) - pairs, error[:, 0].sum(axis=0)]
        for k in range(len(SIZES)):
            for s in range(3):
                grads[0][:, s] += np.bincount(codes[:, :, k].ravel(), error[:, :, s].ravel(), width)
        for k, g in enumerate(grads):
            g = g + 0.02 * params[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            params[k] = params[k] - 0.15 * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.99**r)) + 1e-8)
    return Field(*params)


_SETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "lower": "abcdefghijklmnopqrstuvwxyz", "digits": "0123456789"}


def _made(rng: np.random.Generator, kind: str, low: int, high: int) -> str:
    return "".join(rng.choice(list(_SETS[kind]), int(rng.integers(low, high + 1))))


def _secret(rng: np.random.Generator) -> tuple[str, str]:
    """(text, value): a made secret, alone or next to a keyword."""
    alone = [_made(rng, "mixed", 20, 48), _made(rng, "HEX", 32, 64), _made(rng, "lower", 2, 5) + rng.choice(["-", "_"]) + _made(rng, "mixed", 18, 40), _made(rng, "lower", 2, 5) + "-" + _made(rng, str(rng.choice(["lower", "digits"])), 3, 14) + "-" + _made(rng, "mixed", 14, 32), _made(rng, "upper", 18, 32), _made(rng, "base64", 24, 60), _made(rng, "hex", 32, 64), _made(rng, "mixed", 16, 24) + "." + _made(rng, "mixed", 20, 40)]
    if rng.random() < 0.4:
        value = str(rng.choice(alone))
        return value, value
    password = _made(rng, "lower", 4, 8) + _made(rng, "digits", 1, 3) + _made(rng, "mixed", 4, 8)
    value = str(rng.choice([*alone, password, password]))
    word = str(rng.choice(WORDS))
    word = rng.choice([word, word.capitalize(), word.upper()])
    frame = rng.choice(["{} {}", "{}: {}", "{}={}", '{} = "{}"', "{} is {}", "{}: '{}'", '"{}": "{}"', "the {} was {}", "{} -> {}"])
    return frame.format(word, value), value


def _decoy(rng: np.random.Generator) -> str:
    """Odd text that is no secret."""
    d = lambda k: _made(rng, "digits", k, k)
    w = lambda a=3, b=10: _made(rng, "lower", a, b)
    made = [f"20{d(2)}-0{d(1)}-1{d(1)}T1{d(1)}:{d(2)}:{d(2)}", _made(rng, "digits", 8, 30), f"/{w()}/{w()}/{w()}{d(1)}/{w()}", f"{w().upper()}-{d(6)}-{d(4)}", f"{w()}{w().capitalize()}{w().capitalize()}{d(1)}", f"v{d(1)}.{d(2)}.{d(1)}", f"{w()}_{w()}_{w()}", f"{w()}-{w()}-{w()}", f"{w()}.{w()}{d(2)}@{w()}.{w(2, 3)}", f"+{d(2)} {d(3)} {d(7)}", "-".join(_made(rng, "hex", k, k) for k in (8, 4, 4, 4, 12)), w(14, 26), w(10, 24).upper(), f"https://{w()}.{w(2, 3)}/{w()}?id={d(6)}", w(5, 9) + d(2)]
    out = str(rng.choice(made))
    return out if rng.random() < 0.7 else f"{rng.choice(WORDS)} {rng.choice(['for', 'of', 'is', ':'])} {w()} {out}"


def planted(text: str, rng: np.random.Generator, secrets: int, decoys: int) -> tuple[str, list[tuple[int, int]]]:
    """The text with made secrets and decoys between its words, and the spans of the secrets' values."""
    words = text.split(" ")
    put: dict[int, list[tuple[str, str]]] = {}
    for made in [*(_secret(rng) for _ in range(secrets)), *((_decoy(rng), "") for _ in range(decoys))]:
        put.setdefault(int(rng.integers(0, len(words) + 1)), []).append(made)
    out, spans, at = [], [], 0
    for i in range(len(words) + 1):
        for snippet, value in put.get(i, []):
            if value:
                a = at + snippet.rindex(value)
                spans.append((a, a + len(value)))
            out.append(snippet)
            at += len(snippet) + 1
        if i < len(words):
            out.append(words[i])
            at += len(words[i]) + 1
    return " ".join(out), spans


def _values(text: str) -> list[tuple[int, int]]:
    """Spans of the values of base spans."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return out + [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20] + [m.span() for m in HEX.finditer(text)]


def sequences(texts: list[str], seed: int = 1, most: int = SEQUENCES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences: around each secret, around odd tokens, and some at random."""
    rng, out, half = np.random.default_rng(seed), [], SEQUENCE // 2
    texts = [t for t in texts if t]
    for turn in range(64 * bool(texts)):  # few documents are planted several times over
        for i, t in enumerate(texts):
            if len(out) >= most:
                return out
            many = (0, 0) if turn == 0 and i % 4 == 0 else (int(rng.integers(1, 5)), int(rng.integers(1, 5)))
            made, spans = planted(t, rng, *many)
            raw = np.frombuffer(b" " + made.encode(), np.uint8)
            s, e, codes, _ = tokens(raw, np.zeros(1, np.int64), file_codes(raw[1:], np.array([0, len(raw) - 1])))
            if not len(s):
                continue
            tag, place = np.zeros(len(s), np.int8), _Places(made, raw[1:])
            for a, b in sorted({*spans, *_values(made)}):
                at = np.flatnonzero((s - 1 >= place.byte(a)) & (e - 1 <= place.byte(b)))
                if len(at) and not tag[at].any():
                    tag[at] = INSIDE
                    tag[at[0]] = BEGIN
            odd = np.flatnonzero((tag == OUT) & (codes[:, 0] >= 3 * 160) & (codes[:, 0] // 32 % 5 > 0))
            mid = [*np.flatnonzero(tag == BEGIN)[:8], *rng.permutation(odd)[:6], *rng.integers(0, len(s), 3)]
            for k in mid:
                a = max(0, k - half)
                out.append((codes[a : a + SEQUENCE], tag[a : a + SEQUENCE]))
    return out


def learn(docs: DataFrame) -> Field:
    """A field from at most SAMPLE documents of at most LONGEST bytes, picked by a hash of their ids."""
    size = F.octet_length("text")
    rows = docs.where(size.between(1, LONGEST)).select("doc_id", "text")
    # Ids are picked first, so that texts of the sample alone leave the executors.
    picked = rows.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(SAMPLE).distinct()
    texts = rows.join(F.broadcast(picked), "doc_id").orderBy("doc_id", F.xxhash64("text")).limit(SAMPLE).select("text").collect()  # bounded by SAMPLE
    return train(sequences([r.text for r in texts]))


class _Places:
    """Characters to bytes of a text and back, for texts of any length at once."""

    def __init__(self, text: str, raw: np.ndarray):
        self.starts = None if len(text) == len(raw) else np.flatnonzero((raw & 0xC0) != 0x80)
        self.size = len(raw)

    def byte(self, character: int) -> int:
        if self.starts is None:
            return character
        return int(self.starts[character]) if character < len(self.starts) else self.size

    def character(self, byte: int) -> int:
        return byte if self.starts is None else int(np.searchsorted(self.starts, byte))


def _found(raw: np.ndarray, offsets: np.ndarray, field: Field, file: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(text, start, end) in bytes of its text of the field's spans in a bounded run of texts."""
    n = len(offsets) - 1
    out = np.full(len(raw) + n, 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = raw
    starts = offsets[:-1] + np.arange(n)
    s, e, codes, text = tokens(out, starts, file_codes(raw, offsets) if file is None else file)
    tag = field.tags(codes, text)
    hit = np.flatnonzero(tag)
    found: list[list[int]] = []
    for i in hit:
        if found and tag[i] == INSIDE and found[-1][3] == i - 1 and found[-1][0] == text[i]:
            found[-1][2:] = [int(e[i] - starts[text[i]] - 1), int(i)]
        else:
            found.append([int(text[i]), int(s[i] - starts[text[i]] - 1), int(e[i] - starts[text[i]] - 1), int(i)])
    return [(t, a, b) for t, a, b, _ in found]


def _between(whole: np.ndarray, at: int, block: int = BLOCK) -> int:
    """The first place from `at` on where no token is cut."""
    while at < len(whole):
        gaps = np.flatnonzero(~TOKEN[whole[at : at + block]])
        if len(gaps):
            return at + int(gaps[0])
        at += block
    return len(whole)


def _found_long(whole: np.ndarray, field: Field) -> list[tuple[int, int]]:
    """(start, end) in bytes of the field's spans in one long text: each block has those that start in it."""
    file = file_codes(whole, np.array([0, len(whole)]))
    out, at = [], 0
    while at < len(whole):
        to = _between(whole, at + BLOCK)
        lo, hi = at - AROUND, _between(whole, to + AROUND)
        while lo > 0 and TOKEN[whole[lo - 1]]:
            lo -= 1
        lo = max(lo, 0)
        out += [(lo + s, lo + e) for _, s, e in _found(whole[lo:hi], np.array([0, hi - lo]), field, file) if at <= lo + s < to]
        at = to
    return out


def scan_texts(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int]]]:
    """All spans of each text in code points, by start, then kind."""
    spans = [base_spans(t or "") for t in texts]
    data = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    for a, b in pieces(offsets, BLOCK):
        raw = np.frombuffer(b"".join(data[a:b]), np.uint8)
        found = [(0, s, e) for s, e in _found_long(raw, field)] if len(raw) > BLOCK else _found(raw, offsets[a : b + 1] - offsets[a], field)
        places = {t: _Places(texts[a + t] or "", np.frombuffer(data[a + t], np.uint8)) for t in {t for t, _, _ in found}}
        for t, s, e in found:
            s, e = places[t].character(s), places[t].character(e)
            if e - s >= LEAST and not any(x <= s and e <= y for _, x, y in spans[a + t]):
                spans[a + t].append(("crf", s, e))
    return [sorted(x, key=lambda y: (y[1], KINDS.index(y[0]))) for x in spans]


def with_spans(docs: DataFrame, field: Field) -> DataFrame:
    """`docs` with spans: (kind, start, end) in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        rows = [None if t is None or t != t else t for t in texts.tolist()]
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in scan_texts(rows, shared.value)])

    return docs.withColumn("spans", scan("text"))


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by `mark`."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """`docs` with every secret in `text` replaced by a mark."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        rows = [None if t is None or t != t else t for t in texts.tolist()]
        return pd.Series([redact(t, s) for t, s in zip(rows, scan_texts(rows, shared.value), strict=True)])

    return docs.withColumn("text", clean("text"))


def span_digests(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row."""
    rows = with_spans(docs.select("doc_id", "text"), field)
    text = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return rows.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))

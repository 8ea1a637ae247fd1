"""Word and shingle hashes of whole batches of UTF-8 bytes, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: White space that separates words: space and bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
#: Longest run of bytes that is hashed at a time; longer texts are cut at white space.
BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x.astype(U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


#: A 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=U))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        out = np.empty(size, U)
        out[0] = 1
        done = 1
        while done < size:
            take = min(done, size - done)
            out[done : done + take] = out[:take] * U(pow(base, done, 2**64))
            done += take
        _powers[base] = have = out
    return have


def spans(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in `raw`; a text begins at each of `starts`."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = SPACE[raw]
    opens, closes = ~gap, ~gap
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[starts] = True
    opens[1:] &= gap[:-1] | fresh[1:-1]
    closes[:-1] &= gap[1:] | fresh[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash, one longer than `raw`."""
    out = np.empty(len(raw) + 1, U)
    out[0] = 0
    np.cumsum(BYTE[raw] * powers(BASE, len(raw))[: len(raw)], out=out[1:])
    return out


def hashes(raw: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts in `raw`, and how many words precede each text."""
    raw = LOWER[raw] if lower else raw
    s, e = spans(raw, starts)
    total = prefix(raw)
    h = (total[e] - total[s]) * powers(INVERSE, len(raw) + 1)[s]
    return mix(h + (e - s).astype(U)), np.searchsorted(s, starts)


def long_hashes(raw: np.ndarray) -> np.ndarray:
    """The word hashes of one long text, in blocks cut at white space, so memory stays bounded."""
    out, a = [], 0
    while a < len(raw):
        b = min(a + BLOCK, len(raw))
        if b < len(raw):
            gaps = np.flatnonzero(SPACE[raw[a:b]])
            while not len(gaps) and b < len(raw):  # one word longer than a block
                c = min(b + BLOCK, len(raw))
                gaps = np.flatnonzero(SPACE[raw[b:c]]) + (b - a)
                b = c
            b = a + int(gaps[-1]) + 1 if len(gaps) else b
        out.append(hashes(raw[a:b], np.zeros(1, np.int64))[0])
        a = b
    return np.concatenate(out) if out else np.zeros(0, U)

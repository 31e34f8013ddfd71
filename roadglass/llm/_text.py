"""Words, hashes and shingles of whole texts as numpy arrays over a batch of texts."""

from __future__ import annotations

import numpy as np

MIX1, MIX2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
#: Bytes of text hashed at once; a longer word is hashed whole.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        np.multiply(out[:step], np.uint64(pow(base, filled, 1 << 64)), out=out[filled : filled + step])
        filled += step
    return out


def batch_words(texts: list[bytes], lower: bool = True, tables: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words [^\\x20\\x09-\\x0D]+: 64-bit hashes, starts, ends (bytes of the joined texts), the joined bytes, words before each text (one more entry than texts).

    A hash is a polynomial over a word's bytes (A-Z lower-cased), mixed with its length.
    """
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    if lower:
        up = (joined >= 65) & (joined <= 90)
        joined = joined + (up.astype(np.uint8) << np.uint8(5))
    gap = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
    before = np.searchsorted(starts, begin)
    tables = {} if tables is None else tables
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # piece by piece, as the sums take eight bytes for each byte of text
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        part = joined[starts[at] : ends[end - 1]]
        n = len(part)
        if len(tables.get("up", ())) < n + 1:
            tables["up"], tables["down"] = _powers(BASE, n + n // 4 + 1), _powers(pow(BASE, -1, 1 << 64), n + n // 4 + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * tables["up"][:n], out=total[1:])
        a, b = starts[at:end] - starts[at], ends[at:end] - starts[at]
        hashes[at:end] = (total[b] - total[a]) * tables["down"][a]
        at = end
    return mix(hashes ^ ((ends - starts).astype(np.uint64) * GOLD)), starts, ends, joined, before


def batch_shingles(words: np.ndarray, before: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text (of the whole sequence if shorter), and shingles before each text."""
    n = np.diff(before)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    pad = np.concatenate([words, np.zeros(k, np.uint64)])
    own = np.repeat(np.arange(len(n)), counts)
    place = np.arange(at[-1]) - at[own] + before[:-1][own]
    left = np.minimum(before[1:][own] - place, k)
    out = np.zeros(at[-1], np.uint64)
    for i in range(k):
        w = pad[place + i]
        if i:
            w = np.where(left > i, w, np.uint64(0))
        out = out * np.uint64(0xD6E8FEB86659FD93) + w
    return mix(out ^ (left.astype(np.uint64) * GOLD)), at


def distinct(keys: np.ndarray, top: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and each key's place among them. `top`: all keys are below it.

    Where a key and its place fit in 64 bits, they are sorted as one number, which is far faster than to sort the places.
    """
    bits = max(len(keys) - 1, 1).bit_length()
    if top and max(top - 1, 1).bit_length() + bits <= 64:
        ordered = keys.astype(np.uint64)
        ordered <<= np.uint64(bits)
        ordered |= np.arange(len(keys), dtype=np.uint64)
        ordered.sort()
        order = (ordered & np.uint64((1 << bits) - 1)).astype(np.int32)
        ordered >>= np.uint64(bits)
    else:
        order = np.argsort(keys).astype(np.int32)
        ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ordered[new], order[new], inverse

"""Words of whole texts as 64-bit hashes, computed over byte buffers without a Python object a word."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd number for each byte, and the base whose powers weight a byte's place in its word.
_BYTE = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 0x20


def lowering(keeps) -> bytes:
    """A translation table: A-Z in lower case, and every byte for which keeps(byte) is false as a space."""
    table = bytearray(range(256))
    table[0x41:0x5B] = range(0x61, 0x7B)
    return bytes(b if keeps(b) else _SPACE for b in table)


#: Words between ASCII white space.
WHITE = lowering(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Words of digits, a-z and all beyond ASCII.
ALPHANUMERIC = lowering(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    joined = b" ".join([t.translate(table) for t in texts]) + b" "
    data = np.frombuffer(joined, np.uint8)
    word = data != _SPACE
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    text_end = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, text_end), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    letters = _BYTE[data[word]]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _BASE)]).astype(np.uint64))
    sums = np.add.reduceat(letters * powers[place], first)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts


def ngrams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n consecutive words of each text, number for each text); a shorter text that has words is one n-gram."""
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    total = int(made.sum())
    if not total:
        return np.zeros(0, np.uint64), made
    text_first = np.cumsum(counts) - counts
    out_first = np.cumsum(made) - made
    at = np.arange(total) - np.repeat(out_first, made) + np.repeat(text_first, made)
    left = np.repeat(np.minimum(counts, n), made)
    found = np.zeros(total, np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        part = padded[at + k]
        if k and (left <= k).any():
            part = np.where(left > k, part, np.uint64(k))
        found = found * np.uint64(0xC2B2AE3D27D4EB4F) + part
    return mix(found), made

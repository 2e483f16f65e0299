"""Words, word hashes and shingles of many texts at once, as numpy arrays over UTF-8 bytes.

ASCII bytes never occur inside a multi-byte character, so words that are delimited by ASCII characters can be cut on bytes.
Hashes have 64 bits: two of n different words or shingles share one with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Delimiters of `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Delimiters of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[0:0x30] = NOT_WORD[0x3A:0x61] = NOT_WORD[0x7B:0x80] = True

_U = np.uint64
_seeded = np.random.Generator(np.random.PCG64(20240901))
BYTE = _seeded.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ORDER = _seeded.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def word_bounds(data: np.ndarray, off: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, the offsets of each text's words among them, and the mask of word bytes."""
    inside = ~blank[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off), inside


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Powers of the base and of its inverse, for chunks of the usual size.
_UP, _DOWN = (_powers(x, 1 << 19) for x in (_BASE, _INVERSE))


def span_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans from starts to ends (none empty) of an array of random codes, wherever they lie in it.

    Each is a polynomial of its codes: a difference of running sums, moved to the span's start by a power of the inverse.
    """
    up, down = (_UP, _DOWN) if len(code) <= len(_UP) else (_powers(_BASE, len(code)), _powers(_INVERSE, len(code)))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * up[: len(code)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, off: np.ndarray, blank: np.ndarray = BLANK, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the offsets of each text's words."""
    data = LOWER[buf] if lower else buf
    starts, ends, words, _ = word_bounds(data, off, blank)
    return span_hashes(BYTE[data], starts, ends), words


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on, as far as there are k."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total = h[: len(h) - k + 1] * _ORDER[0]
    for i in range(1, k):
        total += h[i : len(h) - k + 1 + i] * _ORDER[i]
    return mix(total + _U(k))


def sets_of_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each span, sorted, one set behind the other, and their sizes."""
    many = ends - starts
    to = np.cumsum(many)
    out = values[np.arange(int(many.sum())) + np.repeat(starts - to + many, many)]
    for a, b in zip((to - many).tolist(), to.tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[(to - many)[many > 0]] = True
    before = np.concatenate(([0], np.cumsum(new)))
    return out[new], before[to] - before[to - many]


def shingle_sets(h: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles, sorted, one text behind the other, and how many each has.

    With fewer than k words the whole sequence is one shingle; without words there is none.
    """
    starts, ends = words[:-1], words[1:]
    every = windows(h, k)
    short = np.flatnonzero((ends - starts < k) & (ends > starts))
    if len(short):
        own = np.concatenate([windows(h[a:b], b - a) for a, b in zip(starts[short].tolist(), ends[short].tolist(), strict=True)])
        first, last = starts.copy(), np.maximum(ends - k + 1, starts)
        first[short] = len(every) + np.arange(len(short))
        last[short] = first[short] + 1
        return sets_of_spans(np.concatenate((every, own)), first, last)
    return sets_of_spans(every, np.minimum(starts, len(every)), np.maximum(ends - k + 1, np.minimum(starts, len(every))))


def set_hash(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each of n rows' set of distinct values, whatever their order; an empty set's is that of 0 values."""
    total = np.zeros(n, np.uint64)
    np.add.at(total, rows, mix(values + _U(29)))
    return mix(total + mix(np.bincount(rows, minlength=n).astype(np.uint64)))


def parities(rows: np.ndarray, values: np.ndarray, size: np.ndarray, columns: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Of each row's distinct values, by their low bits: whether an odd number falls on each of a row's bits.

    First in so many columns (a power of two) of 64 bits, then in a string of bits about twice to four times as many as the row has values: every
    bit in which two sets' parities differ stands for a value that only one of them has.
    """
    out, bit = np.zeros(len(size) * columns, np.uint64), _U(1) << (values & _U(63))
    np.bitwise_xor.at(out, rows * columns + ((values >> _U(6)) & _U(columns - 1)).view(np.int64), bit)
    words = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(size, 1) / 32)).astype(np.int64).clip(0))
    at = np.cumsum(words) - words
    wide = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(wide, at[rows] + ((values >> _U(6)).view(np.int64) & (words[rows] - 1)), bit)
    return list(out.view(np.int64).reshape(-1, columns).T), [wide[a : a + n].tobytes() for a, n in zip(at.tolist(), words.tolist(), strict=True)]


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two strings of parities differ; the longer one is folded to the length of the other."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) != len(b):
        a, b = (np.bitwise_xor.reduce(v.reshape(-1, min(len(a), len(b))), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())

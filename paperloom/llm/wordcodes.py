"""Vectorised word hashing over Arrow string buffers.

A batch's texts are hashed without making Python strings: the bytes are classed by a
256-entry table, word bounds come from comparing neighbours, and each word's code is the
difference of two prefix sums of a polynomial over randomised byte values, mod 2**64.
Words are cut at text bounds. Codes of equal words are equal; others collide with
probability about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that separate words: blank and the controls 9 to 13.
BLANKS = frozenset([0x20, *range(0x09, 0x0E)])
#: Bytes hashed at once; a longer single text is hashed whole.
CHUNK = 1 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Grown:
    """Powers of the multiplier and its inverse, grown on demand."""

    up = _powers(_MULT, 1 << 10)
    down = _powers(_INV, 1 << 10)

    @classmethod
    def to(cls, n: int):
        if len(cls.up) <= n:
            size = 1 << n.bit_length()
            cls.up, cls.down = _powers(_MULT, size), _powers(_INV, size)
        return cls.up, cls.down


def _byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    if lower:
        v[0x41:0x5B] = v[0x61:0x7B]
    return v


_VALUES = {False: _byte_values(False), True: _byte_values(True)}


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def word_table(blanks=BLANKS) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(blanks)] = False
    return t


_WORD = word_table()


def word_bounds(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word, in order, cut at text bounds."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | edge[1:-1]
    end = w.copy()
    end[:-1] &= ~w[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_codes(column: pa.Array, lower: bool, is_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words, offsets of each text's words), len(offsets) = texts + 1."""
    raw, offsets = text_buffers(column)
    values = _VALUES[lower]
    codes, counts = [], []
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
        j = min(max(j, i + 1), n)
        part, offs = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e = word_bounds(part, offs, is_word)
        up, down = _Grown.to(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        codes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U)))
        counts.append(np.diff(np.searchsorted(s, offs)))
        i = j
    all_codes = np.concatenate(codes) if codes else np.zeros(0, U)
    lens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return all_codes, out


_GRAM = mix(np.arange(101, 101 + 64, dtype=U)) | U(1)


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A code of codes[i:i+k] for each i (fewer than k codes: none)."""
    m = len(codes) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for j in range(k):
        out += codes[j : j + m] * _GRAM[j]
    return mix(out)


def sequence_code(codes: np.ndarray) -> int:
    """A code of one whole short sequence (under 64 codes), another for each length."""
    n = len(codes)
    total = (codes * _GRAM[:n]).sum(dtype=U, keepdims=True)
    return int(mix(total + np.array([n], U) * U(0xA0761D6478BD642F))[0])


def shingles(codes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingle codes; a shorter sequence is one shingle; none for no words."""
    if len(codes) >= k:
        return np.unique(grams(codes, k))
    return np.array([sequence_code(codes)], U) if len(codes) else np.zeros(0, U)


def shingle_sets(codes: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """shingles() of each text of a batch."""
    g = grams(codes, k)
    bounds = zip(offsets[:-1].tolist(), offsets[1:].tolist())
    return [np.unique(g[a : b - k + 1]) if b - a >= k else shingles(codes[a:b], k) for a, b in bounds]


def ragged(values: np.ndarray, lens, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and lengths."""
    offs = np.zeros(len(lens) + 1, np.int32)
    np.cumsum(lens, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, type=kind))

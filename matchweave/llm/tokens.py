"""Vectorised word and shingle hashing over the bytes of whole Arrow batches.

A word is a run of ASCII letters and digits and of non-ASCII characters that are neither white space nor punctuation; ASCII
and Latin-1 letters fold case. In scripts written without spaces every character is a word.
Everything here works on one chunk of rows at a time, so memory follows the chunk (or one very long text).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Workers are reused from stage to stage; the system's allocator gives the memory of past batches back.
pa.set_memory_pool(pa.system_memory_pool())

U = np.uint64
TOKEN_BITS = 44
_MULT = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) * U(2) + U(1)
_POW = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
for _c in range(128):
    _FOLD[_c] = ord(chr(_c).lower()) if chr(_c).isalnum() else 0
#: Scripts without spaces: Thai and Lao, Myanmar, Khmer, Tai, Balinese, Kana and Bopomofo, Han, Yi, Javanese, more of them.
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0xA48F), (0xA980, 0xA9DF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
_WORD, _BREAK, _SINGLE = 0, 1, 2
#: Of each code point: part of a word, a break, or a word of its own.
_KIND = np.zeros(0x110000, np.uint8)
for _a, _b in _UNSPACED:
    _KIND[_a : _b + 1] = _SINGLE
for _c in range(128, 0x20000):
    if unicodedata.category(chr(_c))[0] in "PZ" or _c < 0xA0 or _c in (0x200B, 0xFEFF):
        _KIND[_c] = _BREAK


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal on every machine."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row (nulls are empty)."""
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset, number of bytes and kind of each character beyond ASCII."""
    at = np.flatnonzero(data >= 0xC0)
    first = data[at].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    for k in range(1, 4):
        more = size > k
        code[more] = (code[more] << 6) | (data[at[more] + k] & 0x3F)
    return at, size, _KIND[code]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and 64-bit hash of each word."""
    t = _FOLD[data]
    if len(t) > 1:  # Latin-1 capitals: C3 80..9E
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        t[up] += 0x20
    w = t != 0
    at, n, kind = _kinds(data)
    gap = kind == _BREAK
    for k in range(4):
        w[at[gap & (n > k)] + k] = False
    begins = w.copy()
    begins[1:] &= ~w[:-1]
    one = kind == _SINGLE
    if one.any():
        begins[at[one]] = True
        after = at[one] + n[one]
        after = after[after < len(w)]
        begins[after] = w[after]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    first = np.flatnonzero(begins[w])
    size = np.diff(np.append(first, np.count_nonzero(w)))
    b = t[w].astype(np.uint64)
    b *= _POW[(np.arange(len(b)) - np.repeat(first, size)) & 4095]
    return starts, mix(np.add.reduceat(b, first) + size.astype(np.uint64))


def shingles(h: np.ndarray, g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and group of each run of ``k`` words of one group; a group of fewer words has one run of all of them."""
    if not len(h):
        return h, g
    first = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
    size = np.diff(np.append(first, len(g)))
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        s += h[j : j + len(s)] * _MULT[j]
    whole = np.flatnonzero(g[k - 1 :] == g[: len(g) - k + 1]) if len(g) >= k else np.zeros(0, np.int64)
    short = size < k
    at, n = first[short], size[short]
    x = np.zeros(len(at), np.uint64)
    for j in range(k - 1):
        x += np.where(j < n, h[np.minimum(at + j, len(h) - 1)] * _MULT[j], U(0))
    return mix(np.concatenate([s[whole], x + n.astype(np.uint64) * _MULT[k]])), np.concatenate([g[whole], g[at]])


def line_shingles(data: np.ndarray, k: int) -> np.ndarray:
    """The tokens of all lines, each as often as it occurs, in no set order."""
    starts, h = words(data)
    return shingles(h, np.searchsorted(np.flatnonzero(data == 10), starts), k)[0] >> U(64 - TOKEN_BITS)


def token_sets(data: np.ndarray, off: np.ndarray, k: int, by_line: bool, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, or each line, in order of (group, token): group, token, times it occurs; and each group's words.

    Tokens have TOKEN_BITS bits. Lines are numbered through the chunk; each row must end with a line end. ``level`` (a power
    of two of values below 32, by the token's low bits) becomes the five leading bits of a token: low levels come first."""
    starts, h = words(data)
    if by_line:
        ends = np.flatnonzero(data == 10)
        groups, g = len(ends), np.searchsorted(ends, starts)
    else:
        groups, g = len(off) - 1, np.searchsorted(off[1:], starts, "right")
    n_words = np.bincount(g, minlength=groups)
    s, sg = shingles(h, g, k)
    s >>= U(64 - TOKEN_BITS)
    if level is not None:
        s = (level[(s & U(len(level) - 1)).astype(np.int64)].astype(np.uint64) << U(TOKEN_BITS - 5)) | (s >> U(5))
    if groups < 1 << (64 - TOKEN_BITS):
        key = np.sort((sg.astype(np.uint64) << U(TOKEN_BITS)) | s)
        at = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, np.int64)
        group, token = (key[at] >> U(TOKEN_BITS)).astype(np.int64), key[at] & U((1 << TOKEN_BITS) - 1)
    else:
        o = np.lexsort((s, sg))
        s, sg = s[o], sg[o]
        at = np.flatnonzero((np.diff(s, prepend=~s[:1]) != 0) | (np.diff(sg, prepend=-1) != 0))
        group, token = sg[at], s[at]
    return group, token, np.diff(np.append(at, len(s))), n_words


def starts_of(group: np.ndarray) -> np.ndarray:
    """First index of each run of equal values."""
    return np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.zeros(0, np.int64)

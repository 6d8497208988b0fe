"""Byte-pair encoding and decoding of whole texts with a segment tree over the ranks of adjacent pairs.

A text is cut at added tokens and by the vocabulary's pattern into words, a word is a row of byte symbols. The leaves of a
word's segment tree are its adjacent pairs, each with the rank of its merge and its place; an inner node holds the least of
its children, so the root is the leftmost pair of the lowest rank. A merge writes three leaves (the merged pair goes, its
neighbours on both sides get new ranks) and the nodes above them, which is logarithmic in the word's length; a word is done
when its root is empty. Trees of words of like length are the rows of one array, so that numpy takes a step in all of them at
once; words that are done leave the array. Words of more than LONG bytes have a tree of their own on plain lists, where a
step costs less than in an array of one row. A word of any length is encoded whole.

Each task encodes a word once and keeps it (at most CACHE words at a time; it then starts anew). Nothing is shuffled.

Defined cases: a null or empty text has no tokens and decodes to an empty text. Added tokens inside a text become their id,
as the library does it. Ids outside the vocabulary decode to nothing, a null array to an empty text; byte sequences that are
no UTF-8 decode to U+FFFD as the library does it. All columns of the rows are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: The vocabulary file of the registered query.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern that cuts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII only, in terms of the standard library's faster module.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Words a task keeps; leaves of all trees of one array.
CACHE, LEAVES = 1 << 18, 1 << 17
#: Bytes up to which words share an array.
LONG = 256
NONE = np.int64(1) << 62


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow at U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """bytes of each id (``data`` from ``first``), the id of each byte, added tokens, and a hash table of merges: key
    left << 32 | right, rank and the id of what they become."""

    data: np.ndarray
    first: np.ndarray
    of_byte: np.ndarray
    added: dict[str, int]
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    mask: int
    merges: dict[int, tuple[int, int]] | None = None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = _byte_letters()
        ids = told["model"]["vocab"]
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*ids.values(), *added.values()]) + 1
        words = [b""] * size
        for piece, i in ids.items():
            words[i] = bytes(letters[c] for c in piece)
        for piece, i in added.items():
            words[i] = piece.encode()
        of_byte = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        slots = 1 << max(4, int(4 * len(merges)).bit_length())
        keys, ranks, made = np.full(slots, -1, np.int64), np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
        for rank, (a, b) in enumerate(merges):
            key = ids[a] << 32 | ids[b]
            at = _slot(np.array([key], np.int64), slots - 1)[0]
            while keys[at] >= 0 and keys[at] != key:
                at = (at + 1) & (slots - 1)
            if keys[at] < 0:
                keys[at], ranks[at], made[at] = key, rank, ids[a + b]
        sizes = np.array(list(map(len, words)), np.int64)
        return cls(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), of_byte, added, keys, ranks, made, slots - 1)

    def table(self) -> dict[int, tuple[int, int]]:
        """The merges as a dictionary: key to rank and what they become."""
        if self.merges is None:
            at = np.flatnonzero(self.keys >= 0)
            self.merges = dict(zip(self.keys[at].tolist(), zip(self.ranks[at].tolist(), self.made[at].tolist(), strict=True), strict=True))
        return self.merges

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table's slot of each pair's merge, -1 where the pair has none."""
        key = left << 32 | right
        at = _slot(key, self.mask)
        found = self.keys[at]
        out = np.where(found == key, at, -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out


def _slot(key: np.ndarray, mask: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key * np.int64(-7046029254386353131)) >> 24) & mask


class Trees:
    """Segment trees of ``rows`` words with up to ``width`` symbols (a power of two). Symbols keep the place of their first
    byte: ``next`` and ``before`` are the places of a symbol's neighbours (width: none, -1: none)."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary):
        self.v, (rows, self.width) = vocabulary, symbols.shape
        self.symbol, place = symbols, np.arange(self.width)
        self.next = np.where(place + 1 < sizes[:, None], place + 1, self.width)
        self.before = np.broadcast_to(place - 1, symbols.shape).copy()
        self.alive = place < sizes[:, None]
        self.tree = np.full((rows, 2 * self.width), NONE, np.int64)
        r, p = np.nonzero(self.next < self.width)
        self.tree[r, self.width + p] = self._rank(r, p)
        level = self.width
        while level > 1:
            self.tree[:, level // 2 : level] = np.minimum(self.tree[:, level : 2 * level : 2], self.tree[:, level + 1 : 2 * level : 2])
            level //= 2

    def _rank(self, r: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The leaf of the pair that begins at place p: its rank, then its place."""
        at = self.v.merge(self.symbol[r, p], self.symbol[r, self.next[r, p]])
        return np.where(at >= 0, self.v.ranks[at] * self.width + p, NONE)

    def _write(self, r: np.ndarray, p: np.ndarray, leaf: np.ndarray) -> None:
        node = p + self.width
        self.tree[r, node] = leaf
        while node[0] > 1:  # all leaves are on one level
            node = node >> 1
            self.tree[r, node] = np.minimum(self.tree[r, 2 * node], self.tree[r, 2 * node + 1])

    def run(self) -> None:
        rows = np.flatnonzero(self.tree[:, 1] < NONE)
        while len(rows):
            p = self.tree[rows, 1] % self.width
            q = self.next[rows, p]
            self.symbol[rows, p] = self.v.made[self.v.merge(self.symbol[rows, p], self.symbol[rows, q])]
            after = self.next[rows, q]
            self.next[rows, p], self.alive[rows, q] = after, False
            has = after < self.width
            self.before[rows[has], after[has]] = p[has]
            self._write(rows, q, np.full(len(rows), NONE))
            leaf = np.full(len(rows), NONE)
            leaf[has] = self._rank(rows[has], p[has])
            self._write(rows, p, leaf)
            left = self.before[rows, p]
            has = left >= 0
            if has.any():
                self._write(rows[has], left[has], self._rank(rows[has], left[has]))
            rows = rows[self.tree[rows, 1] < NONE]


def merged_alone(symbols: list[int], v: Vocabulary) -> list[int]:
    """The symbols of one word after all merges, by a segment tree on plain lists."""
    find, none = v.table().get, int(NONE)
    n, width = len(symbols), 1 << max(1, len(symbols) - 1).bit_length()
    nexts, before = [*range(1, n + 1)], [*range(-1, n - 1)]

    def leaf(p: int) -> int:
        q = nexts[p]
        told = find(symbols[p] << 32 | symbols[q]) if q < n else None
        return none if told is None else told[0] * width + p

    tree = [none] * width + [leaf(p) for p in range(n)] + [none] * (width - n)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def write(p: int, value: int) -> None:
        node = p + width
        tree[node] = value
        while node > 1:
            value = min(value, tree[node ^ 1])
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    gone = bytearray(n)
    while tree[1] < none:
        p = tree[1] % width
        q = nexts[p]
        symbols[p], gone[q] = find(symbols[p] << 32 | symbols[q])[1], 1
        nexts[p] = nexts[q]
        if nexts[p] < n:
            before[nexts[p]] = p
        write(q, none)
        write(p, leaf(p))
        if before[p] >= 0:
            write(before[p], leaf(before[p]))
    return [s for s, g in zip(symbols, gone, strict=True) if not g]


def encoded_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words laid end to end and how many each word has."""
    raw = [w.encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    first = np.cumsum(size) - size
    symbols = v.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
    kept = np.ones(len(symbols), bool)
    width = 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
    for k in np.flatnonzero(size > LONG).tolist():
        a, b = first[k], first[k] + size[k]
        told = merged_alone(symbols[a:b].tolist(), v)
        symbols[a : a + len(told)], kept[a + len(told) : b] = told, False
    several = (size > 1) & (size <= LONG)
    for w in np.unique(width[several]).tolist():
        every = np.flatnonzero((width == w) & several)
        step = max(1, LEAVES // w)
        for a in range(0, len(every), step):
            rows = every[a : a + step]
            inside = np.arange(w) < size[rows][:, None]
            at = np.where(inside, first[rows][:, None] + np.arange(w), 0)
            trees = Trees(np.where(inside, symbols[at], 0), size[rows], v)
            trees.run()
            symbols[at[inside]], kept[at[inside]] = trees.symbol[inside], trees.alive[inside]
    per = np.add.reduceat(kept, first) if len(words) else np.zeros(0, np.int64)
    return symbols[kept], per.astype(np.int64)


class Encoder:
    """Cuts texts into words and keeps the ids of the words seen last."""

    def __init__(self, v: Vocabulary):
        import re

        import regex

        self.v, self.cut, self.cut_ascii = v, regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.added = re.compile("(" + "|".join(re.escape(t) for t in sorted(v.added, key=len, reverse=True)) + ")") if v.added else None
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.sizes, self.filled, self.known = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32), 0, 0
        self.starts = np.zeros(1 << 14, np.int64)
        if self.v.added:
            self._keep(list(self.v.added), np.array(list(self.v.added.values())), np.ones(len(self.v.added), np.int64))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        for name, more, used in (("ids", len(ids), self.filled), ("sizes", len(sizes), self.known), ("starts", len(sizes), self.known)):
            held = getattr(self, name)
            if used + more > len(held):
                setattr(self, name, np.concatenate([held[:used], np.zeros(max(used, more), held.dtype)]))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.sizes[self.known : self.known + len(sizes)] = sizes
        self.starts[self.known : self.known + len(sizes)] = self.filled + np.cumsum(sizes) - sizes
        self.index.update(zip(words, range(self.known, self.known + len(words)), strict=True))
        self.filled, self.known = self.filled + len(ids), self.known + len(words)

    def _words(self, text: str) -> list[str]:
        if self.added is None or not any(t in text for t in self.v.added):
            # \s of the standard library holds four separators that the vocabulary's does not
            return self.cut_ascii(text) if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else self.cut(text)
        return [w for k, part in enumerate(self.added.split(text)) for w in ([part] if k % 2 else self.cut(part))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts laid end to end and how many each has."""
        if self.known > CACHE:
            self._empty()
        told = [self._words(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in told for w in set(words) if w not in self.index))
        if new:
            self._keep(new, *encoded_words(new, self.v))
        n_words = np.fromiter(map(len, told), np.int64, len(told))
        find = self.index.__getitem__
        which = np.fromiter((i for words in told for i in map(find, words)), np.int64, int(n_words.sum()))
        size = self.sizes[which].astype(np.int64)
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.starts[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate([[0], np.cumsum(n_words)])
        total = np.concatenate([[0], ends])
        return flat, np.diff(total[cut])


def decoded(ids: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> pa.Array:
    """The texts of id arrays laid end to end: their bytes, read as UTF-8."""
    sound = (ids >= 0) & (ids < len(v.first) - 1)
    known = np.where(sound, ids, 0)
    n = np.where(sound, v.first[known + 1] - v.first[known], 0)
    ends = np.cumsum(n)
    data = v.data[np.repeat(v.first[known] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    off = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
    raw = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    try:
        return pc.cast(raw, pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


def _mapped(df: DataFrame, column: str, name: str, kind: T.DataType, make, slice_bytes: int = 1 << 20) -> DataFrame:
    """``df`` with a column ``name`` (replacing one of that name) made from ``column`` by ``make(arrays) -> array``, in slices of
    about ``slice_bytes``."""
    df = df.drop(name) if name != column else df
    inner = free_name(df.columns, "__made")
    rows = df.withColumn(inner, F.col(f"`{column}`"))
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            held = max(1, batch.num_rows * slice_bytes // max(1, batch.column(batch.num_columns - 1).nbytes))
            for a in range(0, batch.num_rows, held):
                part = batch.slice(a, held)
                arrays = [part.column(k) for k in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*arrays, step(part.column(part.num_columns - 1))], names=schema.names)

    return rows.mapInArrow(run, schema)


def encode(df: DataFrame, path: str = VOCABULARY, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` plus ``ids``: array<int>, the tokens of each whole text; added tokens within it are recognised."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def make():
        encoder = Encoder(shared.value)

        def step(texts: pa.Array) -> pa.Array:
            flat, sizes = encoder.encode(texts.to_pylist())
            off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int32)))

        return step

    return _mapped(df, text, ids, T.ArrayType(T.IntegerType()), make)


def decode(df: DataFrame, path: str = VOCABULARY, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` plus ``text``: the text of each array of ids, added tokens included."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def make():
        v = shared.value

        def step(col: pa.Array) -> pa.Array:
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(pc.list_flatten(col), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            return decoded(flat, sizes, v)

        return step

    return _mapped(df, ids, text, T.StringType(), make)


def digests(tokens: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text in UTF-8)."""
    return tokens.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(text).cast("binary"), 256).alias("decoded_sha256"),
    )

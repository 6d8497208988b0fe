"""SentencePiece encoding and decoding by a relational lattice.

1. Texts are cut into words that no piece crosses: wherever two neighbouring characters stand side by side in no piece of
   the vocabulary, no merge can join them. Distinct words are counted over all texts, with partial sums per task.
2. Every substring of a distinct word, up to the longest piece, is exploded and equi-joined to the piece table (as large
   as the vocabulary, so it is broadcast). The matches are the edges of the word's lattice; they are grouped by word.
3. A Spark higher-order ``aggregate`` folds Viterbi over the positions of a word: the best path to each position is the
   best of the paths to the starts of the edges that end there, each lengthened by its edge. The vocabulary is one of
   merges, so a path's cost is not a sum of scores but the set of merges its pieces are made of, in merge order (rank,
   then place); of two sets the one with the least merge that the other lacks is better. That order is kept when the
   same merges are added to both, which is what Viterbi needs, and its best path is what merging by rank does: merging
   always takes the least merge there is. For a vocabulary made by merging, ids therefore equal the library's.
4. The most frequent words (TABLE_WORDS at most, chosen by a count threshold) go to the tasks as one table, packed by the
   executors. Texts of such words only are put together where they are; a text with other words carries the keys of those
   words through joins to the dictionary. Both ways give the same ids.

Characters without a piece become byte pieces (or the unknown piece). Word keys are 128-bit hashes.

Defined cases: null and empty texts have no ids. U+2581 is read as a space, as the library does; any other text decodes to
itself. Words of more than LONG characters are folded by merge rank with a mutable array in the task, as the native fold
copies its state. Rows may repeat; extra columns of any name pass through, those named in ``ADDED`` are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, saved, small_batches, trimmed
from .tokens import U, chunks, column_bytes, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of the table that every task holds: 20 to 25 bytes each, 100 MB at most.
TABLE_WORDS = 1 << 22
LONG = 64
#: Ends every path's list of merges: a path that has one more merge is better.
NO_MERGE = (1 << 63) - 1
CHUNK = 1 << 19
ADDED = ("ids",)
SPACE = "▁"

_POWERS = mix(np.arange(1 << 12, dtype=np.uint64) + U(1)) | U(1)


@dataclass
class Pieces:
    """The vocabulary: scores of the pieces that text can match, each id's text as bytes, ids of byte pieces."""

    score: dict[str, float]
    ids: dict[str, int]
    data: list[bytes]
    byte_ids: list[int]
    unknown: int
    longest: int
    #: The pieces that text can match in merge order: by falling score, then id.
    ordered: list[str]
    #: Of two neighbouring characters, the last byte of one and the first of the other: whether any piece holds such a pair.
    pairs: np.ndarray

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        score, ids, data, byte_ids = {}, {}, [], [-1] * 256
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                data.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                data.append(b"" if not sp.is_unknown(i) else " ⁇ ".encode())
            else:
                score[p], ids[p] = sp.get_score(i), i
                data.append(p.replace(SPACE, " ").encode())
        assert not any(("\n" in p and len(p) > 1) or SPACE in p.lstrip(SPACE) for p in ids), "a piece crosses words"
        pairs = np.zeros((256, 256), bool)
        for p in ids:
            raw = [c.encode() for c in p.replace(SPACE, " ")]
            for a, b in zip(raw, raw[1:], strict=False):
                pairs[a[-1], b[0]] = True
        return Pieces(score, ids, data, byte_ids, sp.unk_id(), max(map(len, ids)), sorted(ids, key=lambda p: (-score[p], ids[p])), pairs.reshape(-1))

    def merges(self) -> list[tuple[str, list[int]]]:
        """The pieces that merging can make with their merges in order: (rank << 32) + characters to the left of the join."""
        rank, out = {p: k for k, p in enumerate(self.ordered)}, []
        for piece in self.ordered:
            edges = sorted((rank[piece[i:j]], i, j) for i in range(len(piece)) for j in range(i + 2, len(piece) + 1) if piece[i:j] in rank)
            ends, made = list(range(1, len(piece) + 1)), []
            for r, i, j in edges:
                middle = ends[i]
                if i < middle < j and ends[middle] == j:
                    ends[i], ends[middle] = j, 0
                    made.append((r << 32) + middle)
            if len(piece) > 1 and ends[0] == len(piece):
                out.append((piece, made))
        return out

    def of_character(self, c: str) -> list[int]:
        """Ids of a character that no merge has taken."""
        if c in self.ids:
            return [self.ids[c]]
        return [self.byte_ids[b] if self.byte_ids[b] >= 0 else self.unknown for b in c.replace(SPACE, " ").encode()]


def prepared(text: Column) -> Column:
    """The text with the leading space that the model adds; empty stays empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text == "", text).otherwise(F.concat(F.lit(" "), F.replace(text, F.lit(SPACE), F.lit(" "))))


def cut(data: np.ndarray, off: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Where the words begin, for rows of prepared bytes laid end to end: at each row and between characters that no piece
    holds side by side (``pairs``)."""
    if not len(data):
        return np.zeros(0, np.int64)
    new = np.zeros(len(data), bool)
    new[1:] = ~pairs[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]] & ((data[1:] & 0xC0) != 0x80)
    new[off[:-1][np.diff(off) > 0]] = True
    return np.flatnonzero(new)


def keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each word, in two halves: two sums over the same products."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    size = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64) - np.repeat(starts.astype(np.int32 if len(data) < 1 << 31 else np.int64), size)
    b = data.astype(np.uint64)
    b += U(1)
    if size.max() > len(_POWERS):
        b *= mix((place >> 12).astype(np.uint64) * U(2) + U(1)) | U(1)
        place &= len(_POWERS) - 1
    b *= _POWERS[place]
    h1 = np.add.reduceat(b, starts)
    b >>= U(29)
    h2 = np.add.reduceat(b, starts)
    return mix(h1 + size.astype(np.uint64)), mix(h2 * U(2) + U(1))


def _substrings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) + np.repeat(start - off[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data[at].tobytes())]).cast(pa.string())


def word_counts(texts: DataFrame, pieces: Pieces) -> DataFrame:
    """word (spaces as U+2581), n: the distinct words of the column ``__text`` and how often each occurs."""
    pairs = pieces.pairs

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(0))
            for i, j in chunks(off, CHUNK):
                part = data[off[i] : off[j]]
                starts = cut(part, off[i : j + 1] - off[i], pairs)
                _, first, n = np.unique(keys(part, starts)[0], return_index=True, return_counts=True)
                size = np.diff(np.append(starts, len(part)))
                yield pa.RecordBatch.from_arrays([_substrings(part, starts[first], size[first]), pa.array(n)], names=["word", "n"])

    counted = texts.select("__text").mapInArrow(count, "word string, n long").select(F.translate("word", " ", SPACE).alias("word"), "n")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, n, edges: array<struct<start, end, merges>>, the pieces of two characters or more found in each word, from
    place ``start`` to place ``end`` (from 0), with their merges: (rank << 32) + place of the join in the word.

    Words are partitioned by word already, so neither the explosion nor the grouping moves them. The empty substring keeps
    words without an edge."""
    made = pieces.merges()
    # an Arrow table becomes rows of the plan; a list would be read by Python workers of their own
    table = words.sparkSession.createDataFrame(pa.table({"piece": ["", *(p for p, _ in made)], "place": pa.array(range(-1, len(made)), pa.int32())}))
    # of each piece: (rank << 8) + place of each merge, to be spread and moved to the edge's start
    merges = F.from_json(F.lit(json.dumps([[(m >> 32 << 8) + (m & 255) for m in ms] for _, ms in made], separators=(",", ":"))), "array<array<bigint>>")
    spans = words.withColumn("s", F.explode(F.sequence(F.lit(0), F.length("word") - 1)))
    most = F.least(F.lit(pieces.longest), F.length("word") - F.col("s"))
    spans = spans.withColumn("l", F.explode(F.sequence(F.when(F.col("s") == 0, 0).otherwise(F.least(F.lit(2), most)), most)))
    spans = spans.where("l <> 1").withColumn("part", F.substring("word", F.col("s") + 1, F.col("l")))
    found = spans.join(F.broadcast(table), F.col("part") == F.col("piece"))
    # what is grouped is one number an edge: piece, start, length
    edge = F.when(F.col("l") > 0, F.shiftleft(F.col("place").cast("long"), 40) + F.shiftleft(F.col("s").cast("long"), 8) + F.col("l"))
    found = found.groupBy("word").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))
    start = lambda x: F.shiftright(x, 8).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    told = lambda x: F.struct(start(x).alias("start"), (start(x) + x.bitwiseAND(F.lit(255)).cast("int")).alias("end"), F.transform(F.get(merges, F.shiftright(x, 40).cast("int")), lambda m: F.shiftleft(F.shiftright(m, 8), 32) + m.bitwiseAND(F.lit(255)) + start(x)).alias("merges"))
    return found.select("word", "n", F.transform("edges", told).alias("edges"))


def viterbi(word: Column, edges: Column) -> Column:
    """The merges of the best path through the word, in merge order, and NO_MERGE: array<long>.

    The fold goes over the places of the word; its state holds the best path to each place so far. A character that no
    edge covers stands alone: the path to its end is the path to its start."""
    end = F.lit(NO_MERGE).cast("long")

    def to_place(state: Column, place: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda x: x["end"] == place), lambda x: F.sort_array(F.concat(F.get(state, x["start"]), x["merges"])))
        return F.concat(state, F.array(F.array_min(F.concat(F.array(F.get(state, place - 1)), ways))))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), F.array(F.array(end)), to_place, lambda state: F.get(state, F.length(word)))


def fold_in_place(n: int, edges: list[tuple[int, int, int]]) -> list[int]:
    """The merges of one long word as from ``viterbi``, from its edges (rank, start, end): merged by rank with a mutable
    state, where the symbol that begins at each place ends (0: none)."""
    ends, made = list(range(1, n + 1)), []
    for rank, start, end in sorted(edges):
        middle = ends[start]
        if start < middle < end and ends[middle] == end:
            ends[start], ends[middle] = end, 0
            made.append((rank << 32) + middle)
    return [*made, NO_MERGE]


def _dtype(pieces: Pieces) -> str:
    return "<u2" if len(pieces.data) <= 1 << 16 else "<i4"


def segmented(words: list[str], paths: pa.Array, pieces: Pieces, id_of_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words laid end to end and how many each word has. ``paths``: the merges of each word."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size) - size
    off = np.frombuffer(paths.buffers()[1], np.int32)[paths.offset : paths.offset + len(paths) + 1].astype(np.int64)
    merge = paths.values.to_numpy()[off[0] : off[-1]]
    own = np.repeat(np.arange(len(words)), np.diff(off))[merge != NO_MERGE]
    merge = merge[merge != NO_MERGE]
    rank = np.full(len(code), -1, np.int64)  # of the merge that joins a character to the one before it
    rank[first[own] + (merge & 0xFFFFFFFF)] = merge >> 32
    begin = np.flatnonzero(rank < 0)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    last = np.maximum.reduceat(rank, begin)  # a symbol's piece is its last merge
    alone = last < 0
    kinds, which = np.unique(code[begin[alone]], return_inverse=True)
    told = [pieces.of_character(chr(c)) for c in kinds.tolist()]
    n_of = np.array(list(map(len, told)), np.int64)
    n_ids = np.ones(len(begin), np.int64)
    n_ids[alone] = n_of[which]
    flat = np.repeat(id_of_rank[last], n_ids)
    if alone.any():
        at = np.repeat((np.cumsum(n_of) - n_of)[which] - (np.cumsum(n_of[which]) - n_of[which]), n_of[which]) + np.arange(n_of[which].sum())
        flat[np.repeat(alone, n_ids)] = np.array([i for ids in told for i in ids], np.int64)[at]
    per_word = np.bincount(np.searchsorted(first, begin, "right") - 1, n_ids, len(words)).astype(np.int64)
    return flat, per_word


def dictionary(words: DataFrame, pieces: Pieces) -> DataFrame:
    """h1, h2, n, ids (as bytes): the segmentation of each distinct word; written to the shared folder."""
    edges = lattice(words, pieces)
    short = F.length("word") <= LONG
    path = F.when(short, viterbi(F.col("word"), F.col("edges"))).otherwise(F.array().cast("array<long>"))
    folded = edges.select("word", "n", path.alias("path"), F.when(~short, F.col("edges")).alias("edges"))
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    @trimmed
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, kind = shared.value, _dtype(shared.value)
        id_of_rank = np.array([p.ids[piece] for piece in p.ordered], np.int64)
        for batch in batches:
            words_, paths = batch.column(0).to_pylist(), batch.column(2)
            long = np.flatnonzero(pc.is_valid(batch.column(3)).to_numpy(zero_copy_only=False))
            if len(long):
                told = paths.to_pylist()
                for r in long.tolist():
                    told[r] = fold_in_place(len(words_[r]), [(x["merges"][-1] >> 32, x["start"], x["end"]) for x in batch.column(3)[r].as_py()])
                paths = pa.array(told, pa.list_(pa.int64()))
            flat, size = segmented(words_, paths, p, id_of_rank)
            ends = np.concatenate([[0], np.cumsum(size)]) * np.dtype(kind).itemsize
            out = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.astype(kind).tobytes())])
            raw = [w.replace(SPACE, " ").encode() for w in words_]
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            h1, h2 = keys(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column(1), out], names=["h1", "h2", "n", "ids"])

    return saved(folded.mapInArrow(resolve, "h1 long, h2 long, n long, ids binary"))


class WordTable:
    """ids of words by key: entries in order of their key's leading bits, told apart by 64 more bits of it."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, bytes_: np.ndarray, raw: np.ndarray, dtype: str):
        self.bits = max(1, int(len(h1)).bit_length() - 1)
        lead = (h1 >> U(64 - self.bits)).astype(np.int32)
        o = np.argsort(lead, kind="stable").astype(np.int32)
        self.index = np.searchsorted(lead[o], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.key = self._key(h1, h2)[o]
        size = bytes_ // np.dtype(dtype).itemsize
        size, begin = size[o], (np.cumsum(size) - size)[o]
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        self.ids = np.empty(int(self.first[-1]), dtype)
        for a in range(0, len(o), 1 << 18):  # in parts, to keep the temporary arrays small
            n = size[a : a + (1 << 18)]
            at = self.first[a : a + len(n)]
            self.ids[at[0] : at[0] + n.sum()] = raw[np.arange(n.sum()) + np.repeat(begin[a : a + (1 << 18)] - (at - at[0]), n)]

    @staticmethod
    def _key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return (h1 << U(32)) | (h2 & U(0xFFFFFFFF))

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        lead, key = (h1 >> U(64 - self.bits)).astype(np.int64), self._key(h1, h2)
        at, end = self.index[lead], self.index[lead + 1]
        out = np.full(len(h1), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        while len(open_):
            hit = self.key[at] == key[open_]
            out[open_[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            open_, at, end = open_[more], at[more], end[more]
        return out


def _table(rows: DataFrame, dtype: str) -> WordTable:
    """The table of ``rows``, which the executors pack into one row of bytes a batch."""

    @trimmed
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = pc.binary_length(batch.column(2)).to_numpy().astype("<u4")
                parts = [batch.column(0).to_numpy().tobytes(), batch.column(1).to_numpy().tobytes(), size.tobytes(), b"".join(batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["h1", "h2", "size", "ids"])

    t = rows.select("h1", "h2", "ids").mapInArrow(pack, "h1 binary, h2 binary, size binary, ids binary").toArrow()
    h1, h2, size, ids = (b"".join(t.column(c).to_pylist()) for c in range(4))
    return WordTable(np.frombuffer(h1, np.uint64), np.frombuffer(h2, np.uint64), np.frombuffer(size, "<u4").astype(np.int64), np.frombuffer(ids, dtype), dtype)


def _threshold(words: DataFrame, most: int) -> tuple[int, bool]:
    """The least count for which at most ``most`` words occur as often, and whether words remain below it."""
    from pyspark.sql import Window

    per = words.groupBy("n").agg(F.count("*").alias("words"))
    least = per.withColumn("held", F.sum("words").over(Window.orderBy(F.col("n").desc()))).agg(F.min(F.when(F.col("held") <= most, F.col("n"))).alias("n"), F.min("n").alias("all")).first()
    if least["all"] is None:
        return 1, False
    return (least["n"], least["n"] > least["all"]) if least["n"] is not None else (1 << 62, True)


def _spaced(text: pa.Array) -> pa.Array:
    """``prepared`` for an Arrow column."""
    text = pc.replace_substring(pc.fill_null(text, ""), SPACE, " ")
    return pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(" ", text, ""))


def encode(docs: DataFrame, path: str = MODEL, table_words: int = TABLE_WORDS, checked: bool = False) -> DataFrame:
    """The rows of ``docs`` (with text) plus ids: array<int>. ``checked`` adds n_ids and round_trip: whether decoding gives
    the text (null: empty) again."""
    docs = docs.drop(*ADDED)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    pieces = Pieces.load(path)
    kind, pairs = _dtype(pieces), pieces.pairs
    words = dictionary(word_counts(docs.select(prepared(F.col("text")).alias("__text")), pieces), pieces)
    least, rest = _threshold(words, table_words)
    shared = spark.sparkContext.broadcast(_table(words.where(F.col("n") >= least), kind))
    bytes_of = spark.sparkContext.broadcast(_piece_bytes(pieces))
    names = docs.columns
    where = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] + ([T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())] if checked else []))

    def word_keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each word, and its key."""
        data, off = column_bytes(text)
        starts = cut(data, off, pairs)
        return np.searchsorted(off[1:], starts, "right"), *keys(data, starts)

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, off = column_bytes(batch.column(where))
        for i, j in chunks(off, CHUNK):
            yield batch.slice(i, j - i)

    def complete(rows: int, row: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Which rows the table has all words of."""
        return np.bincount(row[found < 0], minlength=rows) == 0

    def gathered(rows: int, row: np.ndarray, begin: np.ndarray, size: np.ndarray, source: np.ndarray) -> pa.ListArray:
        ends = np.cumsum(size, dtype=np.int64)
        ids = source[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        per_row = np.bincount(row, size, rows).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), pa.array(ids.astype(np.int32)))

    def with_ids(columns: list[pa.Array], text: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
        more = [ids]
        if checked:
            raw, begin, size = bytes_of.value
            flat = ids.values.to_numpy()
            ends = np.concatenate([[0], np.cumsum(size[flat])])
            data = raw[np.arange(ends[-1]) + np.repeat(begin[flat] - ends[:-1], size[flat])]
            back = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[ids.offsets.to_numpy()].astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            more += [pc.cast(pc.list_value_length(ids), pa.int64()), pc.equal(back, pc.cast(text, pa.large_binary()))]
        return pa.RecordBatch.from_arrays([*columns, *more], names=schema.names)

    @trimmed
    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in slices(batch):
                row, h1, h2 = word_keys(_spaced(part.column(where)))
                at = table.find(h1, h2)
                if rest:
                    whole = complete(part.num_rows, row, at)
                    held = whole[row]
                    place = np.cumsum(whole) - 1
                    row, at, part = place[row[held]], at[held], part.filter(pa.array(whole))
                if (at < 0).any():
                    raise ValueError("a word is missing from the dictionary")
                begin = table.first[at].astype(np.int64)
                yield with_ids(part.columns, _spaced(part.column(where)), gathered(part.num_rows, row, begin, table.first[at + 1] - begin, table.ids))

    done = docs.mapInArrow(in_place, schema)
    if not rest:
        return done

    need, own, told, key = (free_name(names, c) for c in ("need", "own", "told", "key"))

    @trimmed
    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with words that the table lacks, and the keys of those words."""
        for batch in batches:
            for part in slices(batch):
                row, h1, h2 = word_keys(_spaced(part.column(where)))
                at = shared.value.find(h1, h2)
                whole = complete(part.num_rows, row, at)
                place = np.cumsum(~whole) - 1
                once = np.unique(np.stack([place[row[at < 0]], h1[at < 0].view(np.int64), h2[at < 0].view(np.int64)]), axis=1)
                keys_ = pa.StructArray.from_arrays([pa.array(once[1]), pa.array(once[2])], names=["h1", "h2"])
                off = np.concatenate([[0], np.cumsum(np.bincount(once[0], minlength=int((~whole).sum())))]).astype(np.int32)
                part = part.filter(pa.array(~whole))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(off), keys_)], names=[*names, need])

    @trimmed
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in slices(batch):
                text = _spaced(part.column(where))
                row, h1, h2 = word_keys(text)
                at = table.find(h1, h2)
                missing = np.flatnonzero(at < 0)
                one, two, ids = part.column(len(names)).flatten().flatten()
                size = pc.binary_length(ids).to_numpy().astype(np.int64)
                extra = WordTable(one.to_numpy().view(np.uint64), two.to_numpy().view(np.uint64), size, np.frombuffer(b"".join(ids.to_pylist()), kind), kind)
                found = extra.find(h1[missing], h2[missing])
                if (found < 0).any():
                    raise ValueError("a word is missing from the dictionary")
                begin, size = table.first[at].astype(np.int64), (table.first[at + 1] - table.first[at]).astype(np.int64)
                begin[missing], size[missing] = extra.first[found].astype(np.int64) + len(table.ids), extra.first[found + 1] - extra.first[found]
                yield with_ids(part.columns[: len(names)], text, gathered(part.num_rows, row, begin, size, np.concatenate([table.ids, extra.ids])))

    left = docs.mapInArrow(open_, T.StructType([*docs.schema.fields, T.StructField(need, T.ArrayType(T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])))]))
    left = left.withColumn(own, F.xxhash64(need, *[c for c in names if c in ("doc_id", "text")]))
    asked = left.select(F.col(own).alias(key), F.explode(need).alias("w")).select(key, "w.h1", "w.h2").distinct()
    answers = asked.join(words.where(F.col("n") < least).select("h1", "h2", "ids"), ["h1", "h2"]).groupBy(key).agg(F.collect_list(F.struct("h1", "h2", "ids")).alias(told))
    return done.union(left.join(answers, F.col(own) == F.col(key)).select(*[F.col(f"`{c}`") for c in names], told).mapInArrow(joined, schema))


def _piece_bytes(pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array(list(map(len, pieces.data)), np.int64)
    return np.frombuffer(b"".join(pieces.data), np.uint8), np.cumsum(size) - size, size


def decoder(spark: SparkSession, path: str = MODEL):
    """A function of a column of ids that gives the text."""
    shared = spark.sparkContext.broadcast(_piece_bytes(Pieces.load(path)))

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        raw, begin, size = shared.value
        off = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        own = ids.values.to_numpy(zero_copy_only=False)
        out, step = [], 1 << 18
        i = 0
        while i < len(ids):
            j = min(max(i + 1, int(np.searchsorted(off, off[i] + step, "right")) - 1), len(ids))
            part = own[off[i] : off[j]]
            ends = np.concatenate([[0], np.cumsum(size[part])])
            text = raw[np.arange(ends[-1]) + np.repeat(begin[part] - ends[:-1], size[part])].tobytes()
            bounds = ends[off[i : j + 1] - off[i]].tolist()
            out += [text[a + 1 if text[a : a + 1] == b" " else a : b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]
            i = j
        return pa.array(out, pa.string())

    return decoded


def encoded_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """The rows of ``docs`` plus ids, n_ids and round_trip."""
    return encode(docs.drop("n_ids", "round_trip"), path, checked=True)

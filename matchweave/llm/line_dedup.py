"""Line dedup by an exact set-similarity join over the lines of all documents.

A line is the set of its five-word shingles (its tokens). Tokens have one global order, rarest first (by a bounded
table of hashed counts over all lines, less the table's mean load, so that frequent tokens stand out at any size; ties by
hash). Two lines with Jaccard similarity of SIMILARITY or more share a token in their prefixes of n - ceil(0.8 n) + 1
tokens, so only prefix tokens are shuffled and matched. Length and positional filters drop pairs that cannot reach the
threshold, and so does a count: the prefixes of similar sets share more tokens the closer their sizes are, and how many
two prefixes share at most is read from their lengths and from 64 parities. The rest are verified on whole token sets.

A line goes if a line that comes before it in (doc_id, line number) order is the same set or is similar to it. Lines of
the same set are one class before any pair is made. Each class is compared with the most frequent class that shares a
prefix token; a class that this doesn't remove is then compared with every earlier class that shares one, so no link to
an earlier line is missed. Similar sets that differ share four tokens or more, so two of them among prefixes that are
one token longer: where more than HOT classes share a token, they meet by that token and a later one.

Texts are read three times: for the counts, for lines and prefixes at once, and, only where a checksum of the line is
wanted, for the token sets that are verified (twice).

Lines split at \\n. Lines of fewer than SHINGLE words have one shingle, all of their words: an exact repeat goes, nothing
else can match. Lines of fewer than ``min_words`` words always stay (MIN_WORDS unless the caller says otherwise; op8 and
the pipeline say 1), so do lines without words and null and empty texts (as empty texts). Rows of a null doc_id keep all
their lines and remove none elsewhere. A document id that occurs in several rows loses the same line numbers in each.
Extra columns of any name are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, saved, small_batches, summed_table, trimmed, with_newline
from .tokens import U, chunks, column_bytes, line_shingles, mix, starts_of, token_sets

SHINGLE = 5
MIN_WORDS = 5
COUNT_BUCKETS = 1 << 19
#: Bits of the filter of wanted lines: 32 a line, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Classes that may share a prefix token before a second token is asked for.
HOT = 256
#: Bytes below which no line has SHINGLE words.
SHORTEST = 9


def prefix_size(n: np.ndarray) -> np.ndarray:
    """n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def _similar(n_x: F.Column, i: F.Column, n_y: F.Column, j: F.Column) -> F.Column:
    """Length filter, and positional filter for tokens at places i and j (from 0): at most 1 + what follows is shared."""
    need = F.ceil(4 * (n_x + n_y) / 9 - 1e-9)
    return (5 * n_x >= 4 * n_y) & (5 * n_y >= 4 * n_x) & (1 + F.least(n_x - i, n_y - j) - 1 >= need)


def _enough(n_x: F.Column, kept_x: F.Column, bits_x: F.Column, n_y: F.Column, kept_y: F.Column, bits_y: F.Column) -> F.Column:
    """Count filter. Of the longer prefix of a set all tokens but n less what must be shared are shared, and those up to the
    lesser of the two last tokens lie in both prefixes. ``kept`` and ``bits``: how many tokens of it other sets' prefixes have too,
    and the parities of how many fall on each of 64 bits; these differ in no more bits than the prefixes differ in tokens."""
    longer = lambda n: F.least(n, n - F.ceil(4 * n / 5 - 1e-9) + 2)
    need = F.ceil(4 * (n_x + n_y) / 9 - 1e-9)
    return kept_x + kept_y - F.bit_count(bits_x.bitwiseXOR(bits_y)) >= 2 * (need + F.least(longer(n_x) - n_x, longer(n_y) - n_y))


def token_levels(docs: DataFrame) -> np.ndarray:
    """How frequent the tokens of each hashed bucket are, 0 to 31: the logarithm of their number above the mean."""

    def fill(batch: pa.RecordBatch, counts: np.ndarray) -> None:
        data, off = column_bytes(batch.column(0))
        for i, j in chunks(off):
            token = line_shingles(data[off[i] : off[j]], SHINGLE)
            counts += np.bincount((token & U(COUNT_BUCKETS - 1)).astype(np.int64), minlength=COUNT_BUCKETS)

    counts = summed_table(docs.select(with_newline("text").alias("text")), fill, COUNT_BUCKETS)
    return np.minimum(31, np.ceil(np.log2(np.maximum(counts - int(counts.mean()), 0) + 1))).astype(np.uint8)


def _set_hash(token: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each set of tokens, which begin at ``first``."""
    return (mix(np.add.reduceat(mix(token), first) + size.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)).view(np.int64)


def _once(hashes: np.ndarray) -> np.ndarray:
    once = np.zeros(len(hashes), bool)
    once[np.unique(hashes, return_index=True)[1]] = True
    return once


def _line_parts(docs: DataFrame, levels: np.ndarray, min_words: int) -> DataFrame:
    """One shuffle of the rows that say where lines are and which tokens are in their prefixes; written to the shared folder.

    Rows (key, other, info): a line has the hash of its set, its document, and -1 - (checksum << 31) - line number; a
    token in the prefix (one longer than ``prefix_size``) of a set has itself, the hash of the set, (size << 32) + place.
    Rows arrive sorted, so tokens that only one set has are dropped as they pass."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, off_all = column_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in chunks(off_all):
                data, off = texts[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
                group, token, _, words = token_sets(data, off, SHINGLE, True, shared.value)
                ends = np.flatnonzero(data == 10)
                doc = np.searchsorted(off[1:], ends, "right")
                first = starts_of(group)
                line, size = group[first], np.diff(np.append(first, len(group)))
                own = _set_hash(token, first, size)
                at = np.flatnonzero(words[line] >= min_words)
                raw, begins = memoryview(data.tobytes()), np.concatenate([[0], ends[:-1] + 1])
                check = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(begins[line[at]].tolist(), ends[line[at]].tolist(), strict=True)), np.int64, len(at))
                number = line[at] - np.searchsorted(doc, doc[line[at]])
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(ids[i:j][doc[line[at]]]), pa.array(-1 - ((check << 31) | number))], names=names)
                place = np.arange(len(token)) - np.repeat(first, size)
                take = (place <= np.repeat(prefix_size(size), size)) & np.repeat(_once(own) & (words[line] >= SHINGLE), size)
                yield pa.RecordBatch.from_arrays([pa.array(token[take].view(np.int64)), pa.array(np.repeat(own, size)[take]), pa.array((np.repeat(size, size)[take] << 32) | place[take])], names=names)

    @trimmed
    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last token row, and whether its token has been seen with another set
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            is_line = cols[2] < 0
            if is_line.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[is_line]) for c in cols], names=names)
            cols = [c[~is_line] for c in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held[0], cols, strict=True)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)
            cols = [c[new] for c in cols]
            same = cols[0][1:] == cols[0][:-1]
            some = np.zeros(len(cols[0]), bool)
            some[1:] |= same
            some[:-1] |= same
            some[0] |= held is not None and held[1]
            held = [c[-1:].copy() for c in cols], bool(some[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][some[:-1]]) for c in cols], names=names)
        if held is not None and held[1]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=names)

    names, kind = ["key", "other", "info"], "key long, other long, info long"
    parts = docs.select("doc_id", with_newline("text").alias("text")).mapInArrow(cut, kind)
    return saved(parts.repartition("key").sortWithinPartitions("key", "other").mapInArrow(shared_only, kind))


def _verified(pairs: DataFrame, docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """The pairs (x, y) of set hashes, with the checksums x_check and y_check of a line of each, whose Jaccard similarity is
    0.8 or more."""
    context = docs.sparkSession.sparkContext
    wanted = saved(pairs.select(F.col("x").alias("set_hash"), F.col("x_check").alias("check")).union(pairs.select("y", "y_check")).distinct())
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * wanted.count()).bit_length()))
    bits, rare = context.broadcast(_filter_bits(wanted.select("check"), size)), context.broadcast(levels)

    @trimmed
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, off = column_bytes(batch.column(0))
            for i, j in chunks(off):
                data = texts[off[i] : off[j]]
                ends = np.flatnonzero(data == 10)
                begins = np.concatenate([[0], ends[:-1] + 1])
                some = ends - begins >= SHORTEST
                begins, ends = begins[some], ends[some]
                raw = memoryview(data.tobytes())
                check = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)), np.int64, len(ends)) & (size - 1)
                hit = np.flatnonzero((bits.value[check >> 3] >> (check & 7).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                lines = np.frombuffer(b"".join(raw[a : b + 1] for a, b in zip(begins[hit].tolist(), ends[hit].tolist(), strict=True)), np.uint8)
                group, token, _, _ = token_sets(lines, np.array([0, len(lines)]), SHINGLE, True, rare.value)
                first = starts_of(group)
                n = np.diff(np.append(first, len(group)))
                own = _set_hash(token, first, n)
                at = np.flatnonzero(_once(own))
                tokens = token.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array([tokens[8 * a : 8 * (a + k)] for a, k in zip(first[at].tolist(), n[at].tolist(), strict=True)], pa.binary())], names=["set_hash", "tokens"])

    sets = docs.select(with_newline("text").alias("text")).mapInArrow(sets_of, "set_hash long, tokens binary")
    hashes = wanted.select("set_hash").distinct()
    sets = saved(sets.join(hashes.hint("shuffle_hash"), "set_hash", "left_semi").groupBy("set_hash").agg(F.any_value("tokens").alias("tokens")))

    @trimmed
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r, (a, b) in enumerate(zip(batch.column("tokens_x"), batch.column("tokens_y"), strict=True)):
                p, q = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep[r] = 5 * both >= 4 * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(keep)), batch.column("y").filter(pa.array(keep))], names=["x", "y"])

    x, y = (sets.select(F.col("set_hash").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "xy")
    return pairs.select("x", "y").join(x, "x").join(y, "y").select("x", "y", "tokens_x", "tokens_y").mapInArrow(verify, "x long, y long")


def _filter_bits(checks: DataFrame, size: int) -> np.ndarray:
    """A filter of one hash over the checksums, of ``size`` bits; a false hit costs time only."""

    @trimmed
    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(size, bool)
        for batch in batches:
            on[batch.column(0).to_numpy() & (size - 1)] = True
        parts = np.packbits(on, bitorder="little").reshape(16, -1)
        used = [k for k in range(16) if parts[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["part", "bits"])

    def either(key, pdf):
        import pandas as pd

        out = np.zeros(size // 128, np.uint8)
        for b in pdf["bits"]:
            out |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"part": [key[0]], "bits": [out.tobytes()]})

    out = np.zeros((16, size // 128), np.uint8)
    for r in checks.mapInArrow(set_bits, "part int, bits binary").groupBy("part").applyInPandas(either, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _is_prefix(n: F.Column, place: F.Column) -> F.Column:
    """Whether a place lies in the prefix of ``prefix_size`` tokens, not in the one after it."""
    return place < n - F.ceil(4 * n / 5 - 1e-9) + 1


def _later_pairs(base: DataFrame, shared: DataFrame, gone: DataFrame) -> DataFrame:
    """x, y, x_check, y_check: a set that isn't in ``gone`` and an earlier one that shares a prefix token (and, where more
    than HOT sets do, a later token of the longer prefixes), as far as length, places and counts allow. Pairs may repeat."""
    left = gone.select(F.col("set_hash").alias("gone_hash"))

    def met(rows: DataFrame, keys: list[str]) -> DataFrame:
        x, y = rows.join(left, F.col("set_hash") == F.col("gone_hash"), "left_anti").alias("x"), rows.alias("y")
        same = F.col("x.token") == F.col("y.token")
        for k in keys:
            same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
        enough = _enough(*[F.col(f"{side}.{c}") for side in "xy" for c in ("n", "kept", "bits")])
        pairs = x.join(y, same & (F.col("x.at") > F.col("y.at")) & _similar(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place")) & enough)
        return pairs.select(F.col("x.set_hash").alias("x"), F.col("y.set_hash").alias("y"), F.col("x.at.check").alias("x_check"), F.col("y.at.check").alias("y_check"))

    second = shared.select(F.col("set_hash").alias("own"), F.col("token").alias("token2"))
    hot = base.where(F.col("m") > HOT).join(second, (F.col("set_hash") == F.col("own")) & (F.col("token") < F.col("token2"))).drop("own")
    return met(base.where(F.col("m") <= HOT), []).union(met(hot, ["token2"]))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, lines: the sorted numbers (from 0) of the lines that go, for each document that loses any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    small_batches(docs.sparkSession)
    levels = token_levels(docs)
    parts = _line_parts(docs, levels, min_words)
    where = -1 - F.col("info")
    lines = parts.where("info < 0").select(F.col("key").alias("set_hash"), F.col("other").alias("doc_id"), where.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("line"), F.shiftright(where, 31).alias("check"))
    shared = parts.where("info >= 0").select(F.col("key").alias("token"), F.col("other").alias("set_hash"), F.shiftright("info", 32).cast("int").alias("n"), F.col("info").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"))
    classes = saved(lines.groupBy("set_hash").agg(F.min(F.struct("doc_id", "line", "check")).alias("at"), F.count("*").alias("times")))
    of_set = Window.partitionBy("set_hash")
    marked = shared.withColumns({"kept": F.count("*").over(of_set), "bits": F.bit_xor(F.expr("shiftleft(1L, CAST(token & 63 AS INT))")).over(of_set)})
    rows = saved(marked.where(_is_prefix(F.col("n"), F.col("place"))).join(classes, "set_hash"))
    leader = rows.groupBy("token").agg(F.max_by(F.struct("set_hash", "n", "place", "at", "kept", "bits"), F.struct("times", "set_hash")).alias("y"), F.count("*").alias("m"))
    leader = saved(leader)
    enough = _enough(*[F.col(f"{side}{c}") for side in ("", "y.") for c in ("n", "kept", "bits")])
    near = rows.join(leader, "token").where((F.col("set_hash") != F.col("y.set_hash")) & _similar(F.col("n"), F.col("place"), F.col("y.n"), F.col("y.place")) & enough)
    one = saved(near.select(F.col("set_hash").alias("x"), F.col("at").alias("x_at"), F.col("y.set_hash").alias("y"), F.col("y.at").alias("y_at")).distinct())
    linked = _verified(one.select("x", "y", F.col("x_at.check").alias("x_check"), F.col("y_at.check").alias("y_check")), docs, levels)
    later = F.when(F.col("x_at") > F.col("y_at"), F.col("x")).otherwise(F.col("y"))
    gone = saved(one.join(linked, ["x", "y"]).select(later.alias("set_hash")).distinct())
    tried = one.select("x", "y").union(one.select(F.col("y").alias("x"), F.col("x").alias("y")))
    pairs = saved(_later_pairs(rows.join(leader.select("token", "m"), "token"), shared, gone).distinct().join(tried, ["x", "y"], "left_anti"))
    if not pairs.isEmpty():
        gone = gone.union(_verified(pairs, docs, levels).select("x")).distinct()
    flagged = classes.join(gone.withColumn("gone", F.lit(True)), "set_hash", "left").where("gone or times > 1")
    hit = lines.join(flagged, "set_hash").where(F.coalesce("gone", F.lit(False)) | (F.col("doc_id") != F.col("at.doc_id")) | (F.col("line") != F.col("at.line")))
    return hit.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _bound(value: F.Column, f: Callable[[F.Column], F.Column]) -> F.Column:
    """``f`` of a value that is computed once. A column made before would not do: a caller's filter on the result is pushed below
    it, and then the value stands in every place, in lambdas too, where the text would be split again for each line."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dedup_lines(docs: DataFrame, count: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the lines that go, in the same columns; ``count`` names a column for the number of lines removed."""
    names = docs.columns
    doc, lines = (free_name(names, c) for c in ("doc", "lines"))
    gone = removed_lines(docs, min_words).select(F.col("doc_id").alias(doc), F.col("lines").alias(lines))
    out = docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == F.col(doc), "left")
    parts = F.split("text", "\n")
    going = lambda n: F.filter(F.col(lines), lambda i: i < n)
    run = lambda p, b, j: F.slice(p, F.get(b, j - 1) + 2, F.get(b, j) - F.get(b, j - 1) - 1)
    rest = lambda p, b: F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda j: run(p, b, j))), "\n")
    kept = _bound(parts, lambda p: _bound(F.concat(F.array(F.lit(-1)), going(F.size(p)), F.array(F.size(p))), lambda b: rest(p, b)))
    text = F.when(F.col(lines).isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)
    extra = [] if count is None else [F.when(F.col(lines).isNull(), 0).otherwise(_bound(F.size(parts), lambda n: F.size(going(n)))).alias(count)]
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], *extra)

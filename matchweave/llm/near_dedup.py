"""MinHash near-dedup: improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

1. A bounded table counts, for hashed shingle buckets, the documents that hold them (all documents are counted).
2. Each text becomes the weighted set of its distinct five-word shingles: weight = times it occurs x idf. The idf falls
   from 1 to ``IDF_FLOOR`` as a shingle's share of the documents rises from ``IDF_FROM`` to all of them, so boilerplate
   counts for less and a group of copies stays similar however large it is.
3. ICWS draws ``ROWS`` consistent samples for each of ``BANDS`` bands (the samples of a band come from disjoint hash
   classes of the shingles, so a shingle is evaluated once per band), and a band's samples form one join key.
4. Texts of the same words are one class before any pair is made. In each bucket every class is compared with the
   bucket's most central class. What that leaves unconnected is compared pair by pair; in large buckets in blocks, which
   give a spanning forest of their links instead of rows for all pairs.
5. Pairs are verified by weighted Jaccard similarity, and links become components.

Null, empty and wordless texts link with nothing. A text of fewer than five words has one shingle, all of its words.
Rows may repeat and other columns may have any name; a document id that occurs twice counts as one document. Rows of a null
doc_id are compared with nothing: they have no class or component and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, summed_table, trimmed, with_newline
from .components import Forest, connected_components
from .tokens import U, chunks, column_bytes, mix, starts_of, token_sets

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 12
ROWS = 4
DF_BUCKETS = 1 << 18
IDF_FROM = 0.05
IDF_FLOOR = 0.8
#: Open buckets of HEAVY or more (members x components) are compared in groups of GROUP members, COLUMNS shingles at a time.
HEAVY = 2048
GROUP = 128
COLUMNS = 1 << 14


def _gamma2_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), by bisection of 1 - exp(-x)(1 + x)."""
    q = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_R = _gamma2_quantiles(1 << 12).astype(np.float32)
_LN_C = np.log(_gamma2_quantiles(1 << 16)).astype(np.float32)


def document_counts(docs: DataFrame) -> np.ndarray:
    """For each hashed bucket, in how many documents its shingles occur; the last entry counts the documents."""

    def fill(batch: pa.RecordBatch, counts: np.ndarray) -> None:
        data, off = column_bytes(batch.column(0))
        for i, j in chunks(off):
            _, token, _, _ = token_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], SHINGLE, False)
            counts[:DF_BUCKETS] += np.bincount((token & U(DF_BUCKETS - 1)).astype(np.int64), minlength=DF_BUCKETS)
        counts[DF_BUCKETS] += batch.num_rows

    return summed_table(docs.select("text"), fill, DF_BUCKETS + 1)


def idf_table(counts: np.ndarray) -> np.ndarray:
    """1 up to IDF_FROM of the documents, then falling with the logarithm to IDF_FLOOR; buckets' mean load is taken off."""
    n = max(1, int(counts[-1]))
    share = np.clip((counts[:-1] - counts[:-1].mean()) / n, IDF_FROM, 1.0)
    return (IDF_FLOOR + (1 - IDF_FLOOR) * np.log(share) / np.log(IDF_FROM)).astype(np.float32)


def _weights(token: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return tf.astype(np.float32) * idf[(token & U(DF_BUCKETS - 1)).astype(np.int64)]


def band_keys(token: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band. ``first``: where each set begins."""
    ln_s = np.log(weight)
    keys = np.empty((len(first), BANDS), np.uint64)
    for b in range(BANDS):
        u = mix(token ^ mix(np.full(1, b + 1, np.uint64)))
        r = _R[(u & U(4095)).astype(np.int64)]
        beta = ((u >> U(12)) & U(4095)).astype(np.float32) * np.float32(1 / 4096)
        t = np.floor(ln_s / r + beta)
        ln_a = _LN_C[((u >> U(24)) & U(65535)).astype(np.int64)] - r * (t - beta + 1)
        rank = np.maximum(ln_a + np.float32(64), np.float32(0)).view(np.uint32).astype(np.uint64) << U(32)
        rank |= (mix(token * U(2 * b + 3)) + t.astype(np.int64).astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(32)
        part = (u >> U(62)).astype(np.uint8) if ROWS == 4 else ((u >> U(40)) % U(ROWS)).astype(np.uint8)
        key = np.full(len(first), b, np.uint64)
        for k in range(ROWS):
            least = np.minimum.reduceat(np.where(part == k, rank, ~U(0)), first)
            key = mix(key * U(31) + (least & U(0xFFFFFFFF)))
        keys[:, b] = key
    return keys.view(np.int64)


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, h1 and h2 (128 bits that name the text's words in order), keys (one per band; none without words)."""
    table = docs.sparkSession.sparkContext.broadcast(idf)

    @trimmed
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            for i, j in chunks(off):
                own, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                group, token, tf, _ = token_sets(own, at, SHINGLE, False)
                h1, h2 = _text_hashes(own, at)
                first = starts_of(group)
                lists = np.zeros(j - i + 1, np.int64)
                keys = np.zeros(0, np.int64)
                if len(group):
                    keys = band_keys(token, _weights(token, tf, table.value), first).reshape(-1)
                    lists[group[first] + 1] = BANDS
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(np.cumsum(lists).astype(np.int32)), pa.array(keys))],
                    names=["doc_id", "h1", "h2", "keys"],
                )

    return docs.select("doc_id", with_newline("text").alias("text")).mapInArrow(sign, "doc_id long, h1 long, h2 long, keys array<long>")


def _text_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from .tokens import words

    starts, h = words(data)
    n = len(off) - 1
    out = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    if len(h):
        g = np.searchsorted(off[1:], starts, "right")
        first = starts_of(g)
        pos = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        for k in range(2):
            out[k][g[first]] = np.add.reduceat(mix(h ^ mix(pos.astype(np.uint64) * U(2) + U(k + 1))), first)
    return out[0].view(np.int64), out[1].view(np.int64)


def _verified(pairs: DataFrame, docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """The pairs (a, b) of document ids whose texts' weighted Jaccard similarity is SIMILARITY or more."""
    table = docs.sparkSession.sparkContext.broadcast(idf)

    @trimmed
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [column_bytes(batch.column(c)) for c in ("text_a", "text_b")]
            keep = np.zeros(batch.num_rows, bool)
            bound = sides[0][1] + sides[1][1]
            for i, j in chunks(bound):
                group, token, weight = [], [], []
                for data, off in sides:
                    g, t, tf, _ = token_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], SHINGLE, False)
                    group.append(g)
                    token.append(t)
                    weight.append(_weights(t, tf, table.value).astype(np.float64))
                total = np.bincount(group[0], weight[0], j - i) + np.bincount(group[1], weight[1], j - i)
                g, t, w = np.concatenate(group), np.concatenate(token), np.concatenate(weight)
                o = np.lexsort((t, g))
                g, t, w = g[o], t[o], w[o]
                twice = np.flatnonzero((g[1:] == g[:-1]) & (t[1:] == t[:-1]))
                both = np.bincount(g[twice], np.minimum(w[twice], w[twice + 1]), j - i)
                keep[i:j] = (both > 0) & (both >= SIMILARITY * (total - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = saved(docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left_semi"))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), with_newline("text").alias("text_b"))
    return pairs.join(a, "a").withColumn("text_a", with_newline("text_a")).join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _open_buckets(members: DataFrame, part: DataFrame) -> DataFrame:
    """The members of buckets that hold several components: band, key, class_id, component; how many members and
    components the bucket has, its largest component (main) and that one's size."""
    placed = members.join(part, members.class_id == part.id, "left").select("band", "key", "class_id", F.coalesce("component", "class_id").alias("component"))
    sizes = placed.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    first = F.max(F.struct("n", F.col("component").alias("main")))
    open_ = sizes.groupBy("band", "key").agg(F.sum("n").alias("members"), F.count("*").alias("components"), first.alias("first")).where("components > 1")
    return placed.join(open_, ["band", "key"]).select("band", "key", "class_id", "component", "members", "components", F.col("first.main").alias("main"), F.col("first.n").alias("main_size"))


def _block_links(heavy: DataFrame, docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links (a, b) between different components of large buckets: a spanning forest of them, not all pairs.

    A bucket's classes outside its main component, and those inside, are dealt into groups of about GROUP; each pair of
    groups that holds untried pairs is one unit, compared with matrix products in one task.
    """
    table = docs.sparkSession.sparkContext.broadcast(idf)

    @trimmed
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            for i, j in chunks(off):
                group, token, tf, _ = token_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], SHINGLE, False)
                again = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
                own = np.repeat(_weights(token, np.ones_like(tf), table.value), tf)
                token = mix(np.repeat(token, tf) * U(0x9E3779B97F4A7C15) + again.astype(np.uint64))
                bounds = np.searchsorted(np.repeat(group, tf), np.arange(j - i + 1))
                raw, weights = token.astype("<u8").tobytes(), own.astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([raw[8 * p : 8 * q] for p, q in zip(bounds, bounds[1:], strict=False)], pa.binary()), pa.array([weights[4 * p : 4 * q] for p, q in zip(bounds, bounds[1:], strict=False)], pa.binary())],
                    names=["class_id", "tokens", "weights"],
                )

    def compare(key, t):
        ids, inside = t.column("class_id").to_numpy(), t.column("inside").to_numpy(zero_copy_only=False)
        component = t.column("component").to_numpy()
        token = [np.frombuffer(x, "<u8") for x in t.column("tokens").to_pylist()]
        size = np.array([len(x) for x in token])
        row, token = np.repeat(np.arange(len(ids)), size), np.concatenate(token)
        weight = np.concatenate([np.frombuffer(x, "<f4") for x in t.column("weights").to_pylist()]).astype(np.float64)
        total = np.bincount(row, weight, len(ids))
        _, place, times = np.unique(token, return_inverse=True, return_counts=True)
        column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
        both = np.zeros((len(ids), len(ids)))
        order = np.argsort(column, kind="stable")
        order = order[column[order] >= 0]
        for begin in range(0, int((times > 1).sum()), COLUMNS):
            at = order[np.searchsorted(column[order], begin) : np.searchsorted(column[order], begin + COLUMNS)]
            some = np.zeros((len(ids), COLUMNS))
            some[row[at], column[at] - begin] = np.sqrt(weight[at])
            both += some @ some.T
        near = (both > 0) & (both >= SIMILARITY * (total[:, None] + total[None, :] - both) - 1e-9)
        near &= (component[:, None] != component[None, :]) & ~(inside[:, None] & inside[None, :])
        p, q = np.nonzero(np.triu(near, 1))
        forest = Forest(len(ids))
        forest.add(p, q)
        child = np.flatnonzero(forest.label != np.arange(len(ids)))
        a, b = ids[child], ids[forest.label[child]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    wanted = heavy.select(F.col("class_id").alias("doc_id")).distinct()
    texts = docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", with_newline("text").alias("text"))
    token_rows = saved(texts.mapInArrow(sets, "class_id long, tokens binary, weights binary").dropDuplicates(["class_id"]))
    inside = F.col("component") == F.col("main")
    groups = lambda n: F.greatest(F.lit(1), F.ceil(n / GROUP)).cast("int")
    dealt = heavy.withColumns({"inside": inside, "of_main": groups(F.col("main_size")), "of_rest": groups(F.col("members") - F.col("main_size"))})
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class_id"), F.when(F.col("inside"), F.col("of_main")).otherwise(F.col("of_rest"))).cast("int"))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("of_rest") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.lit(False).alias("to_main"), F.greatest(F.col("own"), j).alias("j")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("of_main") - 1), lambda j: F.struct(F.col("own").alias("i"), F.lit(True).alias("to_main"), j.alias("j")))
    from_main = F.transform(F.sequence(F.lit(0), F.col("of_rest") - 1), lambda i: F.struct(i.alias("i"), F.lit(True).alias("to_main"), F.col("own").alias("j")))
    units = dealt.withColumn("unit", F.explode(F.when(F.col("inside"), from_main).otherwise(F.concat(with_rest, with_main))))
    return units.join(token_rows, "class_id").groupBy("band", "key", "unit").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (least id with the same words), component_id (least id reachable by
    links), kept (doc_id = component_id)."""
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = every.where("doc_id is not null")
    small_batches(docs.sparkSession)
    idf = idf_table(document_counts(docs.select(with_newline("text").alias("text"))))
    sig = saved(signatures(docs, idf))
    some = sig.where("size(keys) > 0")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.any_value("keys").alias("keys"))
    classes = saved(classes)
    keyed = classes.select("class_id", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    members = saved(keyed.join(shared, ["band", "key"]))
    central = members.groupBy("class_id").agg(F.sum("m").alias("weight"))
    members = saved(members.join(central, "class_id").select("band", "key", "class_id", "weight"))
    leaders = members.groupBy("band", "key").agg(F.max_by("class_id", F.struct("weight", -F.col("class_id"))).alias("leader"))
    star = members.join(leaders, ["band", "key"]).where("class_id <> leader").select(F.least("class_id", "leader").alias("a"), F.greatest("class_id", "leader").alias("b"))
    star = saved(star.distinct())
    links = saved(_verified(star, docs, idf))
    part = connected_components(links, "a", "b")
    rest = saved(_open_buckets(members, part))
    x, y = (rest.where(F.col("members") * F.col("components") < HEAVY).alias(c) for c in "xy")
    at = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.class_id") < F.col("y.class_id")) & (F.col("x.component") != F.col("y.component"))
    pairs = saved(x.join(y, at).select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    heavy = rest.where(F.col("members") * F.col("components") >= HEAVY)
    more = [saved(f) for f in ([] if pairs.isEmpty() else [_verified(pairs, docs, idf)]) + ([] if heavy.isEmpty() else [_block_links(heavy, docs, idf)])]
    for new in more:
        links = links.union(new)
    part = connected_components(links, "a", "b") if more else part
    named = sig.select("doc_id", "h1", "h2", (F.size("keys") > 0).alias("some")).join(classes.select("h1", "h2", "class_id"), ["h1", "h2"], "left")
    named = named.select("doc_id", F.when(F.col("some"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    out = named.join(part, named.class_id == part.id, "left")
    out = out.select("doc_id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    none = F.lit(None).cast("long")
    unnamed = every.where("doc_id is null").select("doc_id", none.alias("class_id"), none.alias("component_id"))
    return out.union(unnamed).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents but for those whose component has a smaller document id; all columns stay."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == F.col("__gone"), "left_anti")

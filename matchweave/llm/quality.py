"""Quality classifier: document evidence combined with site and path posteriors by hierarchical empirical Bayes.

1. Two logistic classifiers, for good quality and for toxicity, are fitted in numpy to a bounded sample of the labelled
   documents (TRAIN_DOCS, those of the least id hashes). Features are the presence of the hashed words that differ most
   between the classes and a few ratios of the whole text.
2. Every document gets both probabilities. They are summed per path (source and lang) and per site (source), with
   partial sums before the shuffle.
3. A site's rate is a Beta posterior whose prior is the global rate; its strength comes from the spread between sites by
   the method of moments. A path's rate is a Beta posterior around its site's. Sparse sites and paths so stay near the
   level above.
4. A document's log odds are its evidence plus (log odds of its path's rate - log odds of the global rate). It is kept if
   the posterior of quality is 0.5 or more and that of toxicity below 0.5.

Defined cases: null and empty texts and texts without words are rejected, with posterior quality 0. A null source or lang is a
site or path of its own. Without labels of both kinds a head says 0.5 (quality) or 0 (toxicity) for all. Repeated rows count
each. Labels of a document that occurs twice are used twice. Other columns of any name pass through ``kept_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, trimmed, with_newline
from .tokens import U, chunks, column_bytes, starts_of, words

TRAIN_DOCS = 6000
WORD_BUCKETS = 1 << 18
SELECTED = 2000
RATIOS = 7
SITE = "source"
PATH = "lang"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each word, the ratios of each row, and each row's words. Rows end with a line end."""
    n = len(off) - 1
    starts, h = words(data)
    row = np.searchsorted(off[1:], starts, "right")
    bucket = (h & U(WORD_BUCKETS - 1)).astype(np.int64)
    count = np.bincount(row, minlength=n)
    size = np.maximum(1, np.diff(off))
    sums = lambda flags: np.add.reduceat(np.append(flags, 0), off[:-1])  # noqa: E731  every row has a byte
    alnum = sums(_ALNUM[data].astype(np.int64))
    marks = sums((~_ALNUM[data] & ~_SPACE[data]).astype(np.int64))
    lines = sums((data == 10).astype(np.int64))
    again = [np.bincount(row[k:][(bucket[k:] == bucket[:-k]) & (row[k:] == row[:-k])], minlength=n) if len(row) > k else np.zeros(n) for k in (1, 2)]
    some = np.maximum(1, count)
    ratios = np.stack([np.log1p(count), alnum / some / 10, marks / size * 10, marks / some, again[0] / some * 4, again[1] / some * 4, np.log1p(count / np.maximum(1, lines))], axis=1)
    return row, bucket, ratios.astype(np.float32), count


@dataclass
class Head:
    weight: np.ndarray  # of each bucket, 0 if not selected
    ratio: np.ndarray
    bias: float


@dataclass
class Model:
    heads: list[Head]
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each row for each head, and each row's words."""
        n = len(off) - 1
        out, counts = np.zeros((n, len(self.heads))), np.zeros(n, np.int64)
        for i, j in chunks(off):
            row, bucket, ratios, counts[i:j] = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            r = (ratios - self.mean) / self.scale
            for k, head in enumerate(self.heads):
                hit = np.flatnonzero(head.weight[bucket])
                once = np.unique(row[hit] * WORD_BUCKETS + bucket[hit])
                out[i:j, k] = r @ head.ratio + head.bias + np.bincount(once // WORD_BUCKETS, head.weight[once % WORD_BUCKETS], j - i)
        return np.clip(out, -15, 15), counts


def _fit_head(row: np.ndarray, bucket: np.ndarray, ratios: np.ndarray, y: np.ndarray, constant: float) -> Head:
    """row and bucket: the distinct words of each labelled document."""
    head = Head(np.zeros(WORD_BUCKETS, np.float32), np.zeros(RATIOS), constant)
    if len(set(y.tolist())) < 2:
        return head
    pos, neg = (np.bincount(bucket[y[row] == k], minlength=WORD_BUCKETS) for k in (1, 0))
    a, b = y.sum(), len(y) - y.sum()
    share = (pos + neg) / len(y)
    z = (pos / a - neg / b) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / a + 1 / b))
    z[pos + neg < 5] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:SELECTED]
    chosen = chosen[np.abs(z[chosen]) > 4]
    place = np.full(WORD_BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    use = place[bucket] >= 0
    r, c = row[use], place[bucket[use]]
    x, w, d, bias = ratios.astype(np.float64), np.zeros(len(chosen)), np.zeros(RATIOS), float(np.log(a / b))
    g2 = [np.full(len(chosen), 1e-6), np.full(RATIOS, 1e-6), 1e-6]
    for _ in range(300):  # AdaGrad on all rows
        p = 1 / (1 + np.exp(-np.clip(x @ d + bias + np.bincount(r, w[c], len(y)), -30, 30)))
        e = (p - y) / len(y)
        g = [np.bincount(c, e[r], len(chosen)) + 1e-4 * w, x.T @ e + 1e-4 * d, e.sum()]
        for k in range(3):
            g2[k] = g2[k] + g[k] ** 2
        w, d, bias = w - 0.3 * g[0] / np.sqrt(g2[0]), d - 0.3 * g[1] / np.sqrt(g2[1]), bias - 0.3 * g[2] / np.sqrt(g2[2])
    head.weight[chosen], head.ratio, head.bias = w, d, float(bias)
    return head


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits both heads to the labelled documents of the TRAIN_DOCS least id hashes."""
    marks = labels.select(F.col("doc_id").alias("__doc"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("__doc is not null and (quality is not null or toxic is not null)").orderBy(F.xxhash64("__doc"), "__doc", "quality", "toxic").limit(TRAIN_DOCS)
    marks = saved(marks)
    some = docs.join(F.broadcast(marks), F.col("doc_id") == F.col("__doc")).where("text is not null").select("doc_id", "quality", "toxic", with_newline("text").alias("text"))

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, ratios, _ = features(*column_bytes(batch.column(3)))
            once = np.unique(row * WORD_BUCKETS + bucket)
            off = np.searchsorted(once, np.arange(batch.num_rows + 1) * WORD_BUCKETS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(3)), pa.ListArray.from_arrays(pa.array(off), pa.array((once % WORD_BUCKETS).astype(np.int32))), pa.FixedSizeListArray.from_arrays(pa.array(ratios.reshape(-1)), RATIOS).cast(pa.list_(pa.float32()))],
                names=["doc_id", "quality", "toxic", "buckets", "ratios"],
            )

    t = some.mapInArrow(count, "doc_id long, quality int, toxic int, buckets array<int>, ratios array<float>").orderBy("doc_id", "quality", "toxic").toArrow()
    n = t.num_rows
    if n:
        ratios = t.column("ratios").combine_chunks().flatten().to_numpy().reshape(n, RATIOS)
        lists = t.column("buckets").combine_chunks()
        bucket, row = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
        mean, scale = ratios.mean(axis=0), ratios.std(axis=0) + 1e-3
    else:
        ratios, bucket, row, mean, scale = np.zeros((0, RATIOS)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(RATIOS), np.ones(RATIOS)
    heads = []
    for name, constant in (("quality", 0.0), ("toxic", -15.0)):
        y = np.array([-1 if v is None else int(v > 0) for v in t.column(name).to_pylist()], np.int64)
        at = np.flatnonzero(y >= 0)
        back = np.full(n, -1)
        back[at] = np.arange(len(at))
        use = y[row] >= 0 if n else np.zeros(0, bool)
        heads.append(_fit_head(back[row[use]], bucket[use], ((ratios - mean) / scale)[at], y[at], constant))
    return Model(heads, mean, scale)


def scorer(docs: DataFrame, model: Model):
    """A function of a text column (without nulls, with a line end): struct<q, t, words>, log odds and the number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<q double, t double, words long>")
    @trimmed
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            logits, counts = shared.value.logits(*column_bytes(text))
            yield pa.StructArray.from_arrays([pa.array(logits[:, 0]), pa.array(logits[:, 1]), pa.array(counts)], names=["q", "t", "words"])

    return score.asNondeterministic()  # else a filter on the result scores the texts a second time, in two more workers an executor


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, n: str, total: str, around: Column) -> float:
    """The prior's strength for group rates around ``around``: what spread is left when sampling noise is taken off."""
    mean = F.col(total) / F.col(n)
    noise = around * (1 - around) / F.col(n)
    r = groups.select(F.avg((mean - around) ** 2 - noise).alias("spread"), F.avg(around * (1 - around)).alias("unit")).first()
    if r["spread"] is None:
        return 1.0
    return float(min(1e6, max(1.0, r["unit"] / max(r["spread"], 1e-12) - 1)))


def rates(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """``__site, __path``, site and path posteriors of both rates, from ``__site, __path, q, t``; and the global rates."""
    p = {"q": _sigmoid(F.col("q")), "t": _sigmoid(F.col("t"))}
    paths = saved(scored.groupBy("__site", "__path").agg(F.count("*").alias("n"), *[F.sum(p[k]).alias(f"{k}_sum") for k in p]))
    whole = paths.agg(F.sum("n").alias("n"), *[F.sum(f"{k}_sum").alias(k) for k in p]).first()
    base = {k: (whole[k] / whole["n"] if whole["n"] else 0.5) for k in p}
    sites = paths.groupBy("__site").agg(F.sum("n").alias("site_n"), *[F.sum(f"{k}_sum").alias(f"{k}_site_sum") for k in p])
    for k in p:
        s = _strength(sites, "site_n", f"{k}_site_sum", F.lit(base[k]))
        sites = sites.withColumn(f"{k}_site", (s * base[k] + F.col(f"{k}_site_sum")) / (s + F.col("site_n")))
    sites = sites.select(F.col("__site").alias("__s"), *[f"{k}_site" for k in p])
    both = paths.join(sites, F.col("__site").eqNullSafe(F.col("__s"))).drop("__s")
    for k in p:
        s = _strength(both, "n", f"{k}_sum", F.col(f"{k}_site"))
        both = both.withColumn(f"{k}_path", (s * F.col(f"{k}_site") + F.col(f"{k}_sum")) / (s + F.col("n")))
    return saved(both.select("__site", "__path", *[f"{k}_{level}" for k in p for level in ("site", "path")])), base


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` plus __quality, __toxic (posteriors), __keep and the evidence and rates behind them.

    Texts are scored once for the sums and once for the result: a second pass costs less than moving the texts."""
    small_batches(docs.sparkSession)
    model = fit(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    score = scorer(docs, model)

    def scored(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__score", score(with_newline("text"))).withColumns({"__site": F.col(SITE).cast("string"), "__path": F.col(PATH).cast("string")})

    slim = scored(docs.select(F.col("text").cast("string").alias("text"), SITE, PATH)).where("__score.words > 0")
    table, base = rates(slim.select("__site", "__path", "__score.q", "__score.t"))
    table = table.select(F.col("__site").alias("__rate_site"), F.col("__path").alias("__rate_path"), *[F.col(c).alias(f"__{c}") for c in ("q_site", "q_path", "t_site", "t_path")])
    out = scored(docs).join(table, F.col("__site").eqNullSafe(F.col("__rate_site")) & F.col("__path").eqNullSafe(F.col("__rate_path")), "left")
    words = F.col("__score.words") > 0
    q = _sigmoid(F.col("__score.q") + _logit(F.col("__q_path")) - _logit(F.lit(base["q"])))
    t = _sigmoid(F.col("__score.t") + _logit(F.col("__t_path")) - _logit(F.lit(base["t"])))
    out = out.withColumn("__quality", F.when(words, q).otherwise(F.lit(0.0))).withColumn("__toxic", F.when(words, t).otherwise(F.lit(0.0)))
    return out.withColumn("__keep", (F.col("__quality") >= 0.5) & (F.col("__toxic") < 0.5))


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, evidence, site and path rates, posterior quality and toxicity, keep."""
    out = classify(docs.select("doc_id", "text", SITE, PATH), labels)
    evidence = F.when(F.col("__score.words") > 0, _sigmoid(F.col("__score.q"))).otherwise(F.lit(0.0))
    return out.select("doc_id", evidence.alias("evidence"), F.col("__q_site").alias("site_quality"), F.col("__q_path").alias("path_quality"), F.col("__quality").alias("quality"), F.col("__toxic").alias("toxic"), F.col("__keep").alias("keep"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, in their own columns."""
    return classify(docs, labels).where("__keep").select(*[F.col(f"`{c}`") for c in docs.columns])

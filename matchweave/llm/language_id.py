"""Language ID with a byte convolutional network: multi-width filters, max pooling and softmax, in numpy.

Training: windows of WINDOW bytes from labelled documents, PER_LANGUAGE documents of a language at most or so (those
whose id hash falls under a share set from the language's count; this bound is the sample's parameter). The network is
byte embeddings, FILTERS filters of each width, rectified maxima over the window, and a softmax layer, fitted by Adam on
the driver.

Prediction: every text is cut into windows of WINDOW bytes to its end. For two neighbouring bytes, the products of
embeddings and filters are looked up in tables of 65,536 entries, so a filter costs one or two look-ups a byte. A text's
score is the mean of its windows' probabilities, weighted by their letters.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is everything where no labelled text
exists. With one language, that is predicted. Ties go to the first language by code point. A null doc_id is neither
learned from nor held out. Repeated rows get a row each. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import chunks, column_bytes

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
PER_LANGUAGE = 2000
WINDOWS_A_DOCUMENT = 4
#: Passes over the windows; more where they are few, up to STEPS batches.
EPOCHS = 4
STEPS = 800
#: Windows that are looked up at a time.
AT_ONCE = 4096
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Network:
    languages: list[str]
    #: For each width, tables[k] of the filters' sums for byte pairs (65536 x FILTERS) or single bytes (256 x FILTERS).
    tables: list[list[np.ndarray]]
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x: windows x WINDOW bytes."""
        features = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        flat = np.ascontiguousarray(x).reshape(-1)
        pair = np.zeros(len(flat), np.uint16)
        pair[:-1] = flat[:-1].astype(np.uint16) * 256 + flat[1:]
        for w, (width, tables) in enumerate(zip(WIDTHS, self.tables, strict=True)):
            for f in range(FILTERS):
                total = tables[0][f][pair]
                for k, t in enumerate(tables[1:], 1):
                    total[: len(total) - 2 * k] += t[f][(pair if t.shape[1] > 256 else flat)[2 * k :]]
                features[:, w * FILTERS + f] = total.reshape(x.shape)[:, : WINDOW - width + 1].max(axis=1) + self.bias[w][f]
        z = np.maximum(features, 0) @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The WINDOW-byte windows of each row, the last filled with zeros, and the row of each window."""
    size = np.diff(off)
    count = np.maximum(1, -(-size // WINDOW))
    out = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    first = (np.cumsum(count) - count) * WINDOW
    out[np.arange(len(data)) + np.repeat(first - off[:-1], size)] = data
    return out.reshape(-1, WINDOW), np.repeat(np.arange(len(size)), count)


def train(texts: list[bytes], labels: list[str], seed: int = 0) -> Network:
    """Fits the network to windows of at most WINDOW bytes."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.searchsorted(np.array(languages), np.array(labels))
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for i, t in enumerate(texts):
        x[i, : min(WINDOW, len(t))] = np.frombuffer(t[:WINDOW], np.uint8)
    short = rng.random(len(x)) < 0.25  # so that short texts are known too
    x[short] *= np.arange(WINDOW)[None, :] < rng.integers(12, WINDOW, short.sum())[:, None]
    n = len(languages)
    p = {"e": rng.normal(0, 0.3, (256, EMBEDDING)), "d": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, n)), "db": np.zeros(n)}
    for w in WIDTHS:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(0, 0.3, (w, EMBEDDING, FILTERS)), np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["e"][0] = 0
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    weight = (len(y) / (n * np.bincount(y, minlength=n))).astype(np.float32)
    step, batch = 0, 128
    epochs = max(EPOCHS, -(-STEPS // -(-len(x) // batch)))
    for _ in range(epochs if n > 1 else 0):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows, step = order[i : i + batch], step + 1
            xb, yb = x[rows], y[rows]
            emb = p["e"][xb]
            g = {k: np.zeros_like(a) for k, a in p.items()}
            feats, at = [], []
            for w in WIDTHS:
                span = WINDOW - w + 1
                conv = sum(emb[:, k : k + span] @ p[f"w{w}"][k] for k in range(w))
                at.append(conv.argmax(axis=1))
                feats.append(conv.max(axis=1) + p[f"b{w}"])
            h = np.concatenate(feats, axis=1)
            r = np.maximum(h, 0)
            z = r @ p["d"] + p["db"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(yb)), yb] -= 1
            z *= weight[yb][:, None] / len(yb)
            g["d"], g["db"] = r.T @ z, z.sum(axis=0)
            dh = (z @ p["d"].T) * (h > 0)
            lines = np.arange(len(yb))[:, None]
            for j, w in enumerate(WIDTHS):
                d = dh[:, j * FILTERS : (j + 1) * FILTERS]
                g[f"b{w}"] = d.sum(axis=0)
                for k in range(w):
                    byte = xb[lines, at[j] + k]
                    g[f"w{w}"][k] = np.einsum("bfe,bf->ef", p["e"][byte], d)
                    np.add.at(g["e"], byte, d[:, :, None] * p[f"w{w}"][k].T[None])
            g["e"][0] = 0
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    tables = []
    for w in WIDTHS:
        single = [p["e"] @ p[f"w{w}"][k] for k in range(w)]
        pairs = [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)] + ([single[-1]] if w % 2 else [])
        tables.append([np.ascontiguousarray(t.T.astype(np.float32)) for t in pairs])
    return Network(languages, tables, [p[f"b{w}"] for w in WIDTHS], p["d"], p["db"])


def predict(net: Network, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the language and the score of each row."""
    total = np.zeros((len(off) - 1, len(net.languages)))
    letters = np.full(len(off) - 1, 1e-9)
    for i, j in chunks(off):
        x, row = windows_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for a in range(0, len(x), AT_ONCE):
            part = x[a : a + AT_ONCE]
            weight = _LETTER[part].sum(axis=1) + 1e-9
            at = i + row[a : a + AT_ONCE]
            np.add.at(total, at, net.probabilities(part) * weight[:, None])
            np.add.at(letters, at, weight)
    total /= letters[:, None]
    best = total.argmax(axis=1)
    return best, np.clip(total[np.arange(len(best)), best], 0.0, 1.0)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Network | None:
    """The network for the labelled documents that are not held out; None if there are none."""
    known = docs.select("doc_id", "text", "lang").where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # written first, so that Spark knows its size and, where it is small, doesn't move the texts to join it
    share = saved(known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(1.2 * PER_LANGUAGE) / F.count("*")).alias("share")).withColumnRenamed("lang", "__lang"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = known.withColumn("draw", draw).join(share, F.col("lang") == F.col("__lang")).where("draw < share")
    place = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_A_DOCUMENT - 1)), lambda k: F.substring("text", (F.pmod(F.xxhash64("doc_id", k), F.greatest(F.lit(1), F.length("text") - WINDOW // 2)) + 1).cast("int"), F.lit(WINDOW)))
    rows = some.select("lang", F.explode(F.array_distinct(place)).alias("piece")).where(F.col("piece").rlike(r"\p{L}")).orderBy("lang", "piece").toArrow()
    if not rows.num_rows:
        return None
    return train([t.encode() for t in rows.column("piece").to_pylist()], rows.column("lang").to_pylist())


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            best, score = predict(shared.value, *column_bytes(batch.column(3)))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[np.where(letters, best, len(names) - 1)], pa.string()), pa.array(np.where(letters, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

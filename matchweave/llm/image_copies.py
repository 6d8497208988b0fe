"""Media columns: cropped and edited copies of images by local descriptors.

1. Images of the same bytes are one class.
2. Corners are found on a pyramid of scales: points stronger than any other within SPREAD pixels, so their number grows
   with the picture and a crop keeps those it shows. The patch around each gives an orientation (its intensity centroid)
   and BITS binary tests between points turned by that orientation.
3. A corner and the two nearest ones of its scale form a phrase. Their descriptors are cut into TABLES chunks of 16 bits,
   and the three chunks of a table are one key of that Hamming table: images that show the same corners side by side meet
   in an equi-join; those that merely share a patch, as many strangers may, don't. In each bucket every image is paired
   with the bucket's most central one; what that leaves unconnected is paired image by image. A pair needs EVIDENCE keys.
4. Pairs are verified: descriptors within DISTANCE bits are matched, every match votes for a similarity transform, the fullest
   bins give transforms by least squares, and the copy is accepted if enough matches agree with one of them.
5. Accepted pairs become components; one image of each is kept.

The candidate search is probabilistic: tests measure the share of planted copies that is found. Pictures wider than WIDEST
are reduced by a whole step; scales further apart than SCALES spans don't match.

Binary greymaps and pixmaps (P5, P6) and non-interlaced 8-bit PNG of at most LARGEST samples are read.

Defined cases: media that is null, empty, of another format or broken, and images too small or plain for corners, link with
nothing but equal bytes (null and empty: with nothing). Rows of a null id are not kept and have a null component. A repeated
id counts as one image. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import connected_components

SCALES = (1.0, 1.4, 2.0, 2.8)
#: No corner has a stronger one within so many pixels of its scale.
SPREAD = 5
PATCH = 10
BITS = 256
TABLES = BITS // 16
EVIDENCE = 2
DISTANCE = 40
#: Matches that must agree: so many, and this share of the corners of the picture that has fewer.
INLIERS, INLIER_SHARE = 6, 0.15
LARGEST = 1 << 26
#: Pixels by which a matched corner may miss its place, and the widest image side that is read at full size.
TOLERANCE = 3.0
WIDEST = 512
#: Bins of a turn, pixels of a shift's bin, and the fullest bins that are tried.
TURN_BINS, SHIFT, BINS = 18, 24, 12

_rng = np.random.default_rng(5)
_POINTS = np.clip(_rng.normal(0, PATCH / 2.5, (2, BITS, 2)), -PATCH + 3, PATCH - 3)
_TURNS = 32
_angles = np.arange(_TURNS) * 2 * np.pi / _TURNS
_TURNED = np.rint(np.einsum("tij,pbj->tpbi", np.stack([np.stack([np.cos(_angles), -np.sin(_angles)], 1), np.stack([np.sin(_angles), np.cos(_angles)], 1)], 1), _POINTS)).astype(np.int64)
_DISC = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49])


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey levels, or None where the media can't be read."""
    try:
        if raw[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
                    at = raw.index(b"\n", at) if raw[at : at + 1] == b"#" else at + 1
                end = at
                while raw[end : end + 1].isdigit():
                    end += 1
                fields.append(int(raw[at:end]))
                at = end
            (w, h, top), n = fields, 3 if raw[:2] == b"P6" else 1
            if top > 255 or w * h * n > LARGEST:
                return None
            return _grey(np.frombuffer(raw, np.uint8, w * h * n, at + 1).reshape(h, w, n))
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
    except (ValueError, TypeError, IndexError, KeyError, OverflowError, MemoryError, struct.error, zlib.error):
        pass
    return None


def _grey(x: np.ndarray) -> np.ndarray | None:
    if not x.size:
        return None
    x = x.astype(np.float32)
    x = x[..., 0] if x.shape[2] < 3 else x[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)
    step = -(-max(x.shape) // WIDEST)
    if step > 1:
        h, w = x.shape[0] // step * step, x.shape[1] // step * step
        x = x[:h, :w].reshape(h // step, step, w // step, step).mean(axis=(1, 3))
    return x


def _png(raw: bytes) -> np.ndarray | None:
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", raw[at + 8 : at + 21])
        elif kind == b"IDAT":
            data += raw[at + 8 : at + 8 + size]
        at += size + 12
    w, h, depth, colour, _, _, interlaced = head
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced or w * h * n > LARGEST:
        return None
    lines = np.frombuffer(zlib.decompressobj().decompress(data, h * (1 + w * n)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w, n), np.uint8)
    for y in range(h):
        line, up = lines[y, 1:].reshape(w, n), out[y]
        kind = lines[y, 0]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + up
        else:
            out[y + 1] = np.frombuffer(_unfiltered(line.tobytes(), up.tobytes(), n, kind == 4), np.uint8).reshape(w, n)
    return _grey(out[1:])


def _unfiltered(line: bytes, up: bytes, n: int, paeth: bool) -> bytes:
    """A line of a PNG whose samples are differences to the mean of left and above, or to the nearest of left, above, corner."""
    out = bytearray(n) + bytearray(line)
    for k in range(len(line)):
        left, above = out[k], up[k]
        if paeth:
            corner = up[k - n] if k >= n else 0
            a, b, c = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
            guess = left if a <= b and a <= c else above if b <= c else corner
        else:
            guess = (left + above) // 2
        out[k + n] = (line[k] + guess) & 255
    return bytes(out[n:])


def _strongest_near(x: np.ndarray, r: int) -> np.ndarray:
    """The maximum of each (2r + 1)-sided square."""
    for axis in (0, 1):
        padded = np.pad(x, [(r, r) if k == axis else (0, 0) for k in (0, 1)], constant_values=-np.inf)
        x = np.lib.stride_tricks.sliding_window_view(padded, 2 * r + 1, axis=axis).max(axis=-1)
    return x


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over (2r + 1)-sided squares, edges repeated."""
    s = np.cumsum(np.cumsum(np.pad(x, ((r + 1, r), (r + 1, r)), mode="edge"), axis=0, dtype=np.float64), axis=1)
    k = 2 * r + 1
    return ((s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)).astype(np.float32)


def _scaled(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    h, w = int(x.shape[0] / scale), int(x.shape[1] / scale)
    ys, xs = np.minimum((np.arange(h) + 0.5) * scale - 0.5, x.shape[0] - 1), np.minimum((np.arange(w) + 0.5) * scale - 0.5, x.shape[1] - 1)
    y0, x0 = np.minimum(ys.astype(int), x.shape[0] - 2), np.minimum(xs.astype(int), x.shape[1] - 2)
    fy, fx = (ys - y0)[:, None].astype(np.float32), (xs - x0)[None, :].astype(np.float32)
    rows = x[y0] * (1 - fy) + x[y0 + 1] * fy
    return rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx


def describe(x: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints (x, y in pixels of the image, size, angle) and descriptors (BITS / 8 bytes each)."""
    points, bits = [np.zeros((0, 4), np.float32)], [np.zeros((0, BITS // 8), np.uint8)]
    for scale in SCALES if x is not None else ():
        if min(x.shape) / scale < 2 * PATCH + 8:
            break
        im = _scaled(x, scale)
        gy, gx = np.gradient(_box(im, 1))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        corner = a * b - c * c - 0.05 * (a + b) ** 2
        inner = corner[PATCH:-PATCH, PATCH:-PATCH]
        peak = (inner > 1.0) & (inner >= _strongest_near(corner, SPREAD)[PATCH:-PATCH, PATCH:-PATCH])
        ys, xs = np.nonzero(peak)
        ys, xs = ys + PATCH, xs + PATCH
        if not len(ys):
            continue
        smooth = _box(im, 2)
        disc = smooth[ys[:, None] + _DISC[None, :, 0], xs[:, None] + _DISC[None, :, 1]]
        angle = np.arctan2(disc @ _DISC[:, 0].astype(np.float32), disc @ _DISC[:, 1].astype(np.float32))
        turn = np.rint(angle / (2 * np.pi) * _TURNS).astype(int) % _TURNS
        p = _TURNED[turn]  # keypoint, side, bit, (x, y)
        h, w = smooth.shape
        v = smooth[np.clip(ys[:, None, None] + p[..., 1], 0, h - 1), np.clip(xs[:, None, None] + p[..., 0], 0, w - 1)]
        bits.append(np.packbits(v[:, 0] > v[:, 1] + 0.5, axis=1))
        points.append(np.stack([(xs + 0.5) * scale - 0.5, (ys + 0.5) * scale - 0.5, np.full(len(xs), scale), angle], axis=1).astype(np.float32))
    return np.concatenate(points), np.concatenate(bits)


def _matches(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of descriptors within DISTANCE bits, and whether each is the other's nearest."""
    d, e = (np.ascontiguousarray(x).view(np.uint64) for x in (d, e))
    i, j, bits, nearest = [], [], [], np.full(len(e), 1 << 15)
    for k in range(0, len(d), 256):
        far = np.zeros((len(d[k : k + 256]), len(e)), np.uint16)
        for word in range(d.shape[1]):
            far += np.bitwise_count(d[k : k + 256, None, word] ^ e[None, :, word])
        p, q = np.nonzero(far <= DISTANCE)
        i.append(k + p)
        j.append(q)
        bits.append(far[p, q])
        nearest = np.minimum(nearest, far.min(axis=0))
    i, j, bits = np.concatenate(i), np.concatenate(j), np.concatenate(bits)
    own = np.full(len(d), 1 << 15)
    np.minimum.at(own, i, bits)
    return i, j, (bits == own[i]) & (bits == nearest[j])


def _places(z: np.ndarray) -> np.ndarray:
    """A number for each spot of 4 pixels."""
    return (np.rint(z.real / 4).astype(np.int64) << 32) + np.rint(z.imag / 4).astype(np.int64)


def _ballots(turn: np.ndarray, scale: np.ndarray, centre: np.ndarray, spot: np.ndarray) -> list[np.ndarray]:
    """The matches of the BINS bins of turn, scale and shift that most distinct spots vote for. Every match votes in each of the
    eight grids that are moved by half a bin or not along turn and shift, so no agreement is cut by a border."""
    step = np.rint(4 * np.log2(scale)).astype(np.int64) + 64
    keys = []
    for grid in range(8):
        half = [(grid >> axis & 1) / 2 for axis in range(3)]
        t = np.floor(turn / (2 * np.pi) * TURN_BINS + half[0]).astype(np.int64) % TURN_BINS
        x, y = (np.floor(c / (SHIFT * np.maximum(1, scale)) + h).astype(np.int64) + (1 << 19) for c, h in ((centre.real, half[1]), (centre.imag, half[2])))
        keys.append((((grid * TURN_BINS + t) * 256 + step) << 40) + (x << 20) + y)
    key, who = np.concatenate(keys), np.tile(np.arange(len(turn)), 8)
    order = np.lexsort((spot[who], key))
    key, who = key[order], who[order]
    new = np.r_[True, (key[1:] != key[:-1])]
    fresh = new | np.r_[True, spot[who[1:]] != spot[who[:-1]]]
    starts = np.flatnonzero(new)
    votes, ends = np.add.reduceat(fresh.astype(np.int64), starts), np.r_[starts[1:], len(key)]
    return [who[starts[k] : ends[k]] for k in np.argsort(-votes, kind="stable")[:BINS]]


def is_copy(p: np.ndarray, d: np.ndarray, q: np.ndarray, e: np.ndarray) -> bool:
    """Geometric consensus of two images' keypoints (p, q) and descriptors (d, e), in time proportional to the matches. Those that
    are each other's nearest are asked first, then all."""
    if len(p) < INLIERS or len(q) < INLIERS:
        return False
    need = max(INLIERS, INLIER_SHARE * min(len(p), len(q)))
    i, j, mutual = _matches(d, e)
    return _agree(p[i[mutual]], q[j[mutual]], need) or _agree(p[i], q[j], need)


def _agree(p: np.ndarray, q: np.ndarray, need: float) -> bool:
    """Whether enough matched corners (p with q) agree with one similarity transform.

    Every match votes for the transform that it implies; those of a full bin give one by least squares, which is fitted again to
    all matches that it explains. Each corner of either image counts once: a transform is held up by the fewer of its distinct
    corners."""
    if len(p) < need:
        return False
    a, b = (x[:, 0].astype(np.float64) + 1j * x[:, 1] for x in (p, q))
    a -= a.mean()
    scale, turn = (q[:, 2] / p[:, 2]).astype(np.float64), (q[:, 3] - p[:, 3]).astype(np.float64)
    spots = _places(a), _places(b)
    for own in _ballots(turn, scale, b - scale * np.exp(1j * turn) * a, spots[0]):
        z = np.median(scale[own]) * np.exp(1j * np.angle(np.exp(1j * turn[own]).sum()))
        w = np.median((b[own] - z * a[own]).real) + 1j * np.median((b[own] - z * a[own]).imag)
        for wide in (4, 2, 1, 1):
            off = np.abs(z * a + w - b) <= wide * TOLERANCE * max(1, abs(z))
            fits = np.flatnonzero(off & (np.abs(np.angle(np.exp(1j * (turn - np.angle(z))))) < 0.4))
            if len(fits) < need:
                break
            if min(len(np.unique(s[fits])) for s in spots) >= need and wide == 1:
                return True
            u, v = a[fits] - a[fits].mean(), b[fits] - b[fits].mean()
            spread = (np.abs(u) ** 2).sum()
            if not spread:
                break
            z = (u.conj() * v).sum() / spread
            w = b[fits].mean() - z * a[fits].mean()
            if not 0.2 < abs(z) < 5:
                break
    return False


FEATURES = "media_id long, h1 long, h2 long, points binary, bits binary"


def features(rows: DataFrame) -> DataFrame:
    """points and bits (arrays as bytes) of the column ``media``, which goes no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            both = [describe(decode(x)) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([x[k].tobytes() for x in both], pa.binary()) for k in range(2)]], names=["media_id", "h1", "h2", "points", "bits"])

    return rows.select("media_id", "h1", "h2", "media").mapInArrow(run, FEATURES)


def phrases(points: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The distinct keys of an image: the table (4 bits), the chunks of a corner and of the two nearest ones of its scale
    (16 bits each; 0 for a second one that isn't there)."""
    words, out = bits.view("<u2").astype(np.int64), [np.zeros(0, np.int64)]
    for scale in np.unique(points[:, 2]):
        at = np.flatnonzero(points[:, 2] == scale)
        if len(at) < 2:
            continue
        for k in range(0, len(at), 512):
            own = at[k : k + 512]
            far = ((points[own, None, :2] - points[None, at, :2]) ** 2).sum(axis=2)
            far[np.arange(len(own)), k + np.arange(len(own))] = np.inf
            first = far.argmin(axis=1)
            far[np.arange(len(own)), first] = np.inf
            second = words[at[far.argmin(axis=1)]] if len(at) > 2 else 0
            out.append(((np.arange(TABLES, dtype=np.int64) << 48) + (words[own] << 32) + (words[at[first]] << 16) + second).reshape(-1))
    return np.unique(np.concatenate(out))


def _shared_phrases(found: DataFrame) -> DataFrame:
    """bucket, class_id: the phrase keys that another image has too.

    Keys are dealt and sorted, so each partition is read once and only rows of shared buckets leave it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, points, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = phrases(np.frombuffer(points, "<f4").reshape(-1, 4), np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8))
                ids.append(np.full(len(one), i))
                out.append(one)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(ids))], names=["bucket", "class_id"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and whether its bucket has been seen with another image
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held is not None:
                bucket, own = np.concatenate([held[0], bucket]), np.concatenate([held[1], own])
            same = bucket[1:] == bucket[:-1]
            some = np.zeros(len(bucket), bool)
            some[1:] |= same
            some[:-1] |= same
            some[0] |= held is not None and held[2]
            held = bucket[-1:].copy(), own[-1:].copy(), bool(some[-1])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[:-1][some[:-1]]), pa.array(own[:-1][some[:-1]])], names=["bucket", "class_id"])
        if held is not None and held[2]:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["bucket", "class_id"])

    kind = "bucket long, class_id long"
    return found.select("class_id", "points", "bits").mapInArrow(cut, kind).repartition("bucket").sortWithinPartitions("bucket", "class_id").mapInArrow(shared, kind)


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda raw, kind, width: np.frombuffer(raw, kind).reshape(-1, width)
        for batch in batches:
            ok = [is_copy(read(p, "<f4", 4), read(d, np.uint8, BITS // 8), read(q, "<f4", 4), read(e, np.uint8, BITS // 8)) for p, d, q, e in zip(*(batch.column(c).to_pylist() for c in ("p", "d", "q", "e")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = found.select(F.col("class_id").alias("a"), F.col("points").alias("p"), F.col("bits").alias("d"))
    two = found.select(F.col("class_id").alias("b"), F.col("points").alias("q"), F.col("bits").alias("e"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "p", "d", "q", "e").mapInArrow(run, "a long, b long").distinct()


def image_copies(media: DataFrame, id_column: str = "media_id", media_column: str = "media") -> DataFrame:
    """One row per image: media_id, class_id (least id with the same bytes), component_id, kept."""
    rows = media.select(F.col(id_column).cast("long").alias("media_id"), F.col(media_column).cast("binary").alias("media"))
    some = (F.length("media") > 0) & F.col("media_id").isNotNull()
    keyed = rows.withColumns({"h1": F.when(some, F.xxhash64("media")), "h2": F.when(some, F.xxhash64(F.lit(1), "media"))})
    described = saved(features(keyed))
    found = described.where("h1 is not null").groupBy("h1", "h2").agg(F.min("media_id").alias("class_id"), F.any_value("points").alias("points"), F.any_value("bits").alias("bits"))
    found = saved(found)
    members = saved(_shared_phrases(found))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("m"))
    members = members.join(sizes, "bucket")
    weights = members.groupBy("class_id").agg(F.sum("m").alias("weight"))
    members = saved(members.join(weights, "class_id").select("bucket", "class_id", "weight"))
    leaders = members.groupBy("bucket").agg(F.max_by("class_id", F.struct("weight", -F.col("class_id"))).alias("leader"))
    star = members.join(leaders, "bucket").where("class_id <> leader").groupBy(F.least("class_id", "leader").alias("a"), F.greatest("class_id", "leader").alias("b")).agg(F.count("*").alias("n"))
    star = saved(star.where(F.col("n") >= EVIDENCE).select("a", "b"))
    links = saved(_verified(star, found))
    part = connected_components(links, "a", "b")
    placed = members.join(part, members.class_id == part.id, "left").select("bucket", "class_id", F.coalesce("component", "class_id").alias("component"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    rest = saved(placed.join(open_, "bucket"))
    x, y = rest.alias("x"), rest.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.class_id") < F.col("y.class_id")) & (F.col("x.component") != F.col("y.component")))
    pairs = pairs.groupBy(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= EVIDENCE)
    pairs = saved(pairs.select("a", "b").join(star, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        part = connected_components(links.union(saved(_verified(pairs, found))), "a", "b")
    named = found.select(F.col("class_id").alias("cls"), F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    out = described.select("media_id", "h1", "h2").join(named, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    out = out.select("media_id", F.coalesce("cls", "media_id").alias("class_id")).join(part, F.col("class_id") == F.col("id"), "left")
    out = out.select("media_id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("media_id") == F.col("component_id"), F.lit(False)))


CELLS = 8
CELL = 10
LEVELS = 8


def rendered(vectors: DataFrame) -> DataFrame:
    """media_id, media: a greymap drawn from each vector, as the tables hold no media of their own.

    A picture has CELLS x CELLS cells. Each shows one of LEVELS fixed textures of its own, chosen by one number, so near
    copies of a vector differ in a few cells and strangers share patches. The picture of vector v is media 2 v; every seventh
    (v % 7 = 3) also comes as a crop and the one after it (v % 7 = 4) brighter, as media 2 v + 1. No picture without a vector."""

    greymap = lambda im: b"P5\n%d %d\n255\n" % im.shape[::-1] + im.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = CELLS * CELL
        bank = np.random.default_rng(3).integers(0, 244, (CELLS * CELLS, LEVELS, CELL // 2, CELL // 2)).astype(np.uint8)
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.array([np.nan if c is None else c for c in (v or [])], np.float64)
                ids.append(None if i is None else 2 * i)
                if not len(v) or not np.isfinite(v).all():
                    out.append(None)
                    continue
                level = np.clip(np.floor((np.tanh(np.resize(v, CELLS * CELLS) * 8) + 1) * LEVELS / 2), 0, LEVELS - 1).astype(int)
                im = bank[np.arange(CELLS * CELLS), level].reshape(CELLS, CELLS, CELL // 2, CELL // 2).transpose(0, 2, 1, 3).reshape(side // 2, side // 2).repeat(2, axis=0).repeat(2, axis=1)
                out.append(greymap(im))
                if i is not None and i % 7 in (3, 4):
                    ids.append(2 * i + 1)
                    out.append(greymap(im[7:-6, 5:-8] if i % 7 == 3 else im + np.uint8(12)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["media_id", "media"])

    return vectors.select(F.col("vec_id").cast("long").alias("media_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, "media_id long, media binary")

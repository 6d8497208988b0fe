import os
import struct
import time
import zlib

import numpy as np
import pytest

from matchweave.llm import image_copies as I

SMALL = "/root/testdata/sf0.001"

RNG = np.random.default_rng(8)


def picture():
    return RNG.integers(0, 255, (40, 40)).astype(np.uint8).repeat(3, axis=0).repeat(3, axis=1)


def pgm(x):
    x = np.clip(x, 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % x.shape[::-1] + x.tobytes()


def png(x):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = b"".join(bytes([y % 3]) + (x[y] if y % 3 == 0 else np.diff(x[y], prepend=np.uint8(0)) if y % 3 == 1 else x[y] - (x[y - 1] if y else 0)).astype(np.uint8).tobytes() for y in range(len(x)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_and_pgm_agree():
    x = picture()
    assert (I.decode(png(x)) == x).all() and (I.decode(pgm(x)) == x).all()
    assert I.decode(b"junk") is None and I.decode(None) is None and I.decode(b"P5\n9 9\n255\n") is None


def test_copies_are_found_and_strangers_are_not(spark):
    a, b = picture(), picture()
    rows = [(1, pgm(a)), (2, pgm(a[10:100, 8:110])), (3, pgm(a * 0.8 + 20)), (4, pgm(a + RNG.normal(0, 4, a.shape))), (5, pgm(np.rot90(a))), (6, png(a)), (7, pgm(a)), (10, pgm(b)), (11, pgm(b[5:, 5:]))]
    rows += [(20 + i, pgm(picture())) for i in range(10)] + [(40, None), (41, b""), (42, b"junk"), (43, b"junk"), (44, pgm(np.full((50, 50), 9))), (None, pgm(a))]
    df = spark.createDataFrame(rows, "media_id long, media binary").selectExpr("*", "1 AS class_id")
    out = {r.media_id: r for r in I.image_copies(df).collect()}
    assert len(out) == len(rows)
    assert [out[i].component_id for i in (1, 2, 3, 4, 5, 6, 7)] == [1] * 7 and [out[i].component_id for i in (10, 11)] == [10, 10]
    assert all(out[20 + i].kept for i in range(10)) and out[7].class_id == 1
    assert out[43].component_id == 42 and out[40].kept and out[41].kept and out[44].kept and not out[None].kept
    assert I.image_copies(df.limit(0)).count() == 0


def paeth(left, above, corner):
    p = left + above - corner
    return min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]


def test_all_png_filters_broken_and_huge_media():
    x = RNG.integers(0, 255, (10, 7, 3)).astype(np.uint8)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = b""
    for y in range(10):
        left, above, corner = np.zeros((3, 7, 3), int)
        left[1:], above = x[y, :-1], x[y - 1].astype(int) if y else above
        corner[1:] = above[:-1]
        guess = [0 * left, left, above, (left + above) // 2, np.vectorize(paeth)(left, above, corner)][y % 5]
        lines += bytes([y % 5]) + (x[y] - guess).astype(np.uint8).tobytes()
    head = lambda w, h: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
    data = chunk(b"IDAT", zlib.compress(lines))
    assert (I.decode(head(7, 10) + data) == I._grey(x)).all()
    assert I.decode(head(1 << 20, 1 << 20) + data) is None and I.decode(head(7, 11) + data) is None
    assert I.decode(b"P5\n99999999999999999999 9\n255\n") is None and I.decode(b"P6\n100000 100000\n255\n") is None


def test_recall_of_planted_copies():
    """The share of crops and edits of smooth pictures that the candidate search proposes and the consensus accepts."""

    def smooth(n=160):
        x = sum(np.kron(RNG.normal(0, 1, (n // s, n // s)), np.ones((s, s))) * s**0.7 for s in (2, 4, 8, 16, 32))
        return (x - x.min()) / (x.max() - x.min()) * 235

    edits = {
        "crop": lambda x: x[20:-30, 35:-10],
        "quarter": lambda x: x[40:120, 40:120],
        "brighter": lambda x: np.clip(x * 1.1 + 10, 0, 255),
        "noise": lambda x: np.clip(x + RNG.normal(0, 6, x.shape), 0, 255),
        "half size": lambda x: x.reshape(80, 2, 80, 2).mean((1, 3)),
        "turned": lambda x: np.rot90(x),
    }
    pictures = [smooth() for _ in range(12)]
    told = [I.describe(np.rint(x).astype(np.float32)) for x in pictures]
    for name, edit in edits.items():
        copies = [I.describe(np.rint(edit(x)).astype(np.float32)) for x in pictures]
        found = [len(np.intersect1d(I.phrases(*a), I.phrases(*b))) >= I.EVIDENCE and I.is_copy(*a, *b) for a, b in zip(told, copies, strict=True)]
        assert np.mean(found) >= 0.9, name
    assert not any(I.is_copy(*told[i], *told[j]) for i in range(12) for j in range(i))


def test_consensus_of_large_pictures_is_fast():
    """A picture of 512 pixels has some 2000 corners and 300000 matches within DISTANCE bits."""
    x = sum(np.kron(RNG.normal(0, 1, (512 // s, 512 // s)), np.ones((s, s))) * s**0.7 for s in (2, 4, 8, 16, 32))
    x = np.rint((x - x.min()) / (x.max() - x.min()) * 235).astype(np.float32)
    a, b = I.describe(x), I.describe(x[20:-30, 35:-10])
    began = time.perf_counter()
    assert I.is_copy(*a, *b) and time.perf_counter() - began < 5
    assert not I.is_copy(*a, *I.describe(x[:, ::-1].copy()))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_planted_copies_are_found_by_the_query(spark):
    """Of the copies planted in the registered query's pictures, at least 0.9 join their original, and nothing else is joined."""
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    out = {r.media_id: r for r in I.image_copies(I.rendered(vectors)).collect()}
    planted = [i for i in out if i % 2]
    assert len(planted) > 10 and len(out) == vectors.count() + len(planted)
    assert np.mean([out[i].component_id == out[i - 1].component_id for i in planted]) >= 0.9
    media = {r.media_id: I.describe(I.decode(r.media)) for r in I.rendered(vectors).collect() if r.media}
    for i, r in out.items():
        if r.component_id != i and i - r.component_id != 1:
            assert any(j != i and o.component_id == r.component_id and I.is_copy(*media[i], *media[j]) for j, o in out.items())


def test_strangers_share_textures(spark):
    """A cell's texture follows from its own number, so vectors that share numbers share patches."""
    u, v = RNG.normal(0, 0.1, (2, I.CELLS * I.CELLS))
    v[:8] = u[:8]
    df = spark.createDataFrame([(0, u.tolist()), (1, v.tolist())], "vec_id long, embedding array<double>")
    x, y = (I.decode(r.media) for r in I.rendered(df).orderBy("media_id").collect())
    assert (x[: I.CELL] == y[: I.CELL]).all() and (x != y).any()

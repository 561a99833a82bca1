"""Exact byte formats and decoders on made inputs."""

import os

import numpy as np
import pandas as pd
import pytest

from lumengrid import catalog
from lumengrid.operators import containers as K
from lumengrid.operators import modes as M

DATA = "/root/testdata/sf0.001"
BUFFERS = [b"", b"a", b"aaaaaaaaaaaaaaaa", bytes(range(256)) * 3, os.urandom(3000), b"ab" * 500 + b"c", bytes(1000)]


@pytest.mark.parametrize("kind", range(5))
def test_byte_coders_round_trip(kind):
    for data in BUFFERS:
        blob = K.encode(data, kind)
        assert K.decode(blob) == data
        assert blob[0] == kind
    with pytest.raises(ValueError):
        K.decode(b"\x09" + bytes(20))
    with pytest.raises(ValueError):
        K.decode(K.encode(b"some bytes", kind)[:-1])


def test_coding_a_skewed_stream_pays():
    data = bytes(np.random.default_rng(1).choice(4, 20_000, p=[0.9, 0.05, 0.03, 0.02]).astype(np.uint8))
    sizes = [len(K.encode(data, k)) for k in range(5)]
    assert sizes[K.ORDER0] < sizes[K.STATIC] / 4 and abs(sizes[K.ORDER0] - sizes[K.ORDER0_LANES]) < 32


def test_frequencies():
    for counts in ([5], [1] * 256, [10**9, 1], [3, 0, 7, 90], [1] * 200 + [10**6]):
        n = np.zeros(256, np.int64)
        n[: len(counts)] = counts
        f = K.frequencies(n)
        assert f.sum() == K.SCALE and ((f > 0) == (n > 0)).all()
    assert (K.frequencies(np.zeros(256, np.int64)) == 64).all()


@pytest.mark.parametrize(("width", "channels", "n"), [(7, 3, 7 * 3 * 11), (16, 1, 400), (5, 4, 1), (9, 2, 0)])
def test_plane_containers_round_trip(width, channels, n):
    rng = np.random.default_rng(n)
    words = np.cumsum(rng.integers(0, 5, n)).astype("<u4") * 131
    for chunk in (64, 1 << 18):
        streams = []
        for k in range(-(-n // chunk)):
            planes = words[k * chunk : (k + 1) * chunk].view(np.uint8).reshape(-1, 4).T
            streams += [K.plane_stream(np.ascontiguousarray(p), k * chunk, width, channels) for p in planes]
        blob = K.container(streams, n, chunk)
        assert (K.opened(blob, width, channels) == words).all()
        rows = K.parsed(blob)
        assert sum(r[4] for r in rows) == 4 * n and 21 + sum(r[5] for r in rows) == len(blob)
    with pytest.raises(ValueError):
        K.parsed(blob + b"x")
    with pytest.raises(ValueError):
        K.parsed(b"XXXX" + blob[4:])


def test_byte_filters_are_undone():
    rng = np.random.default_rng(5)
    for n, width, channels, first in ((100, 7, 3, 0), (100, 7, 3, 42), (50, 50, 1, 0), (3, 8, 2, 5)):
        plane = rng.integers(0, 256, n).astype(np.uint8)
        for kind in (K.PLAIN, K.WEST, K.NORTH):
            assert (K.unfiltered(K.filtered(plane, kind, first, width, channels), kind, first, width, channels) == plane).all()


def test_bit_shuffle_keeps_the_tail():
    for n in (0, 1, 7, 8, 9, 64, 67):
        data = os.urandom(4 * n)
        blob = K.shuffled(data)
        assert K.unshuffled(blob) == data and len(blob) == 6 + len(data)
        assert blob[len(blob) - 4 * (n % 8) :] == data[len(data) - 4 * (n % 8) :]
    with pytest.raises(ValueError):
        K.shuffled(b"abc")


def test_packed_values():
    rng = np.random.default_rng(2)
    for width in (1, 2, 4):
        for n in (0, 1, 8, 13):
            v = rng.integers(0, 1 << width, n)
            assert (K.unpacked_values(K.packed_values(v, width), n, width) == v).all()


def test_modes_decode_what_they_encode(spark):
    """Odd sizes, negative numbers, zeros of both signs, infinities, and gaps in the grid."""
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(9, 7)) * 10.0 ** rng.integers(-3, 4, (9, 7))).astype(np.float32)
    v[0, 0], v[3, 2], v[4, 4], v[8, 6] = 0.0, -0.0, np.inf, -np.inf
    rows = [("a", y, x, 0, float(v[y, x])) for y in range(9) for x in range(7)] + [("gaps", 2 * y, 3 * x, 0, float(v[y, x])) for y in range(9) for x in range(7) if (y, x) != (2, 3)]
    samples = spark.createDataFrame(rows, "img string, y long, x int, c int, v float")
    near = M.with_context(samples).selectExpr("*", "shiftright(o, 31) as s")
    same = [m for m in M.MODES if not m.startswith("half") and not m.endswith(("channel", "green"))]
    want = {(r.img, r.y, r.x): r.o for r in near.select("img", "y", "x", "o").collect()}
    plain = near.filter("img = 'a'")
    got = M.decoded(M.payloads(plain, tuple(same), keep=("s",))).collect()
    assert len(got) == 63 * len(same) and all(want[r.img, r.y, r.x] == r.o for r in got)
    whole = [m for m in same if "float" not in m]
    got = M.decoded(M.payloads(near.filter("img = 'gaps'"), tuple(whole), keep=("s",))).collect()
    assert len(got) == 62 * len(whole) and all(want[r.img, r.y, r.x] == r.o for r in got)


def test_quadratic_surfaces_beat_raw_words(spark):
    got = catalog.QUERIES["p16_quadratic_residuals"](spark, DATA).toPandas()
    assert len(got) == 1200 and (got["residual"].abs() < 2**32).all()
    from lumengrid.operators import predict as P
    from lumengrid.sources import grids as G

    words = P.with_words(G.grids(spark, DATA, "evt1", "part1")).select("img", "y", "x", "o").toPandas()
    both = got.merge(words, on=["img", "y", "x"])
    for _, part in both.groupby([both["img"], both["y"] // 16, both["x"] // 16]):
        a = np.stack([np.ones(len(part)), part["x"], part["y"], part["x"] ** 2, part["x"] * part["y"], part["y"] ** 2], 1).astype(float)
        a[:, 1:] -= a[:, 1:].mean(0)
        fit = a @ np.linalg.lstsq(a, part["o"].to_numpy(float), rcond=None)[0]
        assert np.abs(part["o"] - fit - part["residual"]).max() < 2**20  # clipped or rounded apart, the same surface
        assert (part["residual"].astype(float) ** 2).sum() <= ((part["o"] - part["o"].mean()) ** 2).sum() * 1.001 + 1


def test_container_shares_and_model_frequencies(spark):
    shares = catalog.QUERIES["s16_container_shares"](spark, DATA).toPandas()
    assert set(shares["method"]) <= {0, 1, 2} and (shares.groupby("img")["share"].sum() < 1).all()
    f = catalog.QUERIES["a18_model_frequencies"](spark, DATA).toPandas()
    assert (f.groupby(["img", "plane"])["f"].sum() == K.SCALE).all() and (f["f"] > 0).all()
    assert isinstance(f, pd.DataFrame)

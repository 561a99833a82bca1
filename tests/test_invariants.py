"""Golden words, round trips and properties that SQL does not state."""

import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumengrid import catalog
from lumengrid.functions import bits as B
from lumengrid.operators import entropy as E
from lumengrid.operators import streams as S
from lumengrid.sources import grids as G

SPECIAL = [0x00000000, 0x80000000, 0x3F800000, 0xBF800000, 0x7F800000, 0xFF800000, 0x7FC01234, 0x00000001]


@pytest.fixture
def special(spark, tmp_path):
    values = np.array(SPECIAL, np.uint32).view(np.float32)
    pq.write_table(pa.table({"k": pa.array(range(8), pa.int32()), "v": pa.array(values)}), tmp_path / "v.parquet")
    return spark.read.parquet(str(tmp_path / "v.parquet"))


def test_special_words(special):
    rows = special.withColumn("b", B.float_bits(F.col("v"))).withColumn("o", B.ordered(F.col("b"))).orderBy("k").collect()
    assert [r.b for r in rows] == SPECIAL
    order = [r.b for r in sorted(rows, key=lambda r: r.o)]
    assert order == [0xFF800000, 0xBF800000, 0x80000000, 0x00000000, 0x00000001, 0x3F800000, 0x7F800000, 0x7FC01234]


def test_clearing_keeps_infinities_and_nan(special):
    rows = special.withColumn("b", B.float_bits(F.col("v"))).withColumn("q", B.clear_low(F.col("b"), 23)).orderBy("k").collect()
    assert [r.q for r in rows] == [0, 0x80000000, 0x3F800000, 0xBF800000, 0x7F800000, 0xFF800000, 0x7FC01234, 0]


def test_subnormal_halves(spark):
    halves = [0, 1, 2, 3, 512, 1023, 1024, 0x3C00, 0x7C00, 0x8001]
    got = [r.f for r in spark.createDataFrame([(h,) for h in halves], "h long").withColumn("f", B.half_to_float_bits(F.col("h"))).collect()]
    want = np.array(halves, np.uint16).view(np.float16).astype(np.float32).view(np.uint32).tolist()
    assert got == want


def test_hash_noise_equals_wrapped_arithmetic(spark):
    def noise(x, y, c):
        m = 0xFFFFFFFF
        h = (x * 374761393 & m) ^ (y * 668265263 & m) ^ ((c + 1) * 2246822519 & m)
        h = (h ^ h >> 13) * 1274126177 & m
        return (h ^ h >> 16) / 2**32 - 0.5

    rows = [(x, y, c) for x in (0, 1, 63, 5000) for y in (0, 7, 100_000) for c in range(3)]
    got = spark.createDataFrame(rows, "x int, y long, c int").withColumn("n", B.hash_noise(F.col("x"), F.col("y"), F.col("c"))).collect()
    assert [r.n for r in got] == [noise(r.x, r.y, r.c) for r in got]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_range_coder_round_trip(data):
    assert S.decode(S.encode(data), len(data)) == data


def test_range_coder_compresses():
    data = bytes([0] * 9000 + list(range(256)) * 4)
    assert len(S.encode(data)) < len(data) / 2


def test_frames(spark):
    made = S.frame(640, 480, 3, 5, 1, 9, 8, 2, 1, b"payload")
    old = struct.pack("<4sBIIBBIBB", b"HDR0", 1, 7, 5, 1, 0, 3, 0, 4) + b"xy"
    rows = spark.createDataFrame([(made,), (old,), (b"JUNK" + made[4:],)], "d binary").select(*[v.alias(k) for k, v in S.header(F.col("d")).items()]).collect()
    assert rows[0].asDict() == {"version": 3, "width": 640, "height": 480, "channels": 3, "format": 0, "stages": 5, "rans_mode": 1, "effort": 9, "low_bits": 8, "policy": 2, "sign_class": 1, "payload_bytes": 7}
    assert (rows[1].version, rows[1].width, rows[1].low_bits, rows[1].policy, rows[1].payload_bytes) == (1, 7, 0, 0, 2)
    assert rows[2].version is None


def test_log_gamma(spark):
    import math

    xs = [0.5, 1.0, 1.5, 2.0, 10.5, 1000.5, 1e6 + 0.5]
    got = [r.g for r in spark.createDataFrame([(x,) for x in xs], "x double").select(E.log_gamma(F.col("x")).alias("g")).collect()]
    for g, x in zip(got, xs, strict=True):
        assert g == pytest.approx(math.lgamma(x) / math.log(2), abs=1e-9, rel=1e-12)


def test_streams_decode(spark, data):
    rows = catalog.QUERIES["e02_range_coded_streams"](spark, data).collect()
    assert rows and all(r.exact for r in rows)


def test_router_is_finite(spark, data):
    out = catalog.QUERIES["m14_reconstruct"](spark, data)
    n = G.pixels(G.grid(spark, data, "ord3")).count()
    assert out.count() == n and out.filter("isnan(rr) or rr is null or isnan(bb) or bb is null").count() == 0


def test_router_on_ramps_with_a_bright_corner(spark):
    from lumengrid.operators import router

    rows = [("hdr", y, x, *((120.0, 80.0, 60.0) if x > 58 and y > 26 else (0.01 * x + 0.1, 0.008 * y + 0.12, 0.004 * (x + y) + 0.08))) for y in range(32) for x in range(64)]
    px = spark.createDataFrame(rows, "img string, y long, x int, r float, g float, b float")
    out = router.visual_guard(router.reconstructed(px)).cache()
    assert out.filter("x > 58 and y > 26 and not outlier").count() == 0  # the corner is routed as an outlier
    dim = out.filter("x <= 56 or y <= 24")
    worst = dim.agg(*[F.max(F.abs(F.col(a) - F.col(b))) for a, b in (("rr", "r"), ("gg", "g"), ("bb", "b"))]).first()
    assert max(worst) < 0.05
    bright = out.filter("x > 58 and y > 26").agg(F.max(F.abs(F.col("rr") / 120 - 1))).first()[0]
    assert bright < 0.02


def test_error_diffusion_keeps_the_mean(spark, data):
    q = catalog.QUERIES["q13_error_diffusion"](spark, data)
    g = G.grid(spark, data, "ord3").groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))
    got = q.groupBy("c").agg(F.avg("q").alias("q"), F.max("q").alias("top")).join(g, "c").collect()
    for r in got:
        assert r.top <= 15
        assert r.lo + r.q / 15 * (r.hi - r.lo) == pytest.approx(r.mean, abs=0.05)


def test_general_codecs_are_exact(spark, data):
    rows = catalog.QUERIES["e16_general_codecs"](spark, data).collect()
    assert {r.method for r in rows} == {"zlib9", "bz2_9", "xz6"} and all(r.exact for r in rows)


def test_peaks_are_greatest_and_apart(spark, data):
    rows = sorted(catalog.QUERIES["j14_separate_peaks"](spark, data).collect(), key=lambda r: (r.img, r.rank))
    g = G.grids(spark, data, "evt1", "part1").groupBy("img").agg(F.max("v")).collect()
    assert {r.img: r.v for r in rows if r.rank == 1} == {r[0]: r[1] for r in g}
    for a in rows:
        for b in rows:
            if a.img == b.img and a.rank < b.rank:
                assert a.v >= b.v and max(abs(a.y - b.y), abs(a.x - b.x)) >= 10


def test_context_tree_saves_bits(spark, data):
    rows = catalog.QUERIES["t07_mdl_tree"](spark, data).collect()
    n, ones = sum(r.n for r in rows), sum(r.ones for r in rows)
    whole = spark.createDataFrame([(n - ones, ones)], "z long, o long").select(E.kt_bits(F.col("z"), F.col("o"))).first()[0]
    assert len(rows) == 1 or sum(r.bits for r in rows) + 16 * (len(rows) - 1) <= whole


def test_adaptive_bits_cost_what_the_counts_say(spark, data):
    rows = catalog.QUERIES["e03_adaptive_binary"](spark, data).collect()
    assert len(rows) == 3 and all(r.exact for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 3)), max_size=400))
def test_adaptive_bits_round_trip(pairs):
    from lumengrid.operators import sequential as Z

    bits, contexts = [b for b, _ in pairs], [k for _, k in pairs]
    assert Z.decode_bits(Z.encode_bits(bits, contexts, 4), contexts, 4) == bits


def test_predictive_rows_stay_within_half_a_step(spark, data):
    g = G.grid(spark, data, "ord3")
    out = catalog.QUERIES["p20_predictive_index"](spark, data).join(g, ["img", "y", "x", "c"])
    assert out.count() == g.count() and out.agg(F.max(F.abs(F.col("rec") - F.col("v")))).first()[0] <= 0.01 + 1e-6


def test_pulled_codes_stay_in_their_bins(spark, data):
    out = catalog.QUERIES["q14_predictive_dequantisation"](spark, data)
    g = G.grid(spark, data, "ord3").groupBy("c").agg(((F.max("v") - F.min("v")) / 31).alias("step"))
    far = out.join(G.grid(spark, data, "ord3"), ["img", "y", "x", "c"]).join(g, "c").filter(F.abs(F.col("rec") - F.col("v")) > F.col("step") * 1.001)
    assert far.count() == 0

"""Queries on single samples: bit views, colour, tone, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import tone as T
from ..operators import predict as P
from ..sources import grids as G
from .registry import WORDS, grid_sql, query

c = F.col
KEYS = G.KEYS
ALL = ("emb4", "ord3", "evt1", "part1")


def words(spark, d, *names):
    return P.with_words(G.grids(spark, d, *(names or ALL)))


@query("f01_float_bits", f"WITH {grid_sql(*ALL)}, {WORDS} SELECT img, y, x, c, b, o, b >> 31 AS sign, (b >> 23) & 255 AS exponent, b & 8388607 AS mantissa, ((b >> 23) & 255) <> 255 AS finite, b AS back FROM go")
def f01(spark, d):
    """Word, ordered word, fields, and the inverse of the ordered map."""
    w = words(spark, d)
    return w.select(*KEYS, "b", "o", B.sign_of(c("b")).alias("sign"), B.exponent_of(c("b")).alias("exponent"), B.mantissa_of(c("b")).alias("mantissa"), B.is_finite(c("b")).alias("finite"), B.unordered(c("o")).alias("back"))


@query("f01_bits_round_trip", f"WITH {grid_sql(*ALL)}, {WORDS} SELECT img, count(*) AS n, count(*) AS same FROM go GROUP BY img")
def f01_inverse(spark, d):
    """words turned back to floats have the same words."""
    back = B.float_bits(B.bits_float(c("b")))
    return words(spark, d).withColumn("same", back == c("b")).groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same"))


_HALF = "CASE WHEN ((b >> 23) & 255) = 0 AND (b & 8388607) = 0 THEN (b >> 16) & 32768 WHEN ((b >> 23) & 255) BETWEEN 113 AND 142 AND (b & 8191) = 0 THEN ((b >> 16) & 32768) | ((((b >> 23) & 255) - 112) << 10) | ((b & 8388607) >> 13) END"
_CUT = "SELECT img, y, x, c, b - (b % 8192) AS b FROM gb UNION ALL SELECT img, y, x, c, b FROM gb"


@query("f06_half_exact", f"WITH {grid_sql('ord3', 'part1')}, gb AS (SELECT *, CAST(CAST(v AS BIT) AS BIGINT) AS b FROM g), u AS ({_CUT}), h AS (SELECT *, {_HALF} AS half FROM u) SELECT img, y, x, c, b, half, CASE WHEN half >= 32768 THEN 65535 - half ELSE half + 32768 END AS half_ordered, CASE WHEN half IS NOT NULL THEN b END AS back FROM h")
def f06(spark, d):
    """Exact half words (of the samples and of their upper bits), their order and their way back."""
    w = words(spark, d, "ord3", "part1")
    both = w.select(*KEYS, B.clear_low(c("b"), 13).alias("b")).unionByName(w.select(*KEYS, "b"))
    return both.withColumn("half", B.half_bits(c("b"))).withColumn("half_ordered", B.ordered16(c("half"))).withColumn("back", B.half_to_float_bits(c("half")))


@query("f08_bf16_exact", f"WITH {grid_sql('ord3')}, gb AS (SELECT *, CAST(CAST(v AS BIT) AS BIGINT) AS b FROM g) SELECT img, y, x, c, (b - b % 65536) >> 16 AS bf16, CASE WHEN b % 65536 = 0 THEN b >> 16 END AS exact FROM gb")
def f08(spark, d):
    w = words(spark, d, "ord3")
    return w.select(*KEYS, B.bf16_bits(B.clear_low(c("b"), 16)).alias("bf16"), B.bf16_bits(c("b")).alias("exact"))


@query("f09_bytes_and_planes", f"WITH {grid_sql('evt1')}, {WORDS} SELECT img, y, x, c, b & 255 AS b0, (b >> 8) & 255 AS b1, (b >> 16) & 255 AS b2, (b >> 24) & 255 AS b3, (o >> 5) & 1 AS p5, (o >> 31) & 1 AS p31 FROM go")
def f09(spark, d):
    return words(spark, d, "evt1").select(*KEYS, *[B.byte(c("b"), k).alias(f"b{k}") for k in range(4)], B.bit(c("o"), 5).alias("p5"), B.bit(c("o"), 31).alias("p31"))


@query("f10_clear_mantissa", f"WITH {grid_sql(*ALL)}, {WORDS} SELECT img, y, x, c, b - b % 256 AS q8, b - b % 4096 AS q12, b - b % 32768 AS q15, b - b % 8388608 AS q30 FROM go")
def f10(spark, d):
    """Low mantissa bits cleared."""
    return words(spark, d).select(*KEYS, *[B.clear_low(c("b"), k).alias(f"q{k}") for k in (8, 12, 15, 30)])


@query("f11_exponent_adaptive_clear", f"WITH {grid_sql(*ALL)}, {WORDS}, m AS (SELECT *, max((b >> 23) & 255) OVER (PARTITION BY img) - ((b >> 23) & 255) AS below FROM go), k AS (SELECT *, least(23, 6 + below // 2) AS bits FROM m) SELECT img, y, x, c, bits, b - b % CAST(pow(2, bits) AS BIGINT) AS q FROM k")
def f11(spark, d):
    """More bits go the further a value is below the greatest finite exponent."""
    w = words(spark, d)
    most = w.filter(B.is_finite(c("b"))).groupBy("img").agg(F.max(B.exponent_of(c("b"))).alias("most"))
    bits = B.adaptive_clear(c("b"), 6, c("most"))
    return w.join(most, "img").withColumn("bits", bits).select(*KEYS, "bits", B.clear_low(c("b"), c("bits")).alias("q"))


_PX = "px AS (SELECT img, y, x, max(b) FILTER (c = 0) AS r, max(b) FILTER (c = 1) AS g, max(b) FILTER (c = 2) AS bl FROM gb GROUP BY ALL HAVING count(*) = 3)"
_B = "gb AS (SELECT *, CAST(CAST(v AS BIT) AS BIGINT) AS b FROM g)"


def px_bits(spark, d):
    return G.pixels(words(spark, d, "ord3"), "b", "rgb")


@query("f12_xor_color", f"WITH {grid_sql('ord3')}, {_B}, {_PX} SELECT img, y, x, xor(r, g) AS r, g, xor(bl, g) AS b FROM px")
def f12(spark, d):
    return px_bits(spark, d).select("img", "y", "x", c("r").bitwiseXOR(c("g")).alias("r"), "g", c("b").bitwiseXOR(c("g")).alias("b"))


@query("f13_channel_lifting", f"WITH {grid_sql('ord3')}, {_B}, {_PX} SELECT img, y, x, (r - g + 4294967296) % 4294967296 AS dr, g, (bl - g + 4294967296) % 4294967296 AS db, r AS back_r, bl AS back_b FROM px")
def f13(spark, d):
    lifted = px_bits(spark, d).select("img", "y", "x", B.wrap(c("r") - c("g"), 32).alias("dr"), "g", B.wrap(c("b") - c("g"), 32).alias("db"))
    return lifted.withColumns({"back_r": B.wrap(c("dr") + c("g"), 32), "back_b": B.wrap(c("db") + c("g"), 32)})


@query("f14_integer_ycocg", f"WITH {grid_sql('ord3')}, {_B}, {_PX}, s AS (SELECT *, r - bl AS co, bl + ((r - bl) >> 1) AS t FROM px) SELECT img, y, x, t + ((g - t) >> 1) AS luma, co, g - t AS cg, r - g AS lift_r, bl - g AS lift_b, r AS back_r, g AS back_g, bl AS back_b FROM s")
def f14(spark, d):
    """reversible integer colour lifts and their inverse."""
    p = px_bits(spark, d).withColumns({"lift_r": c("r") - c("g"), "lift_b": c("b") - c("g")})
    p = p.withColumn("co", c("r") - c("b")).withColumn("t", c("b") + F.shiftright("co", 1)).withColumn("cg", c("g") - c("t")).withColumn("luma", c("t") + F.shiftright("cg", 1))
    t = c("luma") - F.shiftright("cg", 1)
    p = p.withColumn("back_g", c("cg") + t).withColumn("back_b", t - F.shiftright("co", 1)).withColumn("back_r", c("back_b") + c("co"))
    return p.select("img", "y", "x", "luma", "co", "cg", "lift_r", "lift_b", "back_r", "back_g", "back_b")


_PV = "px AS (SELECT img, y, x, CAST(max(v) FILTER (c = 0) AS DOUBLE) AS r, CAST(max(v) FILTER (c = 1) AS DOUBLE) AS g, CAST(max(v) FILTER (c = 2) AS DOUBLE) AS b FROM g GROUP BY ALL HAVING count(*) = 3)"


def px(spark, d):
    return G.pixels(G.grid(spark, d, "ord3"))


@query("f15_vst_ycocg", f"WITH {grid_sql('ord3')}, {_PV}, t AS (SELECT img, y, x, pow(r, 0.75) AS r, pow(g, 0.75) AS g, pow(b, 0.75) AS b FROM px) SELECT img, y, x, round((r + 2 * g + b) / 4, 6) AS luma, round(r - b, 6) AS co, round(g - (r + b) / 2, 6) AS cg, round(pow(r, 4.0 / 3), 5) AS back_r, round(pow(g, 4.0 / 3), 5) AS back_g, round(pow(b, 4.0 / 3), 5) AS back_b FROM t")
def f15(spark, d):
    """variance-stabilised luma and chroma planes and the way back."""
    t = px(spark, d).select("img", "y", "x", *[T.vst(c(k)).alias(k) for k in "rgb"])
    y, co, cg = T.ycocg(c("r"), c("g"), c("b"))
    planes = t.select("img", "y", "x", y.alias("luma"), co.alias("co"), cg.alias("cg"))
    back = dict(zip(("back_r", "back_g", "back_b"), T.ycocg_inverse(c("luma"), c("co"), c("cg")), strict=True))
    return planes.select("img", "y", "x", *[F.round(k, 6).alias(k) for k in ("luma", "co", "cg")], *[F.round(T.vst_inverse(x), 5).alias(k) for k, x in back.items()])


@query("f16_color_coefficients", f"WITH {grid_sql('ord3')}, {_PV}, k AS (SELECT CAST(unnest([0.25, 0.5]) AS DOUBLE) AS a) SELECT img, y, x, a, round(a * r + (1 - 2 * a) * g + a * b, 6) AS luma, round(r - g, 6) AS cr, round(b - g, 6) AS cb FROM px, k")
def f16(spark, d):
    each = F.explode(F.array(F.lit(0.25), F.lit(0.5)))
    r, g, b = (c(k).cast("double") for k in "rgb")
    return px(spark, d).withColumn("a", each).select("img", "y", "x", "a", F.round(c("a") * r + (1 - 2 * c("a")) * g + c("a") * b, 6).alias("luma"), F.round(r - g, 6).alias("cr"), F.round(b - g, 6).alias("cb"))


_S = "CASE WHEN v < 0 THEN -1.0 ELSE 1.0 END"
_A = "abs(CAST(v AS DOUBLE))"
_FORWARD = {"linear": "CAST(v AS DOUBLE)", "signed_log": f"{_S} * log2(1 + {_A})", "sqrt": f"{_S} * sqrt({_A})", "gamma075": f"{_S} * pow({_A}, 0.75)", "gamma025": f"{_S} * pow({_A}, 0.25)", "asinh": "asinh(CAST(v AS DOUBLE))"}


@query("f19_transforms", f"WITH {grid_sql('emb4', 'evt1')} SELECT img, y, x, c, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _FORWARD.items()) + ", true AS inverts FROM g")
def f19(spark, d):
    """six transforms, and whether each inverse comes back to a relative 1e-9."""
    g = G.grids(spark, d, "emb4", "evt1")
    good = F.lit(True)
    for m in T.TRANSFORMS:
        good = good & (F.abs(T.inverse(T.forward(c("v"), m), m) - c("v").cast("double")) <= 1e-9 * (1 + F.abs(c("v").cast("double"))))
    return g.select(*KEYS, *[F.round(T.forward(c("v"), m), 6).alias(m) for m in T.TRANSFORMS], good.alias("inverts"))


@query("f18_vst_modes", f"WITH {grid_sql('evt1')} SELECT img, y, x, c, round({_S} * log2(1 + {_A} / 0.01), 6) AS log_, round(asinh(CAST(v AS DOUBLE) / 0.01), 6) AS asinh_, round({_S} * (2 / 0.02) * (sqrt({_A} * 0.02 + 0.001) - sqrt(CAST(0.001 AS DOUBLE))), 5) AS sqrt_ FROM g")
def f18(spark, d):
    return G.grid(spark, d, "evt1").select(*KEYS, *[F.round(T.vst_mode(c("v"), m, 0.02, 0.001, 0.01), k).alias(f"{m}_") for m, k in (("log", 6), ("asinh", 6), ("sqrt", 5))])


_PQ = "pow((0.8359375 + 18.8515625 * pow({a} / 500, 0.1593017578125)) / (1 + 18.6875 * pow({a} / 500, 0.1593017578125)), 78.84375)".format(a=_A)


@query("f20_perceptual", f"WITH {grid_sql('evt1', 'ord3')} SELECT img, y, x, c, round({_S} * {_PQ}, 6) AS pq, round({_S} * CASE WHEN {_A} / 2 >= 0.0078125 THEN (log2({_A} / 2) + 9.72) / 17.52 ELSE 10.5402377416545 * {_A} / 2 + 0.0729055341958355 END, 6) AS acescct, round({_S} * pow({_A}, 0.9), 6) AS gamma09, true AS pq_inverts FROM g")
def f20(spark, d):
    """perceptual quantiser, ACEScct, signed power."""
    g = G.grids(spark, d, "evt1", "ord3")
    back = F.abs(T.pq_inverse(T.pq(c("v"), 500.0), 500.0) - c("v")) <= 1e-6 * (1 + F.abs(c("v")))
    return g.select(*KEYS, F.round(T.pq(c("v"), 500.0), 6).alias("pq"), F.round(T.acescct(c("v"), 2.0), 6).alias("acescct"), F.round(T.signed_power(c("v"), 0.9), 6).alias("gamma09"), back.alias("pq_inverts"))


_L = "0.2126 * r + 0.7152 * g + 0.0722 * b"


@query("f22_luma_display", f"WITH {grid_sql('ord3')}, {_PV} SELECT img, y, x, round({_L}, 6) AS luma, round(log2(1 + greatest({_L}, 0)), 6) AS log_luma, round(greatest(r, g, b), 6) AS maxrgb, round(pow(least(greatest({_L}, 0) / 4, 1), 1 / 2.2), 6) AS shown, round(pow(least(greatest({_L}, 0) * 8 / 4, 1), 1 / 2.2), 6) AS lifted FROM px")
def f22(spark, d):
    """luma, its log, the greatest channel, and displayed luma at two exposures."""
    y = T.luma(c("r"), c("g"), c("b"))
    return px(spark, d).select("img", "y", "x", F.round(y, 6).alias("luma"), F.round(T.log_luma(y), 6).alias("log_luma"), F.round(F.greatest("r", "g", "b").cast("double"), 6).alias("maxrgb"), F.round(T.display(y), 6).alias("shown"), F.round(T.display(y, 3.0), 6).alias("lifted"))


@query("f24_zigzag", f"WITH {grid_sql('emb4')}, {WORDS}, z AS (SELECT *, o - 2147483648 AS s FROM go) SELECT img, y, x, c, CASE WHEN s >= 0 THEN 2 * s ELSE -2 * s - 1 END AS z, s AS back, (o % 65536) - CASE WHEN o % 65536 >= 32768 THEN 65536 ELSE 0 END AS wrapped FROM z")
def f24(spark, d):
    """zigzag and back, signed difference modulo 2^16."""
    s = words(spark, d, "emb4").withColumn("s", c("o") - B.SIGN).withColumn("z", B.zigzag(c("s")))
    return s.select(*KEYS, "z", B.unzigzag(c("z")).alias("back"), B.signed_difference(c("o"), B.long(0), 16).alias("wrapped"))


_TZ = "CASE WHEN b % 8388608 = 0 THEN 23 ELSE CAST(log2((b % 8388608) & (8388608 - (b % 8388608))) AS INTEGER) END"


@query("f26_trailing_zeros", f"WITH {grid_sql('ord3', 'part1')}, {_B} SELECT img, tz, count(*) AS n FROM (SELECT img, {_TZ} AS tz FROM gb) GROUP BY ALL")
def f26(spark, d):
    """Trailing zeros of the mantissas."""
    return words(spark, d, "ord3", "part1").groupBy("img", B.trailing_zeros(B.mantissa_of(c("b")), 23).alias("tz")).agg(F.count(F.lit(1)).alias("n"))


_FOLD = "(({k} * 2654435761) & 4294967295)"


@query("f27_hash_fold", f"WITH {grid_sql('ord3')}, {_B}, k AS (SELECT *, b & 262143 AS code FROM gb), m AS (SELECT *, xor(code, code >> 11) AS k FROM k), h AS (SELECT *, {_FOLD.format(k='k')} AS h FROM m) SELECT img, y, x, c, xor(h, h >> 16) & 2047 AS bucket FROM h")
def f27(spark, d):
    return words(spark, d, "ord3").select(*KEYS, B.fold_hash(c("b").bitwiseAND(B.long(262143))).alias("bucket"))


_M = lambda e, k: f"(CAST((CAST({e} AS HUGEINT) * {k}) % 4294967296 AS BIGINT))"
_H0 = f"xor(xor({_M('x', 374761393)}, {_M('y', 668265263)}), {_M('(c + 1)', 2246822519)})"


@query("f28_hash_noise", f"WITH {grid_sql('emb4', 'ord3')}, h AS (SELECT *, {_H0} AS h FROM g), i AS (SELECT *, {_M('xor(h, h >> 13)', 1274126177)} AS i FROM h) SELECT img, y, x, c, xor(i, i >> 16) / 4294967296.0::DOUBLE - 0.5 AS noise FROM i")
def f28(spark, d):
    return G.grids(spark, d, "emb4", "ord3").select(*KEYS, B.hash_noise(c("x"), c("y"), c("c")).alias("noise"))


@query("f29_decimal_exact", f"WITH {grid_sql('ord3', 'part1', 'evt1')} SELECT img, " + ", ".join(f"count(*) FILTER (CAST(round_even(CAST(v AS DOUBLE) * {10**k}, 0) / {10**k} AS FLOAT) = v) AS d{k}" for k in range(7)) + " FROM g GROUP BY img")
def f29(spark, d):
    """samples that k decimals express."""
    return G.grids(spark, d, "ord3", "part1", "evt1").groupBy("img").agg(*[F.count_if(B.decimal_exact(c("v"), k)).alias(f"d{k}") for k in range(7)])


@query("f31_varint_size", "SELECT CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 16384 THEN 2 WHEN o_orderkey < 2097152 THEN 3 ELSE 4 END::BIGINT AS size, count(*) AS n FROM orders GROUP BY ALL")
def f31(spark, d):
    return G.table(spark, d, "orders").groupBy(B.varint_size(c("o_orderkey")).alias("size")).agg(F.count(F.lit(1)).alias("n"))


_T = "least(greatest((CAST(v AS DOUBLE) - 1) / 3, 0), 1)"


@query("f32_smoothstep", f"WITH {grid_sql('ord3')} SELECT img, y, x, c, round({_T} * {_T} * (3 - 2 * {_T}), 6) AS s FROM g")
def f32(spark, d):
    return G.grid(spark, d, "ord3").select(*KEYS, F.round(T.smoothstep(1.0, 4.0, c("v").cast("double")), 6).alias("s"))


@query("n02_patterns", "WITH g AS (SELECT y, x, c FROM range(64) t(y), range(32) u(x), range(3) w(c)) SELECT y::INTEGER AS y, x::INTEGER AS x, c::INTEGER AS c, round(0.01 * x + 0.006 * y + 0.25 * c + 0.001 * sin(0.17 * (x + y + c)), 9) AS ripple, round(12 * sin(0.09 * x) - 8 * cos(0.07 * y) + 0.125 * c, 9) AS wave FROM g")
def n02(spark, d):
    """Closed-form test patterns."""
    g = spark.range(64 * 32 * 3).selectExpr("cast(id div 96 as int) y", "cast(id div 3 % 32 as int) x", "cast(id % 3 as int) c")
    return g.selectExpr("y", "x", "c", "round(0.01D * x + 0.006D * y + 0.25D * c + 0.001D * sin(0.17D * (x + y + c)), 9) ripple", "round(12 * sin(0.09D * x) - 8 * cos(0.07D * y) + 0.125D * c, 9) wave")

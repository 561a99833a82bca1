"""Queries on predictions, residuals, entropies, adaptive code lengths and mode choice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import contexts as C
from ..operators import entropy as E
from ..operators import predict as P
from ..sources import grids as G
from .registry import KT, NEIGHBOURS, PREDICTIONS, QUERIES, SQL, WORDS, grid_sql, modes_sql, query, residual_sql

c = F.col
KEYS = G.KEYS
TWO = ("ord3", "evt1")


def near(spark, d, *names):
    return P.with_neighbours(P.with_words(G.grids(spark, d, *(names or TWO))))


def _predictor(i: int, mode: str):
    def run(spark, d):
        n = near(spark, d, "emb4", "part1")
        r = P.xor_residual(c("o"), P.prediction(mode)) if mode.startswith("xor") else c("o").bitwiseAND(B.long(B.BODY)) if mode == "raw" else P.body_residual(c("o"), P.prediction(mode))
        return n.select(*KEYS, P.prediction(mode).alias("predicted"), r.alias("residual"))

    run.__doc__ = f"P1-P9, R1: the {mode} prediction of every sample and the residual of its body."
    name = f"p{i:02d}_{mode}"
    QUERIES[name] = run
    SQL[name] = f"WITH {grid_sql('emb4', 'part1')}, {WORDS}, {NEIGHBOURS} SELECT img, y, x, c, CAST({PREDICTIONS[mode]} AS BIGINT) AS predicted, {residual_sql(mode)} AS residual FROM nb"


for _i, _m in enumerate(P.MODES):
    _predictor(_i + 1, _m)


@query("p03_channels", f"WITH {grid_sql('ord3')}, {WORDS}, k AS (SELECT *, lag(o, 1, 0) OVER (PARTITION BY img, y, x ORDER BY c) AS pc, max(o) FILTER (c = 1) OVER (PARTITION BY img, y, x) AS gr, count(*) OVER (PARTITION BY img, y, x) AS k FROM go) SELECT img, y, x, c, pc, CASE WHEN k >= 3 AND c <> 1 THEN coalesce(gr, 0) ELSE 0 END AS green FROM k")
def p03(spark, d):
    return P.with_channels(P.with_words(G.grid(spark, d, "ord3"))).select(*KEYS, "pc", c("green").cast("long").alias("green"))


_FN = """fr AS (SELECT *, lag(v) OVER (PARTITION BY img, c, y ORDER BY x) AS fw FROM nb),
fn AS (SELECT *, lag(v) OVER k AS fn, lag(fw) OVER k AS fnw FROM fr WINDOW k AS (PARTITION BY img, c, x ORDER BY y))"""
_FORD = "(CASE WHEN CAST(CAST(p AS BIT) AS BIGINT) >= 2147483648 THEN 4294967295 - CAST(CAST(p AS BIT) AS BIGINT) ELSE CAST(CAST(p AS BIT) AS BIGINT) + 2147483648 END)"


def _float(mode: str, inner: str):
    def run(spark, d):
        n = near(spark, d, "emb4", "part1")
        row, col = Window.partitionBy("img", "c", "y").orderBy("x"), Window.partitionBy("img", "c", "x").orderBy("y")
        f = n.withColumn("fw", F.lag("v").over(row)).withColumns({"fn": F.lag("v").over(col)}).withColumn("fnw", F.lag("fw").over(col))
        return f.select(*KEYS, P.float_prediction(mode).alias("predicted"))

    name = f"p08_float_{mode}"
    run.__doc__ = f"P8: the {mode} prediction in binary32 arithmetic, as an ordered word."
    QUERIES[name] = run
    SQL[name] = f"WITH {grid_sql('emb4', 'part1')}, {WORDS}, {NEIGHBOURS}, {_FN}, q AS (SELECT *, {inner} AS p FROM fn) SELECT img, y, x, c, CASE WHEN y = 0 AND x = 0 THEN 2147483648 WHEN y = 0 THEN w WHEN x = 0 THEN n ELSE {_FORD} END AS predicted FROM q"


_float("planar", "fn + fw - fnw")
_float("med", "CASE WHEN fnw >= greatest(fn, fw) THEN least(fn, fw) WHEN fnw <= least(fn, fw) THEN greatest(fn, fw) ELSE fn + fw - fnw END")


@query("p11_index_average", f"WITH {grid_sql('ord3')}, go AS (SELECT img, y, x, c, CAST(floor(v * 25.4) AS BIGINT) AS o FROM g), {NEIGHBOURS} SELECT img, y, x, c, (w + n) // 2 AS average, greatest(0, CASE WHEN nw >= greatest(w, n) THEN least(w, n) WHEN nw <= least(w, n) THEN greatest(w, n) ELSE w + n - nw END) AS med FROM nb")
def p11(spark, d):
    """Average and MED predictions of 7-bit indices."""
    q = G.grid(spark, d, "ord3").select(*KEYS, F.floor(c("v") * F.lit(25.4).cast("float")).cast("long").alias("o"))
    return P.with_neighbours(q).select(*KEYS, F.expr("(w + n) div 2").alias("average"), P.med(c("w"), c("n"), c("nw")).alias("med"))


SQL["p11_index_average"] = SQL["p11_index_average"].replace("floor(v * 25.4)", "floor(v * CAST(25.4 AS FLOAT))")


@query("p13_byte_filters", f"WITH {grid_sql('evt1')}, {WORDS}, i AS (SELECT *, y * 100 + x AS idx FROM go), s AS (SELECT *, unnest([0, 1, 2, 3]) AS plane FROM i), t AS (SELECT *, (b >> CAST(8 * plane AS INTEGER)) & 255 AS byte, idx // 4096 AS chunk FROM s), u AS (SELECT *, lag(byte, 1, 0) OVER k AS w0, lag(byte, 100, 0) OVER k AS n0 FROM t WINDOW k AS (PARTITION BY chunk, plane ORDER BY idx)) SELECT chunk, plane, sum((byte - CASE WHEN x > 0 THEN w0 ELSE 0 END + 256) % 256)::BIGINT AS west, sum((byte - n0 + 256) % 256)::BIGINT AS north, count(*) AS n FROM u GROUP BY ALL")
def p13(spark, d):
    """Byte-plane west and north residuals inside chunks of 4096 samples."""
    w = G.raster(P.with_words(G.grid(spark, d, "evt1"))).withColumnRenamed("i", "idx")
    width = int(w.agg(F.max("width")).first()[0] or 1)  # the row above lies so many places back
    planes = F.explode(F.array(*[F.struct(F.lit(k).alias("plane"), B.byte(c("b"), k).alias("byte")) for k in range(4)]))
    s = w.select("x", "idx", F.expr("idx div 4096").alias("chunk"), planes.alias("s")).select("x", "idx", "chunk", "s.*")
    k = Window.partitionBy("chunk", "plane").orderBy("idx")
    west, north = F.when(c("x") > 0, F.lag("byte", 1, 0).over(k)).otherwise(F.lit(0)), F.lag("byte", width, 0).over(k)
    r = s.select("chunk", "plane", F.pmod(c("byte") - west, F.lit(256)).alias("rw"), F.pmod(c("byte") - north, F.lit(256)).alias("rn"))
    return r.groupBy("chunk", "plane").agg(F.sum("rw").alias("west"), F.sum("rn").alias("north"), F.count(F.lit(1)).alias("n"))


@query("p14_scanline_difference", f"WITH {grid_sql('ord3')} SELECT img, y, x, c, round(CAST(v - lag(v, 1, CAST(0 AS FLOAT)) OVER (PARTITION BY img, y ORDER BY x, c) AS DOUBLE), 5) AS d FROM g")
def p14(spark, d):
    before = F.lag("v", 1).over(Window.partitionBy("img", "y").orderBy("x", "c"))
    return G.grid(spark, d, "ord3").select(*KEYS, F.round((c("v") - F.coalesce(before, F.lit(0.0).cast("float"))).cast("double"), 5).alias("d"))


@query("p15_second_order", f"WITH {grid_sql('evt1')}, {WORDS} SELECT img, y, x, c, o - 2 * lag(o, 1, 0) OVER r + lag(o, 2, 0) OVER r AS dx, o - 2 * lag(o, 1, 0) OVER k + lag(o, 2, 0) OVER k AS dy FROM go WINDOW r AS (PARTITION BY img, c, y ORDER BY x), k AS (PARTITION BY img, c, x ORDER BY y)")
def p15(spark, d):
    r, k = Window.partitionBy("img", "c", "y").orderBy("x"), Window.partitionBy("img", "c", "x").orderBy("y")
    lag = lambda w, i: F.coalesce(F.lag("o", i).over(w), F.lit(0))
    return P.with_words(G.grid(spark, d, "evt1")).select(*KEYS, (c("o") - 2 * lag(r, 1) + lag(r, 2)).alias("dx"), (c("o") - 2 * lag(k, 1) + lag(k, 2)).alias("dy"))


_T128 = "y // 64 AS ty, x // 64 AS tx"


@query("p16_tile_plane_fit", f"WITH {grid_sql('part1', 'evt1')}, t AS (SELECT *, y // 16 AS ty, x // 16 AS tx, CAST(v AS DOUBLE) AS d FROM g) SELECT img, ty, tx, round(covar_pop(x, d), 4) AS cx, round(covar_pop(y, d), 4) AS cy, round(regr_slope(d, x), 5) AS sx, round(regr_slope(d, y), 5) AS sy, round(avg(d), 5) AS mean FROM t GROUP BY ALL")
def p16(spark, d):
    """Least-squares surfaces of tiles (x and y are uncorrelated in full tiles)."""
    t = G.grids(spark, d, "part1", "evt1").withColumns({"ty": F.expr("y div 16"), "tx": F.expr("cast(x div 16 as int)"), "d": c("v").cast("double")})
    return t.groupBy("img", "ty", "tx").agg(F.round(F.covar_pop("x", "d"), 4).alias("cx"), F.round(F.covar_pop("y", "d"), 4).alias("cy"), F.round(F.regr_slope("d", "x"), 5).alias("sx"), F.round(F.regr_slope("d", "y"), 5).alias("sy"), F.round(F.avg("d"), 5).alias("mean"))


MODES = P.MODES
_R = modes_sql(MODES)


@query("r01_payloads", f"WITH {grid_sql(*TWO)}, {WORDS}, {NEIGHBOURS}, {_R} SELECT img, mode, count(*) AS n, count(*) FILTER (r = 0) AS zeros, sum(r)::BIGINT AS total FROM r GROUP BY ALL")
def r01(spark, d):
    """Payloads of all modes in one pass."""
    r = P.residuals(near(spark, d), MODES)
    return r.groupBy("img", "mode").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("r") == 0).alias("zeros"), F.sum("r").alias("total"))


@query("r03_mode_legality", "SELECT m AS mode, ch AS c, CASE WHEN m = 'green' THEN ch IN (0, 2) WHEN m = 'channel' THEN ch IN (0, 2) ELSE true END AS legal FROM (SELECT unnest(['raw', 'west', 'channel', 'green']) AS m), (SELECT unnest([0, 1, 2]) AS ch)")
def r03(spark, d):
    """Modes that a channel may use when channels decode in the order green, red, blue."""
    rank = F.element_at(F.array(F.lit(1), F.lit(0), F.lit(2)), c("c") + 1)
    before = F.element_at(F.array(F.lit(1), F.lit(0), F.lit(2)), F.greatest(c("c"), F.lit(1)))
    modes = spark.createDataFrame([(m, i) for m in ("raw", "west", "channel", "green") for i in range(3)], "mode string, c int")
    legal = F.when(c("mode") == "green", c("c").isin(0, 2) & (rank > 0)).when(c("mode") == "channel", (c("c") == 0) | (before < rank)).otherwise(True)
    return modes.withColumn("legal", legal)


@query("r04_convertible_tiles", f"WITH {grid_sql(*TWO)}, {WORDS}, t AS (SELECT *, y // 16 AS ty, x // 16 AS tx, y % 2 = 0 AS even FROM go) SELECT img, ty, tx, bool_and(b % 65536 = 0) AS bf16, bool_and((b - b % 8192) % 8192 = 0) AS half_cut, count(*) AS n FROM t GROUP BY ALL")
def r04(spark, d):
    """Tiles whose samples are all bf16, or half after the low 13 bits are cleared."""
    t = P.with_words(G.grids(spark, d, *TWO)).withColumns({"ty": F.expr("y div 16"), "tx": F.expr("cast(x div 16 as int)"), "k": B.bf16_bits(c("b")).isNotNull(), "h": B.half_bits(B.clear_low(c("b"), 13)).isNotNull()})
    return t.groupBy("img", "ty", "tx").agg(F.every("k").alias("bf16"), F.every("h").alias("half_cut"), F.count(F.lit(1)).alias("n"))


SQL["r04_convertible_tiles"] = SQL["r04_convertible_tiles"].replace("bool_and((b - b % 8192) % 8192 = 0)", "bool_and(((b >> 23) & 255) BETWEEN 113 AND 142 OR (b & 2147483647) = 0)")


@query("r05_tail_split", f"WITH {grid_sql(*TWO)}, {WORDS} SELECT img, y // 64 AS ty, count(*) AS n, count(*) FILTER (o % 32768 <> 0) AS nonzero, sum(o % 32768)::BIGINT AS tail FROM go GROUP BY ALL")
def r05(spark, d):
    t = P.with_words(G.grids(spark, d, *TWO)).withColumn("tail", c("o").bitwiseAND(B.long(32767)))
    return t.groupBy("img", F.expr("y div 64").alias("ty")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("tail") != 0).alias("nonzero"), F.sum("tail").alias("tail"))


@query("r07_small_escape", f"WITH {grid_sql('ord3')}, go AS (SELECT img, y, x, c, CAST(floor(v * CAST(25.4 AS FLOAT)) AS BIGINT) AS o FROM g), {NEIGHBOURS}, s AS (SELECT *, o - (w + n) // 2 AS s FROM nb) SELECT img, c, CASE WHEN s < -7 THEN 15 WHEN s > 7 THEN 16 ELSE s + 7 END AS category, count(*) AS n FROM s GROUP BY ALL")
def r07(spark, d):
    """Signed index residuals in 17 categories, two of them escapes."""
    q = P.with_neighbours(G.grid(spark, d, "ord3").select(*KEYS, F.floor(c("v") * F.lit(25.4).cast("float")).cast("long").alias("o")))
    s = q.withColumn("s", c("o") - F.expr("(w + n) div 2"))
    return s.groupBy("img", "c", F.when(c("s") < -7, 15).when(c("s") > 7, 16).otherwise(c("s") + 7).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("r10_carries", f"WITH {grid_sql('evt1')}, {WORDS}, {NEIGHBOURS} SELECT img, y, x, c, CAST((o & 32767) < (w & 32767) AS INTEGER) AS carry15, CAST((o & 2097151) < (w & 2097151) AS INTEGER) AS carry21 FROM nb")
def r10(spark, d):
    """Borrows out of the low 15 and 21 bits of the west difference."""
    low = lambda k: (c("o").bitwiseAND(B.long((1 << k) - 1)) < c("w").bitwiseAND(B.long((1 << k) - 1))).cast("int")
    return near(spark, d, "evt1").select(*KEYS, low(15).alias("carry15"), low(21).alias("carry21"))


@query("r11_west_reconstruct", f"WITH {grid_sql(*TWO)}, {WORDS} SELECT img, count(*) AS n, count(*) AS same, count(*) AS same_xor FROM go GROUP BY img")
def r11(spark, d):
    """Running sums and running xors of west residuals give the words back."""
    row = Window.partitionBy("img", "c", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    n = near(spark, d).withColumns({"dw": F.pmod(c("o") - c("w"), B.long(1 << 32)), "xw": c("o").bitwiseXOR(c("w"))})
    back = n.withColumns({"a": F.pmod(F.sum("dw").over(row), B.long(1 << 32)) == c("o"), "e": F.expr("bit_xor(xw)").over(row) == c("o")})
    return back.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("same"), F.count_if("e").alias("same_xor"))


_CTX = "ORDER BY x"
_RN = """rt AS (SELECT *, y // 128 AS ty, x // 128 AS tx FROM (SELECT img, y, x, c, {r} AS r FROM nb)),
ra AS (SELECT *, lag(r, 1, 0) OVER (PARTITION BY img, c, y, ty, tx ORDER BY x) AS rw, lead(r, 1, 0) OVER (PARTITION BY img, c, y, ty, tx ORDER BY x) AS re, lag(r, 1, 0) OVER (PARTITION BY img, y, x ORDER BY c) AS rpc FROM rt),
rb AS (SELECT *, lag(r, 1, 0) OVER k AS rn, lag(rw, 1, 0) OVER k AS rnw, lag(re, 1, 0) OVER k AS rne FROM ra WINDOW k AS (PARTITION BY img, c, x, ty, tx ORDER BY y)),
bits AS (SELECT rb.*, t.bit FROM rb, (SELECT CAST(unnest(range(31)) AS INTEGER) AS bit) t)"""
_RN_WEST = _RN.format(r=residual_sql("west"))


def _at(v: str, up: int = 0) -> str:
    return f"(({v} >> CAST(bit + {up} AS INTEGER)) & 1)"


# Contexts written out by hand for SQL (the lowest bit first): not made from the operator's lists.
_W, _N, _NW, _NE, _PC = _at("rw"), _at("rn"), _at("rnw"), _at("rne"), _at("rpc")
_P1, _P2, _P3, _P4 = (_at("r", k) for k in (1, 2, 3, 4))
_WP1, _WP2, _NP1, _NP2 = _at("rw", 1), _at("rw", 2), _at("rn", 1), _at("rn", 2)
_C0, _C1, _C2 = (f"CAST(c = {k} AS INTEGER)" for k in (0, 1, 2))
_XO, _YO = "(x % 2)", "(y % 2)"
_CODE = f"({_W} + 2*{_N} + 4*{_NW} + 8*{_NE} + 16*{_PC} + 32*{_P1} + 64*{_P2} + 128*{_P3} + 256*{_P4} + 512*{_WP1} + 1024*{_NP1} + 2048*{_WP2} + 4096*{_NP2} + 8192*{_XO} + 16384*{_YO} + 32768*{_C0} + 65536*{_C1} + 131072*{_C2})"
_MIXED = f"((xor(CAST({_CODE} AS BIGINT), CAST({_CODE} AS BIGINT) >> 11) * 2654435761) & 4294967295)"
_FAMILY_SQL = {
    "base": f"{_W} + 2*{_N} + 4*{_NW} + 8*{_NE} + 16*{_P1} + 32*{_P2} + 64*{_P3} + 128*{_P4}",
    "prev": f"{_P1} + 2*{_P2} + 4*{_P3} + 8*{_P4}",
    "wn_prev": f"{_W} + 2*{_N} + 4*{_P1} + 8*{_P2} + 16*{_P3} + 32*{_P4}",
    "spatial_prev_pc": f"{_W} + 2*{_N} + 4*{_NW} + 8*{_NE} + 16*{_PC} + 32*{_P1} + 64*{_P2} + 128*{_P3} + 256*{_P4}",
    "spatial_prev_channel": f"{_W} + 2*{_N} + 4*{_NW} + 8*{_NE} + 16*{_C0} + 32*{_C1} + 64*{_C2} + 128*{_P1} + 256*{_P2} + 512*{_P3} + 1024*{_P4}",
    "spatial_hi": f"{_W} + 2*{_N} + 4*{_NW} + 8*{_NE} + 16*{_P1} + 32*{_WP1} + 64*{_NP1} + 128*{_P2} + 256*{_WP2} + 512*{_NP2}",
    "spatial_hi_channel": f"{_W} + 2*{_N} + 4*{_C0} + 8*{_C1} + 16*{_C2} + 32*{_P1} + 64*{_WP1} + 128*{_NP1} + 256*{_P2} + 512*{_WP2} + 1024*{_NP2}",
    "spatial_hi_pc": f"{_W} + 2*{_N} + 4*{_NW} + 8*{_NE} + 16*{_PC} + 32*{_P1} + 64*{_WP1} + 128*{_NP1} + 256*{_P2} + 512*{_WP2} + 1024*{_NP2}",
    "prev_xy_channel": f"{_P1} + 2*{_P2} + 4*{_XO} + 8*{_YO} + 16*{_C0} + 32*{_C1} + 64*{_C2}",
    "hash_all": f"xor({_MIXED}, {_MIXED} >> 16) & 2047",
    "prev4_channel": f"{_P1} + 2*{_P2} + 4*{_P3} + 8*{_P4} + 16*{_C0} + 32*{_C1} + 64*{_C2}",
    "wn_prev4_channel": f"{_W} + 2*{_N} + 4*{_P1} + 8*{_P2} + 16*{_P3} + 32*{_P4} + 64*{_C0} + 128*{_C1} + 256*{_C2}",
    "wn_prev4_pc": f"{_W} + 2*{_N} + 4*{_PC} + 8*{_P1} + 16*{_P2} + 32*{_P3} + 64*{_P4}",
    "spatial_xy": f"{_W} + 2*{_N} + 4*{_NW} + 8*{_NE} + 16*{_XO} + 32*{_YO} + 64*{_P1} + 128*{_P2}",
    "constant_zero": "0",
}
FAMS = list(C.FAMILIES)
_FAM = "fam AS (" + " UNION ALL ".join(f"SELECT img, ty, tx, bit, '{f}' AS family, {i} AS ord, {ctx} AS ctx, (r >> bit) & 1 AS one FROM bits" for i, (f, ctx) in enumerate(_FAMILY_SQL.items())) + ")"
_CTXQ = f"WITH {grid_sql('ord3')}, {WORDS}, {NEIGHBOURS}, {_RN_WEST}, {_FAM}, n AS (SELECT img, ty, tx, bit, family, ord, ctx, count(*) AS n, sum(one) AS ones FROM fam GROUP BY ALL)"
_LEGAL = f"CASE WHEN max(family) <> 'constant_zero' THEN sum({KT}) WHEN sum(ones) = 0 THEN 0.0 END"


def families(spark, d, names=("ord3",)):
    n = near(spark, d, *names).select(*KEYS, P.body_residual(c("o"), c("w")).alias("r"))
    return C.counted(C.with_residual_neighbours(n), FAMS, range(31))



def _cost():
    """Adaptive bits of n bits with `ones` ones."""
    return E.kt_bits(c("n") - c("ones"), c("ones"))


@query("c00_context_counts", f"{_CTXQ} SELECT family, bit, count(*) AS contexts, sum(n)::BIGINT AS n, sum(ones)::BIGINT AS ones, sum(ctx * n)::BIGINT AS weight FROM n GROUP BY ALL")
def c00(spark, d):
    """Contexts of every bit of the west residual in every family."""
    n = families(spark, d)
    return n.groupBy("family", "bit").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.sum(c("ctx") * c("n")).alias("weight"))


@query("a13_context_cost", f"{_CTXQ}, k AS (SELECT img, ty, tx, bit, family, {_LEGAL} AS bits FROM n GROUP BY ALL) SELECT img, ty, tx, family, count(bits) AS planes, round(sum(bits), 3) AS bits FROM k GROUP BY ALL")
def a13(spark, d):
    """Adaptive bits of each family over the planes of a tile that it may code."""
    cost = C.family_bits(families(spark, d), ["img", "ty", "tx", "bit", "family"], _cost())
    return cost.groupBy("img", "ty", "tx", "family").agg(F.count("bits").alias("planes"), F.round(F.sum("bits"), 3).alias("bits"))


@query("a14_best_family", f"{_CTXQ}, k AS (SELECT img, ty, tx, bit, family, ord, round({_LEGAL}, 6) AS bits FROM n GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY img, ty, tx, bit ORDER BY bits, ord) AS place FROM k WHERE bits IS NOT NULL) SELECT img, ty, tx, round(sum(bits), 3) AS bits, count(*) AS planes, count(*) FILTER (family = 'constant_zero') AS empty FROM m WHERE place = 1 GROUP BY ALL")
def a14(spark, d):
    """The cheapest family of each plane (the first wins ties), summed over planes; C14 where a plane is empty."""
    cost = C.family_bits(families(spark, d), ["img", "ty", "tx", "bit", "family", "ord"], _cost()).withColumn("bits", F.round("bits", 6)).filter("bits is not null")
    best = cost.groupBy("img", "ty", "tx", "bit").agg(F.min(F.struct("bits", "ord", "family")).alias("m"))
    return best.groupBy("img", "ty", "tx").agg(F.round(F.sum("m.bits"), 3).alias("bits"), F.count(F.lit(1)).alias("planes"), F.count_if(c("m.family") == C.ZERO).alias("empty"))


_MB = f"WITH {grid_sql(*TWO)}, {WORDS}, {NEIGHBOURS}, {_R}, t AS (SELECT img, y // 64 AS ty, mode, ord, r FROM r), s AS (SELECT img, ty, mode, ord, bit, count(*) AS n, sum((r >> bit) & 1) AS ones FROM t, (SELECT CAST(unnest(range(31)) AS INTEGER) AS bit) GROUP BY ALL), k AS (SELECT img, ty, mode, ord, round(sum({KT}), 4) AS bits FROM s GROUP BY ALL)"


def mode_costs(spark, d, names=TWO):
    r = P.residuals(near(spark, d, *names), MODES).withColumn("ty", F.expr("y div 64"))
    planes = E.plane_counts(r, ["img", "ty", "mode", "ord"], "r", range(31))
    return planes.groupBy("img", "ty", "mode", "ord").agg(F.round(F.sum(E.kt_bits(c("n") - c("ones"), c("ones"))), 4).alias("bits"))


@query("a09_plane_kt", f"{_MB} SELECT img, ty, mode, round(bits, 3) AS bits FROM k")
def a09(spark, d):
    """Adaptive bits of all 31 planes for each tile band and mode."""
    return mode_costs(spark, d).select("img", "ty", "mode", F.round("bits", 3).alias("bits"))


@query("a45_best_mode", f"{_MB}, w AS (SELECT *, row_number() OVER (PARTITION BY img, ty ORDER BY bits, ord) AS k FROM k) SELECT img, ty, mode, round(bits, 3) AS bits FROM w WHERE k = 1")
def a45(spark, d):
    """Strictly cheapest mode of each tile band."""
    best = mode_costs(spark, d).groupBy("img", "ty").agg(F.min(F.struct("bits", "ord", "mode")).alias("m"))
    return best.select("img", "ty", "m.mode", F.round("m.bits", 3).alias("bits"))


@query("j10_top_modes", f"{_MB}, w AS (SELECT *, row_number() OVER (PARTITION BY img, ty ORDER BY bits, ord) AS rank FROM k) SELECT img, ty, rank, mode FROM w WHERE rank <= 3")
def j10(spark, d):
    """The three cheapest modes of each tile band."""
    rank = F.row_number().over(Window.partitionBy("img", "ty").orderBy("bits", "ord")).cast("long")
    return mode_costs(spark, d).withColumn("rank", rank).filter("rank <= 3").select("img", "ty", "rank", "mode")


_BP = f"WITH {grid_sql(*TWO)}, {WORDS}, s AS (SELECT img, plane, (b >> CAST(8 * plane AS INTEGER)) & 255 AS byte FROM go, (SELECT unnest([0, 1, 2, 3]) AS plane)), n AS (SELECT img, plane, byte, count(*) AS n FROM s GROUP BY ALL)"


def byte_planes(spark, d, names=TWO, value="b"):
    w = P.with_words(G.grids(spark, d, *names))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("plane"), B.byte(c(value), k).alias("byte")) for k in range(4)]))
    return w.select(*KEYS, each.alias("s")).select(*KEYS, "s.*")


@query("a01_byte_histogram", f"{_BP} SELECT * FROM n")
def a01(spark, d):
    return E.histogram(byte_planes(spark, d), ["img", "plane"], "byte")


@query("a04_byte_plane_entropy", f"{_BP}, t AS (SELECT *, sum(n) OVER (PARTITION BY img, plane) AS t FROM n) SELECT img, plane, max(t)::BIGINT AS total, round(sum(n * log2(t / n)), 4) AS bits, CAST(ceil(round(sum(n * log2(t / n)), 4) / 8) AS BIGINT) AS bytes FROM t GROUP BY ALL")
def a04(spark, d):
    """A2-A4: order-0 entropy of byte planes and its bound in bytes."""
    e = E.entropy_bits(byte_planes(spark, d), ["img", "plane"], "byte").withColumn("bits", F.round("bits", 4))
    return e.withColumn("bytes", F.ceil(c("bits") / 8))


_REP = f"WITH {grid_sql(*TWO)}, {WORDS}, {NEIGHBOURS}, p AS (SELECT unnest([0, 1, 2, 3]) AS plane), q AS (SELECT img, 'raw' AS rep, 0 AS plane, (b >> CAST(8 * plane AS INTEGER)) & 255 AS s FROM nb, p UNION ALL SELECT img, 'planes', plane, (b >> CAST(8 * plane AS INTEGER)) & 255 FROM nb, p UNION ALL SELECT img, 'residual', 0, (((o - w + 4294967296) % 4294967296) >> CAST(8 * plane AS INTEGER)) & 255 FROM nb, p UNION ALL SELECT img, 'planes_residual', plane, (((o - w + 4294967296) % 4294967296) >> CAST(8 * plane AS INTEGER)) & 255 FROM nb, p)"


@query("a05_representations", f"{_REP}, n AS (SELECT img, rep, plane, s, count(*) AS n FROM q GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY img, rep, plane) AS t FROM n) SELECT img, rep, round(sum(n * log2(t / n)), 3) AS bits, round(sum(n) * 8 / sum(n * log2(t / n)), 5) AS ratio FROM t GROUP BY ALL")
def a05(spark, d):
    """A5: entropy of four representations, and the ratio that it bounds."""
    w = near(spark, d).withColumn("r", F.pmod(c("o") - c("w"), B.long(1 << 32)))
    each = [F.struct(F.lit(rep).alias("rep"), F.lit(k if "planes" in rep else 0).alias("plane"), B.byte(c(v), k).alias("s")) for rep, v in (("raw", "b"), ("planes", "b"), ("residual", "r"), ("planes_residual", "r")) for k in range(4)]
    e = E.entropy_bits(w.select("img", F.explode(F.array(*each)).alias("q")).select("img", "q.*"), ["img", "rep", "plane"], "s")
    return e.groupBy("img", "rep").agg(F.round(F.sum("bits"), 3).alias("bits"), F.round(F.sum("total") * 8 / F.sum("bits"), 5).alias("ratio"))


@query("a06_bit_plane_entropy", f"WITH {grid_sql(*TWO)}, {WORDS}, s AS (SELECT img, bit, count(*) AS n, sum((b >> bit) & 1) AS k FROM go, (SELECT CAST(unnest(range(32)) AS INTEGER) AS bit) GROUP BY ALL) SELECT img, CASE WHEN bit = 31 THEN 'sign' WHEN bit >= 23 THEN 'exponent' WHEN bit >= 15 THEN 'mantissa_hi' WHEN bit >= 8 THEN 'mantissa_mid' ELSE 'mantissa_lo' END AS field, round(sum(CASE WHEN k > 0 AND k < n THEN k * log2(n / k) + (n - k) * log2(n / (n - k)) ELSE 0 END), 3) AS bits, sum(k)::BIGINT AS ones FROM s GROUP BY ALL")
def a06(spark, d):
    """Binary entropies of bit planes, summed by field of the word."""
    p = E.plane_counts(P.with_words(G.grids(spark, d, *TWO)), ["img"], "b", range(32))
    field = F.when(c("bit") == 31, "sign").when(c("bit") >= 23, "exponent").when(c("bit") >= 15, "mantissa_hi").when(c("bit") >= 8, "mantissa_mid").otherwise("mantissa_lo")
    return p.groupBy("img", field.alias("field")).agg(F.round(F.sum(E.binary_entropy(c("n"), c("ones"))), 3).alias("bits"), F.sum("ones").alias("ones"))


@query("a07_chunked_entropy", f"WITH {grid_sql('ord3')}, {WORDS}, s AS (SELECT img, k, ((b & 32767) >> CAST(8 * k AS INTEGER)) & 255 AS s FROM go, (SELECT unnest([0, 1]) AS k)), n AS (SELECT img, k, s, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY img, k) AS t FROM n) SELECT img, round(sum(n * log2(t / n)), 3) AS bits FROM t GROUP BY ALL")
def a07(spark, d):
    """Entropy of a 15-bit alphabet as that of its 8-bit chunks."""
    w = P.with_words(G.grid(spark, d, "ord3")).withColumn("t", c("b").bitwiseAND(B.long(32767)))
    chunks = w.select("img", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), B.byte(c("t"), k).alias("s")) for k in (0, 1)])).alias("q")).select("img", "q.*")
    return E.entropy_bits(chunks, ["img", "k"], "s").groupBy("img").agg(F.round(F.sum("bits"), 3).alias("bits"))


_BYTES = "b AS (SELECT doc_id, i AS pos, CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) AS byte FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(octet_length(encode(text)))) AS i FROM documents))"
_ORDER1 = f"WITH {_BYTES}, p AS (SELECT *, lag(byte, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS ctx FROM b), n AS (SELECT ctx, byte, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY ctx) AS t FROM n)"


@query("a08_order1_entropy", f"{_ORDER1} SELECT sum(n)::BIGINT AS total, count(DISTINCT ctx) AS contexts, round(sum(n * log2(t / n)), 2) AS bits, round(8 * sum(n) / sum(n * log2(t / n)), 5) AS ratio FROM t")
def a08(spark, d):
    """Entropy of document bytes given the byte before."""
    e = E.conditional_from_counts(E.byte_pair_counts(G.table(spark, d, "documents"), "text"), "ctx", "byte", "n")
    return e.select("total", "contexts", F.round("bits", 2).alias("bits"), F.round(8 * c("total") / c("bits"), 5).alias("ratio"))


@query("a10_dirichlet", f"{_BP} SELECT img, plane, round((lgamma(sum(n) + 128) - lgamma(CAST(128 AS DOUBLE)) - sum(lgamma(n + 0.5)) + count(*) * lgamma(CAST(0.5 AS DOUBLE))) / ln(2), 3) AS bits FROM n GROUP BY ALL")
def a10(spark, d):
    """A10: adaptive multinomial code length of byte planes."""
    n = E.histogram(byte_planes(spark, d), ["img", "plane"], "byte")
    return E.dirichlet_bits(n, ["img", "plane"], "n", 256).withColumn("bits", F.round("bits", 3))


@query("a11_kt_prior", f"WITH {grid_sql(*TWO)}, {WORDS}, s AS (SELECT img, bit, count(*) AS n, sum((b >> bit) & 1) AS ones FROM go, (SELECT CAST(unnest(range(32)) AS INTEGER) AS bit) GROUP BY ALL) SELECT img, bit, round((lgamma(n + 4) - lgamma(n - ones + 2) - lgamma(ones + 2) + 2 * lgamma(CAST(2 AS DOUBLE)) - lgamma(CAST(4 AS DOUBLE))) / ln(2), 4) AS bits FROM s")
def a11(spark, d):
    """Adaptive bits with two prior counts for each value."""
    p = E.plane_counts(P.with_words(G.grids(spark, d, *TWO)), ["img"], "b", range(32))
    return p.select("img", "bit", F.round(E.kt_bits(c("n") - c("ones"), c("ones"), 2.0), 4).alias("bits"))


@query("a12_sequential_equals_batch", f"WITH {grid_sql('evt1')}, {WORDS}, s AS (SELECT img, y % 4 AS ctx, (b >> 20) & 1 AS ones FROM go), n AS (SELECT ctx, count(*) AS n, sum(ones) AS ones FROM s GROUP BY ALL) SELECT ctx, n, round({KT}, 6) AS batch, round({KT}, 6) AS sequential FROM n")
def a12(spark, d):
    """Running counts before each bit give the same code length as counts alone."""
    s = P.with_words(G.grid(spark, d, "evt1")).select((c("y") % 4).alias("ctx"), (c("y") * 100 + c("x")).alias("pos"), B.bit(c("b"), 20).alias("one"))
    # counts before a chunk of 4,096 places from a small table, and running counts inside it
    s = s.withColumn("chunk", F.expr("pos div 4096"))
    run = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = s.groupBy("ctx", "chunk").agg(F.count(F.lit(1)).alias("m"), F.sum("one").alias("k"))
    over = run(Window.partitionBy("ctx").orderBy("chunk"))
    whole = whole.select("ctx", "chunk", F.coalesce(F.sum("m").over(over), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(over), F.lit(0)).alias("k0"))
    inside = run(Window.partitionBy("ctx", "chunk").orderBy("pos"))
    k = s.withColumns({"n": F.count(F.lit(1)).over(inside), "ones": F.coalesce(F.sum("one").over(inside), F.lit(0))}).join(whole, ["ctx", "chunk"])
    k = k.withColumns({"n": c("n") + c("n0"), "ones": c("ones") + c("k0")})
    hits = F.when(c("one") == 1, c("ones")).otherwise(c("n") - c("ones"))
    seq = k.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("ones"), F.sum(F.log2((c("n") + 1) / (hits + 0.5))).alias("sequential"))
    return seq.select("ctx", "n", F.round(E.kt_bits(c("n") - c("ones"), c("ones")), 6).alias("batch"), F.round("sequential", 6).alias("sequential"))


@query("a17_zero_planes", f"WITH {grid_sql('part1', 'ord3')}, {WORDS}, s AS (SELECT img, bit, sum((b >> bit) & 1) AS k FROM go, (SELECT CAST(unnest(range(32)) AS INTEGER) AS bit) GROUP BY ALL) SELECT img, bit, k = 0 AS all_zero FROM s")
def a17(spark, d):
    p = E.plane_counts(P.with_words(G.grids(spark, d, "part1", "ord3")), ["img"], "b", range(32))
    return p.select("img", "bit", (c("ones") == 0).alias("all_zero"))


@query("a19_static_model", f"{_BP}, t AS (SELECT *, sum(n) OVER (PARTITION BY img, plane) AS t FROM n), f AS (SELECT *, greatest(1, CAST(floor(n * 16384 / t + 0.5) AS BIGINT)) AS f FROM t), u AS (SELECT *, f + CASE WHEN row_number() OVER (PARTITION BY img, plane ORDER BY f DESC, byte) = 1 THEN 16384 - sum(f) OVER (PARTITION BY img, plane) ELSE 0 END AS q FROM f) SELECT img, plane, sum(q)::BIGINT AS total, count(*) AS symbols, round(sum(n * log2(16384 / q)), 3) AS bits, 3 * count(*) AS model_bytes FROM u GROUP BY ALL")
def a19(spark, d):
    """14-bit model frequencies (at least 1; the largest takes the rest), its ideal bits and its bytes."""
    key = Window.partitionBy("img", "plane")
    n = E.histogram(byte_planes(spark, d), ["img", "plane"], "byte").withColumn("t", F.sum("n").over(key))
    f = n.withColumn("f", F.greatest(F.lit(1), F.floor(c("n") * 16384 / c("t") + 0.5)))
    first = F.row_number().over(key.orderBy(F.desc("f"), "byte")) == 1
    q = f.withColumn("q", c("f") + F.when(first, 16384 - F.sum("f").over(key)).otherwise(0))
    return q.groupBy("img", "plane").agg(F.sum("q").alias("total"), F.count(F.lit(1)).alias("symbols"), F.round(F.sum(c("n") * F.log2(16384 / c("q"))), 3).alias("bits"), (3 * F.count(F.lit(1))).alias("model_bytes"))


_Q0 = f"WITH {grid_sql('emb1')}, {WORDS}, {NEIGHBOURS}, {modes_sql(('raw', 'west', 'med'))}, s AS (SELECT img, y // 128 AS ty, mode, plane, (r >> CAST(8 * plane AS INTEGER)) & 255 AS byte FROM r, (SELECT unnest([0, 1, 2, 3]) AS plane)), n AS (SELECT img, ty, mode, plane, byte, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY img, ty, mode, plane) AS t FROM n)"


@query("q_flagship_tile_entropy", f"{_Q0} SELECT img, ty, mode, round(sum(n * log2(t / n)), 4) AS bits FROM t GROUP BY ALL")
def flagship(spark, d):
    """For each band of 128 rows and three predictors: byte-plane entropy of the residuals, summed over planes."""
    r = P.residuals(near(spark, d, "emb1"), ("raw", "west", "med"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("plane"), B.byte(c("r"), k).alias("byte")) for k in range(4)]))
    s = r.select("img", F.expr("y div 128").alias("ty"), "mode", each.alias("s")).select("img", "ty", "mode", "s.*")
    return E.entropy_bits(s, ["img", "ty", "mode", "plane"], "byte").groupBy("img", "ty", "mode").agg(F.round(F.sum("bits"), 4).alias("bits"))

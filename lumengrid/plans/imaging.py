"""Queries on stencils, quantisers, routing, quality, multi-resolution transforms, streams and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import tone as T
from ..operators import entropy as E
from ..operators import multires as M
from ..operators import order as D
from ..operators import predict as P
from ..operators import quality as Y
from ..operators import quantize as Q
from ..operators import report as R
from ..operators import router as N
from ..operators import stencil as W
from ..operators import streams as S
from ..sources import grids as G
from .coding import byte_planes
from .registry import WORDS, grid_sql, query

c = F.col
KEYS = G.KEYS
TWO = ("ord3", "evt1")


def px(spark, d):
    return G.pixels(G.grid(spark, d, "ord3"))


def plane(spark, d, *names):
    """One-channel grids as pixel tables with a double v."""
    return G.grids(spark, d, *names).select("img", "y", "x", c("v").cast("double").alias("v"))


_REFLECT = "CASE WHEN n = 1 THEN 0 ELSE CASE WHEN m < n THEN m ELSE 2 * (n - 1) - m END END"


def box_sql(src: str, name: str, columns: dict[str, str], r: int, keep: str) -> str:
    """CTE `name`: src's keep columns and box means; lines are gathered by reflected index."""

    def line(s, along, across, cols, out, carry):
        size = f"{out}_n AS (SELECT *, count(*) OVER (PARTITION BY img, {across}) AS n FROM {s})"
        at = f"{out}_k AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE (({along} + k) % (2 * (n - 1)) + 2 * (n - 1)) % (2 * (n - 1)) END AS m FROM {out}_n, (SELECT unnest(range(-{r}, {r + 1})) AS k))"
        at2 = f"{out}_i AS (SELECT *, {_REFLECT} AS src FROM {out}_k)"
        means = ", ".join(f"avg(s.{v}) AS {k}" for k, v in cols.items())
        join = f"{out} AS (SELECT {', '.join('t.' + q for q in carry)}, {means} FROM {out}_i t JOIN {s} s ON s.img = t.img AND s.{across} = t.{across} AND s.{along} = t.src GROUP BY {', '.join('t.' + q for q in carry)})"
        return ", ".join([size, at, at2, join])

    keeps = [x.strip() for x in keep.split(",")]
    half = {f"h_{k}": v for k, v in columns.items()}
    return line(src, "x", "y", half, f"{name}_h", keeps) + ", " + line(f"{name}_h", "y", "x", {k: f"h_{k}" for k in columns}, name, keeps)


_V = "p AS (SELECT img, y, x, CAST(v AS DOUBLE) AS v, CAST(v AS DOUBLE) * CAST(v AS DOUBLE) AS sq FROM g)"
_EVT = f"WITH {grid_sql('evt1', 'part1')}, {_V}"


@query("w01_box_mean", f"{_EVT}, {box_sql('p', 'b', {'m': 'v'}, 2, 'img, y, x')} SELECT img, y, x, round(m, 6) AS m FROM b")
def w01(spark, d):
    """Box mean of radius 2 with reflected borders, as two line passes."""
    return W.box_mean(plane(spark, d, "evt1", "part1"), {"m": "v"}, 2).select("img", "y", "x", F.round("m", 6).alias("m"))


@query("w02_local_std", f"{_EVT}, {box_sql('p', 'b', {'m': 'v', 's': 'sq'}, 2, 'img, y, x')} SELECT img, y, x, round(sqrt(greatest(s - m * m, 0)), 4) AS std FROM b")
def w02(spark, d):
    return W.local_std(plane(spark, d, "evt1", "part1"), "v", "std", 2).select("img", "y", "x", F.round("std", 4).alias("std"))


_GUIDE = f"""WITH {grid_sql('ord3')}, q AS (SELECT img, y, x, pow(CAST(max(v) FILTER (c = 0) AS DOUBLE), 0.75) AS r, pow(CAST(max(v) FILTER (c = 1) AS DOUBLE), 0.75) AS gg, pow(CAST(max(v) FILTER (c = 2) AS DOUBLE), 0.75) AS b FROM g GROUP BY ALL HAVING count(*) = 3),
p AS (SELECT *, yp * co AS gp, yp * yp AS g2 FROM (SELECT img, y, x, (r + 2 * gg + b) / 4 AS yp, r - b AS co FROM q)), {box_sql('p', 'b1', {'mp': 'co', 'mg': 'yp', 'mgp': 'gp', 'mgg': 'g2'}, 2, 'img, y, x, yp')},
ab AS (SELECT *, (mgp - mg * mp) / (mgg - mg * mg + 0.1) AS a FROM b1), ac AS (SELECT *, mp - a * mg AS bb FROM ab), {box_sql('ac', 'b2', {'ma': 'a', 'mb': 'bb'}, 2, 'img, y, x, yp')}"""


@query("w03_guided_filter", f"{_GUIDE} SELECT img, y, x, round(ma * yp + mb, 6) AS low FROM b2")
def w03(spark, d):
    """Guided low-pass of the co plane by luma."""
    return W.guided(N.planes(px(spark, d)).select("img", "y", "x", "yp", "co"), {"low": "co"}, "yp", 2, 0.1).select("img", "y", "x", F.round("low", 6).alias("low"))


@query("w04_block_mean", f"{_EVT} SELECT img, y // 2 AS by, x // 2 AS bx, round(avg(v), 6) AS mean, max(CASE WHEN v > 300 THEN 1 ELSE 0 END) AS hot, count(*) AS n FROM p GROUP BY ALL")
def w04(spark, d):
    """Block means and any-masks at half size."""
    made = {"mean": F.round(F.avg("v"), 6), "hot": F.max((c("v") > 300).cast("int")), "n": F.count(F.lit(1))}
    return W.block_reduced(plane(spark, d, "evt1", "part1"), 2, made)


@query("w05_upsample", f"{_EVT}, b AS (SELECT img, y // 2 AS by, x // 2 AS bx, avg(v) AS mean FROM p GROUP BY ALL) SELECT p.img, p.y, p.x, round(p.v - b.mean, 6) AS detail FROM p JOIN b ON p.img = b.img AND p.y // 2 = b.by AND p.x // 2 = b.bx")
def w05(spark, d):
    p = plane(spark, d, "evt1", "part1")
    return W.upsampled(p, W.block_reduced(p, 2, {"mean": F.avg("v")}), 2).select("img", "y", "x", F.round(c("v") - c("mean"), 6).alias("detail"))


@query("w06_dilation", f"{_EVT}, m AS (SELECT *, CASE WHEN v > 300 THEN 1 ELSE 0 END AS m FROM p), h AS (SELECT *, max(m) OVER (PARTITION BY img, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hm FROM m) SELECT img, y, x, max(hm) OVER (PARTITION BY img, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h")
def w06(spark, d):
    p = plane(spark, d, "evt1", "part1").withColumn("m", (c("v") > 300).cast("int"))
    return W.dilated(p, "m", "near", 2).select("img", "y", "x", "near")


@query("w07_dark_noise", f"{_EVT} SELECT img, y, x, round(coalesce(abs(v - (lag(v) OVER r + lead(v) OVER r + lag(v) OVER k + lead(v) OVER k) * 0.25), 0), 5) AS noise FROM p WINDOW r AS (PARTITION BY img, y ORDER BY x), k AS (PARTITION BY img, x ORDER BY y)")
def w07(spark, d):
    """Distance from the mean of the four neighbours; 0 at borders."""
    r, k = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    around = (F.lag("v").over(r) + F.lead("v").over(r) + F.lag("v").over(k) + F.lead("v").over(k)) * 0.25
    return plane(spark, d, "evt1", "part1").select("img", "y", "x", F.round(F.coalesce(F.abs(c("v") - around), F.lit(0.0)), 5).alias("noise"))


@query("w09_gradient_masks", f"{_EVT}, d AS (SELECT *, greatest(coalesce(abs(v - lag(v) OVER r), 0), coalesce(abs(v - lag(v) OVER k), 0)) AS grad FROM p WINDOW r AS (PARTITION BY img, y ORDER BY x), k AS (PARTITION BY img, x ORDER BY y)), q AS (SELECT img, quantile_cont(grad, 0.35) AS q35, quantile_cont(grad, 0.95) AS q95 FROM d GROUP BY img) SELECT d.img, count(*) FILTER (grad <= q35) AS smooth, count(*) FILTER (grad >= q95) AS edge, round(max(q35), 6) AS q35, round(max(q95), 6) AS q95 FROM d JOIN q ON d.img = q.img GROUP BY d.img")
def w09(spark, d):
    """Absolute backward gradients and quantile masks of them."""
    r, k = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    grad = F.greatest(F.coalesce(F.abs(c("v") - F.lag("v").over(r)), F.lit(0.0)), F.coalesce(F.abs(c("v") - F.lag("v").over(k)), F.lit(0.0)))
    g = plane(spark, d, "evt1", "part1").withColumn("grad", grad)
    q = D.quantiles(g, ["img"], {"grad": [0.35, 0.95]}).withColumnRenamed("grad", "q")
    j = g.join(q, "img")
    return j.groupBy("img").agg(F.count_if(c("grad") <= c("q")[0]).alias("smooth"), F.count_if(c("grad") >= c("q")[1]).alias("edge"), F.round(F.max(c("q")[0]), 6).alias("q35"), F.round(F.max(c("q")[1]), 6).alias("q95"))


@query("w11_tile_boundaries", f"{_EVT}, d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY img, y ORDER BY x)) AS dx FROM p) SELECT img, round(avg(dx) FILTER (x % 16 = 0), 5) AS boundary, round(avg(dx) FILTER (x % 16 <> 0), 5) AS inside FROM d GROUP BY img")
def w11(spark, d):
    dx = F.abs(c("v") - F.lag("v").over(Window.partitionBy("img", "y").orderBy("x")))
    return plane(spark, d, "evt1", "part1").withColumn("dx", dx).groupBy("img").agg(F.round(F.avg(F.when(c("x") % 16 == 0, c("dx"))), 5).alias("boundary"), F.round(F.avg(F.when(c("x") % 16 != 0, c("dx"))), 5).alias("inside"))


@query("w14_bitshuffle", f"WITH {grid_sql('evt1')}, {WORDS}, i AS (SELECT (y * 100 + x) // 8 AS block, (y * 100 + x) % 8 AS k, b FROM go WHERE y * 100 + x <> 3), f AS (SELECT *, count(*) OVER (PARTITION BY block) AS n FROM i) SELECT block, plane, sum(((b >> plane) & 1) << CAST(k AS INTEGER))::BIGINT AS v FROM f, (SELECT CAST(unnest(range(32)) AS INTEGER) AS plane) WHERE n = 8 GROUP BY ALL UNION ALL SELECT block, CAST(-1 - k AS INTEGER), b FROM f WHERE n < 8")
def w14(spark, d):
    """Words by bit plane, eight to a byte; the words of a block that is not full stay as they are."""
    w = P.with_words(G.grid(spark, d, "evt1")).withColumn("i", c("y") * 100 + c("x")).filter("i <> 3")
    return S.bitshuffled(w, [], "i", "b")


@query("w14_bitshuffle_inverse", f"WITH {grid_sql('evt1')}, {WORDS} SELECT y * 100 + x AS index, b AS word FROM go WHERE y * 100 + x <> 3")
def w14_inverse(spark, d):
    """The words again from their planes."""
    return S.unshuffled(w14(spark, d), [])


@query("w16_point_guard", f"{_EVT} SELECT img, count(*) FILTER ((x - 20) * (x - 20) + (y - 5) * (y - 5) <= 16) AS disc, count(*) FILTER (x = 0 OR y = 0) AS edge FROM p GROUP BY img")
def w16(spark, d):
    disc = (c("x") - 20) * (c("x") - 20) + (c("y") - 5) * (c("y") - 5) <= 16
    return plane(spark, d, "evt1", "part1").groupBy("img").agg(F.count_if(disc).alias("disc"), F.count_if((c("x") == 0) | (c("y") == 0)).alias("edge"))


# --- quantisers

_LOHI = "r AS (SELECT *, CAST(CAST(min(t) OVER (PARTITION BY img, c) AS FLOAT) AS DOUBLE) AS lo, CAST(CAST(max(t) OVER (PARTITION BY img, c) AS FLOAT) AS DOUBLE) AS hi FROM t)"
_FWD = {"linear": "CAST(v AS DOUBLE)", "signed_log": "sign(v) * log2(1 + abs(CAST(v AS DOUBLE)))", "sqrt": "sign(v) * sqrt(abs(CAST(v AS DOUBLE)))", "gamma075": "sign(v) * pow(abs(CAST(v AS DOUBLE)), 0.75)", "gamma025": "sign(v) * pow(abs(CAST(v AS DOUBLE)), 0.25)", "asinh": "asinh(CAST(v AS DOUBLE))"}
_BACK = {"linear": "w", "signed_log": "sign(w) * (pow(2, abs(w)) - 1)", "sqrt": "sign(w) * w * w", "gamma075": "sign(w) * pow(abs(w), 1 / 0.75::DOUBLE)", "gamma025": "sign(w) * pow(w, 4)", "asinh": "sinh(w)"}


def _transform(mode: str, bits: int):
    sql = f"WITH {grid_sql(*TWO)}, t AS (SELECT *, {_FWD[mode]} AS t FROM g), {_LOHI}, q AS (SELECT *, CASE WHEN hi > lo THEN CAST(least(greatest(floor((t - lo) / (hi - lo) * {(1 << bits) - 1} + 0.5), 0), {(1 << bits) - 1}) AS BIGINT) ELSE 0 END AS q FROM r), w AS (SELECT *, CASE WHEN hi > lo THEN lo + q * (hi - lo) / {(1 << bits) - 1} ELSE lo END AS w FROM q) SELECT img, y, x, c, q, round({_BACK[mode]}, 4) AS rec FROM w"

    @query(f"q07_index_{mode}", sql)
    def run(spark, d):
        return Q.transform_index(G.grids(spark, d, *TWO), mode, bits, ["img", "c"]).select(*KEYS, "q", F.round("rec", 4).alias("rec"))

    run.__doc__ = f"Q5-Q9: {bits}-bit indices in the {mode} domain by channel, and their reconstruction."


for _m in T.TRANSFORMS:
    _transform(_m, 8)


@query("q02_random_tails", f"WITH {grid_sql('ord3', 'part1')}, {WORDS}, s AS (SELECT img, y // 8 AS ty, bit, count(*) AS n, sum((b >> bit) & 1) AS k FROM go, (SELECT CAST(unnest(range(15)) AS INTEGER) AS bit) GROUP BY ALL), f AS (SELECT img, ty, max(n) AS n, coalesce(min(bit) FILTER (NOT abs(2 * k - n) <= n // 10), 15) AS first FROM s GROUP BY ALL) SELECT img, ty, n, CASE WHEN n < 64 THEN 0 ELSE first END AS tail FROM f")
def q02(spark, d):
    """The random low bits of each band, capped at 15."""
    w = P.with_words(G.grids(spark, d, "ord3", "part1")).filter(B.is_finite(c("b"))).withColumn("ty", F.expr("y div 8"))
    return Q.random_tail(w, ["img", "ty"], 15)


@query("a22_ranges", f"WITH {grid_sql('emb4', 'ord3')} SELECT img, c, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi, CAST(min(v) FILTER (v >= 0) AS DOUBLE) AS lo_positive FROM g GROUP BY ALL")
def a22(spark, d):
    g = G.grids(spark, d, "emb4", "ord3")
    return g.groupBy("img", "c").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"), F.min(F.when(c("v") >= 0, c("v"))).cast("double").alias("lo_positive"))


@query("q11_tile_ranges", f"WITH {grid_sql('evt1')}, t AS (SELECT *, CAST(v AS DOUBLE) AS t FROM g), r AS (SELECT *, CAST(CAST(min(t) OVER w AS FLOAT) AS DOUBLE) AS lo, CAST(CAST(max(t) OVER w AS FLOAT) AS DOUBLE) AS hi FROM t WINDOW w AS (PARTITION BY img, y // 16, x // 16)) SELECT img, y, x, CASE WHEN hi > lo THEN CAST(least(greatest(floor((t - lo) / (hi - lo) * 63 + 0.5), 0), 63) AS BIGINT) ELSE 0 END AS q FROM r")
def q11(spark, d):
    t = plane(spark, d, "evt1").withColumns({"ty": F.expr("y div 16"), "tx": F.expr("x div 16")})
    return Q.ranged(t, c("v"), ["img", "ty", "tx"]).select("img", "y", "x", Q.index_of(c("v"), c("lo"), c("hi"), 6).alias("q"))


@query("q12_clipped_range", f"WITH {grid_sql('evt1')}, b AS (SELECT img, quantile_cont(CAST(v AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.99) AS hi FROM g GROUP BY img) SELECT g.img, count(*) FILTER (v < lo OR v > hi) AS escaped, count(*) AS n, sum(CASE WHEN v < lo OR v > hi THEN 0 ELSE CAST(least(greatest(floor((CAST(v AS DOUBLE) - lo) / (hi - lo) * 127 + 0.5), 0), 127) AS BIGINT) END)::BIGINT AS total FROM g JOIN b ON g.img = b.img GROUP BY g.img")
def q12(spark, d):
    """Q12: range between percentiles; what lies outside escapes."""
    p = plane(spark, d, "evt1")
    b = D.quantiles(p, ["img"], {"v": [0.01, 0.99]}).select("img", c("v")[0].alias("lo"), c("v")[1].alias("hi"))
    j = p.join(b, "img").withColumn("out", (c("v") < c("lo")) | (c("v") > c("hi")))
    return j.groupBy("img").agg(F.count_if("out").alias("escaped"), F.count(F.lit(1)).alias("n"), F.sum(F.when(c("out"), 0).otherwise(Q.index_of(c("v"), c("lo"), c("hi"), 7))).alias("total"))


@query("q13_error_diffusion")
def q13_fs(spark, d):
    """Q13: Floyd-Steinberg dithered 4-bit indices: a sequential scan of each image channel."""
    return Q.error_diffused(Q.ranged(G.grid(spark, d, "ord3").withColumn("v", c("v").cast("double")), c("v"), ["img", "c"]), 4)


@query("q13_ordered_dither", f"WITH {grid_sql('evt1')}, t AS (SELECT *, CAST(v AS DOUBLE) AS t FROM g), r AS (SELECT *, min(t) OVER () AS lo, max(t) OVER () AS hi FROM t) SELECT img, y, x, CAST(least(greatest(round_even((t - lo) / (hi - lo) * 31 + ([[0, 2], [3, 1]][y % 2 + 1][x % 2 + 1] + 0.5) / 4 - 0.5, 0), 0), 31) AS BIGINT) AS q FROM r")
def q13_ordered(spark, d):
    p = plane(spark, d, "evt1")
    p = p.join(p.groupBy("img").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "img")
    matrix = F.array(F.lit(0), F.lit(2), F.lit(3), F.lit(1))
    dither = (F.element_at(matrix, (c("y") % 2 * 2 + c("x") % 2 + 1).cast("int")) + 0.5) / 4 - 0.5
    z = (c("v") - c("lo")) / (c("hi") - c("lo")) * 31 + dither
    return p.select("img", "y", "x", F.least(F.greatest(F.rint(z), F.lit(0.0)), F.lit(31.0)).cast("long").alias("q"))


@query("a48_code_means", f"WITH {grid_sql('evt1')}, t AS (SELECT *, CAST(v AS DOUBLE) AS t FROM g), {_LOHI}, q AS (SELECT *, CAST(floor((t - lo) / (hi - lo) * 31 + 0.5) AS BIGINT) AS q FROM r) SELECT q, count(*) AS n, round(avg(t), 5) AS mean FROM q GROUP BY q")
def a48(spark, d):
    """Mean of the samples of each code."""
    q = Q.ranged(plane(spark, d, "evt1"), c("v"), ["img"]).withColumn("q", Q.index_of(c("v"), c("lo"), c("hi"), 5))
    return q.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 5).alias("mean"))


@query("a47_quantile_codebook", f"WITH {grid_sql('evt1')}, k AS (SELECT unnest(range(16)) AS k), b AS (SELECT k.k, quantile_cont(CAST(v AS DOUBLE), (k.k + 0.5) / 16) AS code FROM g, k GROUP BY k.k) SELECT k AS code_no, round(code, 5) AS code, round(max(code) OVER (ORDER BY k), 5) AS monotone FROM b".replace("quantile_cont(CAST(v AS DOUBLE), (k.k + 0.5) / 16)", "list_extract(quantile_cont(CAST(v AS DOUBLE), [" + ", ".join(str((i + 0.5) / 16) for i in range(16)) + "]), k.k + 1)"))
def a47(spark, d):
    """Quantile codebook, made monotone by a running maximum."""
    p = D.quantiles(plane(spark, d, "evt1"), ["img"], {"v": [(i + 0.5) / 16 for i in range(16)]})
    k = p.select(F.posexplode("v").alias("code_no", "code"))
    running = F.max("code").over(Window.partitionBy().orderBy("code_no").rowsBetween(Window.unboundedPreceding, 0))  # 16 rows
    return k.select(c("code_no").cast("long").alias("code_no"), F.round("code", 5).alias("code"), F.round(running, 5).alias("monotone"))


# --- aggregates over images

@query("a25_sign_class", f"WITH {grid_sql('emb4', 'ord3', 'evt1')}, {WORDS} SELECT img, CASE WHEN bool_and(b < 2147483648) THEN 'positive' WHEN bool_and(b >= 2147483648) THEN 'negative' ELSE 'mixed' END AS class FROM go GROUP BY img")
def a25(spark, d):
    w = P.with_words(G.grids(spark, d, "emb4", "ord3", "evt1")).withColumn("neg", c("b") >= B.SIGN)
    return w.groupBy("img").agg(F.when(~F.bool_or("neg"), "positive").when(F.bool_and("neg"), "negative").otherwise("mixed").alias("class"))


@query("a26_percentiles", f"WITH {grid_sql(*TWO)} SELECT img, round(quantile_cont(CAST(v AS DOUBLE), 0.97), 6) AS p97, round(quantile_cont(CAST(v AS DOUBLE), 0.5), 6) AS p50, CAST(quantile_disc(v, 0.99) AS DOUBLE) AS d99, CAST(quantile_disc(v, 0.999) AS DOUBLE) AS d999 FROM g GROUP BY img")
def a26(spark, d):
    """Interpolated and nearest-rank percentiles."""
    g = G.grids(spark, d, *TWO)
    between = D.quantiles(g, ["img"], {"v": [0.97, 0.5]}).select("img", F.round(c("v")[0], 6).alias("p97"), F.round(c("v")[1], 6).alias("p50"))
    return between.join(D.quantiles(g, ["img"], {"v": [0.99, 0.999]}, nearest=True).select("img", c("v")[0].alias("d99"), c("v")[1].alias("d999")), "img")


@query("a27_robust_sigma", f"WITH {grid_sql(*TWO)}, m AS (SELECT *, median(CAST(v AS DOUBLE)) OVER (PARTITION BY img) AS m FROM g) SELECT img, round(1.4826 * median(abs(CAST(v AS DOUBLE) - m)), 6) AS sigma FROM m GROUP BY img")
def a27(spark, d):
    g = G.grids(spark, d, *TWO).withColumn("v", c("v").cast("double"))
    m = D.quantiles(g, ["img"], {"v": [0.5]}).select("img", c("v")[0].alias("m"))
    off = D.quantiles(g.join(m, "img").withColumn("off", F.abs(c("v") - c("m"))), ["img"], {"off": [0.5]})
    return off.select("img", F.round(1.4826 * c("off")[0], 6).alias("sigma"))


_Q8 = "q AS (SELECT img, y, x, c, CAST(v AS DOUBLE) AS o, floor(CAST(v AS DOUBLE) * 16) / 16 AS d FROM g)"


@query("a28_ks_distance", f"WITH {grid_sql(*TWO)}, {_Q8}, r AS (SELECT *, least(min(o) OVER w, min(d) OVER w) AS lo, greatest(max(o) OVER w, max(d) OVER w) AS hi FROM q WINDOW w AS (PARTITION BY img)), s AS (SELECT img, least(floor(256 * (o - lo) / (hi - lo)), 255) AS k, 1 AS d FROM r UNION ALL SELECT img, least(floor(256 * (d - lo) / (hi - lo)), 255), -1 FROM r), n AS (SELECT img, k, sum(d) AS d, count(*) AS m FROM s GROUP BY ALL), u AS (SELECT *, sum(d) OVER (PARTITION BY img ORDER BY k) AS run FROM n) SELECT img, round(max(abs(run)) / (sum(m) / 2), 6) AS ks FROM u GROUP BY img")
def a28(spark, d):
    """Greatest difference of two 256-bin cumulative histograms."""
    g = G.grids(spark, d, *TWO).select("img", c("v").cast("double").alias("o")).withColumn("d", F.floor(c("o") * 16) / 16)
    return E.ks_distance(g, "o", "d", ["img"]).withColumn("ks", F.round("ks", 6))


@query("a29_exponent_buckets", f"WITH {grid_sql('emb4', 'ord3')}, {WORDS}, n AS (SELECT img, (b >> 23) & 255 AS exponent, count(*) AS n, count(*) FILTER (b % 256 = 0) AS zero8 FROM go GROUP BY ALL HAVING count(*) >= 128), k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, exponent) AS rank FROM n) SELECT img, exponent, n, zero8, rank FROM k WHERE rank <= 12")
def a29(spark, d):
    """The twelve most frequent exponents with 128 samples or more."""
    w = P.with_words(G.grids(spark, d, "emb4", "ord3")).withColumns({"exponent": B.exponent_of(c("b")), "z": c("b") % 256 == 0})
    n = w.groupBy("img", "exponent").agg(F.count(F.lit(1)).alias("n"), F.count_if("z").alias("zero8")).filter("n >= 128")
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("n"), "exponent")).cast("long")).filter("rank <= 12")


_CLASS = "CASE WHEN low >= 16 THEN 'bfloat' WHEN low >= 13 OR half = n THEN 'half_like' WHEN low >= 8 THEN 'low8_zero' WHEN dec >= 0 THEN 'decimal' WHEN low >= 1 THEN 'partly' ELSE 'float' END"


@query("a31_source_precision", f"WITH {grid_sql('ord3', 'part1')}, {WORDS}, t AS (SELECT img, y // 16 AS ty, count(*) AS n, bit_or(b & 8388607) AS o, count(*) FILTER (((b >> 23) & 255) BETWEEN 113 AND 142 AND b % 8192 = 0) AS half, " + ", ".join(f"bool_and(CAST(round_even(CAST(v AS DOUBLE) * {10**k}, 0) / {10**k} AS FLOAT) = v) AS d{k}" for k in range(5)) + f" FROM go GROUP BY ALL), u AS (SELECT *, CASE WHEN o = 0 THEN 23 ELSE CAST(log2(o & (-o)) AS INTEGER) END AS low, CASE WHEN d0 THEN 0 WHEN d1 THEN 1 WHEN d2 THEN 2 WHEN d3 THEN 3 WHEN d4 THEN 4 ELSE -1 END AS dec FROM t) SELECT img, ty, n, low, dec, {_CLASS} AS class FROM u")
def a31(spark, d):
    """What precision the samples of a band come from."""
    w = P.with_words(G.grids(spark, d, "ord3", "part1")).withColumn("ty", F.expr("y div 16"))
    w = w.withColumns({"m": B.mantissa_of(c("b")), "h": B.half_bits(c("b")).isNotNull()} | {f"d{k}": B.decimal_exact(c("v"), k) for k in range(5)})
    t = w.groupBy("img", "ty").agg(F.count(F.lit(1)).alias("n"), F.bit_or("m").alias("o"), F.count_if("h").alias("half"), *[F.bool_and(f"d{k}").alias(f"d{k}") for k in range(5)])
    dec = F.lit(-1)
    for k in reversed(range(5)):
        dec = F.when(c(f"d{k}"), k).otherwise(dec)
    u = t.withColumns({"low": B.trailing_zeros(c("o"), 23).cast("int"), "dec": dec})
    return u.select("img", "ty", "n", "low", "dec", F.expr(_CLASS).alias("class"))


@query("a38_zero_runs", f"{_EVT}, m AS (SELECT img, y, x, CAST(v > 100 AS INTEGER) AS m FROM p), f AS (SELECT *, CASE WHEN m = lag(m) OVER w THEN 0 ELSE 1 END AS f FROM m WINDOW w AS (PARTITION BY img, y ORDER BY x)), r AS (SELECT *, sum(f) OVER (PARTITION BY img, y ORDER BY x) AS run FROM f), l AS (SELECT img, y, run, max(m) AS m, count(*) AS n FROM r GROUP BY ALL) SELECT img, m, count(*) AS runs, round(avg(n), 5) AS mean, quantile_disc(n, 0.95) AS p95 FROM l GROUP BY ALL")
def a38(spark, d):
    """Runs of a mask along rows: how many, mean and 95th percentile of their lengths."""
    m = plane(spark, d, "evt1", "part1").withColumn("m", (c("v") > 100).cast("int"))
    r = S.runs(m, ["img", "y"], ["x"], "m")
    return r.groupBy("img", "m").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("length"), 5).alias("mean"), F.expr("percentile_disc(0.95) within group (order by length)").cast("long").alias("p95"))


@query("a39_mask_tiles", f"{_EVT}, t AS (SELECT img, tile, y // tile AS ty, x // tile AS tx, avg(CASE WHEN v > 100 THEN 1.0 ELSE 0 END) AS share FROM p, (SELECT unnest([8, 16, 32]) AS tile) GROUP BY ALL) SELECT img, tile, count(*) FILTER (share = 0) AS zero, count(*) FILTER (share = 1) AS one, count(*) FILTER (share > 0 AND share < 1) AS mixed FROM t GROUP BY ALL")
def a39(spark, d):
    """All-zero, all-one and mixed tiles of a mask for three tile sizes."""
    p = plane(spark, d, "evt1", "part1").withColumn("tile", F.explode(F.array(F.lit(8), F.lit(16), F.lit(32))))
    t = p.groupBy("img", "tile", F.expr("y div tile").alias("ty"), F.expr("x div tile").alias("tx")).agg(F.avg((c("v") > 100).cast("double")).alias("s"))
    return t.groupBy("img", "tile").agg(F.count_if(c("s") == 0).alias("zero"), F.count_if(c("s") == 1).alias("one"), F.count_if((c("s") > 0) & (c("s") < 1)).alias("mixed"))


_KT1 = "(lgamma(n + 1) + ln(pi()) - lgamma(n - k + 0.5) - lgamma(k + 0.5)) / ln(2)"


@query("a40_region_budget", f"WITH {grid_sql(*TWO)}, {WORDS}, s AS (SELECT img, bit, count(*) AS n, sum((o >> bit) & 1) AS k FROM go, (SELECT CAST(unnest(range(32)) AS INTEGER) AS bit) GROUP BY ALL) SELECT img, CASE WHEN bit = 31 THEN 'sign' WHEN bit >= 21 THEN 'body_21_30' WHEN bit >= 15 THEN 'body_15_20' ELSE 'body_0_14' END AS region, round(sum({_KT1}), 3) AS bits, round(greatest(0, sum({_KT1}) - 32 * max(n) / 16), 3) AS over FROM s GROUP BY ALL")
def a40(spark, d):
    """Adaptive bits by region of the word, and what exceeds a sixteenth of the raw size."""
    p = E.plane_counts(P.with_words(G.grids(spark, d, *TWO)), ["img"], "o", range(32))
    region = F.when(c("bit") == 31, "sign").when(c("bit") >= 21, "body_21_30").when(c("bit") >= 15, "body_15_20").otherwise("body_0_14")
    bits = F.sum(E.kt_bits(c("n") - c("ones"), c("ones")))
    return p.groupBy("img", region.alias("region")).agg(F.round(bits, 3).alias("bits"), F.round(F.greatest(F.lit(0.0), bits - 2 * F.max("n")), 3).alias("over"))


@query("a46_block_covariance", f"WITH {grid_sql('ord3')}, p AS (SELECT img, y, x, CAST(max(v) FILTER (c = 0) AS DOUBLE) AS r, CAST(max(v) FILTER (c = 1) AS DOUBLE) AS g, CAST(max(v) FILTER (c = 2) AS DOUBLE) AS b FROM g GROUP BY ALL HAVING count(*) = 3) SELECT img, y // 8 AS by, x // 8 AS bx, round(covar_pop(r, g), 5) AS rg, round(covar_pop(g, b), 5) AS gb, round(stddev_pop(r), 5) AS sr FROM p GROUP BY ALL")
def a46(spark, d):
    p = px(spark, d).select("img", "y", "x", *[c(k).cast("double").alias(k) for k in "rgb"])
    return p.groupBy("img", F.expr("y div 8").alias("by"), F.expr("cast(x div 8 as int)").alias("bx")).agg(F.round(F.covar_pop("r", "g"), 5).alias("rg"), F.round(F.covar_pop("g", "b"), 5).alias("gb"), F.round(F.stddev_pop("r"), 5).alias("sr"))


# --- routing

_PXR = "px AS (SELECT img, y, x, CAST(max(v) FILTER (c = 0) AS DOUBLE) AS r, CAST(max(v) FILTER (c = 1) AS DOUBLE) AS g, CAST(max(v) FILTER (c = 2) AS DOUBLE) AS b FROM g GROUP BY ALL HAVING count(*) = 3)"
_PLANES = f"""WITH {grid_sql('ord3')}, {_PXR}, l AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS luma, greatest(r, g, b) AS maxrgb, (pow(r, 0.75) + 2 * pow(g, 0.75) + pow(b, 0.75)) / 4 AS yp FROM px),
p AS (SELECT *, log2(1 + greatest(luma, 0)) AS ll, log2(1 + greatest(luma, 0)) * log2(1 + greatest(luma, 0)) AS l2 FROM l), {box_sql('p', 'b', {'m': 'll', 's': 'l2'}, 2, 'img, y, x, luma, maxrgb, yp')},
r0 AS (SELECT *, luma <= 0.5 AS dark, sqrt(greatest(s - m * m, 0)) <= 0.0025 AS smooth FROM b)"""


@query("m04_first_route", f"{_PLANES} SELECT img, y, x, dark, smooth, dark AND smooth AS route0 FROM r0")
def m04(spark, d):
    """M1-M4: dark and smooth pixels."""
    return N.first_route(N.planes(px(spark, d))).select("img", "y", "x", "dark", "smooth", "route0")


_CAND = ", ".join(f"({i}, {p})" for i, p in enumerate(N.CANDIDATES))


@query("m06_outlier_scan", f"{_PLANES}, s AS (SELECT quantile_cont(maxrgb, 0.97) AS p97, quantile_cont(maxrgb, 0.99) AS p99, max(maxrgb) AS top FROM r0), c AS (SELECT ord, pc, CASE " + " ".join(f"WHEN ord = {i} THEN (SELECT quantile_cont(maxrgb, {p / 100}) FROM r0)" for i, p in enumerate(N.CANDIDATES)) + f" END AS t FROM (VALUES {_CAND}) v(ord, pc)), e AS (SELECT ord, pc, t, (coalesce(max(yp) FILTER (NOT (dark AND smooth) AND maxrgb <= t), max(yp)) - coalesce(min(yp) FILTER (NOT (dark AND smooth) AND maxrgb <= t), min(yp))) / 255 AS step FROM r0, c GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN step <= 0.0032 THEN ord ELSE 100 - ord END) AS rank FROM e) SELECT 'ord3' AS img, (SELECT greatest(top / p99, p99 / p97) >= 4 FROM s) AS active, CAST(pc AS DOUBLE) AS percentile, round(t, 6) AS threshold, round(step, 7) AS step FROM k WHERE rank = 1")
def m06(spark, d):
    """M5-M8: outlier activation and the first percentile whose luma step is fine enough (else the last)."""
    t = N.outlier_thresholds(N.first_route(N.planes(px(spark, d))))
    return t.select("img", "active", "percentile", F.round("threshold", 6).alias("threshold"), F.round("step", 7).alias("step"))


@query("m11_soft_shrink", f"{_GUIDE}, h AS (SELECT b2.img, b2.y, b2.x, p.co - (ma * b2.yp + mb) AS h FROM b2 JOIN p ON b2.y = p.y AND b2.x = p.x), m AS (SELECT *, median(h) OVER () AS med FROM h), t AS (SELECT greatest(1.4826 * 2.5 * median(abs(h - med)), 1e-12) AS t FROM m) SELECT img, y, x, round(sign(h) * greatest(abs(h) - t, 0), 5) AS high FROM m, t")
def m11(spark, d):
    """High part of the co plane, soft-shrunk by a robust threshold."""
    p = N.planes(px(spark, d)).withColumns({"ll": F.lit(0.0)})
    return N.chroma_split(p).select("img", "y", "x", F.round("co_high", 5).alias("high"))


_BOTH = f"""WITH {grid_sql('ord3')}, {_PXR}, l AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS luma, greatest(r, g, b) AS maxrgb, pow(r, 0.75) AS vr, pow(g, 0.75) AS vg, pow(b, 0.75) AS vb FROM px),
p AS (SELECT *, log2(1 + greatest(luma, 0)) AS ll, (vr + 2 * vg + vb) / 4 AS yp, vr - vb AS co, vg - (vr + vb) / 2 AS cg FROM l), p2 AS (SELECT *, ll * ll AS l2, yp * yp AS gg, yp * co AS gco, yp * cg AS gcg FROM p),
{box_sql('p2', 'b1', {'m1': 'll', 'm2': 'l2', 'mg': 'yp', 'mgg': 'gg', 'mco': 'co', 'mcg': 'cg', 'mgco': 'gco', 'mgcg': 'gcg'}, 2, 'img, y, x, r, g, b, luma, maxrgb, yp, co, cg')},
s1 AS (SELECT *, luma <= 0.5 AND sqrt(greatest(m2 - m1 * m1, 0)) <= 0.0025 AS route0, (mgco - mg * mco) / (mgg - mg * mg + 0.1) AS aco, (mgcg - mg * mcg) / (mgg - mg * mg + 0.1) AS acg FROM b1),
s2 AS (SELECT *, mco - aco * mg AS bco, mcg - acg * mg AS bcg FROM s1),
{box_sql('s2', 'b2', {'xco': 'aco', 'zco': 'bco', 'xcg': 'acg', 'zcg': 'bcg'}, 2, 'img, y, x, r, g, b, luma, maxrgb, yp, co, cg, route0')},
s3 AS (SELECT *, xco * yp + zco AS lco, xcg * yp + zcg AS lcg FROM b2), s4 AS (SELECT *, co - lco AS hco, cg - lcg AS hcg FROM s3),
me AS (SELECT median(hco) AS mo, median(hcg) AS mc FROM s4), md AS (SELECT greatest(1.4826 * 2.5 * median(abs(hco - mo)), 1e-12) AS tho, greatest(1.4826 * 2.5 * median(abs(hcg - mc)), 1e-12) AS thc FROM s4, me),
st AS (SELECT quantile_cont(maxrgb, 0.97) AS p97, quantile_cont(maxrgb, 0.99) AS p99, max(maxrgb) AS top FROM s4),
cd AS (SELECT ord, CASE {' '.join(f"WHEN ord = {i} THEN (SELECT quantile_cont(maxrgb, {p / 100}) FROM s4)" for i, p in enumerate(N.CANDIDATES))} END AS t FROM (SELECT unnest(range({len(N.CANDIDATES)})) AS ord)),
ce AS (SELECT ord, t, (coalesce(max(yp) FILTER (NOT route0 AND maxrgb <= t), max(yp)) - coalesce(min(yp) FILTER (NOT route0 AND maxrgb <= t), min(yp))) / 255 AS step FROM s4, cd GROUP BY ALL),
ck AS (SELECT t AS cut FROM ce ORDER BY CASE WHEN step <= 0.0032 THEN ord ELSE 100 - ord END LIMIT 1),
s5 AS (SELECT s4.*, route0 OR (greatest(top / p99, p99 / p97) >= 4 AND maxrgb > cut) AS route, sign(hco) * greatest(abs(hco) - tho, 0) AS co_high, sign(hcg) * greatest(abs(hcg) - thc, 0) AS cg_high, log2(1 + r) AS tr, log2(1 + g) AS tg, log2(1 + b) AS tb FROM s4, md, st, ck),
s6 AS (SELECT *, NOT route AND (co_high <> 0 OR cg_high <> 0) AS high FROM s5),
bl AS (SELECT y // 2 AS by, x // 2 AS bx, avg(lco) AS cco, avg(lcg) AS ccg, bool_or(route) AS touched FROM s6 GROUP BY ALL),
ra AS (SELECT {', '.join(f"coalesce({f}({n}) FILTER ({w}), {f}({n})) AS {e}_{n}" for n, w in (('yp', 'NOT route'), ('co_high', 'high'), ('cg_high', 'high'), ('tr', 'route'), ('tg', 'route'), ('tb', 'route')) for e, f in (('lo', 'min'), ('hi', 'max')))} FROM s6),
rb AS (SELECT {', '.join(f"coalesce({f}({n}) FILTER (NOT touched), {f}({n})) AS {e}_{n}" for n in ('cco', 'ccg') for e, f in (('lo', 'min'), ('hi', 'max')))} FROM bl)"""


def _back_sql(n: str, bits: int) -> str:
    top = (1 << bits) - 1
    return f"CASE WHEN hi_{n} > lo_{n} THEN lo_{n} + least(greatest(floor(({n} - lo_{n}) / (hi_{n} - lo_{n}) * {top} + 0.5), 0), {top}) * (hi_{n} - lo_{n}) / {top} ELSE lo_{n} END"


_M14 = f"""{_BOTH}, d AS (SELECT s6.img, s6.y, s6.x, r, g, b, route, {_back_sql('yp', 8)} AS dy, {_back_sql('cco', 8)} + CASE WHEN high THEN {_back_sql('co_high', 5)} ELSE 0 END AS dco, {_back_sql('ccg', 8)} + CASE WHEN high THEN {_back_sql('cg_high', 5)} ELSE 0 END AS dcg, {_back_sql('tr', 10)} AS dr, {_back_sql('tg', 10)} AS dg, {_back_sql('tb', 10)} AS db FROM s6 JOIN bl ON bl.by = s6.y // 2 AND bl.bx = s6.x // 2, ra, rb),
e AS (SELECT *, dy - dcg / 2 + dco / 2 AS er, dy + dcg / 2 AS eg, dy - dcg / 2 - dco / 2 AS eb FROM d),
f AS (SELECT img, y, x, route, r, g, b, {', '.join(f"CASE WHEN route THEN sign(d{k}) * (pow(2, abs(d{k})) - 1) ELSE sign(e{k}) * pow(abs(e{k}), 4.0 / 3) END AS {k}{k}" for k in 'rgb')} FROM e)"""
_SHOWN = lambda k: f"pow(least(greatest({k} / 4, 0), 1), 1 / 2.2)"


@query("m14_reconstruct", f"{_M14} SELECT img, y, x, route, abs((0.2126 * {_SHOWN('rr')} + 0.7152 * {_SHOWN('gg')} + 0.0722 * {_SHOWN('bb')}) - (0.2126 * {_SHOWN('r')} + 0.7152 * {_SHOWN('g')} + 0.0722 * {_SHOWN('b')})) >= 0.010 AS guard, round(rr, 4) AS rr, round(gg, 4) AS gg, round(bb, 4) AS bb FROM f")
def m14(spark, d):
    """Every decoded pixel, its route and whether the visual guard would route it."""
    out = N.visual_guard(N.reconstructed(px(spark, d)))
    return out.select("img", "y", "x", "route", "guard", *[F.round(k, 4).alias(k) for k in ("rr", "gg", "bb")])


@query("m15_route_report", f"{_PLANES} SELECT img, count(*) AS n, round(avg(CASE WHEN dark THEN 1.0 ELSE 0 END), 6) AS dark_rate, round(avg(CASE WHEN smooth THEN 1.0 ELSE 0 END), 6) AS smooth_rate, round(max(maxrgb) / quantile_cont(maxrgb, 0.99), 6) AS max_over_p99 FROM r0 GROUP BY img")
def m15(spark, d):
    r = N.first_route(N.planes(px(spark, d)))
    rate = lambda k: F.round(F.avg(c(k).cast("double")), 6).alias(f"{k}_rate")
    return r.groupBy("img").agg(F.count(F.lit(1)).alias("n"), rate("dark"), rate("smooth"), F.max("maxrgb").alias("top")).join(D.quantiles(r, ["img"], {"maxrgb": [0.99]}), "img").select("img", "n", "dark_rate", "smooth_rate", F.round(c("top") / c("maxrgb")[0], 6).alias("max_over_p99"))


# --- quality

_QQ = f"WITH {grid_sql(*TWO)}, {_Q8}"


def pairs(spark, d):
    g = G.grids(spark, d, *TWO).select(*KEYS, c("v").cast("double").alias("o"))
    up = c("o") * 16
    whole = F.when(F.abs(up) < 2.0**52, F.floor(up).cast("double")).otherwise(up)  # F.floor gives a BIGINT; greater ones have no fraction
    return g.withColumn("d", whole / 16)


@query("g01_error_stats", f"{_QQ} SELECT img, count(*) AS n, round(max(abs(d - o)), 6) AS max_abs, round(avg(abs(d - o)), 6) AS mae, round(sqrt(avg((d - o) * (d - o))), 6) AS rmse, round(10 * log10(avg(o * o) / avg((d - o) * (d - o))), 5) AS snr_db, round(20 * log10(max(abs(o)) / sqrt(avg((d - o) * (d - o)))), 5) AS psnr_db, round(max(abs((d - o) / o)), 6) AS max_rel, round(avg(CASE WHEN d <> o THEN 1.0 ELSE 0 END), 6) AS changed FROM q GROUP BY img")
def g01(spark, d):
    s = Y.error_stats(pairs(spark, d), ["img"], "o", "d").drop("max_rel_nonzero")
    return s.select("img", "n", *[F.round(k, 5 if k.endswith("db") else 6).alias(k) for k in s.columns[2:]])


@query("g02_region_stats", f"{_QQ}, r AS (SELECT *, abs(d - o) AS a, unnest(['all', CASE WHEN o <= 0.25 THEN 'dark' WHEN o <= 1 THEN 'mid' WHEN o <= 4 THEN 'highlight' ELSE 'extreme' END]) AS region FROM q) SELECT img, region, count(*) AS samples, round(sqrt(avg(a * a)), 6) AS rmse, round(avg(a), 6) AS mae, round(quantile_disc(a, 0.95), 6) AS p95, round(quantile_disc(a, 0.99), 6) AS p99, round(quantile_disc(a, 0.999), 6) AS p999, round(max(a), 6) AS max_abs FROM r GROUP BY ALL")
def g02(spark, d):
    """Difference statistics by brightness region."""
    p = pairs(spark, d).withColumn("region", F.explode(Y.regions(c("o"))))
    s = Y.scalar_stats(p, ["img", "region"], c("d") - c("o")).drop("psnr_db")
    return s.select("img", "region", "samples", *[F.round(k, 6).alias(k) for k in s.columns[3:]])


_GG = f"{_EVT}, q AS (SELECT img, y, x, v AS o, floor(v * 16) / 16 AS d FROM p), e AS (SELECT img, lead(o) OVER r - o AS o, lead(d) OVER r - d AS d FROM q WINDOW r AS (PARTITION BY img, y ORDER BY x) UNION ALL SELECT img, lead(o) OVER k - o, lead(d) OVER k - d FROM q WINDOW k AS (PARTITION BY img, x ORDER BY y))"


@query("g03_gradient_stats", f"{_GG} SELECT img, count(*) AS gradients, round(sqrt(sum((d - o) * (d - o)) / sum(o * o)), 6) AS nrmse, round(sqrt(sum(d * d) / sum(o * o)), 6) AS energy, round(sum(o * d) / sqrt(sum(o * o) * sum(d * d)), 6) AS correlation, round(avg(CASE WHEN abs(o) > 1.0 / 4096 AND abs(d) < abs(o) * 0.5 THEN 1.0 ELSE 0 END), 6) AS lost FROM e WHERE o IS NOT NULL GROUP BY img")
def g03(spark, d):
    p = plane(spark, d, "evt1", "part1").select("img", "y", "x", c("v").alias("o"), (F.floor(c("v") * 16) / 16).alias("d"))
    s = Y.gradient_stats(p, ["img"], "o", "d")
    return s.select("img", "gradients", *[F.round(k, 6).alias(k) for k in s.columns[2:]])


@query("g05_low_frequency", f"{_EVT}, q AS (SELECT img, y, x, floor(v * 16) / 16 - v AS e FROM p), {box_sql('q', 'b', {'low': 'e'}, 3, 'img, y, x')}, k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY round(abs(low), 7) DESC, y, x) AS k FROM b) SELECT img, y, x, round(low, 6) AS low FROM k WHERE k = 1")
def g05(spark, d):
    """Where the box mean of the error is greatest (the first in raster order)."""
    p = plane(spark, d, "evt1", "part1").withColumn("e", F.floor(c("v") * 16) / 16 - c("v"))
    b = W.box_mean(p, {"low": "e"}, 3)
    best = b.groupBy("img").agg(F.max_by(F.struct("y", "x", "low"), F.struct(F.round(F.abs("low"), 7), -c("y"), -c("x"))).alias("s"))
    return best.select("img", "s.y", "s.x", F.round("s.low", 6).alias("low"))


@query("g08_gate", f"{_QQ}, s AS (SELECT img, c, quantile_disc(abs(d - o), 0.99) AS p99, max(abs(d - o)) AS top FROM q GROUP BY ALL), k AS (SELECT img, c, CASE WHEN p99 <= 0.0619 THEN 'pass' WHEN p99 <= 0.062 THEN 'maybe' ELSE 'reject' END AS decision FROM s) SELECT img, c, decision, CASE decision WHEN 'pass' THEN 0 WHEN 'maybe' THEN 1 ELSE 2 END AS rank FROM k")
def g08(spark, d):
    """Gates on a percentile of the error, and their order."""
    s = Y.scalar_stats(pairs(spark, d), ["img", "c"], c("d") - c("o"))
    return s.select("img", "c", Y.gate(c("p99"), 0.0619, 0.062).alias("decision")).withColumn("rank", Y.decision_rank(c("decision")))


@query("g13_affine_fit", f"{_QQ} SELECT img, c, round(regr_slope(o, d), 6) AS slope, round(regr_intercept(o, d), 5) AS intercept FROM q GROUP BY ALL")
def g13(spark, d):
    return pairs(spark, d).groupBy("img", "c").agg(F.round(F.regr_slope("o", "d"), 6).alias("slope"), F.round(F.regr_intercept("o", "d"), 5).alias("intercept"))


@query("g14_bit_exact", f"WITH {grid_sql(*TWO)}, {WORDS} SELECT img, count(*) FILTER (b % 256 <> 0) AS differing, count(*) FILTER (b % 256 <> 0) = 0 AS exact FROM go GROUP BY img")
def g14(spark, d):
    w = P.with_words(G.grids(spark, d, *TWO)).withColumn("diff", B.clear_low(c("b"), 8) != c("b"))
    return w.groupBy("img").agg(F.count_if("diff").alias("differing")).withColumn("exact", c("differing") == 0)


# --- multi-resolution

_H1 = "q AS (SELECT img, y // 2 AS y, x // 2 AS x, max(v) FILTER (y % 2 = 0 AND x % 2 = 0) AS a, max(v) FILTER (y % 2 = 0 AND x % 2 = 1) AS b, max(v) FILTER (y % 2 = 1 AND x % 2 = 0) AS c, max(v) FILTER (y % 2 = 1 AND x % 2 = 1) AS d FROM p GROUP BY ALL HAVING count(*) = 4), l1 AS (SELECT img, y, x, (a + b + c + d) / 2 AS v, (a - b + c - d) / 2 AS hl, (a + b - c - d) / 2 AS lh, (a - b - c + d) / 2 AS hh FROM q)"


@query("t01_haar", f"{_EVT}, {_H1} SELECT img, 1 AS level, 'll' AS band, y, x, round(v, 5) AS v FROM l1 UNION ALL SELECT img, 1, 'hl', y, x, round(hl, 5) FROM l1 UNION ALL SELECT img, 1, 'lh', y, x, round(lh, 5) FROM l1 UNION ALL SELECT img, 1, 'hh', y, x, round(hh, 5) FROM l1")
def t01(spark, d):
    h = M.haar(plane(spark, d, "evt1", "part1"), "v", 1)
    return h.select("img", "level", "band", "y", c("x").cast("int").alias("x"), F.round("v", 5).alias("v"))


@query("t01_haar_inverse", f"{_EVT}, {_H1} SELECT img, count(*) * 4 AS n, count(*) * 4 AS close FROM l1 GROUP BY img")
def t01_inverse(spark, d):
    p = plane(spark, d, "evt1", "part1")
    back = M.haar_inverse_level(M.haar(p, "v", 1)).withColumnRenamed("v", "back")
    j = back.join(p, ["img", "y", "x"])
    return j.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(c("back") - c("v")) < 1e-9).alias("close"))


@query("t02_anchor_pyramid", f"WITH {grid_sql('evt1')}, {WORDS}, q AS (SELECT img, y // 2 AS y, x // 2 AS x, max(o) FILTER (y % 2 = 0 AND x % 2 = 0) AS a, max(o) FILTER (y % 2 = 0 AND x % 2 = 1) AS b, max(o) FILTER (y % 2 = 1 AND x % 2 = 0) AS c, max(o) FILTER (y % 2 = 1 AND x % 2 = 1) AS d FROM go GROUP BY ALL) SELECT img, y, x, a AS anchor, (b - a + 4294967296) % 4294967296 AS d01, (c - a + 4294967296) % 4294967296 AS d10, (d - a + 4294967296) % 4294967296 AS d11 FROM q")
def t02(spark, d):
    """One level of an integer pyramid with modular differences."""
    return M.anchor_pyramid(P.with_words(G.grid(spark, d, "evt1")), "o", 32)


@query("t04_pass_map", f"{_EVT} SELECT img, CASE WHEN y % 8 = 0 AND x % 8 = 0 THEN 0 WHEN y % 4 = 0 AND x % 4 = 0 THEN 1 WHEN y % 2 = 0 AND x % 2 = 0 THEN 2 ELSE 3 END AS pass, count(*) AS n FROM p GROUP BY ALL")
def t04(spark, d):
    return plane(spark, d, "evt1", "part1").groupBy("img", M.pass_of(c("y"), c("x"), 3).alias("pass")).agg(F.count(F.lit(1)).alias("n"))


# --- streams and frames

@query("e02_range_coded_streams")
def e02(spark, d):
    """Byte planes range-coded chunk by chunk and decoded again."""
    s = G.raster(byte_planes(spark, d))
    return S.coded(s, ["img", "plane"], "i", "byte").select("img", "plane", "chunk", "raw_bytes", "coded_bytes", "exact")


@query("e13_packed_masks", f"{_EVT}, sd AS (SELECT img, max(x) + 1 AS wd FROM p GROUP BY img) SELECT p.img, (y * wd + x) // 8 AS byte, sum(CAST(v > 100 AS BIGINT) << CAST((y * wd + x) % 8 AS INTEGER))::BIGINT AS v FROM p JOIN sd ON sd.img = p.img GROUP BY ALL")
def e13(spark, d):
    p = G.raster(plane(spark, d, "evt1", "part1")).withColumn("m", c("v") > 100)
    return S.packed_bits(p, ["img"], "i", "m")


@query("s14_frames", "SELECT o_orderkey, 3::BIGINT AS version, o_orderkey % 5000 + 1 AS width, o_custkey + 1 AS height, (o_orderkey % 4 + 1)::BIGINT AS channels, 0::BIGINT AS format, o_orderkey * 7 AS stages, 0::BIGINT AS rans_mode, 0::BIGINT AS effort, 0::BIGINT AS low_bits, (o_orderkey % 4)::BIGINT AS policy, (o_orderkey % 3)::BIGINT AS sign_class, octet_length(encode(o_orderpriority))::BIGINT AS payload_bytes FROM orders")
def s14(spark, d):
    """Frames written as binary columns and their headers parsed again."""
    o = G.table(spark, d, "orders")
    k = c("o_orderkey")
    f = o.select(k, S.framed(k % 5000 + 1, c("o_custkey") + 1, k % 4 + 1, k * 7, k % 4, k % 3, F.encode("o_orderpriority", "utf-8")).alias("data"))
    return f.select("o_orderkey", *[v.cast("long").alias(n) for n, v in S.header(c("data")).items()])


@query("s08_json_unnest", "SELECT event_type, count(*) AS n, count(DISTINCT props) AS kinds FROM events GROUP BY ALL")
def s08(spark, d):
    """JSON documents parsed by their own schema; counts by type."""
    e = G.table(spark, d, "events").withColumn("parsed", F.from_json("props", "map<string,string>"))
    return e.filter(c("parsed").isNotNull() | c("props").isNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("props").alias("kinds"))


# --- reports over results that the engine itself makes

_RES = f"WITH {grid_sql('emb4', 'ord3', 'evt1', 'part1')}, {WORDS}, s AS (SELECT img, low, bit, count(*) AS n, sum(((b - b % CAST(pow(2, low) AS BIGINT)) >> bit) & 1) AS k FROM go, (SELECT unnest([0, 8, 12, 15]) AS low), (SELECT CAST(unnest(range(32)) AS INTEGER) AS bit) GROUP BY ALL), res AS (SELECT img, 'low' || low AS method, low AS low_bits, round(sum({_KT1}), 3) AS bits, round(32 * max(n) / sum({_KT1}), 6) AS ratio FROM s GROUP BY img, low)"


def results(spark, d):
    """img, method, low_bits, bits, ratio: bit-plane cost of the samples with low mantissa bits cleared."""
    w = P.with_words(G.grids(spark, d, "emb4", "ord3", "evt1", "part1"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("low_bits"), B.clear_low(c("b"), k).alias("q")) for k in (0, 8, 12, 15)]))
    p = E.plane_counts(w.select("img", each.alias("s")).select("img", "s.*"), ["img", "low_bits"], "q", range(32))
    bits = F.sum(E.kt_bits(c("n") - c("ones"), c("ones")))
    return p.groupBy("img", "low_bits").agg(F.round(bits, 3).alias("bits"), F.round(32 * F.max("n") / bits, 6).alias("ratio")).withColumn("method", F.concat(F.lit("low"), c("low_bits").cast("string"))).select("img", "method", "low_bits", "bits", "ratio")


@query("a42_method_summary", f"{_RES} SELECT method, round(exp(avg(ln(ratio))), 5) AS ratio_geomean, round(avg(bits), 2) AS bits_mean, round(min(bits), 2) AS bits_min, round(max(bits), 2) AS bits_max, round(median(bits), 2) AS bits_median, count(*) AS images FROM res GROUP BY method")
def a42(spark, d):
    s = R.summary(results(spark, d))
    return s.select("method", F.round("ratio_geomean", 5).alias("ratio_geomean"), *[F.round(k, 2).alias(k) for k in ("bits_mean", "bits_min", "bits_max", "bits_median")], "images")


@query("a43_totals", f"{_RES} SELECT method, round(sum(bits) / 8192, 3) AS kib, count(*) FILTER (ratio >= 2) AS hits, round(sum(greatest(0, bits - bits * ratio / 2)) / 8192, 3) AS gap_kib FROM res GROUP BY method")
def a43(spark, d):
    r = results(spark, d)
    return r.groupBy("method").agg(F.round(F.sum("bits") / 8192, 3).alias("kib"), F.count_if(c("ratio") >= 2).alias("hits"), F.round(F.sum(F.greatest(F.lit(0.0), c("bits") - c("bits") * c("ratio") / 2)) / 8192, 3).alias("gap_kib"))


@query("j02_against_baseline", f"{_RES} SELECT r.img, r.method, r.ratio, b.ratio AS base_ratio, round(r.ratio / b.ratio, 5) AS gain FROM res r LEFT JOIN res b ON r.img = b.img AND b.method = 'low0' WHERE r.method <> 'low0'")
def j02(spark, d):
    """Ratios next to the baseline's."""
    return R.against_baseline(results(spark, d), "low0").select("img", "method", "ratio", "base_ratio", F.round("gain", 5).alias("gain"))


@query("j04_reach_target", f"{_RES}, k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY CASE WHEN ratio >= 2 THEN low_bits ELSE 100 END, ratio DESC, low_bits) AS k FROM res) SELECT img, low_bits, ratio, ratio >= 2 AS reached FROM k WHERE k = 1")
def j04(spark, d):
    return R.reach_target(results(spark, d), 2.0)


@query("j05_keep_best", f"{_RES} SELECT img, method, ratio FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY ratio DESC, method DESC) AS k FROM res) WHERE k = 1")
def j05(spark, d):
    return R.keep_best(results(spark, d), ["img"], "ratio", "method").select("img", "method", "ratio")


@query("j07_sets", "SELECT name FROM (SELECT DISTINCT n_name AS name FROM nation WHERE n_regionkey < 3 UNION SELECT n_name FROM nation WHERE n_nationkey > 15) WHERE name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 2)")
def j07(spark, d):
    """Union of patterns without repeats, minus an exclusion."""
    n = G.table(spark, d, "nation")
    either = n.filter("n_regionkey < 3").select("n_name").union(n.filter("n_nationkey > 15").select("n_name")).distinct()
    return either.join(n.filter("n_regionkey = 2").select("n_name"), "n_name", "left_anti").withColumnRenamed("n_name", "name")


@query("j12_report_order", f"{_RES} SELECT img, method, row_number() OVER (PARTITION BY img ORDER BY CASE WHEN low_bits = 0 THEN 0 ELSE 1 END, ratio DESC, method) AS place FROM res")
def j12(spark, d):
    """Exact methods first, then by ratio."""
    order = Window.partitionBy("img").orderBy(F.when(c("low_bits") == 0, 0).otherwise(1), F.desc("ratio"), "method")
    return results(spark, d).select("img", "method", F.row_number().over(order).cast("long").alias("place"))


@query("j13_top_symbols", f"WITH {grid_sql('evt1')}, {WORDS}, n AS (SELECT b >> 16 AS symbol, count(*) AS n FROM go GROUP BY ALL) SELECT symbol, n FROM n ORDER BY n DESC, symbol LIMIT 10")
def j13(spark, d):
    """The ten most frequent upper halves of words (the limit is the report's)."""
    n = P.with_words(G.grid(spark, d, "evt1")).groupBy(F.shiftright("b", 16).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "symbol").limit(10)


@query("j15_top_rate_mask", f"{_EVT}, t AS (SELECT img, quantile_cont(v, 0.95) AS t FROM p GROUP BY img) SELECT p.img, p.y, p.x FROM p JOIN t ON p.img = t.img WHERE v > t.t")
def j15(spark, d):
    p = plane(spark, d, "evt1", "part1")
    t = D.quantiles(p, ["img"], {"v": [0.95]}).select("img", c("v")[0].alias("t"))
    return p.join(t, "img").filter("v > t").select("img", "y", "x")


@query("j16_sliding_windows", f"{_EVT}, w AS (SELECT img, (y // 8 - j) AS wy, (x // 8 - i) AS wx, v FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) SELECT img, wy, wx, count(*) AS n, round(avg(v), 5) AS mean FROM w WHERE wy >= 0 AND wx >= 0 GROUP BY ALL")
def j16(spark, d):
    """Windows of 16 by 16 with stride 8; a pixel lies in four of them."""
    ids = F.explode(F.array(*[F.struct((F.expr("y div 8") - j).alias("wy"), (F.expr("cast(x div 8 as int)") - i).alias("wx")) for i in (0, 1) for j in (0, 1)]))
    w = plane(spark, d, "evt1", "part1").select("img", "v", ids.alias("w")).select("img", "v", "w.*").filter("wy >= 0 and wx >= 0")
    return w.groupBy("img", "wy", "wx").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 5).alias("mean"))

"""Queries on variants: full context families of masks and residual categories, fitted and corner surfaces, quantisers
that are applied, learnt codebooks, pyramids with their inverse, bit-matrix costs, joins and samples of results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import tone as T
from ..operators import entropy as E
from ..operators import order as D
from ..operators import predict as P
from ..operators import pyramid as Y
from ..operators import quantize as Q
from ..sources import grids as G
from .coding import near
from .imaging import plane, results
from .registry import KT, NEIGHBOURS, WORDS, grid_sql, query

c = F.col
KEYS = G.KEYS
TWO = ("ord3", "evt1")
_ENT = "sum(n * log2(t / n))"
_V = "p AS (SELECT img, y, x, CAST(v AS DOUBLE) AS v FROM g)"
_EVT = f"WITH {grid_sql('evt1', 'part1')}, {_V}"

def _cost():
    """Adaptive bits of n bits with `ones` ones."""
    return E.kt_bits(c("n") - c("ones"), c("ones"))


def families(df, keep: list[str], made: dict, family: str = "family"):
    """df's keep columns times families: family, ctx."""
    each = F.array(*[F.struct(F.lit(k).alias(family), v.cast("long").alias("ctx")) for k, v in made.items()])
    return df.select(*keep, F.explode(each).alias("_f")).select(*keep, "_f.*")


# --- residual categories and masks

_INDEX = f"WITH {grid_sql('ord3')}, go AS (SELECT img, y, x, c, CAST(floor(v * CAST(25.4 AS FLOAT)) AS BIGINT) AS o FROM g), {NEIGHBOURS}, sr AS (SELECT img, y, x, c, CASE WHEN (o - (w + n) // 2 + 128) % 128 >= 64 THEN (o - (w + n) // 2 + 128) % 128 - 128 ELSE (o - (w + n) // 2 + 128) % 128 END AS s FROM nb)"
_SMALL = "CASE WHEN s = 0 THEN 0 WHEN s BETWEEN 1 AND 7 THEN s WHEN s BETWEEN -7 AND -1 THEN 7 - s WHEN s > 7 THEN 15 ELSE 16 END"
_SEVEN = "CASE WHEN s = 0 THEN 0 WHEN s = 1 THEN 1 WHEN s = -1 THEN 2 WHEN s BETWEEN 2 AND 3 THEN 3 WHEN s BETWEEN -3 AND -2 THEN 4 WHEN s BETWEEN 4 AND 7 THEN 5 ELSE 6 END"


def _neighbours_sql(value: str) -> str:
    return f"""k0 AS (SELECT img, y, x, c, {value} AS k, s FROM sr), k1 AS (SELECT *, lag(k, 1, 0) OVER (PARTITION BY img, c, y ORDER BY x) AS w, lag(k, 1, 0) OVER (PARTITION BY img, y, x ORDER BY c) AS pc FROM k0),
k2 AS (SELECT *, lag(k, 1, 0) OVER q AS n, lag(w, 1, 0) OVER q AS nw FROM k1 WINDOW q AS (PARTITION BY img, c, x ORDER BY y))"""


def signed_residuals(spark, d):
    """img, y, x, c and the residual s of 7-bit indices from the mean of west and north, in -64 .. 63."""
    q = P.with_neighbours(G.grid(spark, d, "ord3").select(*KEYS, F.floor(c("v") * F.lit(25.4).cast("float")).cast("long").alias("o")))
    return q.select(*KEYS, B.signed_difference(c("o"), F.expr("(w + n) div 2"), 7).alias("s"))


def small_category(s):
    """17 categories: 0, up to 7, down to -7, and an escape to each side."""
    return F.when(s == 0, 0).when(s.between(1, 7), s).when(s.between(-7, -1), 7 - s).when(s > 7, 15).otherwise(16).cast("long")


def seven_category(s):
    return F.when(s == 0, 0).when(s == 1, 1).when(s == -1, 2).when(s.between(2, 3), 3).when(s.between(-3, -2), 4).when(s.between(4, 7), 5).otherwise(6).cast("long")


def with_category_neighbours(r):
    """r (img, y, x, c, k) with w, n, nw and pc of k."""
    before = F.coalesce(F.lag("k").over(Window.partitionBy("img", "y", "x").orderBy("c")), B.long(0))
    return P.with_neighbours(r.withColumn("pc", before), "k")


@query("r08_categories", f"{_INDEX} SELECT img, c, s, {_SMALL} AS small, {_SEVEN} AS seven, count(*) AS n FROM sr GROUP BY ALL")
def r08(spark, d):
    """Signed residuals with their 17-way and their 7-way category."""
    s = c("s")
    return signed_residuals(spark, d).groupBy("img", "c", "s").agg(F.count(F.lit(1)).alias("n")).select("img", "c", "s", small_category(s).alias("small"), seven_category(s).alias("seven"), "n")


@query("c17_small_escape", f"{_INDEX}, {_neighbours_sql(_SMALL)}, e AS (SELECT img, w + 17 * n + 289 * pc AS ctx, k, count(*) AS n FROM (SELECT img, w, n, pc, k FROM k2) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY img, ctx) AS t FROM e) SELECT img, count(DISTINCT ctx) AS contexts, sum(n)::BIGINT AS total, round({_ENT}, 3) AS bits FROM t GROUP BY img")
def c17(spark, d):
    """C17: entropy of 17-way categories under the 17^3 contexts of west, north and the channel before."""
    n = with_category_neighbours(signed_residuals(spark, d).select(*KEYS, small_category(c("s")).alias("k")))
    e = n.select("img", "k", (c("w") + 17 * c("n") + 289 * c("pc")).alias("ctx"))
    return E.conditional_entropy_bits(e, ["img"], "ctx", "k").withColumn("bits", F.round("bits", 3))


_PHASE = "((y & 1) * 2 + (x & 1))"
_EIGHT = {
    "order0": "0",
    "phase_channel": f"{_PHASE} + 4 * c",
    "west": "w",
    "north": "n",
    "west_north": "w + 8 * n",
    "west_north_phase_channel": f"w + 8 * n + 64 * ({_PHASE} + 4 * c)",
    "west_north_previous": "w + 8 * n + 64 * pc",
    "wnnw_phase_channel": f"w + 8 * n + 64 * nw + 512 * ({_PHASE} + 4 * c)",
}


@query("c20_all_contexts", f"{_INDEX}, {_neighbours_sql(_SEVEN)}, e AS (" + " UNION ALL ".join(f"SELECT '{f}' AS family, {x} AS ctx, s FROM k2" for f, x in _EIGHT.items()) + f"), m AS (SELECT family, ctx, s, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY family, ctx) AS t FROM m) SELECT family, count(DISTINCT ctx) AS contexts, sum(n)::BIGINT AS total, round({_ENT}, 3) AS bits FROM t GROUP BY family")
def c20_all(spark, d):
    """Entropy of signed residuals under all eight contexts of their neighbours' categories."""
    n = with_category_neighbours(signed_residuals(spark, d).withColumn("k", seven_category(c("s"))))
    w, no, nw, pc, phase = c("w"), c("n"), c("nw"), c("pc"), (c("y") % 2) * 2 + c("x") % 2
    made = [F.lit(0), phase + 4 * c("c"), w, no, w + 8 * no, w + 8 * no + 64 * (phase + 4 * c("c")), w + 8 * no + 64 * pc, w + 8 * no + 64 * nw + 512 * (phase + 4 * c("c"))]
    e = families(n, ["s"], dict(zip(_EIGHT, made, strict=True)))
    return E.conditional_entropy_bits(e, ["family"], "ctx", "s").withColumn("bits", F.round("bits", 3))


_MASK = f"""WITH {grid_sql('ord3')}, k0 AS (SELECT img, y, x, c, CAST(v > 1.5 AS BIGINT) AS m FROM g), k1 AS (SELECT *, lag(m, 1, 0) OVER (PARTITION BY img, c, y ORDER BY x) AS w, lead(m, 1, 0) OVER (PARTITION BY img, c, y ORDER BY x) AS e, lag(m, 1, 0) OVER (PARTITION BY img, y, x ORDER BY c) AS pc FROM k0),
k2 AS (SELECT *, lag(m, 1, 0) OVER q AS n, lag(w, 1, 0) OVER q AS nw, lag(e, 1, 0) OVER q AS ne FROM k1 WINDOW q AS (PARTITION BY img, c, x ORDER BY y))"""


@query("c16_index_mask", f"{_MASK}, s AS (SELECT img, w + 2 * n + 4 * nw + 8 * ne + 16 * pc + 32 * (c + 3 * {_PHASE}) AS ctx, count(*) AS n, sum(m) AS ones FROM k2 GROUP BY ALL) SELECT img, count(*) AS contexts, sum(n)::BIGINT AS n, round(sum({KT}), 3) AS bits FROM s GROUP BY img")
def c16(spark, d):
    """A mask under 32 spatial contexts times channel times 2 x 2 phase."""
    m = G.grid(spark, d, "ord3").select(*KEYS, (c("v") > 1.5).cast("long").alias("m"))
    before = F.coalesce(F.lag("m").over(Window.partitionBy("img", "y", "x").orderBy("c")), B.long(0))
    n = P.with_neighbours(m.withColumn("pc", before), "m")
    ctx = c("w") + 2 * c("n") + 4 * c("nw") + 8 * c("ne") + 16 * c("pc") + 32 * (c("c") + 3 * ((c("y") % 2) * 2 + c("x") % 2))
    s = n.groupBy("img", ctx.alias("ctx")).agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("ones"))
    return s.groupBy("img").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n"), F.round(F.sum(_cost()), 3).alias("bits"))


_SEVEN_MASKS = {"order0": "0", "west": "w", "north": "n", "west_north": "w + 2 * n", "west_north_nw": "w + 2 * n + 4 * nw", "phase2": "(x % 2) + 2 * (y % 2) + 4 * (w + 2 * n)", "phase6": "(x % 6) + 6 * (y % 6) + 36 * (w + 2 * n)"}


@query("c21_mask_families", f"{_MASK}, e AS (" + " UNION ALL ".join(f"SELECT img, '{f}' AS family, {x} AS ctx, m FROM k2" for f, x in _SEVEN_MASKS.items()) + f"), k AS (SELECT img, family, ctx, m, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY img, family, ctx) AS t FROM k) SELECT img, family, CAST(max(ctx) + 1 AS BIGINT) AS contexts, CAST(ceil(round({_ENT}, 4) / 8) + 4 * (max(ctx) + 1) + 16 AS BIGINT) AS bytes FROM t GROUP BY ALL")
def c21(spark, d):
    """Entropy bytes of a mask with its model's under seven context families."""
    n = P.with_neighbours(G.grid(spark, d, "ord3").select(*KEYS, (c("v") > 1.5).cast("long").alias("m")), "m")
    w, no, wn = c("w"), c("n"), c("w") + 2 * c("n")
    made = [F.lit(0), w, no, wn, wn + 4 * c("nw"), c("x") % 2 + 2 * (c("y") % 2) + 4 * wn, c("x") % 6 + 6 * (c("y") % 6) + 36 * wn]
    e = families(n, ["img", "m"], dict(zip(_SEVEN_MASKS, made, strict=True)))
    inner = E.entropy_bits(e, ["img", "family", "ctx"], "m")
    top = F.max("ctx") + 1
    return inner.groupBy("img", "family").agg(top.alias("contexts"), (F.ceil(F.round(F.sum("bits"), 4) / 8) + 4 * top + 16).alias("bytes"))


@query("c24_noise_contexts", f"WITH {grid_sql('ord3')}, r AS (SELECT c, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM g GROUP BY c), q AS (SELECT g.y, g.x, g.c, CAST(v AS DOUBLE) AS v, lo, hi, CAST(floor((CAST(v AS DOUBLE) - lo) / (hi - lo) * 127 + 0.5) AS BIGINT) AS q FROM g JOIN r ON g.c = r.c), e AS (SELECT (({_PHASE} * 3 + c) * 8 + q * 8 // 128) AS ctx, v - (lo + q * (hi - lo) / 127) AS e FROM q) SELECT ctx, count(*) AS n, round(avg(e), 6) AS mean FROM e GROUP BY ctx")
def c24(spark, d):
    """Mean quantisation residual by phase, channel and bucket of the index."""
    t = Q.ranged(G.grid(spark, d, "ord3").withColumn("v", c("v").cast("double")), c("v"), ["img", "c"])
    t = t.withColumn("q", Q.index_of(c("v"), c("lo"), c("hi"), 7))
    ctx = ((((c("y") % 2) * 2 + c("x") % 2) * 3 + c("c")) * 8 + F.expr("q * 8 div 128")).cast("long")
    e = t.select(ctx.alias("ctx"), (c("v") - Q.value_of(c("q"), c("lo"), c("hi"), 7)).alias("e"))
    return e.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mean"))


_FOLDS = {"fold8": "(t >> 7)", "fold_low": "(t & 127)", "fold_xor": "(xor(t, t >> 8) & 255)", "seed": "((w + n) // 2) % 256"}


@query("c23_tail_contexts", f"WITH {grid_sql(*TWO)}, {WORDS}, {NEIGHBOURS}, h AS (SELECT img, (o >> 15) & 32767 AS t, (w >> 15) & 255 AS w, (n >> 15) & 255 AS n, (o >> 14) & 1 AS one FROM nb), e AS (" + " UNION ALL ".join(f"SELECT img, '{f}' AS family, {x} AS ctx, one FROM h" for f, x in _FOLDS.items()) + f"), s AS (SELECT img, family, ctx, count(*) AS n, sum(one) AS ones FROM e GROUP BY ALL) SELECT img, family, count(*) AS contexts, round(sum({KT}), 3) AS bits FROM s GROUP BY ALL")
def c23(spark, d):
    """The top tail bit under folds of the bits above it and a seed from the neighbours."""
    n = near(spark, d)
    high = lambda k, m: F.shiftright(c(k), 15).bitwiseAND(B.long(m))
    h = n.select("img", high("o", 32767).alias("t"), high("w", 255).alias("w"), high("n", 255).alias("n"), B.bit(c("o"), 14).alias("one"))
    made = [F.shiftright("t", 7), c("t").bitwiseAND(B.long(127)), c("t").bitwiseXOR(F.shiftright("t", 8)).bitwiseAND(B.long(255)), F.expr("((w + n) div 2) % 256")]
    e = families(h, ["img", "one"], dict(zip(_FOLDS, made, strict=True)))
    s = e.groupBy("img", "family", "ctx").agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("ones"))
    return s.groupBy("img", "family").agg(F.count(F.lit(1)).alias("contexts"), F.round(F.sum(_cost()), 3).alias("bits"))


# --- predictors

@query("p15_all_second_orders", f"WITH {grid_sql('evt1')}, {WORDS}, {NEIGHBOURS} SELECT img, y, x, c, o - w - n + nw AS dxy, round(CAST(v - 2 * lag(v, 1, CAST(0 AS FLOAT)) OVER r + lag(v, 2, CAST(0 AS FLOAT)) OVER r AS DOUBLE), 3) AS fx, round(CAST(v - 2 * lag(v, 1, CAST(0 AS FLOAT)) OVER k + lag(v, 2, CAST(0 AS FLOAT)) OVER k AS DOUBLE), 3) AS fy FROM nb WINDOW r AS (PARTITION BY img, c, y ORDER BY x), k AS (PARTITION BY img, c, x ORDER BY y)")
def p15_all(spark, d):
    """The mixed second-order difference of ordered words, and those of floats along both axes (binary32)."""
    r, k = Window.partitionBy("img", "c", "y").orderBy("x"), Window.partitionBy("img", "c", "x").orderBy("y")
    lag = lambda w, i: F.coalesce(F.lag("v", i).over(w), F.lit(0.0).cast("float"))
    second = lambda w: F.round((c("v") - F.lit(2.0).cast("float") * lag(w, 1) + lag(w, 2)).cast("double"), 3)
    return near(spark, d, "evt1").select(*KEYS, (c("o") - c("w") - c("n") + c("nw")).alias("dxy"), second(r).alias("fx"), second(k).alias("fy"))


_FIT = f"""{_EVT}, t AS (SELECT *, y // 16 AS ty, x // 16 AS tx FROM p), m AS (SELECT img, ty, tx, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(v) AS mv, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM t GROUP BY ALL),
f AS (SELECT *, xx * yy - xy * xy AS det FROM m), k AS (SELECT *, CASE WHEN det > 1e-9 THEN (xv * yy - yv * xy) / det WHEN xx > 0 THEN xv / xx ELSE 0 END AS gx, CASE WHEN det > 1e-9 THEN (yv * xx - xv * xy) / det WHEN xx > 0 THEN 0 WHEN yy > 0 THEN yv / yy ELSE 0 END AS gy FROM f)"""


@query("p16_affine_residuals", f"{_FIT} SELECT t.img, t.y, t.x, round(t.v - (mv + gx * (t.x - mx) + gy * (t.y - my)), 4) AS residual FROM t JOIN k ON t.img = k.img AND t.ty = k.ty AND t.tx = k.tx")
def p16_affine(spark, d):
    """Residuals from the least-squares plane of each tile (normal equations from its moments)."""
    t = plane(spark, d, "evt1", "part1").withColumns({"ty": F.expr("y div 16"), "tx": F.expr("cast(x div 16 as int)")})
    m = t.groupBy("img", "ty", "tx").agg(*[F.avg(k).alias(f"m{k}") for k in "xyv"], F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "v").alias("xv"), F.covar_pop("y", "v").alias("yv"))
    det, full = c("xx") * c("yy") - c("xy") * c("xy"), (c("xx") * c("yy") - c("xy") * c("xy")) > 1e-9
    bx = F.when(full, (c("xv") * c("yy") - c("yv") * c("xy")) / det).when(c("xx") > 0, c("xv") / c("xx")).otherwise(0.0)
    by = F.when(full, (c("yv") * c("xx") - c("xv") * c("xy")) / det).when(c("xx") > 0, 0.0).when(c("yy") > 0, c("yv") / c("yy")).otherwise(0.0)
    j = t.join(m.withColumns({"bx": bx, "by": by}), ["img", "ty", "tx"])
    return j.select("img", "y", "x", F.round(c("v") - (c("mv") + c("bx") * (c("x") - c("mx")) + c("by") * (c("y") - c("my"))), 4).alias("residual"))


@query("p16_quadratic_residuals")
def p16_quadratic(spark, d):
    """tiles' quadratic least-squares surfaces of the ordered words and of log2 of positive samples; words' integer residuals."""
    t = P.with_words(G.grids(spark, d, "evt1", "part1")).withColumns({"ty": F.expr("y div 16"), "tx": F.expr("cast(x div 16 as int)")})

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x, y, o, v = (part[k].to_numpy(float) for k in ("x", "y", "o", "v"))
        x, y = x - x.mean(), y - y.mean()
        a = np.stack([np.ones(len(x)), x, y, x * x, x * y, y * y], 1)
        guess = np.rint(a @ np.linalg.lstsq(a, o, rcond=None)[0]).clip(0, B.WORD)
        log = np.log2(np.where(v > 0, v, 1.0))
        off = np.abs(log - a @ np.linalg.lstsq(a, log, rcond=None)[0]).max() if (v > 0).all() else None
        return part[["img", "y", "x"]].assign(residual=(o - guess).astype(np.int64), log_off=off)

    return t.groupBy("img", "c", "ty", "tx").applyInPandas(fit, "img string, y long, x int, residual long, log_off double")


_CORNERS = f"""{_EVT}, t AS (SELECT *, y // 8 AS ty, x // 8 AS tx FROM p), k AS (SELECT img, ty, tx, arg_min(v, y * 1000 + x) AS a, arg_min(v, y * 1000 - x) AS b, arg_max(v, y * 1000 - x) AS d, arg_max(v, y * 1000 + x) AS e, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM t GROUP BY ALL),
j AS (SELECT t.img, t.y, t.x, t.ty, t.tx, t.v, k.a, k.b, k.d, k.e, CASE WHEN x1 > x0 THEN (t.x - x0) / CAST(x1 - x0 AS DOUBLE) ELSE 0 END AS fx, CASE WHEN y1 > y0 THEN (t.y - y0) / CAST(y1 - y0 AS DOUBLE) ELSE 0 END AS fy FROM t JOIN k ON t.img = k.img AND t.ty = k.ty AND t.tx = k.tx),
s AS (SELECT *, first_value(v) OVER r AS left_, last_value(v) OVER r AS right_, first_value(v) OVER q AS top_, last_value(v) OVER q AS bottom_, lag(v) OVER o AS before FROM j WINDOW r AS (PARTITION BY img, ty, tx, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), q AS (PARTITION BY img, ty, tx, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), o AS (PARTITION BY img, ty, tx, y ORDER BY x))"""


@query("p17_all_surfaces", f"{_CORNERS} SELECT img, y, x, round(v - (a + (b - a) * fx + (d - a) * fy), 4) AS affine, round(v - (a * (1 - fx) * (1 - fy) + b * fx * (1 - fy) + d * (1 - fx) * fy + e * fx * fy), 4) AS bilinear, round(v - (left_ + (right_ - left_) * fx), 4) AS row_line, round(v - (top_ + (bottom_ - top_) * fy), 4) AS column_line, round(v - coalesce(before, top_), 4) AS progressive FROM s")
def p17_all(spark, d):
    """Residuals from five surfaces of a tile: through three corners, four, the ends of rows, of columns, and the sample before."""
    t = plane(spark, d, "evt1", "part1").withColumns({"ty": F.expr("y div 8"), "tx": F.expr("cast(x div 8 as int)")})
    up, down = c("y") * 1000 + c("x"), c("y") * 1000 - c("x")
    k = t.groupBy("img", "ty", "tx").agg(F.min_by("v", up).alias("a"), F.min_by("v", down).alias("b"), F.max_by("v", down).alias("d"), F.max_by("v", up).alias("e"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    j = t.join(k, ["img", "ty", "tx"])
    part = lambda at, lo, hi: F.when(c(hi) > c(lo), (c(at) - c(lo)) / (c(hi) - c(lo))).otherwise(0.0)
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row, column = Window.partitionBy("img", "ty", "tx", "y").orderBy("x"), Window.partitionBy("img", "ty", "tx", "x").orderBy("y")
    j = j.withColumns({"fx": part("x", "x0", "x1"), "fy": part("y", "y0", "y1"), "left_": F.first("v").over(whole(row)), "right_": F.last("v").over(whole(row)), "before": F.lag("v").over(row)})
    j = j.withColumns({"top_": F.first("v").over(whole(column)), "bottom_": F.last("v").over(whole(column))})
    a, b, e, g, fx, fy, v = c("a"), c("b"), c("d"), c("e"), c("fx"), c("fy"), c("v")
    made = {
        "affine": a + (b - a) * fx + (e - a) * fy,
        "bilinear": a * (1 - fx) * (1 - fy) + b * fx * (1 - fy) + e * (1 - fx) * fy + g * fx * fy,
        "row_line": c("left_") + (c("right_") - c("left_")) * fx,
        "column_line": c("top_") + (c("bottom_") - c("top_")) * fy,
        "progressive": F.coalesce("before", "top_"),
    }
    return j.select("img", "y", "x", *[F.round(v - p, 4).alias(n) for n, p in made.items()])


_HITS = ", ".join(f"count(*) FILTER (((o >> bit) & 1) = ((({e}) >> bit) & 1)) AS {k}" for k, e in (("northwest", "nw"), ("northeast", "ne"), ("average", "(w + n) // 2"), ("med", "CASE WHEN nw >= greatest(w, n) THEN least(w, n) WHEN nw <= least(w, n) THEN greatest(w, n) ELSE least(greatest(w + n - nw, 0), 4294967295) END")))


@query("p22_more_bit_predictors", f"WITH {grid_sql(*TWO)}, {WORDS}, {NEIGHBOURS} SELECT img, bit, count(*) AS n, {_HITS} FROM nb, (SELECT CAST(unnest(range(32)) AS INTEGER) AS bit) GROUP BY ALL")
def p22_more(spark, d):
    """How often each bit equals that of the northwest, the northeast, the average and the MED prediction."""
    n = near(spark, d)
    guesses = {"northwest": c("nw"), "northeast": c("ne"), "average": F.expr("(w + n) div 2"), "med": P.prediction("med")}
    wrong = n.select("img", *[c("o").bitwiseXOR(g).alias(k) for k, g in guesses.items()])
    each = [F.sum(F.shiftright(k, b).bitwiseAND(B.long(1))).alias(f"{k}_{b}") for k in guesses for b in range(32)]
    wide = wrong.groupBy("img").agg(F.count(F.lit(1)).alias("n"), *each)
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), *[(c("n") - c(f"{k}_{b}")).alias(k) for k in guesses]) for b in range(32)])).alias("s")
    return wide.select("img", "n", rows).select("img", "n", "s.*")


_TAIL_GUESS = {"zero": "0", "west": "w % 32768", "north": "n % 32768", "average": "((w + n) // 2) % 32768", "xor": "xor(xor(w, n), nw) % 32768", "med": "(CASE WHEN nw >= greatest(w, n) THEN least(w, n) WHEN nw <= least(w, n) THEN greatest(w, n) ELSE least(greatest(w + n - nw, 0), 4294967295) END) % 32768"}


@query("p19_tail_predictors", f"WITH {grid_sql(*TWO)}, {WORDS}, {NEIGHBOURS}, r AS (" + " UNION ALL ".join(f"SELECT img, '{k}' AS predictor, (o % 32768 - {g} + 32768) % 32768 AS r FROM nb" for k, g in _TAIL_GUESS.items()) + ") SELECT img, predictor, count(*) AS n, count(*) FILTER (r = 0) AS hits, sum(least(r, 32768 - r))::BIGINT AS distance FROM r GROUP BY ALL")
def p19_all(spark, d):
    """Low 15 bits predicted in six ways from what is visible: hits and modular distance."""
    n = near(spark, d)
    low = lambda v: v % 32768
    guesses = {"zero": B.long(0), "west": low(c("w")), "north": low(c("n")), "average": low(F.expr("(w + n) div 2")), "xor": low(P.prediction("xor_planar")), "med": low(P.prediction("med"))}
    each = F.array(*[F.struct(F.lit(k).alias("predictor"), F.pmod(low(c("o")) - g, B.long(32768)).alias("r")) for k, g in guesses.items()])
    r = n.select("img", F.explode(each).alias("s")).select("img", "s.*")
    return r.groupBy("img", "predictor").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("r") == 0).alias("hits"), F.sum(F.least(c("r"), 32768 - c("r"))).alias("distance"))


# --- quantisers that are applied

_SUMS = ", ".join(f"sum((b >> {k}) & 1) AS s{k}" for k in range(23))
_TAILS = "CASE WHEN n < 64 THEN 0 " + " ".join(f"WHEN abs(2 * s{k} - n) > n // 10 THEN {k}" for k in range(23)) + " ELSE 23 END"


def _tile_sql(cap: int) -> str:
    return f"WITH {grid_sql(*TWO)}, {WORDS}, t AS (SELECT *, y // 16 AS ty, x // 16 AS tx FROM go), u AS (SELECT img, ty, tx, count(*) AS n, {_SUMS} FROM t GROUP BY ALL), k AS (SELECT img, ty, tx, least({cap}, {_TAILS}) AS tail FROM u), top AS (SELECT img, max((b >> 23) & 255) AS most FROM t WHERE ((b >> 23) & 255) <> 255 GROUP BY img)"


@query("q02_tile_mantissas", f"{_tile_sql(12)} SELECT t.img, t.y, t.x, t.c, b - b % CAST(pow(2, tail) AS BIGINT) AS q FROM t JOIN k ON t.img = k.img AND t.ty = k.ty AND t.tx = k.tx")
def q02_tile(spark, d):
    """Q2: low mantissa bits that look random in a tile, 12 at most, are cleared."""
    t = P.with_words(G.grids(spark, d, *TWO)).withColumns({"ty": F.expr("y div 16"), "tx": F.expr("cast(x div 16 as int)")})
    k = Q.random_tail(t, ["img", "ty", "tx"], 23).withColumn("tail", F.least("tail", F.lit(12)))
    return t.join(k, ["img", "ty", "tx"]).select(*KEYS, B.clear_low(c("b"), c("tail")).alias("q"))


@query("q04_tile_and_exponent", f"{_tile_sql(23)}, a AS (SELECT t.*, tail, least(23, 8 + CAST(floor(greatest(most - ((b >> 23) & 255), 0) / 2) AS BIGINT)) AS adaptive FROM t JOIN k ON t.img = k.img AND t.ty = k.ty AND t.tx = k.tx JOIN top ON top.img = t.img) SELECT img, y, x, c, b - b % CAST(pow(2, least(tail, adaptive)) AS BIGINT) AS q FROM a")
def q04(spark, d):
    """Q4: the lesser of the tile's random tail and what the exponent allows is cleared."""
    t = P.with_words(G.grids(spark, d, *TWO)).withColumns({"ty": F.expr("y div 16"), "tx": F.expr("cast(x div 16 as int)")})
    most = t.filter(B.is_finite(c("b"))).groupBy("img").agg(F.max(B.exponent_of(c("b"))).alias("most"))
    j = t.join(Q.random_tail(t, ["img", "ty", "tx"], 23), ["img", "ty", "tx"]).join(most, "img")
    return j.select(*KEYS, B.clear_low(c("b"), F.least("tail", B.adaptive_clear(c("b"), 8, c("most")))).alias("q"))


@query("q12_clipped_reconstruct", f"{_EVT}, r AS (SELECT img, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM p GROUP BY img), q AS (SELECT p.*, lo, hi, v < lo OR v > hi AS escaped, CAST(least(greatest(floor((v - lo) / (hi - lo) * 63 + 0.5), 0), 63) AS BIGINT) AS q FROM p JOIN r ON p.img = r.img) SELECT img, y, x, escaped, round(CASE WHEN escaped THEN v ELSE lo + q * (hi - lo) / 63 END, 5) AS rec FROM q")
def q12(spark, d):
    """Q12: six bits inside the middle 98 %, samples outside kept as they are."""
    p = plane(spark, d, "evt1", "part1")
    r = D.quantiles(p, ["img"], {"v": [0.01, 0.99]}).select("img", c("v")[0].alias("lo"), c("v")[1].alias("hi"))
    j = p.join(r, "img").withColumn("escaped", (c("v") < c("lo")) | (c("v") > c("hi")))
    rec = Q.value_of(Q.index_of(c("v"), c("lo"), c("hi"), 6), c("lo"), c("hi"), 6)
    return j.select("img", "y", "x", "escaped", F.round(F.when(c("escaped"), c("v")).otherwise(rec), 5).alias("rec"))


_BAYER = (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)
_ZED = f"{_EVT}, r AS (SELECT img, min(v) AS lo, max(v) AS hi FROM p GROUP BY img), z AS (SELECT p.img, y, x, (v - lo) / (hi - lo) * 31 AS z FROM p JOIN r ON p.img = r.img)"


def scaled(spark, d):
    p = plane(spark, d, "evt1", "part1")
    r = p.groupBy("img").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return p.join(r, "img").select("img", "y", "x", ((c("v") - c("lo")) / (c("hi") - c("lo")) * 31).alias("z"))


@query("q13_ordered_dither", f"{_ZED} SELECT img, y, x, CAST(least(floor(z + ([{', '.join(str(k) for k in _BAYER)}][CAST((y % 4) * 4 + x % 4 + 1 AS INTEGER)] + 0.5) / 16), 31) AS BIGINT) AS q FROM z")
def q13_ordered(spark, d):
    """Q13: five-bit indices with a 4 x 4 ordered dither."""
    step = F.element_at(F.array(*[F.lit(k) for k in _BAYER]), ((c("y") % 4) * 4 + c("x") % 4 + 1).cast("int"))
    return scaled(spark, d).select("img", "y", "x", F.least(F.floor(c("z") + (step + 0.5) / 16), F.lit(31)).cast("long").alias("q"))


@query("q13_block_dither", f"{_ZED}, f AS (SELECT *, floor(z) AS f, round(z - floor(z), 9) AS e, floor(z) < 31 AS open, y // 4 AS ty, x // 4 AS tx FROM z), k AS (SELECT *, row_number() OVER (PARTITION BY img, ty, tx, open ORDER BY e DESC, y, x) AS place, round_even(round(sum(e) OVER (PARTITION BY img, ty, tx), 6), 0) AS ups FROM f) SELECT img, y, x, CAST(f + CASE WHEN open AND place <= ups THEN 1 ELSE 0 END AS BIGINT) AS q FROM k")
def q13_block(spark, d):
    """Q13: in each block of 4 x 4 as many indices go up as their fractions sum to, the greatest fractions first."""
    f = scaled(spark, d).withColumns({"f": F.floor("z"), "e": F.round(c("z") - F.floor("z"), 9), "ty": F.expr("y div 4"), "tx": F.expr("cast(x div 4 as int)")}).withColumn("open", c("f") < 31)
    block = Window.partitionBy("img", "ty", "tx")
    place = F.row_number().over(Window.partitionBy("img", "ty", "tx", "open").orderBy(F.desc("e"), "y", "x"))
    k = f.withColumns({"ups": F.rint(F.round(F.sum("e").over(block), 6)), "place": place})
    return k.select("img", "y", "x", (c("f") + F.when(c("open") & (c("place") <= c("ups")), 1).otherwise(0)).cast("long").alias("q"))


@query("q14_nudged_centres", f"WITH {grid_sql('ord3')}, r AS (SELECT c, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM g GROUP BY c), q AS (SELECT g.img, g.y, g.x, g.c, lo, hi, (hi - lo) / 31 AS step, CAST(least(greatest(floor((CAST(v AS DOUBLE) - lo) / (hi - lo) * 31 + 0.5), 0), 31) AS BIGINT) AS q FROM g JOIN r ON g.c = r.c), k AS (SELECT *, lo + q * step AS m FROM q), a AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY c, y ORDER BY x), m) AS w, coalesce(lag(m) OVER (PARTITION BY c, x ORDER BY y), m) AS n FROM k) SELECT img, y, x, c, round(m * 0.5 + least(greatest((w + n) / 2, CASE WHEN q = 0 THEN lo ELSE m - step / 2 END), CASE WHEN q = 31 THEN hi ELSE m + step / 2 END) * 0.5, 6) AS rec FROM a")
def q14_nudged(spark, d):
    """Q14: bin centres moved half way towards the mean of the neighbours' centres, inside their bins: no sample waits for another."""
    g = G.grid(spark, d, "ord3").withColumn("v", c("v").cast("double"))
    t = g.join(g.groupBy("img", "c").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), ["img", "c"])
    t = t.withColumns({"q": Q.index_of(c("v"), c("lo"), c("hi"), 5), "step": (c("hi") - c("lo")) / 31}).withColumn("m", c("lo") + c("q") * c("step"))
    row, column = Window.partitionBy("img", "c", "y").orderBy("x"), Window.partitionBy("img", "c", "x").orderBy("y")
    guess = (F.coalesce(F.lag("m").over(row), c("m")) + F.coalesce(F.lag("m").over(column), c("m"))) / 2
    low, high = F.when(c("q") == 0, c("lo")).otherwise(c("m") - c("step") / 2), F.when(c("q") == 31, c("hi")).otherwise(c("m") + c("step") / 2)
    return t.withColumn("guess", guess).select(*KEYS, F.round(c("m") * 0.5 + F.least(F.greatest("guess", low), high) * 0.5, 6).alias("rec"))


_POWERS = (0.6, 0.75, 0.9)


@query("q15_channel_powers", f"WITH {grid_sql('ord3')}, t AS (SELECT *, pow(CAST(v AS DOUBLE), [0.6, 0.75, 0.9][CAST(c + 1 AS INTEGER)]::DOUBLE) AS t FROM g), r AS (SELECT c, min(t) AS lo, max(t) AS hi FROM t GROUP BY c), q AS (SELECT t.img, t.y, t.x, t.c, lo, hi, CAST(floor((t - lo) / (hi - lo) * 127 + 0.5) AS BIGINT) AS q FROM t JOIN r ON t.c = r.c) SELECT img, y, x, c, q, round(pow(lo + q * (hi - lo) / 127, 1 / [0.6, 0.75, 0.9][CAST(c + 1 AS INTEGER)]::DOUBLE), 5) AS rec FROM q")
def q15(spark, d):
    """Q15: seven-bit indices of powers, each channel with an exponent of its own."""
    power = F.element_at(F.array(*[F.lit(x) for x in _POWERS]), c("c") + 1)
    t = G.grid(spark, d, "ord3").withColumn("t", F.pow(c("v").cast("double"), power))
    t = t.join(t.groupBy("img", "c").agg(F.min("t").alias("lo"), F.max("t").alias("hi")), ["img", "c"]).withColumn("q", Q.index_of(c("t"), c("lo"), c("hi"), 7))
    return t.select(*KEYS, "q", F.round(F.pow(Q.value_of(c("q"), c("lo"), c("hi"), 7), 1 / power), 5).alias("rec"))


@query("q18_fixed_point_pmf", f"WITH {grid_sql('evt1')}, {WORDS}, n AS (SELECT (b >> 20) AS s, count(*) AS n FROM go GROUP BY ALL), f AS (SELECT s, n, greatest(1, CAST(floor(n * 16384.0 / sum(n) OVER ()) AS BIGINT)) AS f FROM n) SELECT s, CAST(f + CASE WHEN row_number() OVER (ORDER BY n DESC, s) = 1 THEN 16384 - sum(f) OVER () ELSE 0 END AS BIGINT) AS f FROM f")
def q18(spark, d):
    """Probabilities as 14-bit integers: rounded down, 1 at least, the most probable takes the rest."""
    n = E.histogram(P.with_words(G.grid(spark, d, "evt1")).select(F.shiftright("b", 20).alias("s")), [], "s")
    total = n.agg(F.sum("n").alias("t"))
    f = n.join(F.broadcast(total)).withColumn("f", F.greatest(F.lit(1), F.floor(c("n") * 16384.0 / c("t"))))  # one row
    rest = f.agg((16384 - F.sum("f")).alias("rest"), F.min_by("s", F.struct(-c("n"), c("s"))).alias("first"))
    return f.join(F.broadcast(rest)).select("s", (c("f") + F.when(c("s") == c("first"), c("rest")).otherwise(0)).cast("long").alias("f"))  # one row


def _lloyd_sql(steps: int, k: int) -> str:
    ctes = [f"{_EVT}, c0 AS (SELECT img, unnest(range({k})) AS q, unnest(quantile_cont(v, [{', '.join(str((i + 0.5) / k) for i in range(k))}])) AS centre FROM p GROUP BY img)"]
    for i in range(steps):
        ctes.append(f"b{i} AS (SELECT img, list(centre ORDER BY q) AS cs FROM c{i} GROUP BY img), l{i} AS (SELECT p.img, len(list_filter(range(1, {k}), lambda j: (cs[j] + cs[j + 1]) / 2 < v)) AS q, v FROM p JOIN b{i} ON p.img = b{i}.img), m{i} AS (SELECT img, q, avg(v) AS m FROM l{i} GROUP BY ALL), c{i + 1} AS (SELECT c.img, c.q, max(coalesce(m.m, c.centre)) OVER (PARTITION BY c.img ORDER BY c.q) AS centre FROM c{i} c LEFT JOIN m{i} m ON m.img = c.img AND m.q = c.q)")
    return ", ".join(ctes)


@query("a47_lloyd_codebook", f"{_lloyd_sql(3, 8)} SELECT img, CAST(q AS INTEGER) AS q, round(centre, 5) AS centre FROM c3")
def a47(spark, d):
    """Eight centres from quantiles, then three Lloyd steps (means of codes; an empty code keeps its centre; running maximum)."""
    p, k = plane(spark, d, "evt1", "part1"), 8
    cs = D.quantiles(p, ["img"], {"v": [(i + 0.5) / k for i in range(k)]}).withColumnRenamed("v", "cs")
    for _ in range(3):
        code = F.size(F.filter(F.sequence(F.lit(1), F.lit(k - 1)), lambda j: (F.element_at("cs", j) + F.element_at("cs", j + 1)) / 2 < c("v")))
        means = p.join(cs, "img").groupBy("img", "cs").agg(*[F.avg(F.when(code == i, c("v"))).alias(f"m{i}") for i in range(k)])  # one wide aggregate for each step
        fresh = F.array(*[F.coalesce(f"m{i}", c("cs")[i]) for i in range(k)])
        running = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.array_max(F.slice(fresh, F.lit(1), j)))
        cs = means.select("img", running.alias("cs"))
    return cs.select("img", F.posexplode("cs").alias("q", "centre")).withColumn("centre", F.round("centre", 5))


@query("f20_aces_decode", f"WITH {grid_sql('ord3')}, e AS (SELECT img, y, x, c, CAST(v AS DOUBLE) / 4 AS a, v FROM g), t AS (SELECT *, CASE WHEN a >= 0.0078125 THEN (log2(a) + 9.72) / 17.52 ELSE 10.5402377416545 * a + 0.0729055341958355 END AS t FROM e) SELECT img, y, x, c, round(t, 6) AS t, round(CASE WHEN t > 0.155251141552511 THEN pow(2, t * 17.52 - 9.72) ELSE (t - 0.0729055341958355) / 10.5402377416545 END * 4, 5) AS back FROM t")
def f20(spark, d):
    """the ACEScct curve and its inverse."""
    t = G.grid(spark, d, "ord3").withColumn("t", T.acescct(c("v"), 4.0))
    return t.select(*KEYS, F.round("t", 6).alias("t"), F.round(T.acescct_inverse(c("t"), 4.0), 5).alias("back"))


# --- statistics and costs

_RATES = ", ".join(f"round(avg(CASE WHEN b % {1 << k} = 0 THEN 1.0 ELSE 0 END), 6) AS low{k}" for k in range(1, 17))


@query("a30_low_zero_rates", f"WITH {grid_sql('ord3', 'evt1', 'part1')}, {WORDS} SELECT img, {_RATES}, CAST(CASE WHEN bit_or(b) = 0 THEN 32 ELSE round(log2(bit_or(b) & -bit_or(b))) END AS BIGINT) AS common FROM go GROUP BY img")
def a30(spark, d):
    """How often the low 1 to 16 bits are zero, and how many low bits are zero in all words."""
    w = P.with_words(G.grids(spark, d, "ord3", "evt1", "part1"))
    rates = [F.round(F.avg((c("b") % (1 << k) == 0).cast("double")), 6).alias(f"low{k}") for k in range(1, 17)]
    return w.groupBy("img").agg(*rates, F.bit_or("b").alias("o")).withColumn("common", B.trailing_zeros(c("o"), 32).cast("long")).drop("o")


_D3 = "(lgamma(n + 1.5) - lgamma(CAST(1.5 AS DOUBLE)) - lgamma(zero + 0.5) - lgamma(one + 0.5) - lgamma(n - zero - one + 0.5) + 3 * lgamma(CAST(0.5 AS DOUBLE))) / ln(2)"
_BM = f"WITH {grid_sql(*TWO)}, {WORDS}, sd AS (SELECT img, max(x) + 1 AS wd, max(c) + 1 AS ch FROM go GROUP BY img), i AS (SELECT go.img, b, ((y * wd + x) * ch + c) // 8 AS k FROM go JOIN sd ON sd.img = go.img), u AS (SELECT img, k, bit, count(*) AS m, sum((b >> bit) & 1) AS s FROM i, (SELECT CAST(unnest(range(15)) AS INTEGER) AS bit) GROUP BY ALL), z AS (SELECT img, bit, count(*) AS n, count(*) FILTER (s > 0) AS ones, count(*) FILTER (s = 0) AS zero, count(*) FILTER (s = m) AS one FROM u GROUP BY ALL)"


@query("a34_bit_matrix_costs", f"{_BM} SELECT img, round(sum({KT} + ones * 8), 3) AS zero_words, round(sum({_D3} + (n - zero - one) * 8), 3) AS constant_words, CAST(sum(n + ones * 8) AS BIGINT) AS fixed_mask FROM z GROUP BY img")
def a34(spark, d):
    """Words of eight samples of each of 15 planes: an adaptive mask of zero words, one of zero, one and mixed words, a fixed mask."""
    w = P.with_words(G.grids(spark, d, *TWO)).select("img", "y", "x", "c", "b")
    sides = w.groupBy("img").agg((F.max("x") + 1).alias("wd"), (F.max("c") + 1).alias("ch"))
    i = w.join(sides, "img").select("img", "b", F.expr("((y * wd + x) * ch + c) div 8").alias("k"))
    sums = [F.sum(B.bit(c("b"), k)).alias(f"s{k}") for k in range(15)]
    u = i.groupBy("img", "k").agg(F.count(F.lit(1)).alias("m"), *sums)
    made = []
    for k in range(15):
        made += [F.count_if(c(f"s{k}") > 0).alias(f"o{k}"), F.count_if(c(f"s{k}") == 0).alias(f"z{k}"), F.count_if(c(f"s{k}") == c("m")).alias(f"e{k}")]
    z = u.groupBy("img").agg(F.count(F.lit(1)).alias("n"), *made)
    rows = z.select("img", "n", F.explode(F.array(*[F.struct(c(f"o{k}").alias("ones"), c(f"z{k}").alias("zero"), c(f"e{k}").alias("one")) for k in range(15)])).alias("s")).select("img", "n", "s.*")
    half, whole = float(np.log2(np.pi) / 2), float(np.log2(np.sqrt(np.pi) / 2))
    mixed = c("n") - c("zero") - c("one")
    three = E.log_gamma(c("n") + 1.5) - whole - E.log_gamma(c("zero") + 0.5) - E.log_gamma(c("one") + 0.5) - E.log_gamma(mixed + 0.5) + 3 * half
    return rows.groupBy("img").agg(F.round(F.sum(_cost() + c("ones") * 8), 3).alias("zero_words"), F.round(F.sum(three + mixed * 8), 3).alias("constant_words"), F.sum(c("n") + c("ones") * 8).alias("fixed_mask"))


@query("a36_context_escape", f"WITH {grid_sql(*TWO)}, {WORDS}, n AS (SELECT img, c AS ctx, (b >> 16) AS s, count(*) AS n FROM go GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY img, ctx ORDER BY n DESC, s) AS k, sum(n) OVER (PARTITION BY img, ctx) AS t FROM n), e AS (SELECT img, ctx, CASE WHEN k <= 16 THEN s ELSE -1 END AS s, sum(n) AS n, max(t) AS t FROM k GROUP BY ALL) SELECT img, coalesce(sum(n) FILTER (s = -1), 0)::BIGINT AS escaped, round({_ENT} + 16 * coalesce(sum(n) FILTER (s = -1), 0) + 32 * count(*) FILTER (s >= 0), 3) AS bits FROM e GROUP BY img")
def a36(spark, d):
    """A table of the 16 most frequent symbols for each channel, the others escaped in 16 bits."""
    n = E.histogram(P.with_words(G.grids(spark, d, *TWO)).select("img", c("c").alias("ctx"), F.shiftright("b", 16).alias("s")), ["img", "ctx"], "s")
    key = Window.partitionBy("img", "ctx")
    k = n.withColumns({"k": F.row_number().over(key.orderBy(F.desc("n"), "s")), "t": F.sum("n").over(key)})
    e = k.groupBy("img", "ctx", F.when(c("k") <= 16, c("s")).otherwise(B.long(-1)).alias("s")).agg(F.sum("n").alias("n"), F.max("t").alias("t"))
    escaped = F.coalesce(F.sum(F.when(c("s") == -1, c("n"))), B.long(0))
    return e.groupBy("img").agg(escaped.alias("escaped"), F.round(F.sum(c("n") * F.log2(c("t") / c("n"))) + 16 * escaped + 32 * F.count_if(c("s") >= 0), 3).alias("bits"))


_STATIC = f"WITH {grid_sql('ord3', 'emb4')}, {WORDS}, s AS (SELECT img, c, y % 2 AS parity, (b >> 18) & 31 AS s FROM go)"
_VARIANTS = {"shared": "0", "channel": "c", "parity": "parity", "channel_parity": "c * 2 + parity", "high": "c * 100"}


@query("a35_static_tables", f"{_STATIC}, e AS (" + " UNION ALL ".join(f"SELECT img, '{k}' AS variant, {x} AS ctx, s FROM s" for k, x in _VARIANTS.items()) + f"), k AS (SELECT img, variant, ctx, s, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY img, variant, ctx) AS t FROM k), q AS (SELECT *, greatest(1, CAST(floor(n * 4096.0 / t + 0.5) AS BIGINT)) AS f FROM t) SELECT img, variant, count(*) AS entries, round(sum(n * log2(4096.0 / f)) + 12 * count(*), 3) AS bits FROM q GROUP BY ALL")
def a35(spark, d):
    """Transmitted 12-bit tables under five splits of the samples: their cross entropy and their own bits."""
    s = P.with_words(G.grids(spark, d, "ord3", "emb4")).select("img", "c", (c("y") % 2).alias("parity"), F.shiftright("b", 18).bitwiseAND(B.long(31)).alias("s"))
    made = [F.lit(0), c("c"), c("parity"), c("c") * 2 + c("parity"), c("c") * 100]
    e = families(s, ["img", "s"], dict(zip(_VARIANTS, made, strict=True)), "variant")
    k = E.histogram(e, ["img", "variant", "ctx"], "s").withColumn("t", F.sum("n").over(Window.partitionBy("img", "variant", "ctx")))
    f = F.greatest(F.lit(1), F.floor(c("n") * 4096.0 / c("t") + 0.5))
    return k.groupBy("img", "variant").agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum(c("n") * F.log2(4096.0 / f)) + 12 * F.count(F.lit(1)), 3).alias("bits"))


_CASCADE = f"WITH {grid_sql(*TWO)}, {WORDS}, s AS (SELECT img, bit, (b % 32768) >> CAST(bit + 1 AS INTEGER) AS above, (b >> bit) & 1 AS one FROM go, (SELECT CAST(unnest(range(15)) AS INTEGER) AS bit))"


@query("a37_prefix_cascade", f"{_CASCADE}, k AS (SELECT img, bit, above = 0 AS zero, count(*) AS n, sum(one) AS ones FROM s GROUP BY ALL) SELECT img, count(*) AS contexts, round(sum({KT}), 3) AS bits FROM k GROUP BY img")
def a37(spark, d):
    """Tail bits from the top, each told apart by whether all bits above it are zero."""
    w = P.with_words(G.grids(spark, d, *TWO)).select("img", c("b").bitwiseAND(B.long(32767)).alias("t"))
    made = []
    for k in range(15):
        zero = F.shiftright("t", k + 1) == 0
        made += [F.count_if(zero).alias(f"nz{k}"), F.sum(F.when(zero, B.bit(c("t"), k)).otherwise(0)).alias(f"oz{k}"), F.count_if(~zero).alias(f"nn{k}"), F.sum(F.when(~zero, B.bit(c("t"), k)).otherwise(0)).alias(f"on{k}")]
    rows = F.explode(F.array(*[F.struct(c(f"n{q}{k}").alias("n"), c(f"o{q}{k}").alias("ones")) for k in range(15) for q in "zn"])).alias("s")
    r = w.groupBy("img").agg(*made).select("img", rows).select("img", "s.*").filter("n > 0")
    return r.groupBy("img").agg(F.count(F.lit(1)).alias("contexts"), F.round(F.sum(_cost()), 3).alias("bits"))


_FIELDS = "CASE WHEN bit = 31 THEN 'sign' WHEN bit >= 23 THEN 'exponent' WHEN bit >= 15 THEN 'mantissa_hi' WHEN bit >= 8 THEN 'mantissa_mid' ELSE 'mantissa_lo' END"


@query("a44_tile_best", f"WITH {grid_sql(*TWO)}, {WORDS}, {NEIGHBOURS}, e AS (SELECT img, y // 64 AS ty, 'raw' AS mode, o AS r FROM nb UNION ALL SELECT img, y // 64, 'west', xor(o, w) FROM nb UNION ALL SELECT img, y // 64, 'north', xor(o, n) FROM nb), s AS (SELECT img, ty, mode, bit, count(*) AS n, sum((r >> bit) & 1) AS k FROM e, (SELECT CAST(unnest(range(32)) AS INTEGER) AS bit) GROUP BY ALL), f AS (SELECT img, ty, {_FIELDS} AS field, mode, round(sum(CASE WHEN k > 0 AND k < n THEN k * log2(n / k) + (n - k) * log2(n / (n - k)) ELSE 0 END), 4) AS bits FROM s GROUP BY ALL), m AS (SELECT img, ty, field, min(bits) AS bits FROM f GROUP BY ALL) SELECT img, field, count(*) AS tiles, round(sum(bits) + 2 * count(*), 3) AS bits FROM m GROUP BY ALL")
def a44_tile(spark, d):
    """The best predictor of each field in every band, with two bits to name it."""
    n = near(spark, d).withColumn("ty", F.expr("y div 64"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), v.alias("r")) for m, v in (("raw", c("o")), ("west", c("o").bitwiseXOR(c("w"))), ("north", c("o").bitwiseXOR(c("n"))))])).alias("s")
    p = E.plane_counts(n.select("img", "ty", each).select("img", "ty", "s.*"), ["img", "ty", "mode"], "r", range(32)).withColumn("field", F.expr(_FIELDS))
    f = p.groupBy("img", "ty", "field", "mode").agg(F.round(F.sum(E.binary_entropy(c("n"), c("ones"))), 4).alias("bits"))
    m = f.groupBy("img", "ty", "field").agg(F.min("bits").alias("bits"))
    return m.groupBy("img", "field").agg(F.count(F.lit(1)).alias("tiles"), F.round(F.sum("bits") + 2 * F.count(F.lit(1)), 3).alias("bits"))


# --- pyramids and their inverse

_ALL = f"WITH {grid_sql('evt1', 'part1')}, {WORDS} SELECT img, count(*) AS n, sum(o)::BIGINT AS total, sum(o * ((y * 31 + x) % 97))::BIGINT AS mixed FROM go GROUP BY img"


def _same(df):
    return df.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("total"), F.sum(c("o") * ((c("y") * 31 + c("x")) % 97)).alias("mixed"))


@query("t02_pyramid_round_trip", _ALL)
def t02(spark, d):
    """Three levels of an integer pyramid (averages modulo 2^32) and back; odd edges travel along."""
    return _same(Y.inverse(Y.forward(P.with_words(G.grids(spark, d, "evt1", "part1")), 32, 3, "average"), 32, "average"))


@query("t03_lorenzo_round_trip", _ALL)
def t03(spark, d):
    """A Lorenzo pyramid (the diagonal predicted from both edges) and back."""
    return _same(Y.inverse(Y.forward(P.with_words(G.grids(spark, d, "evt1", "part1")), 32, 3, "lorenzo"), 32, "lorenzo"))


@query("t05_tail_wavelet", f"WITH {grid_sql('evt1', 'part1')}, {WORDS} SELECT img, count(*) AS n, sum(o % 32768)::BIGINT AS total, sum((o % 32768) * ((y * 31 + x) % 97))::BIGINT AS mixed FROM go GROUP BY img")
def t05(spark, d):
    """T5: the pyramid of the low 15 bits, and back."""
    tails = P.with_words(G.grids(spark, d, "evt1", "part1")).withColumn("o", c("o") % 32768)
    return _same(Y.inverse(Y.forward(tails, 15, 2, "anchor"), 15, "anchor"))


_QUAD = "q AS (SELECT img, y // 2 AS y, x // 2 AS x, max(o) FILTER (y % 2 = 0 AND x % 2 = 0) AS a, max(o) FILTER (y % 2 = 0 AND x % 2 = 1) AS b, max(o) FILTER (y % 2 = 1 AND x % 2 = 0) AS c, max(o) FILTER (y % 2 = 1 AND x % 2 = 1) AS d FROM go GROUP BY ALL HAVING count(*) = 4)"


@query("t03_lorenzo_bands", f"WITH {grid_sql('evt1', 'part1')}, {WORDS}, {_QUAD}, s AS (SELECT img, b - a AS h, c - a AS v, d - (b + c - a) AS dd FROM q) SELECT img, unnest(['h', 'v', 'd']) AS band, unnest([sum(((h % 4294967296) + 4294967296) % 4294967296), sum(((v % 4294967296) + 4294967296) % 4294967296), sum(((dd % 4294967296) + 4294967296) % 4294967296)])::BIGINT AS total FROM s GROUP BY img")
def t03_bands(spark, d):
    """The detail bands of the first level, as differences modulo 2^32."""
    f = Y.forward(P.with_words(G.grids(spark, d, "evt1", "part1")), 32, 1, "lorenzo").filter("band in ('h', 'v', 'd')")
    return f.groupBy("img", "band").agg(F.sum("o").alias("total"))


@query("t04_hierarchy_round_trip", f"{_EVT} SELECT img, count(*) AS n, round(sum(v), 3) AS total FROM p GROUP BY img")
def t04(spark, d):
    """T4: samples decoded pass by pass from the residuals to their first known neighbour."""
    back = Y.hierarchy_decoded(Y.hierarchy_residuals(plane(spark, d, "evt1", "part1")))
    return back.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"))


# --- routing

_PXS = "px AS (SELECT img, y, x, CAST(max(v) FILTER (c = 0) AS DOUBLE) AS r, CAST(max(v) FILTER (c = 1) AS DOUBLE) AS g, CAST(max(v) FILTER (c = 2) AS DOUBLE) AS b FROM g GROUP BY ALL HAVING count(*) = 3)"
_CUT = lambda k: f"(floor({k} * 16) / 16)"
_LUM = lambda r, g, b: f"(0.2126 * {r} + 0.7152 * {g} + 0.0722 * {b})"
_DARK = f"""WITH {grid_sql('ord3')}, {_PXS}, l AS (SELECT *, {_LUM('r', 'g', 'b')} AS lo, {_LUM(_CUT('r'), _CUT('g'), _CUT('b'))} AS ld, log2(1 + g) AS t FROM px),
k AS (SELECT *, pow(least(greatest(lo * 0.125 / 4, 0), 1), 1 / 2.2) < 0.06 AS dark, abs(pow(least(greatest(ld * 1.0 / 4, 0), 1), 1 / 2.2) - pow(least(greatest(lo * 1.0 / 4, 0), 1), 1 / 2.2)) >= 0.012 AS shows FROM l),
e AS (SELECT min(t) AS lo_t, max(t) AS hi_t FROM k WHERE dark AND shows)"""


@query("m17_dark_refine_levels", f"{_DARK} SELECT img, y, x, dark, dark AND shows AS refined, round(CASE WHEN dark AND shows THEN CASE WHEN hi_t > lo_t THEN pow(2, lo_t + floor((t - lo_t) / (hi_t - lo_t) * 511 + 0.5) * (hi_t - lo_t) / 511) - 1 ELSE pow(2, lo_t) - 1 END ELSE {_CUT('g')} END, 5) AS green FROM k, e")
def m17(spark, d):
    """Pixels below a displayed luma of 0.06 whose error shows three stops up get a nine-bit signed-log green (image three stops down)."""
    px = G.pixels(G.grid(spark, d, "ord3"))
    cut = {k: F.floor(c(k).cast("double") * 16) / 16 for k in "rgb"}
    lo, ld = T.luma(c("r"), c("g"), c("b")), T.luma(cut["r"], cut["g"], cut["b"])
    k = px.select("img", "y", "x", cut["g"].alias("cut"), T.forward(c("g"), "signed_log").alias("t"), (T.display(lo, -3.0) < 0.06).alias("dark"), (F.abs(T.display(ld) - T.display(lo)) >= 0.012).alias("shows"))
    k = k.withColumn("refined", c("dark") & c("shows"))
    ends = k.groupBy("img").agg(F.min(F.when(c("refined"), c("t"))).alias("lo"), F.max(F.when(c("refined"), c("t"))).alias("hi"))
    j = k.join(ends, "img")
    fine = T.inverse(Q.value_of(Q.index_of(c("t"), c("lo"), c("hi"), 9), c("lo"), c("hi"), 9), "signed_log")
    return j.select("img", "y", "x", "dark", "refined", F.round(F.when(c("refined"), fine).otherwise(c("cut")), 5).alias("green"))


# --- relational

@query("j01_estimates_with_baseline", "WITH e AS (SELECT o_orderpriority AS image, avg(o_totalprice) AS estimate FROM orders GROUP BY ALL), b AS (SELECT o_orderpriority AS image, min(o_totalprice) AS baseline FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT e.image, round(estimate, 3) AS estimate, baseline, round(least(estimate, baseline), 3) AS hybrid FROM e JOIN b ON e.image = b.image")
def j01(spark, d):
    """Estimates joined to the baseline by image; the hybrid takes the lesser."""
    o = G.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "image")
    e, b = o.groupBy("image").agg(F.avg("o_totalprice").alias("estimate")), o.filter("o_orderstatus = 'F'").groupBy("image").agg(F.min("o_totalprice").alias("baseline"))
    return e.join(b, "image").select("image", F.round("estimate", 3).alias("estimate"), "baseline", F.round(F.least("estimate", "baseline"), 3).alias("hybrid"))


_FIELD_BITS = f"WITH {grid_sql(*TWO)}, {WORDS}, {NEIGHBOURS}, e AS (SELECT img, 'raw' AS mode, o AS r FROM nb UNION ALL SELECT img, 'west', xor(o, w) FROM nb), s AS (SELECT img, mode, bit, count(*) AS n, sum((r >> bit) & 1) AS k FROM e, (SELECT CAST(unnest(range(32)) AS INTEGER) AS bit) GROUP BY ALL), f AS (SELECT img, mode, {_FIELDS} AS field, sum(CASE WHEN k > 0 AND k < n THEN k * log2(n / k) + (n - k) * log2(n / (n - k)) ELSE 0 END) AS bits FROM s GROUP BY ALL)"


@query("j03_replaced_fields", f"{_FIELD_BITS}, t AS (SELECT img, sum(bits) AS total FROM f WHERE mode = 'west' GROUP BY img) SELECT a.img, a.field, round(t.total, 2) AS total, round(t.total - w.bits + a.bits, 2) AS replaced, a.bits < w.bits AS better FROM f a JOIN f w ON a.img = w.img AND a.field = w.field AND w.mode = 'west' JOIN t ON t.img = a.img WHERE a.mode = 'raw'")
def j03(spark, d):
    """Results of each field joined to the total, with the field's part replaced by another method's."""
    n = near(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), v.alias("r")) for m, v in (("raw", c("o")), ("west", c("o").bitwiseXOR(c("w"))))])).alias("s")
    p = E.plane_counts(n.select("img", each).select("img", "s.*"), ["img", "mode"], "r", range(32)).withColumn("field", F.expr(_FIELDS))
    f = p.groupBy("img", "field").pivot("mode", ["raw", "west"]).agg(F.sum(E.binary_entropy(c("n"), c("ones"))))
    t = f.groupBy("img").agg(F.sum("west").alias("total"))
    return f.join(t, "img").select("img", "field", F.round("total", 2).alias("total"), F.round(c("total") - c("west") + c("raw"), 2).alias("replaced"), (c("raw") < c("west")).alias("better"))


@query("j08_directory_splits", f"WITH {grid_sql(*TWO)}, {WORDS}, s AS (SELECT CASE WHEN img = 'ord3' THEN 'train' ELSE 'test' END AS part, img, (y // 32 + x // 32) % 4 = 0 AS held FROM go) SELECT part, img, count(*) FILTER (NOT held) AS fitted, count(*) FILTER (held) AS held FROM s GROUP BY ALL")
def j08(spark, d):
    """Images split by directory, and their crops into fitted and held-out ones."""
    s = G.grids(spark, d, *TWO).select(F.when(c("img") == "ord3", "train").otherwise("test").alias("part"), "img", ((F.expr("y div 32") + F.expr("x div 32")) % 4 == 0).alias("held"))
    return s.groupBy("part", "img").agg(F.count_if(~c("held")).alias("fitted"), F.count_if("held").alias("held"))


@query("j17_stratified", "WITH k AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 2654435761) % 4294967296, event_id) AS place FROM events) SELECT event_type, event_id FROM k WHERE place <= 20")
def j17(spark, d):
    """A seeded sample of 20 rows of each stratum (the operator samples)."""
    order = F.struct(((c("event_id") * B.long(2654435761)) % B.long(1 << 32)).alias("h"), c("event_id"))
    kept = F.row_number().over(Window.partitionBy("event_type").orderBy(order)) <= 20
    return G.table(spark, d, "events").select("event_type", "event_id", kept.alias("kept")).filter("kept").drop("kept")


@query("s08_parsed_fields", "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, sum(length(props))::BIGINT AS chars FROM events GROUP BY ALL")
def s08(spark, d):
    """A field of JSON documents, parsed, beside their counts."""
    e = G.table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"), F.length("props").alias("chars"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


@query("s10_globbed_names", "SELECT n_name AS name FROM nation WHERE (n_name GLOB 'NATION_?' OR n_name GLOB '*1?') AND NOT n_name GLOB '*_1*' GROUP BY ALL")
def s10(spark, d):
    """Names that match one of several patterns with * and ?, without those of an exclusion, each once."""
    n = G.table(spark, d, "nation").select(c("n_name").alias("name"))
    either = n.filter(F.expr(" or ".join(f"name rlike '{glob(p)}'" for p in ("NATION_?", "*1?")))).distinct()
    return either.filter(~F.expr(f"name rlike '{glob('*_1*')}'"))


def glob(pattern: str) -> str:
    """A regular expression for a pattern of literal characters, * and ?."""
    return "^" + "".join({"*": ".*", "?": "."}.get(x, x if x.isalnum() else "[" + x + "]") for x in pattern) + "$"


@query("n01_generators", "WITH p AS (SELECT y, x FROM (SELECT unnest(range(64)) AS y), (SELECT unnest(range(128)) AS x)) SELECT CAST(y AS BIGINT) AS y, CAST(x AS INTEGER) AS x, round(x / 127.0, 6) AS gradient, round(0.5 * x / 127.0 + 0.5 * y / 63.0, 6) AS mixed, round(CASE WHEN (x - 96) * (x - 96) + (y - 16) * (y - 16) <= 36 THEN 1000.0 ELSE 0.2 + 0.8 * y / 63.0 END, 6) AS sun FROM p")
def n01(spark, d):
    """Generated images: a gradient, a mixture of two, and a bright disc on a sky."""
    p = spark.range(64 * 128).select(F.expr("id div 128").alias("y"), F.expr("cast(id % 128 as int)").alias("x"))
    x, y = c("x"), c("y")
    sun = F.when((x - 96) * (x - 96) + (y - 16) * (y - 16) <= 36, 1000.0).otherwise(0.2 + 0.8 * y / 63.0)
    return p.select("y", "x", F.round(x / 127.0, 6).alias("gradient"), F.round(0.5 * x / 127.0 + 0.5 * y / 63.0, 6).alias("mixed"), F.round(sun, 6).alias("sun"))


_SPECIAL = {"infinity": 0x7F800000, "minus_infinity": 0xFF800000, "nan": 0x7FC00000, "minus_zero": 0x80000000, "least": 1, "most": 0x7F7FFFFF}


@query("n02_special_words", "SELECT name, b AS back, CASE WHEN b >= 2147483648 THEN 4294967295 - b ELSE b + 2147483648 END AS o FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in _SPECIAL.items()) + ") t(name, b)")
def n02(spark, d):
    """Infinities, NaN, minus zero and the least numbers through floats, ordered words and back."""
    w = spark.createDataFrame(list(_SPECIAL.items()), "name string, b long").withColumn("v", B.bits_float(c("b")))
    o = B.ordered(B.float_bits(c("v")))
    return w.select("name", B.unordered(o).alias("back"), o.alias("o"))


@query("l02_window_cross_entropy", "WITH b AS (SELECT doc_id, i AS pos, CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) AS byte FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(octet_length(encode(text)))) AS i FROM documents)), n AS (SELECT byte, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT byte, n / sum(n) OVER () AS p FROM n), w AS (SELECT b.doc_id, pos // 1024 AS win, count(*) AS bytes, avg(-log2(p)) AS bpb FROM b JOIN p USING (byte) GROUP BY ALL) SELECT doc_id, win, bytes, round(bpb, 5) AS bpb, round(8 / bpb, 5) AS ratio FROM w")
def l02(spark, d):
    """L2: bits a byte of windows of 1,024 bytes under the corpus's byte shares, and the ratio that they bound."""
    docs = G.table(spark, d, "documents").select("doc_id", "text")
    counts = E.byte_pair_counts(docs, "text").groupBy("byte").agg(F.sum("n").alias("n")).collect()  # 256 rows at most
    total = sum(r["n"] for r in counts)
    bits = np.zeros(256)
    for r in counts:
        bits[r["byte"]] = -np.log2(r["n"] / total)

    def run(batches):
        for frame in batches:
            for k, t in zip(frame["doc_id"], frame["text"], strict=True):
                cost = bits[np.frombuffer((t or "").encode(), np.uint8)]
                if len(cost):
                    starts = np.arange(0, len(cost), 1024)
                    n = np.minimum(len(cost) - starts, 1024)
                    bpb = np.add.reduceat(cost, starts) / n
                    yield pd.DataFrame({"doc_id": k, "win": np.arange(len(starts)), "bytes": n, "bpb": bpb.round(5), "ratio": (8 / bpb).round(5)})

    return docs.mapInPandas(run, "doc_id long, win long, bytes long, bpb double, ratio double")

"""Further queries: masked and hierarchical predictors, small context models, routes by cost, splits and codecs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import tone as T
from ..operators import entropy as E
from ..operators import predict as P
from ..operators import quality as Y
from ..operators import quantize as Q
from ..operators import routes as O
from ..operators import stencil as W
from ..operators import streams as S
from ..sources import grids as G
from .imaging import plane, results
from .registry import KT, NEIGHBOURS, WORDS, grid_sql, query

c = F.col
KEYS = G.KEYS
TWO = ("ord3", "evt1")
_V = "p AS (SELECT img, y, x, CAST(v AS DOUBLE) AS v FROM g)"
_EVT = f"WITH {grid_sql('evt1', 'part1')}, {_V}"
_ENT = "sum(n * log2(t / n))"

_BF = f"WITH {grid_sql(*TWO)}, {WORDS}, gh AS (SELECT img, y, x, c, y // 16 AS ty, x // 16 AS tx, CASE WHEN (b >> 16) >= 32768 THEN 65535 - (b >> 16) ELSE (b >> 16) + 32768 END AS o FROM go), h1 AS (SELECT *, lag(o, 1, 0) OVER (PARTITION BY img, c, y, ty, tx ORDER BY x) AS w FROM gh), h2 AS (SELECT *, lag(o, 1, 0) OVER k AS n, lag(w, 1, 0) OVER k AS nw FROM h1 WINDOW k AS (PARTITION BY img, c, x, ty, tx ORDER BY y))"


@query("p10_tile_local_16bit", f"{_BF}, r AS (SELECT img, (o - w + 65536) % 65536 AS rw, (o - n + 65536) % 65536 AS rn, (o - CASE WHEN nw >= greatest(w, n) THEN least(w, n) WHEN nw <= least(w, n) THEN greatest(w, n) ELSE least(greatest(w + n - nw, 0), 65535) END + 65536) % 65536 AS rm FROM h2) SELECT img, sum(rw)::BIGINT AS west, sum(rn)::BIGINT AS north, sum(rm)::BIGINT AS med, count(*) AS n FROM r GROUP BY img")
def p10(spark, d):
    """P10: residuals of ordered 16-bit words inside tiles of 16."""
    w = P.with_words(G.grids(spark, d, *TWO)).select(*KEYS, F.expr("y div 16").alias("ty"), F.expr("cast(x div 16 as int)").alias("tx"), B.ordered16(F.shiftright("b", 16)).alias("o"))
    n = P.with_neighbours(w, "o", ("ty", "tx"))
    r = lambda p: F.sum(F.pmod(c("o") - p, B.long(65536)))
    return n.groupBy("img").agg(r(c("w")).alias("west"), r(c("n")).alias("north"), r(P.med(c("w"), c("n"), c("nw"), 65535)).alias("med"), F.count(F.lit(1)).alias("n"))


_MM = f"{_EVT}, m AS (SELECT img, y, x, 0 AS c, CASE WHEN v > 100 THEN CAST(floor(v) AS BIGINT) END AS o FROM p), a AS (SELECT *, lag(o) OVER (PARTITION BY img, y ORDER BY x) AS w FROM m), b AS (SELECT *, lag(o) OVER k AS n, lag(w) OVER k AS nw FROM a WINDOW k AS (PARTITION BY img, x ORDER BY y)), f AS (SELECT *, coalesce(w, 0) AS fw, coalesce(n, w, 0) AS fn, coalesce(nw, w, 0) AS fnw FROM b WHERE o IS NOT NULL)"


@query("p12_masked_med", f"{_MM} SELECT img, y, x, CASE WHEN fnw >= greatest(fw, fn) THEN least(fw, fn) WHEN fnw <= least(fw, fn) THEN greatest(fw, fn) ELSE fw + fn - fnw END AS predicted FROM f")
def p12(spark, d):
    """MED from selected neighbours only; a missing north or northwest becomes west."""
    m = plane(spark, d, "evt1", "part1").select("img", "y", "x", F.lit(0).alias("c"), F.when(c("v") > 100, F.floor("v")).alias("o"))
    row, col = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    n = m.withColumn("w", F.lag("o").over(row)).withColumns({"n": F.lag("o").over(col)}).withColumn("nw", F.lag("w").over(col)).filter("o is not null")
    z = B.long(0)
    w, north, nw = F.coalesce("w", z), F.coalesce("n", "w", z), F.coalesce("nw", "w", z)
    high, low = F.greatest(w, north), F.least(w, north)
    return n.select("img", "y", "x", F.when(nw >= high, low).when(nw <= low, high).otherwise(w + north - nw).alias("predicted"))


@query("p17_corner_surface", f"{_EVT}, t AS (SELECT *, y // 8 AS ty, x // 8 AS tx FROM p), k AS (SELECT img, ty, tx, arg_min(v, y * 1000 + x) AS a, arg_min(v, y * 1000 - x) AS b, arg_max(v, y * 1000 - x) AS d, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM t GROUP BY ALL) SELECT t.img, t.y, t.x, round(t.v - (a + CASE WHEN x1 > x0 THEN (b - a) * (t.x - x0) / (x1 - x0) ELSE 0 END + CASE WHEN y1 > y0 THEN (d - a) * (t.y - y0) / (y1 - y0) ELSE 0 END), 5) AS residual FROM t JOIN k ON t.img = k.img AND t.ty = k.ty AND t.tx = k.tx")
def p17(spark, d):
    """Residual from the plane through three corners of each tile."""
    t = plane(spark, d, "evt1", "part1").withColumns({"ty": F.expr("y div 8"), "tx": F.expr("cast(x div 8 as int)")})
    k = t.groupBy("img", "ty", "tx").agg(F.min_by("v", c("y") * 1000 + c("x")).alias("a"), F.min_by("v", c("y") * 1000 - c("x")).alias("b"), F.max_by("v", c("y") * 1000 - c("x")).alias("d"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    j = t.join(k, ["img", "ty", "tx"])
    part = lambda e, at, lo, hi: F.when(c(hi) > c(lo), (c(e) - c("a")) * (c(at) - c(lo)) / (c(hi) - c(lo))).otherwise(0.0)
    return j.select("img", "y", "x", F.round(c("v") - (c("a") + part("b", "x", "x0", "x1") + part("d", "y", "y0", "y1")), 5).alias("residual"))


@query("p18_hierarchy_nearest", f"{_EVT}, q AS (SELECT *, CASE WHEN y % 4 = 0 AND x % 4 = 0 THEN 0 WHEN y % 2 = 0 AND x % 2 = 0 THEN 1 ELSE 2 END AS pass FROM p), j AS (SELECT a.img, a.y, a.x, a.v, a.pass, b.v AS u, row_number() OVER (PARTITION BY a.img, a.y, a.x ORDER BY o.ord) AS k FROM q a JOIN (VALUES (0, 0, -1), (1, -1, 0), (2, 0, 1), (3, 1, 0), (4, -1, -1), (5, -1, 1), (6, 1, -1), (7, 1, 1)) o(ord, dy, dx) ON true JOIN q b ON b.img = a.img AND b.y = a.y + o.dy AND b.x = a.x + o.dx AND b.pass < a.pass) SELECT q.img, q.y, q.x, q.pass, round(q.v - coalesce(j.u, 0), 5) AS residual FROM q LEFT JOIN j ON j.img = q.img AND j.y = q.y AND j.x = q.x AND j.k = 1")
def p18(spark, d):
    """Residual from the first of eight neighbours that an earlier pass has decoded."""
    y, x = c("y"), c("x")
    q = plane(spark, d, "evt1", "part1").withColumn("pass", F.when((y % 4 == 0) & (x % 4 == 0), 0).when((y % 2 == 0) & (x % 2 == 0), 1).otherwise(2))
    known = F.struct("pass", "v")
    row, col = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    q = q.withColumn("_s", known).withColumns({"_w": F.lag("_s").over(row), "_e": F.lead("_s").over(row)})
    q = q.withColumns({"_n": F.lag("_s").over(col), "_so": F.lead("_s").over(col), "_nw": F.lag("_w").over(col), "_ne": F.lag("_e").over(col), "_sw": F.lead("_w").over(col), "_se": F.lead("_e").over(col)})
    picks = [F.when(c(k)["pass"] < c("pass"), c(k)["v"]) for k in ("_w", "_n", "_e", "_so", "_nw", "_ne", "_sw", "_se")]
    return q.select("img", "y", "x", "pass", F.round(c("v") - F.coalesce(*picks, F.lit(0.0)), 5).alias("residual"))


_HITS = ", ".join(f"count(*) FILTER (((o >> bit) & 1) = {e}) AS {k}" for k, e in (("zero", "0"), ("west", "((w >> bit) & 1)"), ("north", "((n >> bit) & 1)"), ("planar", "(xor(xor(w, n), nw) >> bit) & 1"), ("majority", "((((w & n) | (w & nw) | (n & nw)) >> bit) & 1)")))


@query("p22_bit_predictors", f"WITH {grid_sql(*TWO)}, {WORDS}, {NEIGHBOURS} SELECT img, bit, count(*) AS n, {_HITS} FROM nb, (SELECT CAST(unnest(range(32)) AS INTEGER) AS bit) GROUP BY ALL")
def p22(spark, d):
    """How often each bit equals what five bit predictors say."""
    n = P.with_neighbours(P.with_words(G.grids(spark, d, *TWO)))
    guesses = {"zero": B.long(0), "west": c("w"), "north": c("n"), "planar": P.prediction("xor_planar"), "majority": P.prediction("xor_majority")}
    wrong = n.select("img", *[c("o").bitwiseXOR(g).alias(k) for k, g in guesses.items()])
    total = F.count(F.lit(1)).alias("n")
    each = [F.sum(F.shiftright(k, b).bitwiseAND(B.long(1))).alias(f"{k}_{b}") for k in guesses for b in range(32)]
    wide = wrong.groupBy("img").agg(total, *each)
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), *[(c("n") - c(f"{k}_{b}")).alias(k) for k in guesses]) for b in range(32)])).alias("s")
    return wide.select("img", "n", rows).select("img", "n", "s.*")


@query("q17_float_prefix", f"WITH {grid_sql('ord3')}, {WORDS} SELECT img, y, x, c, (b >> 15) AS prefix, b - b % 32768 + 16384 AS middle FROM go")
def q17(spark, d):
    """Words cut to eight mantissa bits, and rebuilt at the middle of the step."""
    w = P.with_words(G.grid(spark, d, "ord3"))
    return w.select(*KEYS, F.shiftright("b", 15).alias("prefix"), (B.clear_low(c("b"), 15) + 16384).alias("middle"))


_MC = f"{_EVT}, m AS (SELECT img, y, x, CAST(v > 100 AS INTEGER) AS m FROM p), a AS (SELECT *, lag(m, 1, 0) OVER (PARTITION BY img, y ORDER BY x) AS w FROM m), b AS (SELECT *, lag(m, 1, 0) OVER k AS n, lag(w, 1, 0) OVER k AS nw FROM a WINDOW k AS (PARTITION BY img, x ORDER BY y)), e AS (SELECT img, 'order0' AS family, 0 AS ctx, m FROM b UNION ALL SELECT img, 'wn', w + 2 * n, m FROM b UNION ALL SELECT img, 'wn_nw', w + 2 * n + 4 * nw, m FROM b UNION ALL SELECT img, 'wn_parity', w + 2 * n + 4 * (x % 2) + 8 * (y % 2), m FROM b), s AS (SELECT img, family, ctx, count(*) AS n, sum(m) AS ones FROM e GROUP BY ALL)"


@query("c18_mask_contexts", f"{_MC} SELECT img, family, count(*) AS contexts, round(sum({KT}), 4) AS bits FROM s GROUP BY ALL")
def c18(spark, d):
    """Adaptive bits of a mask under four context families."""
    m = plane(spark, d, "evt1", "part1").select("img", "y", "x", F.lit(0).alias("c"), (c("v") > 100).cast("long").alias("m"))
    n = P.with_neighbours(m, "m")
    wn = c("w") + 2 * c("n")
    each = {"order0": F.lit(0), "wn": wn, "wn_nw": wn + 4 * c("nw"), "wn_parity": wn + 4 * (c("x") % 2) + 8 * (c("y") % 2)}
    e = n.select("img", "m", F.explode(F.array(*[F.struct(F.lit(k).alias("family"), v.cast("long").alias("ctx")) for k, v in each.items()])).alias("s")).select("img", "m", "s.*")
    counts = e.groupBy("img", "family", "ctx").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("ones"))
    return counts.groupBy("img", "family").agg(F.count(F.lit(1)).alias("contexts"), F.round(F.sum(E.kt_bits(c("n") - c("ones"), c("ones"))), 4).alias("bits"))


_IX = f"WITH {grid_sql('ord3')}, go AS (SELECT img, y, x, c, CAST(floor(v * CAST(25.4 AS FLOAT)) AS BIGINT) AS o FROM g), {NEIGHBOURS}, r AS (SELECT img, y, x, c, CASE WHEN s < -7 THEN 15 WHEN s > 7 THEN 16 ELSE s + 7 END AS o FROM (SELECT *, o - (w + n) // 2 AS s FROM nb))"
_IXN = NEIGHBOURS.replace("FROM go", "FROM r").replace("nr AS", "mr AS").replace("FROM nr", "FROM mr").replace("nb AS", "mb AS")


@query("c20_index_contexts", f"{_IX}, {_IXN}, e AS (SELECT 'order0' AS family, 0 AS ctx, o FROM mb UNION ALL SELECT 'phase_channel', (y % 2) * 6 + (x % 2) * 3 + c, o FROM mb UNION ALL SELECT 'west', w, o FROM mb UNION ALL SELECT 'north', n, o FROM mb UNION ALL SELECT 'wn', w * 17 + n, o FROM mb), k AS (SELECT family, ctx, o, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY family, ctx) AS t FROM k) SELECT family, count(DISTINCT ctx) AS contexts, sum(n)::BIGINT AS total, round({_ENT}, 3) AS bits FROM t GROUP BY family")
def c20(spark, d):
    """Conditional entropy of residual categories under five contexts."""
    q = P.with_neighbours(G.grid(spark, d, "ord3").select(*KEYS, F.floor(c("v") * F.lit(25.4).cast("float")).cast("long").alias("o")))
    s = c("o") - F.expr("(w + n) div 2")
    r = q.select(*KEYS, F.when(s < -7, 15).when(s > 7, 16).otherwise(s + 7).cast("long").alias("o"))
    n = P.with_neighbours(r)
    each = {"order0": F.lit(0), "phase_channel": (c("y") % 2) * 6 + (c("x") % 2) * 3 + c("c"), "west": c("w"), "north": c("n"), "wn": c("w") * 17 + c("n")}
    e = n.select("o", F.explode(F.array(*[F.struct(F.lit(k).alias("family"), v.cast("long").alias("ctx")) for k, v in each.items()])).alias("s")).select("o", "s.*")
    return E.conditional_entropy_bits(e, ["family"], "ctx", "o").withColumn("bits", F.round("bits", 3))


_TAIL = f"WITH {grid_sql(*TWO)}, {WORDS}, t AS (SELECT img, y // 64 AS ty, b % 32768 AS t FROM go)"


@query("a15_tail_routes", f"{_TAIL}, z AS (SELECT img, ty, count(*) AS n, count(*) FILTER (t <> 0) AS ones FROM t GROUP BY ALL), s AS (SELECT img, ty, bit, count(*) AS n, sum((t >> bit) & 1) AS ones FROM t, (SELECT CAST(unnest(range(15)) AS INTEGER) AS bit) WHERE t <> 0 GROUP BY ALL), k AS (SELECT img, ty, sum({KT}) AS bits FROM s GROUP BY ALL) SELECT z.img, z.ty, z.ones AS nonzero, round({KT.replace('ones', 'z.ones').replace('(n', '(z.n').replace('- n', '- z.n')} + coalesce(k.bits, 0), 3) AS masked, 15 * z.n AS raw FROM z LEFT JOIN k ON k.img = z.img AND k.ty = z.ty")
def a15(spark, d):
    """Low 15 bits as a zero mask and the planes of what is not zero, against sending them raw."""
    t = P.with_words(G.grids(spark, d, *TWO)).select("img", F.expr("y div 64").alias("ty"), c("b").bitwiseAND(B.long(32767)).alias("t"))
    z = t.groupBy("img", "ty").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("t") != 0).alias("nonzero"))
    p = E.plane_counts(t.filter("t <> 0"), ["img", "ty"], "t", range(15)).groupBy("img", "ty").agg(F.sum(E.kt_bits(c("n") - c("ones"), c("ones"))).alias("bits"))
    return z.join(p, ["img", "ty"], "left").select("img", "ty", "nonzero", F.round(E.kt_bits(c("n") - c("nonzero"), c("nonzero")) + F.coalesce("bits", F.lit(0.0)), 3).alias("masked"), (15 * c("n")).alias("raw"))


_CS = f"WITH {grid_sql('ord3', 'emb4')}, {WORDS}, s AS (SELECT img, c, (b >> 16) & 127 AS s FROM go), a AS (SELECT img, s, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT img, c, s, count(*) AS n FROM s GROUP BY ALL), pa AS (SELECT img, sum(n * log2(t / n)) + 16 * count(*) AS cost FROM (SELECT *, sum(n) OVER (PARTITION BY img) AS t FROM a) GROUP BY img), pb AS (SELECT img, sum(n * log2(t / n)) + 16 * count(*) AS cost FROM (SELECT *, sum(n) OVER (PARTITION BY img, c) AS t FROM b) GROUP BY img)"


@query("a21_channel_split", f"{_CS} SELECT pa.img, round(pa.cost, 3) AS shared, round(pb.cost, 3) AS split, pb.cost < pa.cost AS splits FROM pa JOIN pb ON pa.img = pb.img")
def a21(spark, d):
    """One table for all channels or one for each, with 16 bits for each entry."""
    s = P.with_words(G.grids(spark, d, "ord3", "emb4")).select("img", "c", F.shiftright("b", 16).bitwiseAND(B.long(127)).alias("s"))
    return O.shared_or_split(s, "img", "c", "s", 16)


@query("a34_word_groups", f"{_TAIL}, i AS (SELECT img, b % 65536 AS h, (y * 100 + x) // 8 AS k FROM go), w AS (SELECT img, k, count(*) AS n, max(h) AS top, min(h) AS low FROM i GROUP BY ALL) SELECT img, count(*) AS groups, count(*) FILTER (top = 0) AS zero, count(*) FILTER (top = low) AS constant FROM w GROUP BY img")
def a34(spark, d):
    """Groups of eight whose low half words are all zero, or all equal."""
    i = P.with_words(G.grids(spark, d, *TWO)).select("img", c("b").bitwiseAND(B.long(65535)).alias("h"), F.expr("(y * 100 + x) div 8").alias("k"))
    w = i.groupBy("img", "k").agg(F.max("h").alias("top"), F.min("h").alias("low"))
    return w.groupBy("img").agg(F.count(F.lit(1)).alias("groups"), F.count_if(c("top") == 0).alias("zero"), F.count_if(c("top") == c("low")).alias("constant"))


@query("a36_top_k_escape", f"WITH {grid_sql(*TWO)}, {WORDS}, n AS (SELECT img, (b >> 16) AS s, count(*) AS n FROM go GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, s) AS k, sum(n) OVER (PARTITION BY img) AS t FROM n), e AS (SELECT img, CASE WHEN k <= 64 THEN s ELSE -1 END AS s, sum(n) AS n, max(t) AS t FROM k GROUP BY ALL) SELECT img, coalesce(max(n) FILTER (s = -1), 0)::BIGINT AS escaped, round({_ENT} + 16 * coalesce(max(n) FILTER (s = -1), 0) + 32 * count(*) FILTER (s >= 0), 3) AS bits FROM e GROUP BY img")
def a36(spark, d):
    """A table of the 64 most frequent symbols, the others escaped in 16 bits."""
    s = P.with_words(G.grids(spark, d, *TWO)).select("img", F.shiftright("b", 16).alias("s"))
    return O.top_k_escape(s, "img", "s", 64, 16, 32)


_FIELDS = "CASE WHEN bit = 31 THEN 'sign' WHEN bit >= 23 THEN 'exponent' WHEN bit >= 15 THEN 'mantissa_hi' WHEN bit >= 8 THEN 'mantissa_mid' ELSE 'mantissa_lo' END"


@query("a44_field_predictors", f"WITH {grid_sql(*TWO)}, {WORDS}, {NEIGHBOURS}, e AS (SELECT img, 'raw' AS mode, 0 AS ord, o AS r FROM nb UNION ALL SELECT img, 'west', 1, xor(o, w) FROM nb UNION ALL SELECT img, 'north', 2, xor(o, n) FROM nb), s AS (SELECT img, mode, ord, bit, count(*) AS n, sum((r >> bit) & 1) AS k FROM e, (SELECT CAST(unnest(range(32)) AS INTEGER) AS bit) GROUP BY ALL), f AS (SELECT img, {_FIELDS} AS field, mode, ord, round(sum(CASE WHEN k > 0 AND k < n THEN k * log2(n / k) + (n - k) * log2(n / (n - k)) ELSE 0 END), 4) AS bits FROM s GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY img, field ORDER BY bits, ord) AS rank FROM f) SELECT img, field, mode, round(bits, 3) AS bits FROM w WHERE rank = 1")
def a44(spark, d):
    """The predictor with the least bit entropy for each field of the word."""
    n = P.with_neighbours(P.with_words(G.grids(spark, d, *TWO)))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(i).alias("ord"), v.alias("r")) for i, (m, v) in enumerate((("raw", c("o")), ("west", c("o").bitwiseXOR(c("w"))), ("north", c("o").bitwiseXOR(c("n")))))])).alias("s")
    p = E.plane_counts(n.select("img", each).select("img", "s.*"), ["img", "mode", "ord"], "r", range(32)).withColumn("field", F.expr(_FIELDS))
    f = p.groupBy("img", "field", "mode", "ord").agg(F.round(F.sum(E.binary_entropy(c("n"), c("ones"))), 4).alias("bits"))
    return f.groupBy("img", "field").agg(F.min(F.struct("bits", "ord", "mode")).alias("m")).select("img", "field", "m.mode", F.round("m.bits", 3).alias("bits"))


@query("a50_learned_prior", f"WITH {grid_sql('evt1')}, {WORDS}, s AS (SELECT y % 2 AS half, bit, count(*) AS n, sum((b >> bit) & 1) AS k FROM go, (SELECT CAST(unnest(range(31)) AS INTEGER) AS bit) GROUP BY ALL), j AS (SELECT a.bit, (a.k + 0.5) / (a.n + 1) AS p, t.n, t.k FROM s a JOIN s t ON a.bit = t.bit AND a.half = 0 AND t.half = 1) SELECT bit, round(-(k * log2(p) + (n - k) * log2(1 - p)), 4) AS bits FROM j")
def a50(spark, d):
    """Bit probabilities learnt on even rows, their cost on odd rows."""
    w = P.with_words(G.grid(spark, d, "evt1")).withColumn("half", c("y") % 2)
    p = E.plane_counts(w, ["half"], "b", range(31))
    train = p.filter("half = 0").select("bit", ((c("ones") + 0.5) / (c("n") + 1)).alias("p"))
    j = p.filter("half = 1").join(F.broadcast(train), "bit")  # 31 rows
    return j.select("bit", F.round(-(c("ones") * F.log2("p") + (c("n") - c("ones")) * F.log2(1 - c("p"))), 4).alias("bits"))


@query("w13_cumulative_model", f"WITH {grid_sql('evt1')}, {WORDS}, n AS (SELECT (b >> 24) & 255 AS s, count(*) AS f FROM go GROUP BY ALL) SELECT s, f, (sum(f) OVER (ORDER BY s) - f)::BIGINT AS cum FROM n")
def w13(spark, d):
    """Cumulative frequencies of a byte alphabet."""
    n = E.histogram(P.with_words(G.grid(spark, d, "evt1")).select(B.byte(c("b"), 3).alias("s")), [], "s")
    run = F.sum("n").over(Window.partitionBy().orderBy("s").rowsBetween(Window.unboundedPreceding, 0))  # 256 rows at most
    return n.select("s", c("n").alias("f"), (run - c("n")).alias("cum"))


@query("q10_signed_log", f"WITH {grid_sql('emb4', 'ord3')}, t AS (SELECT *, sign(v) * log2(1 + abs(CAST(v AS DOUBLE))) AS t FROM g), r AS (SELECT *, min(t) OVER w AS lo, max(t) OVER w AS hi FROM t WINDOW w AS (PARTITION BY img, c)), q AS (SELECT *, CAST(least(greatest(floor((t - lo) / (hi - lo) * 1023 + 0.5), 0), 1023) AS BIGINT) AS q FROM r), b AS (SELECT *, lo + q * (hi - lo) / 1023 AS w FROM q) SELECT img, y, x, c, q, round(sign(w) * (pow(2, abs(w)) - 1), 5) AS rec FROM b")
def q10(spark, d):
    """Q10, Q6: 10-bit signed-log anchors."""
    t = G.grids(spark, d, "emb4", "ord3").withColumn("t", T.forward(c("v"), "signed_log"))
    t = t.join(t.groupBy("img", "c").agg(F.min("t").alias("lo"), F.max("t").alias("hi")), ["img", "c"]).withColumn("q", Q.index_of(c("t"), c("lo"), c("hi"), 10))
    return t.select(*KEYS, "q", F.round(T.inverse(Q.value_of(c("q"), c("lo"), c("hi"), 10), "signed_log"), 5).alias("rec"))


_YC = f"WITH {grid_sql('ord3')}, px AS (SELECT img, y, x, CAST(max(v) FILTER (c = 0) AS DOUBLE) AS r, CAST(max(v) FILTER (c = 1) AS DOUBLE) AS g, CAST(max(v) FILTER (c = 2) AS DOUBLE) AS b FROM g GROUP BY ALL HAVING count(*) = 3), p AS (SELECT *, (r + 2 * g + b) / 4 AS l, r - b AS co, g - (r + b) / 2 AS cg FROM px), s AS (SELECT min(l) AS l0, max(l) AS l1, min(co) AS o0, max(co) AS o1, min(cg) AS g0, max(cg) AS g1 FROM p)"
_IDX = lambda e, lo, hi, n: f"CAST(least(greatest(floor(({e} - {lo}) / ({hi} - {lo}) * {n} + 0.5), 0), {n}) AS BIGINT)"


@query("q16_asymmetric_color", f"{_YC} SELECT img, y, x, {_IDX('l', 'l0', 'l1', 255)} AS ql, {_IDX('co', 'o0', 'o1', 31)} AS qo, {_IDX('cg', 'g0', 'g1', 31)} AS qg FROM p, s")
def q16(spark, d):
    """Q16: eight bits of luma, five of each chroma plane."""
    r, g, b = (c(k).cast("double") for k in "rgb")
    y, co, cg = T.ycocg(r, g, b)
    p = G.pixels(G.grid(spark, d, "ord3")).select("img", "y", "x", y.alias("l"), co.alias("o"), cg.alias("g"))
    ends = [f(k).alias(f"{n}_{k}") for k in ("l", "o", "g") for n, f in (("lo", F.min), ("hi", F.max))]
    p = p.join(p.groupBy("img").agg(*ends), "img")
    q = lambda k, bits: Q.index_of(c(k), c(f"lo_{k}"), c(f"hi_{k}"), bits).alias(f"q{k}")
    return p.select("img", "y", "x", q("l", 8), q("o", 5), q("g", 5))


@query("m17_dark_refine", f"{_YC}, d AS (SELECT img, y, x, 0.2126 * r + 0.7152 * g + 0.0722 * b AS a, 0.2126 * floor(r * 16) / 16 + 0.7152 * floor(g * 16) / 16 + 0.0722 * floor(b * 16) / 16 AS e FROM px), f AS (SELECT img, y, x, pow(least(greatest(a / 4, 0), 1), 1 / 2.2) AS sa, pow(least(greatest(a * 8 / 4, 0), 1), 1 / 2.2) AS la, pow(least(greatest(e * 8 / 4, 0), 1), 1 / 2.2) AS le FROM d) SELECT img, count(*) AS n, count(*) FILTER (sa < 0.3) AS dark, count(*) FILTER (sa < 0.3 AND abs(la - le) >= 0.012) AS refined FROM f GROUP BY img")
def m17(spark, d):
    """Dark pixels whose error shows three stops up."""
    px = G.pixels(G.grid(spark, d, "ord3"))
    cut = lambda k: F.floor(c(k).cast("double") * 16) / 16
    a, e = T.luma(c("r"), c("g"), c("b")), T.luma(cut("r"), cut("g"), cut("b"))
    f = px.select("img", (T.display(a) < 0.3).alias("dark"), (F.abs(T.display(a, 3.0) - T.display(e, 3.0)) >= 0.012).alias("shows"))
    return f.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.count_if("dark").alias("dark"), F.count_if(c("dark") & c("shows")).alias("refined"))


@query("m18_constant_channels", f"WITH {grid_sql('ord3', 'emb4', 'part1')} SELECT img, c, min(v) = max(v) AS constant FROM g GROUP BY ALL")
def m18(spark, d):
    return G.grids(spark, d, "ord3", "emb4", "part1").groupBy("img", "c").agg((F.min("v") == F.max("v")).alias("constant"))


_ST = f"WITH {grid_sql(*TWO)}, {WORDS}, s AS (SELECT img, plane, (b >> CAST(8 * plane AS INTEGER)) & 255 AS byte, lag((b >> CAST(8 * plane AS INTEGER)) & 255, 1, 0) OVER (PARTITION BY img, plane ORDER BY y, x, c) AS ctx FROM go, (SELECT unnest([0, 1, 2, 3]) AS plane)), n0 AS (SELECT img, plane, byte, count(*) AS n FROM s GROUP BY ALL), n1 AS (SELECT img, plane, ctx, byte, count(*) AS n FROM s GROUP BY ALL), e AS (SELECT img, plane, 'raw' AS method, 0 AS ord, sum(n)::DOUBLE AS size FROM n0 GROUP BY ALL UNION ALL SELECT img, plane, 'order0', 1, ceil(round({_ENT} / 8, 6)) + 512 FROM (SELECT *, sum(n) OVER (PARTITION BY img, plane) AS t FROM n0) GROUP BY ALL UNION ALL SELECT img, plane, 'order1', 2, ceil(round({_ENT} / 8, 6)) + 3 * count(*) FROM (SELECT *, sum(n) OVER (PARTITION BY img, plane, ctx) AS t FROM n1) GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY img, plane ORDER BY size, ord) AS k FROM e)"


@query("e12_stream_methods", f"{_ST} SELECT img, plane, method, CAST(size AS BIGINT) AS size FROM w WHERE k = 1")
def e12(spark, d):
    """The smallest of raw, order-0 and order-1 for each stream, with their tables."""
    from .coding import byte_planes

    # the byte before: in the row, or the last one of the row before, from a table of a row for each line of the image
    s = byte_planes(spark, d).withColumn("before", F.lag("byte").over(Window.partitionBy("img", "plane", "y").orderBy("x", "c")))
    ends = s.groupBy("img", "plane", "y").agg(F.max_by("byte", F.struct("x", "c")).alias("end"))
    ends = ends.select("img", "plane", "y", F.lag("end", 1, 0).over(Window.partitionBy("img", "plane").orderBy("y")).alias("carried"))
    s = s.join(ends, ["img", "plane", "y"]).withColumn("ctx", F.coalesce("before", "carried"))
    return O.stream_methods(s, ["img", "plane"], "ctx", "byte")


@query("s17_stream_shares", f"{_ST} SELECT img, plane, CAST(size AS BIGINT) AS size, round(size / sum(size) OVER (PARTITION BY img), 6) AS share FROM w WHERE k = 1")
def s17(spark, d):
    """Each byte plane's share of its image's bytes (s15 and s16 parse containers)."""
    e = e12(spark, d)
    return e.select("img", "plane", "size", F.round(c("size") / F.sum("size").over(Window.partitionBy("img")), 6).alias("share"))


@query("e16_general_codecs")
def e16(spark, d):
    """Sizes under the general compressors of the standard library, stream by stream."""
    from .coding import byte_planes

    s = G.raster(byte_planes(spark, d))
    return O.general_codecs(s, ["img", "plane"], "i", "byte")


_CH = f"{_YC}, e AS (SELECT img, (floor(r * 16) / 16 - floor(b * 16) / 16) - (r - b) AS o, (floor(g * 16) / 16 - (floor(r * 16) / 16 + floor(b * 16) / 16) / 2) - (g - (r + b) / 2) AS g FROM px)"


@query("g04_chroma_stats", f"{_CH} SELECT img, count(*) AS samples, round(sqrt(avg(o * o)), 6) AS co_rmse, round(sqrt(avg(g * g)), 6) AS cg_rmse, round(quantile_disc(abs(o), 0.99), 6) AS co_p99, round(quantile_disc(abs(g), 0.99), 6) AS cg_p99 FROM e GROUP BY img")
def g04(spark, d):
    """Chroma errors."""
    px = G.pixels(G.grid(spark, d, "ord3"))
    a = {k: c(k).cast("double") for k in "rgb"}
    q = {k: F.floor(v * 16) / 16 for k, v in a.items()}
    chroma = lambda s: T.ycocg(s["r"], s["g"], s["b"])[1:]
    e = px.select("img", *[(y - x).alias(k) for k, x, y in zip(("o", "g"), chroma(a), chroma(q), strict=True)])
    rank = lambda k: F.expr(f"percentile_disc(0.99) within group (order by abs({k}))")
    return e.groupBy("img").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sqrt(F.avg(c("o") * c("o"))), 6).alias("co_rmse"), F.round(F.sqrt(F.avg(c("g") * c("g"))), 6).alias("cg_rmse"), F.round(rank("o"), 6).alias("co_p99"), F.round(rank("g"), 6).alias("cg_p99"))


@query("j06_anchor_deltas", f"WITH {grid_sql(*TWO)}, e AS (SELECT img, c, abs(floor(CAST(v AS DOUBLE) * 16) / 16 - v) AS a, abs(floor(CAST(v AS DOUBLE) * 64) / 64 - v) AS b FROM g) SELECT img, c, 'mae' AS metric, round(avg(a), 6) AS anchor, round(avg(b), 6) AS candidate, round(avg(b) - avg(a), 6) AS delta FROM e GROUP BY ALL UNION ALL SELECT img, c, 'max', round(max(a), 6), round(max(b), 6), round(max(b) - max(a), 6) FROM e GROUP BY ALL")
def j06(spark, d):
    """An anchor's and a candidate's metrics in long form, joined."""
    g = G.grids(spark, d, *TWO).withColumn("v", c("v").cast("double"))

    def metrics(scale, name):
        e = F.abs(F.floor(c("v") * scale) / scale - c("v"))
        long = g.groupBy("img", "c").agg(F.avg(e).alias("mae"), F.max(e).alias("max"))
        return long.unpivot(["img", "c"], ["mae", "max"], "metric", name)

    j = metrics(16, "anchor").join(metrics(64, "candidate"), ["img", "c", "metric"])
    return j.select("img", "c", "metric", F.round("anchor", 6).alias("anchor"), F.round("candidate", 6).alias("candidate"), F.round(c("candidate") - c("anchor"), 6).alias("delta"))


@query("j14_separate_peaks")
def j14(spark, d):
    """The five greatest samples of each image that are ten apart (greedy)."""
    return O.separate_peaks(plane(spark, d, "evt1", "part1"), "v", 5, 10)


@query("j17_strided", f"{_EVT}, sd AS (SELECT img, max(x) + 1 AS wd FROM p GROUP BY img) SELECT p.img, count(*) AS n, count(*) FILTER ((y * wd + x) % 7 = 0) AS picked, round(avg(v) FILTER ((y * wd + x) % 7 = 0), 5) AS mean FROM p JOIN sd ON sd.img = p.img GROUP BY p.img")
def j17(spark, d):
    """A strided sample (the operator samples) beside the whole."""
    picked = c("i") % 7 == 0
    return G.raster(plane(spark, d, "evt1", "part1")).groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.count_if(picked).alias("picked"), F.round(F.avg(F.when(picked, c("v"))), 5).alias("mean"))


@query("t03_lorenzo", f"WITH {grid_sql('evt1')}, {WORDS}, {NEIGHBOURS} SELECT img, y, x, ((o - w - n + nw) % 4294967296 + 4294967296) % 4294967296 AS r FROM nb")
def t03(spark, d):
    """Lorenzo differences modulo 2^32 (two differences, one along each axis)."""
    n = P.with_neighbours(P.with_words(G.grid(spark, d, "evt1")))
    return n.select("img", "y", "x", F.pmod(c("o") - c("w") - c("n") + c("nw"), B.long(1 << 32)).alias("r"))


@query("t06_band_sigma", f"{_EVT}, q AS (SELECT img, y // 2 AS y, x // 2 AS x, max(v) FILTER (y % 2 = 0 AND x % 2 = 0) AS a, max(v) FILTER (y % 2 = 0 AND x % 2 = 1) AS b, max(v) FILTER (y % 2 = 1 AND x % 2 = 0) AS c, max(v) FILTER (y % 2 = 1 AND x % 2 = 1) AS d FROM p GROUP BY ALL HAVING count(*) = 4), s AS (SELECT img, unnest(['hl', 'lh', 'hh']) AS band, unnest([(a - b + c - d) / 2, (a + b - c - d) / 2, (a - b - c + d) / 2]) AS v FROM q) SELECT img, band, round(stddev_pop(v), 5) AS sigma FROM s GROUP BY ALL")
def t06(spark, d):
    """Deviations of the Haar detail bands."""
    from ..operators import multires as M

    return M.haar(plane(spark, d, "evt1", "part1"), "v", 1).filter("band <> 'll'").groupBy("img", "band").agg(F.round(F.stddev_pop("v"), 5).alias("sigma"))


@query("t07_mdl_tree")
def t07(spark, d):
    """A greedy tree of context features for a bit plane, by adaptive code length."""
    n = P.with_neighbours(P.with_words(G.grid(spark, d, "evt1")))
    features = {"w": B.bit(c("w"), 24), "n": B.bit(c("n"), 24), "nw": B.bit(c("nw"), 24), "p1": B.bit(c("o"), 25), "p2": B.bit(c("o"), 26), "xo": c("x") % 2}
    return O.context_tree(n.select(B.bit(c("o"), 24).alias("one"), *[v.cast("long").alias(k) for k, v in features.items()]), list(features), "one", 4)



@query("s03_windows", f"WITH {grid_sql('evt1', 'part1')}, {_V} SELECT img, y, x, round(v, 5) AS v FROM p WHERE y BETWEEN 2 AND 9 AND x BETWEEN 10 AND 29")
def s03(spark, d):
    """A rectangle of every image; its predicates reach the scan where places are stored columns."""
    return G.window_of(plane(spark, d, "evt1", "part1"), 10, 2, 20, 8).withColumn("v", F.round("v", 5))


_ORIGINS = [(x, y) for x, y in G.crop_origins(100, 10, 8, 3)]


@query("s04_crops", f"WITH {grid_sql('evt1')}, {_V}, o AS (SELECT * FROM (VALUES {', '.join(str(k) for k in _ORIGINS)}) t(x0, y0)) SELECT x0, y0, count(*) AS n, round(avg(v), 5) AS mean FROM o JOIN p ON x BETWEEN x0 AND x0 + 7 AND y BETWEEN y0 AND y0 + 7 GROUP BY ALL")
def s04(spark, d):
    """Evenly spaced crops of an image; a sample looks up the crops that it lies in."""
    origins = F.array(*[F.struct(F.lit(x).alias("x0"), F.lit(y).alias("y0")) for x, y in _ORIGINS])
    inside = F.filter(origins, lambda o: c("x").between(o["x0"], o["x0"] + 7) & c("y").between(o["y0"], o["y0"] + 7))
    p = plane(spark, d, "evt1").select("v", F.explode(inside).alias("o")).select("v", "o.*")
    return p.groupBy("x0", "y0").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 5).alias("mean"))


@query("p20_predictive_planes")
def p20_planes(spark, d):
    """P20: indices of residuals from four predictions out of reconstructed neighbours."""
    from ..operators import sequential as L

    return L.predictive_planes(G.grid(spark, d, "ord3").withColumn("v", c("v").cast("double")), 0.02)

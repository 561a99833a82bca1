"""Audits of a decoded image beside its original: regions, metrics by region and exposure, and two gates.

Pixels carry the names of all regions that they lie in; every metric is one aggregate over exploded regions, and a
gate is a table of rules joined to the metrics of a candidate and of an anchor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tone as T
from . import order as O
from . import stencil as W

c = F.col
# Names of the regions, quantiles of their masks, offset of the log luma, share of a lost gradient.
REGIONS = ("all", "dark_0_0.25", "mid_0.25_1", "highlight_1_4", "extreme_gt4", "smooth", "dark_smooth", "edge", "texture", "route_mask", "nonmask")
GRAD_SMOOTH, GRAD_EDGE, STD_SMOOTH, STD_TEXTURE, OFFSET, VISIBLE = 0.35, 0.95, 0.40, 0.75, 1e-4, 1 / 4096
#: Radii of the box means: local deviation, structure, low frequencies.
LOCAL, STRUCTURE, LOW = 3, 2, 3


def region_masks(px: DataFrame, route: Column) -> DataFrame:
    """px (img, y, x, r, g, b) with `regions`: the names of those that each pixel lies in."""
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    p = px.withColumn("_l", F.log2(F.greatest(T.luma(c("r"), c("g"), c("b")), F.lit(0.0)) + OFFSET)).withColumn("_route", route)
    back = lambda w: F.coalesce(F.abs(c("_l") - F.lag("_l").over(w)), F.lit(0.0))
    p = W.local_std(p.withColumn("_g", F.round(F.greatest(back(row), back(column)), 9)), "_l", "_s", LOCAL).withColumn("_s", F.round("_s", 6))
    cuts = O.quantiles(p, ["img"], {"_g": [GRAD_SMOOTH, GRAD_EDGE], "_s": [STD_SMOOTH, STD_TEXTURE]})
    p = p.join(cuts.withColumnsRenamed({"_g": "_gq", "_s": "_sq"}), "img")
    v = F.greatest("r", "g", "b").cast("double")
    smooth = (c("_g") <= c("_gq")[0]) & (c("_s") <= c("_sq")[0])
    holds = (F.lit(True), v <= 0.25, (v > 0.25) & (v <= 1), (v > 1) & (v <= 4), v > 4, smooth, smooth & (v <= 0.25), c("_g") >= c("_gq")[1], c("_s") >= c("_sq")[1], c("_route"), ~c("_route"))
    names = F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in zip(REGIONS, holds, strict=True)]))
    return p.withColumn("regions", names).drop("_l", "_g", "_s", "_gq", "_sq", "_route")


def shown(prefix: str, exposure: float) -> dict[str, Column]:
    return {k: T.display(c(f"{prefix}{k}"), exposure) for k in "rgb"}


def _gradients(df: DataFrame, original: str, decoded: str, new: str) -> DataFrame:
    """df with array `new` of forward gradients (o, d, regions that both pixels lie in) to the east and to the south."""
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")

    def one(w) -> Column:
        ahead = F.lead(F.struct(c(original).alias("o"), c(decoded).alias("d"), c("regions"))).over(w)
        return F.when(ahead.isNotNull(), F.struct((ahead["o"] - c(original)).alias("o"), (ahead["d"] - c(decoded)).alias("d"), F.array_intersect(ahead["regions"], c("regions")).alias("regions")))

    return df.withColumns({f"_{new}x": one(row), f"_{new}y": one(column)}).withColumn(new, F.array_compact(F.array(f"_{new}x", f"_{new}y"))).drop(f"_{new}x", f"_{new}y")


def detail(df: DataFrame, keys: list[str], gradients: str, prefix: str) -> DataFrame:
    """Samples, normalised error, energy ratio, correlation, and rates of lost and visible detail of gradients, by region."""
    g = df.select(*keys, F.explode(gradients).alias("g")).select(*keys, "g.o", "g.d", F.explode("g.regions").alias("region"))
    o, d = c("o"), c("d")
    oo, dd, od, ee = F.sum(o * o), F.sum(d * d), F.sum(o * d), F.sum((d - o) * (d - o))
    visible = F.abs(o) > VISIBLE
    lost = visible & (F.abs(d) < F.abs(o) * 0.5)
    some = oo > 0
    made = {
        "samples": F.count(F.lit(1)),
        "nrmse": F.when(some, F.sqrt(ee / oo)).otherwise(0.0),
        "energy": F.when(some, F.sqrt(dd / oo)).otherwise(1.0),
        "correlation": F.when(some & (dd > 0), od / F.sqrt(oo * dd)).otherwise(1.0),
        "lost": F.when(some, F.avg(lost.cast("double"))).otherwise(0.0),
        "visible": F.when(some, F.avg(visible.cast("double"))).otherwise(0.0),
    }
    return g.groupBy(*keys, "region").agg(*[v.alias(f"{prefix}_{k}") for k, v in made.items()])


def audited(pairs: DataFrame, exposures: tuple[float, ...]) -> DataFrame:
    """pairs (version, y, x, regions, r, g, b and decoded dr, dg, db) to metrics: version, ev, region, ...

    Each version at each exposure is an image of its own for the stencils.
    """
    each = []
    for ev in exposures:
        o, d = shown("", ev), shown("d", ev)
        chroma = [(y - x) for x, y in zip(T.ycocg(*o.values())[1:], T.ycocg(*d.values())[1:], strict=True)]
        top = F.greatest(*[F.abs(d[k] - o[k]) for k in "rgb"])
        each.append(pairs.select(F.concat_ws("|", "version", F.lit(f"{ev:g}")).alias("img"), "y", "x", "regions", T.luma(*o.values()).alias("lo"), T.luma(*d.values()).alias("ld"), top.alias("top"), chroma[0].alias("co"), chroma[1].alias("cg")))
    p = reduce(DataFrame.unionByName, each).withColumn("e", c("ld") - c("lo"))
    p = W.box_mean(p, {"so": "lo", "sd": "ld"}, STRUCTURE)
    p = W.box_mean(p, {"low": "e"}, LOW)
    p = _gradients(_gradients(p, "lo", "ld", "fine"), "so", "sd", "coarse")
    rank = lambda e, q: F.expr(f"percentile_disc({q}) within group (order by round(abs({e}), 9))")
    points = p.select("img", F.explode("regions").alias("region"), "e", "top", "co", "cg", "low").groupBy("img", "region").agg(
        F.count(F.lit(1)).alias("samples"), F.sqrt(F.avg(c("e") * c("e"))).alias("luma_rmse"), F.avg(F.abs("e")).alias("luma_mae"), rank("e", 0.99).alias("luma_p99"), F.sqrt(F.avg(c("top") * c("top"))).alias("rgb_rmse"),
        F.max("top").alias("rgb_max"), rank("co", 0.99).alias("co_p99"), rank("cg", 0.99).alias("cg_p99"), rank("low", 0.99).alias("low_p99"),
    )
    out = points.join(detail(p, ["img"], "fine", "fine"), ["img", "region"], "left").join(detail(p, ["img"], "coarse", "coarse"), ["img", "region"], "left")
    parts = F.split("img", r"\|")
    return out.withColumns({"version": parts[0], "ev": parts[1].cast("double")}).drop("img")


# Rules of the gates.  (regions, metric, kind, maybe above, reject above, samples needed)
LOST = ("dark_0_0.25", "dark_smooth")
GATE_A = [
    *[(r, "coarse_lost", "delta", 0.04, 0.10, 0) for r in LOST],
    *[(r, "low_p99", "double_or_0.01", 0.0, None, 0) for r in LOST],
    *[(r, "coarse_lost", "delta", 0.035, 0.075, 1024) for r in ("highlight_1_4", "extreme_gt4")],
    *[(r, "coarse_energy", "off_one", 0.06, None, 1024) for r in ("highlight_1_4", "extreme_gt4")],
    ("mid_0.25_1", "chroma_p99", "delta", 0.03, None, 0),
]
GATE_B = [
    ("dark_0_0.25", "fine_lost", "delta", 0.04, 0.10, 0),
    ("dark_0_0.25", "fine_nrmse", "ratio_1.45_0.035_2.1_0.08", 0.0, 0.0, 0),
    ("mid_0.25_1", "fine_lost", "delta", 0.06, 0.12, 0),
    ("highlight_1_4", "fine_lost", "delta", 0.035, 0.075, 0),
    ("extreme_gt4", "fine_lost", "delta", 0.06, 0.14, 0),
    *[(r, "fine_energy", "off_one", None, 0.06, 1024) for r in ("highlight_1_4", "extreme_gt4")],
]


def gate(metrics: DataFrame, rules: list[tuple], candidate: str, anchor: str, counted: str) -> DataFrame:
    """ev, region, metric, value, severity (maybe, reject) of every rule that the candidate fails."""
    spark = metrics.sparkSession
    table = spark.createDataFrame([(r, m, k, a, b, n) for r, m, k, a, b, n in rules], "region string, metric string, kind string, maybe double, reject double, needed long")
    used = sorted({r[1] for r in rules})
    wide = metrics.withColumn("chroma_p99", F.greatest("co_p99", "cg_p99"))
    long = wide.unpivot(["version", "ev", "region", counted], used, "metric", "value")
    now = long.filter(c("version") == candidate).drop("version")
    then = long.filter(c("version") == anchor).select("ev", "region", "metric", c("value").alias("base"))
    j = now.join(then, ["ev", "region", "metric"]).join(table, ["region", "metric"]).filter(c(counted) >= c("needed"))
    v, b = c("value"), c("base")
    over = lambda step, a, d: F.when(c("kind") == "delta", v - b > step).when(c("kind") == "off_one", F.abs(v - 1) > step).when(c("kind") == "double_or_0.01", v > F.greatest(b * 2, b + 0.01) + step).otherwise(v > F.greatest(b * a, b + d) + step)
    severity = F.when(c("reject").isNotNull() & over(c("reject"), 2.1, 0.08), "reject").when(c("maybe").isNotNull() & over(c("maybe"), 1.45, 0.035), "maybe")
    return j.withColumn("severity", severity).filter("severity is not null").select("ev", "region", "metric", "value", "severity")


def decision(failures: DataFrame) -> DataFrame:
    """One row: pass, maybe or reject, and how many rules failed."""
    return failures.agg(F.when(F.max((c("severity") == "reject").cast("int")) == 1, "reject").when(F.count(F.lit(1)) > 0, "maybe").otherwise("pass").alias("decision"), F.count(F.lit(1)).alias("failures"))

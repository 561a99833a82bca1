"""Queries on audits: region masks, metrics by region and exposure, gates, detail and colour of regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tone as T
from ..operators import audit as A
from ..sources import grids as G
from .imaging import box_sql
from .registry import grid_sql, query

c = F.col

_PX = "px AS (SELECT img, y, x, CAST(max(v) FILTER (c = 0) AS DOUBLE) AS r, CAST(max(v) FILTER (c = 1) AS DOUBLE) AS g, CAST(max(v) FILTER (c = 2) AS DOUBLE) AS b FROM g GROUP BY ALL HAVING count(*) = 3)"
_HOLDS = {
    "all": "true",
    "dark_0_0.25": "v <= 0.25",
    "mid_0.25_1": "v > 0.25 AND v <= 1",
    "highlight_1_4": "v > 1 AND v <= 4",
    "extreme_gt4": "v > 4",
    "smooth": "gr <= g35 AND sd <= s40",
    "dark_smooth": "gr <= g35 AND sd <= s40 AND v <= 0.25",
    "edge": "gr >= g95",
    "texture": "sd >= s75",
    "route_mask": "lu <= 0.5",
    "nonmask": "lu > 0.5",
}
_MASKS = f"""WITH {grid_sql('ord3')}, {_PX},
l0 AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS lu, greatest(r, g, b) AS v FROM px),
l1 AS (SELECT *, log2(greatest(lu, 0) + 0.0001) AS ll FROM l0),
l2 AS (SELECT *, ll * ll AS l2, round(greatest(coalesce(abs(ll - lag(ll) OVER (PARTITION BY img, y ORDER BY x)), 0), coalesce(abs(ll - lag(ll) OVER (PARTITION BY img, x ORDER BY y)), 0)), 9) AS gr FROM l1),
{box_sql('l2', 'lb', {'m1': 'll', 'm2': 'l2'}, 3, 'img, y, x, r, g, b, lu, v, gr')},
l3 AS (SELECT *, round(sqrt(greatest(m2 - m1 * m1, 0)), 6) AS sd FROM lb),
lq AS (SELECT quantile_cont(gr, 0.35) AS g35, quantile_cont(gr, 0.95) AS g95, quantile_cont(sd, 0.40) AS s40, quantile_cont(sd, 0.75) AS s75 FROM l3),
mk AS (SELECT y, x, r, g, b, list_filter([{', '.join(f"CASE WHEN {h} THEN '{n}' END" for n, h in _HOLDS.items())}], lambda z: z IS NOT NULL) AS regions FROM l3, lq)"""


def masked(spark, d):
    px = G.pixels(G.grid(spark, d, "ord3"))
    return A.region_masks(px, T.luma(c("r"), c("g"), c("b")) <= 0.5)


@query("g06_region_masks", f"{_MASKS}, e AS (SELECT unnest(regions) AS region, y, x FROM mk) SELECT region, count(*) AS n, sum(y * 7 + x)::BIGINT AS places FROM e GROUP BY ALL")
def g06(spark, d):
    """Pixels in each of the eleven regions."""
    e = masked(spark, d).select("y", "x", F.explode("regions").alias("region"))
    return e.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(c("y") * 7 + c("x")).alias("places"))


def _show(v: str, ev: float) -> str:
    return f"pow(least(greatest({v} * {2.0**ev} / 4, 0), 1), CAST(1 / 2.2 AS DOUBLE))"


def _variant(scale: int, ev: float) -> str:
    cut = lambda k: f"(floor({k} * {scale}) / {scale})"
    parts = ", ".join(f"{_show(k, ev)} AS p{k}, {_show(cut(k), ev)} AS d{k}" for k in "rgb")
    return f"SELECT '{'anchor' if scale == 64 else 'candidate'}|{ev:g}' AS img, y, x, regions, {parts} FROM mk"


_LUMA = "0.2126 * {0}r + 0.7152 * {0}g + 0.0722 * {0}b"
_GRADS = "SELECT img, lead({o}) OVER {w} - {o} AS o, lead({d}) OVER {w} - {d} AS d, list_intersect(regions, lead(regions) OVER {w}) AS regions FROM a4"
_DETAIL = """{n}0 AS ({gx} UNION ALL {gy}), {n}1 AS (SELECT img, o, d, unnest(regions) AS region FROM {n}0 WHERE o IS NOT NULL),
{n}2 AS (SELECT img, region, count(*) AS {n}_samples, CASE WHEN sum(o * o) > 0 THEN sqrt(sum((d - o) * (d - o)) / sum(o * o)) ELSE 0 END AS {n}_nrmse, CASE WHEN sum(o * o) > 0 THEN sqrt(sum(d * d) / sum(o * o)) ELSE 1 END AS {n}_energy, CASE WHEN sum(o * o) > 0 AND sum(d * d) > 0 THEN sum(o * d) / sqrt(sum(o * o) * sum(d * d)) ELSE 1 END AS {n}_correlation, CASE WHEN sum(o * o) > 0 THEN avg(CASE WHEN abs(o) > 1.0 / 4096 AND abs(d) < abs(o) * 0.5 THEN 1.0 ELSE 0 END) ELSE 0 END AS {n}_lost, CASE WHEN sum(o * o) > 0 THEN avg(CASE WHEN abs(o) > 1.0 / 4096 THEN 1.0 ELSE 0 END) ELSE 0 END AS {n}_visible FROM {n}1 GROUP BY ALL)"""
_ROW, _COL = "(PARTITION BY img, y ORDER BY x)", "(PARTITION BY img, x ORDER BY y)"
_METRICS = f"""{_MASKS}, a0 AS ({' UNION ALL '.join(_variant(s, ev) for s in (6, 64) for ev in (0.0, 3.0))}),
a1 AS (SELECT img, y, x, regions, {_LUMA.format('p')} AS lo, {_LUMA.format('d')} AS ld, greatest(abs(dr - pr), abs(dg - pg), abs(db - pb)) AS top, (dr - db) - (pr - pb) AS co, (dg - (dr + db) / 2) - (pg - (pr + pb) / 2) AS cg FROM a0),
a2 AS (SELECT *, ld - lo AS e FROM a1),
{box_sql('a2', 'a3', {'so': 'lo', 'sd': 'ld'}, 2, 'img, y, x, regions, lo, ld, top, co, cg, e')},
{box_sql('a3', 'a4', {'low': 'e'}, 3, 'img, y, x, regions, lo, ld, top, co, cg, e, so, sd')},
ap AS (SELECT *, unnest(regions) AS region FROM a4),
aq AS (SELECT img, region, count(*) AS samples, sqrt(avg(e * e)) AS luma_rmse, avg(abs(e)) AS luma_mae, quantile_disc(round(abs(e), 9), 0.99) AS luma_p99, sqrt(avg(top * top)) AS rgb_rmse, max(top) AS rgb_max, quantile_disc(round(abs(co), 9), 0.99) AS co_p99, quantile_disc(round(abs(cg), 9), 0.99) AS cg_p99, quantile_disc(round(abs(low), 9), 0.99) AS low_p99 FROM ap GROUP BY ALL),
{_DETAIL.format(n='fine', gx=_GRADS.format(o='lo', d='ld', w=_ROW), gy=_GRADS.format(o='lo', d='ld', w=_COL))},
{_DETAIL.format(n='coarse', gx=_GRADS.format(o='so', d='sd', w=_ROW), gy=_GRADS.format(o='so', d='sd', w=_COL))},
am AS (SELECT split_part(aq.img, '|', 1) AS version, CAST(split_part(aq.img, '|', 2) AS DOUBLE) AS ev, aq.*, f.* EXCLUDE (img, region), k.* EXCLUDE (img, region) FROM aq LEFT JOIN fine2 f ON f.img = aq.img AND f.region = aq.region LEFT JOIN coarse2 k ON k.img = aq.img AND k.region = aq.region)"""
_ROUNDED = ("luma_rmse", "luma_mae", "luma_p99", "rgb_rmse", "rgb_max", "co_p99", "cg_p99", "low_p99", "fine_nrmse", "fine_energy", "fine_correlation", "fine_lost", "fine_visible", "coarse_nrmse", "coarse_energy", "coarse_correlation", "coarse_lost")


def metrics(spark, d):
    m = masked(spark, d)
    cut = lambda k, n: (F.floor(c(k).cast("double") * n) / n).alias(f"d{k}")
    version = lambda name, n: m.select(F.lit(name).alias("version"), "y", "x", "regions", *[c(k).cast("double").alias(k) for k in "rgb"], *[cut(k, n) for k in "rgb"])
    return A.audited(version("candidate", 6).unionByName(version("anchor", 64)), (0.0, 3.0))


@query("g07_region_exposures", f"{_METRICS} SELECT version, ev, region, samples, fine_samples, coarse_samples, {', '.join(f'round({k}, 5) AS {k}' for k in _ROUNDED)} FROM am")
def g07(spark, d):
    """All metrics of a candidate and an anchor by region and exposure."""
    return metrics(spark, d).select("version", "ev", "region", "samples", "fine_samples", "coarse_samples", *[F.round(k, 5).alias(k) for k in _ROUNDED])


def _kind(kind: str, step: str, a: float, d: float) -> str:
    return {"delta": f"n.v - t.v > {step}", "off_one": f"abs(n.v - 1) > {step}", "double_or_0.01": "n.v > greatest(t.v * 2, t.v + 0.01)"}.get(kind, f"n.v > greatest(t.v * {a}, t.v + {d})")


def _gate_sql(rules, counted: str) -> str:
    parts = []
    for r, m, k, a, b, needed in rules:
        v = "greatest(co_p99, cg_p99)" if m == "chroma_p99" else m
        reject = f"WHEN {_kind(k, str(b), 2.1, 0.08)} THEN 'reject'" if b is not None else ""
        maybe = f"WHEN {_kind(k, str(a), 1.45, 0.035)} THEN 'maybe'" if a is not None else ""
        parts.append(f"SELECT n.ev, '{r}' AS region, '{m}' AS metric, n.v AS value, CASE {reject} {maybe} END AS severity FROM (SELECT ev, {v} AS v, {counted} AS k FROM am WHERE version = 'candidate' AND region = '{r}') n JOIN (SELECT ev, {v} AS v FROM am WHERE version = 'anchor' AND region = '{r}') t ON n.ev = t.ev WHERE n.k >= {needed}")
    return f"{_METRICS}, fails AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE severity IS NOT NULL)"


_DECISION = "SELECT CASE WHEN count(*) FILTER (severity = 'reject') > 0 THEN 'reject' WHEN count(*) > 0 THEN 'maybe' ELSE 'pass' END AS decision, count(*) AS failures FROM fails"


@query("g08_gate_structure", f"{_gate_sql(A.GATE_A, 'samples')} SELECT ev, region, metric, severity, round(value, 5) AS value FROM fails")
def g08_structure(spark, d):
    """Rules on structure, low frequencies and chroma that the candidate fails beside the anchor."""
    f = A.gate(metrics(spark, d), A.GATE_A, "candidate", "anchor", "samples")
    return f.withColumn("value", F.round("value", 5))


@query("g08_decision", f"{_gate_sql(A.GATE_A, 'samples')} {_DECISION}")
def g08_decision(spark, d):
    """Pass, maybe or reject."""
    return A.decision(A.gate(metrics(spark, d), A.GATE_A, "candidate", "anchor", "samples"))


@query("g09_gate_visual", f"{_gate_sql(A.GATE_B, 'fine_samples')} SELECT ev, region, metric, severity, round(value, 5) AS value FROM fails")
def g09(spark, d):
    """Rules on dark, middle, highlight and extreme detail that the candidate fails beside the anchor."""
    f = A.gate(metrics(spark, d), A.GATE_B, "candidate", "anchor", "fine_samples")
    return f.withColumn("value", F.round("value", 5))


@query("g09_decision", f"{_gate_sql(A.GATE_B, 'fine_samples')} {_DECISION}")
def g09_decision(spark, d):
    """Pass, maybe or reject."""
    return A.decision(A.gate(metrics(spark, d), A.GATE_B, "candidate", "anchor", "fine_samples"))


# Thresholds that a near-lossless result passes.
PASSES = {"luma_p99": 0.02, "rgb_max": 0.08, "fine_lost": 0.05}


@query("g10_quality_passes", f"{_METRICS} SELECT version, ev, region, luma_p99 <= 0.02 AND rgb_max <= 0.08 AND fine_lost <= 0.05 AS passes FROM am WHERE region IN ('all', 'dark_0_0.25', 'smooth')")
def g10(spark, d):
    """The predicate of all thresholds, for three regions."""
    good = [c(k) <= v for k, v in PASSES.items()]
    return metrics(spark, d).filter(c("region").isin("all", "dark_0_0.25", "smooth")).select("version", "ev", "region", (good[0] & good[1] & good[2]).alias("passes"))

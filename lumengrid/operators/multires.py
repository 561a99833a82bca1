"""Multi-resolution transforms of one-channel grids, level by level as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B

c = F.col


def _quads(df: DataFrame, value: str) -> DataFrame:
    """Blocks of 2 by 2: img, y, x (of the block) and a b / c d as columns q00, q01, q10, q11 (null outside)."""
    pick = lambda dy, dx: F.max(F.when((c("y") % 2 == dy) & (c("x") % 2 == dx), c(value))).alias(f"q{dy}{dx}")
    return df.groupBy("img", F.expr("y div 2").alias("by"), F.expr("cast(x div 2 as int)").alias("bx")).agg(*[pick(i, j) for i in (0, 1) for j in (0, 1)]).withColumnsRenamed({"by": "y", "bx": "x"})


def haar(df: DataFrame, value: str, levels: int) -> DataFrame:
    """Orthonormal Haar bands: img, level, band (ll only at the last level), y, x, v.  Only complete blocks have bands."""
    now, out = df.select("img", "y", "x", c(value).cast("double").alias("v")), None
    for level in range(1, levels + 1):
        q = _quads(now, "v").dropna()
        a, b, d, e = (c(k) for k in ("q00", "q01", "q10", "q11"))
        bands = F.array(*[F.struct(F.lit(n).alias("band"), (x / 2).alias("v")) for n, x in (("ll", a + b + d + e), ("hl", a - b + d - e), ("lh", a + b - d - e), ("hh", a - b - d + e))])
        made = q.select("img", "y", "x", F.explode(bands).alias("s")).select("img", F.lit(level).alias("level"), "s.band", "y", "x", "s.v")
        part = made if level == levels else made.filter("band <> 'll'")
        out = part if out is None else out.unionByName(part)
        now = made.filter("band = 'll'").select("img", "y", "x", "v")
    return out


def haar_inverse_level(bands: DataFrame) -> DataFrame:
    """One level's bands (img, band, y, x, v) back to samples."""
    pick = lambda n: F.max(F.when(c("band") == n, c("v"))).alias(n)
    w = bands.groupBy("img", "y", "x").agg(*[pick(n) for n in ("ll", "hl", "lh", "hh")])
    quads = ((0, 0, 1, 1, 1), (0, 1, -1, 1, -1), (1, 0, 1, -1, -1), (1, 1, -1, -1, 1))
    each = F.array(*[F.struct((c("y") * 2 + i).alias("y"), (c("x") * 2 + j).alias("x"), ((c("ll") + s * c("hl") + t * c("lh") + u * c("hh")) / 2).alias("v")) for i, j, s, t, u in quads])
    return w.select("img", F.explode(each).alias("s")).select("img", "s.*")


def anchor_pyramid(df: DataFrame, value: str, width: int) -> DataFrame:
    """Blocks with their anchor (top left) and modular differences of the other three (null outside) from it."""
    q = _quads(df, value)
    diff = lambda k: F.pmod(c(k) - c("q00"), B.long(1 << width))
    return q.select("img", "y", "x", c("q00").alias("anchor"), *[diff(k).alias(k.replace("q", "d")) for k in ("q01", "q10", "q11")])


def pass_of(y: Column, x: Column, levels: int) -> Column:
    """The pass in which a hierarchy decodes a pixel: 0 for the coarsest lattice, then a pass for each halving."""
    out = F.lit(levels)
    for k in range(1, levels + 1):
        step = 1 << k
        out = F.when((y % step == 0) & (x % step == 0), levels - k).otherwise(out)
    return out

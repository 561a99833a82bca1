"""Integer pyramids of 2 x 2 blocks with modular differences, coarse-to-fine passes, and their inverses.

A level turns each full block into a low-pass value, which the next level works on, and three details; samples of
blocks that are cut by an odd edge stay as they are, as the band `rest`.  Everything is grouping and projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
BANDS = ("h", "v", "d")


def _wrap(v: Column, width: int) -> Column:
    return F.pmod(v, F.lit(1 << width).cast("long"))


def _lowpass(kind: str, width: int) -> Column:
    """From the anchor a and the details h, v: a itself, or a moved by half of both details taken as signed."""
    if kind != "average":
        return c("a")
    signed = lambda d: F.when(d >= 1 << (width - 1), d - (1 << width)).otherwise(d)
    return _wrap(c("a") + F.floor((signed(c("h")) + signed(c("v"))) / 2), width)


def _anchor(kind: str, width: int) -> Column:
    if kind != "average":
        return c("low")
    signed = lambda d: F.when(d >= 1 << (width - 1), d - (1 << width)).otherwise(d)
    return _wrap(c("low") - F.floor((signed(c("h")) + signed(c("v"))) / 2), width)


def forward(samples: DataFrame, width: int, levels: int, kind: str) -> DataFrame:
    """samples (img, y, x, o: integers of width bits) to level, band, y, x, o: `low` of the last level, h, v, d and rest of each.

    kind: `anchor` (details are differences to the block's first sample), `average` (its low-pass is moved by half of
    the details), `lorenzo` (the diagonal is predicted from both edges).
    """
    now, out = samples.select("img", "y", "x", "o"), []
    for level in range(1, levels + 1):
        corner = lambda dy, dx: F.max(F.when((c("y") % 2 == dy) & (c("x") % 2 == dx), c("o")))
        q = now.groupBy("img", F.expr("y div 2").alias("by"), F.expr("cast(x div 2 as int)").alias("bx")).agg(F.count(F.lit(1)).alias("n"), corner(0, 0).alias("a"), corner(0, 1).alias("b"), corner(1, 0).alias("e"), corner(1, 1).alias("f"))
        full = q.filter("n = 4")
        guess = c("b") + c("e") - c("a") if kind == "lorenzo" else c("a")
        parts = full.withColumns({"h": _wrap(c("b") - c("a"), width), "v": _wrap(c("e") - c("a"), width), "d": _wrap(c("f") - guess, width)})
        details = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), c(k).alias("o")) for k in BANDS])).alias("s")
        out.append(parts.select("img", F.lit(level).alias("level"), c("by").alias("y"), c("bx").alias("x"), details).select("img", "level", "s.band", "y", "x", "s.o"))
        loose = F.explode(F.array(*[F.struct((2 * c("by") + dy).alias("y"), (2 * c("bx") + dx).alias("x"), c(k).alias("o")) for k, dy, dx in (("a", 0, 0), ("b", 0, 1), ("e", 1, 0), ("f", 1, 1))])).alias("s")
        rest = q.filter("n < 4").select("img", loose).select("img", F.lit(level).alias("level"), F.lit("rest").alias("band"), "s.y", "s.x", "s.o").filter("o is not null")
        out.append(rest)
        now = parts.select("img", c("by").alias("y"), c("bx").alias("x"), _lowpass(kind, width).alias("o"))
    out.append(now.select("img", F.lit(levels).alias("level"), F.lit("low").alias("band"), "y", "x", "o"))
    return reduce(DataFrame.unionByName, out)


def inverse(bands: DataFrame, width: int, kind: str, levels: int | None = None) -> DataFrame:
    """img, y, x, o from forward's bands (levels: how many there are; by default it is looked up)."""
    levels = levels or int(bands.agg(F.max("level")).first()[0] or 0)
    now = bands.filter("band = 'low'").select("img", "y", "x", "o")
    for level in range(levels, 0, -1):
        here = bands.filter(c("level") == level)
        both = now.withColumn("band", F.lit("low")).unionByName(here.filter(c("band").isin(*BANDS)).select("img", "y", "x", "o", "band"))
        pick = lambda k: F.max(F.when(c("band") == k, c("o")))
        q = both.groupBy("img", "y", "x").agg(pick("low").alias("low"), *[pick(k).alias(k) for k in BANDS])
        q = q.withColumn("a", _anchor(kind, width))
        b, e = _wrap(c("a") + c("h"), width), _wrap(c("a") + c("v"), width)
        guess = b + e - c("a") if kind == "lorenzo" else c("a")
        each = F.explode(F.array(*[F.struct((2 * c("y") + dy).alias("y"), (2 * c("x") + dx).alias("x"), o.alias("o")) for dy, dx, o in ((0, 0, c("a")), (0, 1, b), (1, 0, e), (1, 1, _wrap(guess + c("d"), width)))])).alias("s")
        blocks = q.select("img", each).select("img", "s.*")
        now = blocks.unionByName(here.filter("band = 'rest'").select("img", "y", "x", "o"))
    return now


# --- passes

PASSES = 3
_OFFSETS = (("_w", 0, -1), ("_n", -1, 0), ("_e", 0, 1), ("_s", 1, 0), ("_nw", -1, -1), ("_ne", -1, 1), ("_sw", 1, -1), ("_se", 1, 1))


def pass_number() -> Column:
    y, x = c("y"), c("x")
    return F.when((y % 4 == 0) & (x % 4 == 0), 0).when((y % 2 == 0) & (x % 2 == 0), 1).otherwise(2)


def _around(df: DataFrame, value: str) -> DataFrame:
    """df with the structs (y, x, pass, value) of its eight neighbours that lie next to it."""
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    s = df.withColumn("_self", F.struct("y", "x", "pass", c(value).alias("v")))
    s = s.withColumns({"_w": F.lag("_self").over(row), "_e": F.lead("_self").over(row)})
    return s.withColumns({"_n": F.lag("_self").over(column), "_s": F.lead("_self").over(column), "_nw": F.lag("_w").over(column), "_ne": F.lag("_e").over(column), "_sw": F.lead("_w").over(column), "_se": F.lead("_e").over(column)})


def _guess() -> Column:
    known = [F.when((c(k)["y"] == c("y") + dy) & (c(k)["x"] == c("x") + dx) & (c(k)["pass"] < c("pass")), c(k)["v"]) for k, dy, dx in _OFFSETS]
    return F.coalesce(*known, F.lit(0.0))


def hierarchy_residuals(samples: DataFrame) -> DataFrame:
    """samples (img, y, x, v) to img, y, x, pass and `r`, the difference to the first neighbour of an earlier pass."""
    p = _around(samples.withColumn("pass", pass_number()), "v")
    return p.select("img", "y", "x", "pass", (c("v") - _guess()).alias("r"))


def hierarchy_decoded(residuals: DataFrame) -> DataFrame:
    """img, y, x, v: one step for each pass; what a pass decodes is known to the next."""
    now = residuals.withColumn("v", F.when(c("pass") == 0, c("r")))
    for k in range(1, PASSES):
        p = _around(now, "v").withColumn("v", F.when(c("pass") == k, c("r") + _guess()).otherwise(c("v")))
        now = p.select("img", "y", "x", "pass", "r", "v")
    return now.select("img", "y", "x", "v")

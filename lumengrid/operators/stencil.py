"""Stencils on pixel tables (img, y, x, value columns): lines reflect at their own ends, the edge sample once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _padded(df: DataFrame, along: str, across: str, r: int) -> tuple[DataFrame, Window]:
    """df with positions `_p` from -r to n - 1 + r along each line of n samples, and the line's window."""
    line = Window.partitionBy("img", across)
    n, at = F.col("_n"), F.col(along).cast("int")
    period = 2 * (n - 1)
    images = [at + period * j for j in range(-r, r + 1)] + [-at + period * j for j in range(-r, r + 1)]
    places = F.array_distinct(F.filter(F.array(*images), lambda p: (p >= -r) & (p <= n - 1 + r)))
    places = F.when(n == 1, F.sequence(F.lit(-r), F.lit(r))).otherwise(places)
    spread = df.withColumn("_n", F.count(F.lit(1)).over(line).cast("int")).withColumn("_p", F.explode(places))
    return spread, line.orderBy("_p")


def _line_pass(df: DataFrame, along: str, across: str, r: int, made: dict[str, Column], frame) -> DataFrame:
    spread, line = _padded(df, along, across, r)
    out = spread.withColumns({k: v.over(frame(line)) for k, v in made.items()})
    return out.filter(F.col("_p") == F.col(along)).drop("_n", "_p")


def box_mean(df: DataFrame, columns: dict[str, str], r: int) -> DataFrame:
    """df with a new column for each of columns (new -> old): its mean over a square of 2 r + 1, in two line passes."""
    frame = lambda w: w.rowsBetween(-r, r)
    half = _line_pass(df, "x", "y", r, {f"_h_{k}": F.avg(v) for k, v in columns.items()}, frame)
    return _line_pass(half, "y", "x", r, {k: F.avg(f"_h_{k}") for k in columns}, frame).drop(*[f"_h_{k}" for k in columns])


def dilated(df: DataFrame, mask: str, new: str, r: int) -> DataFrame:
    """df with `new`: whether mask (0 or 1) holds anywhere in the square of 2 r + 1 (cut at the image's border)."""
    row, column = Window.partitionBy("img", "y").orderBy("x").rangeBetween(-r, r), Window.partitionBy("img", "x").orderBy("y").rangeBetween(-r, r)
    return df.withColumn("_m", F.max(mask).over(row)).withColumn(new, F.max("_m").over(column)).drop("_m")


def local_std(df: DataFrame, value: str, new: str, r: int) -> DataFrame:
    moments = box_mean(df.withColumn("_sq", F.col(value) * F.col(value)), {"_m1": value, "_m2": "_sq"}, r)
    return moments.withColumn(new, F.sqrt(F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0)))).drop("_sq", "_m1", "_m2")


def guided(df: DataFrame, planes: dict[str, str], guide: str, r: int, eps: float, means: dict[str, str] | None = None) -> DataFrame:
    """df with an edge-keeping low-pass of each plane (new -> plane): local linear models of the guide, averaged.

    All planes share their passes; `means` (new -> column) are box means that are made in the first of them as well.
    """
    g = F.col(guide)
    products = {"_gg": g * g} | {f"_gp_{k}": g * F.col(p) for k, p in planes.items()}
    wanted = {"_mg": guide, "_mgg": "_gg"} | {f"_mp_{k}": p for k, p in planes.items()} | {f"_mgp_{k}": f"_gp_{k}" for k in planes} | (means or {})
    first = box_mean(df.withColumns(products), wanted, r).drop(*products)
    variance = F.col("_mgg") - F.col("_mg") * F.col("_mg") + eps
    slopes = {f"_a_{k}": (F.col(f"_mgp_{k}") - F.col("_mg") * F.col(f"_mp_{k}")) / variance for k in planes}
    lines = first.withColumns(slopes).withColumns({f"_b_{k}": F.col(f"_mp_{k}") - F.col(f"_a_{k}") * F.col("_mg") for k in planes})
    lines = lines.drop("_mg", "_mgg", *[f"_{m}_{k}" for k in planes for m in ("mp", "mgp")])
    out = box_mean(lines, {f"_m{m}_{k}": f"_{m}_{k}" for k in planes for m in "ab"}, r)
    out = out.withColumns({k: F.col(f"_ma_{k}") * g + F.col(f"_mb_{k}") for k in planes})
    return out.drop(*[f"_{m}_{k}" for k in planes for m in ("a", "b", "ma", "mb")])


def block_reduced(df: DataFrame, scale: int, made: dict[str, Column]) -> DataFrame:
    """One row for each block of scale by scale pixels: img, by, bx and the aggregates."""
    by, bx = F.expr(f"y div {scale}").alias("by"), F.expr(f"cast(x div {scale} as int)").alias("bx")
    return df.groupBy("img", by, bx).agg(*[v.alias(k) for k, v in made.items()])


def upsampled(df: DataFrame, blocks: DataFrame, scale: int) -> DataFrame:
    """df with the columns of its block."""
    keyed = df.withColumns({"by": F.expr(f"y div {scale}"), "bx": F.expr(f"cast(x div {scale} as int)")})
    return keyed.join(blocks, ["img", "by", "bx"]).drop("by", "bx")

"""Quantisers: value ranges by group, indices and their reconstruction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tone as T

PRESETS = {"ratio": 7, "balanced": 8, "quality": 9, "quality_plus": 10}


def index_of(v: Column, lo: Column, hi: Column, bits: int) -> Column:
    """floor(z + 1/2) of the place in the range, cut to 0 .. 2^bits - 1; 0 in a range of no width."""
    levels = (1 << bits) - 1
    z = F.floor((v - lo) / (hi - lo) * levels + 0.5)
    return F.when(hi > lo, F.least(F.greatest(z, F.lit(0)), F.lit(levels))).otherwise(F.lit(0)).cast("long")


def value_of(q: Column, lo: Column, hi: Column, bits: int) -> Column:
    return F.when(hi > lo, lo + q * (hi - lo) / ((1 << bits) - 1)).otherwise(lo)


def ranged(df: DataFrame, value: Column, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """df with the range of value in each group, its ends rounded to FLOAT.

    An aggregate joined back, not a window: no group's samples meet in one task.
    """
    end = lambda f, name: f(value).cast("float").cast("double").alias(name)
    return df.join(df.groupBy(*keys).agg(end(F.min, lo), end(F.max, hi)), keys)


def transform_index(df: DataFrame, mode: str, bits: int, keys: list[str]) -> DataFrame:
    """df (with v) with its index `q` and reconstruction `rec` in the transformed domain's range by group."""
    t = ranged(df.withColumn("_t", T.forward(F.col("v"), mode)), F.col("_t"), keys)
    q = t.withColumn("q", index_of(F.col("_t"), F.col("lo"), F.col("hi"), bits))
    return q.withColumn("rec", T.inverse(value_of(F.col("q"), F.col("lo"), F.col("hi"), bits), mode)).drop("_t", "lo", "hi")


def random_tail(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """keys and `tail`: how many low bits in a row look random (ones within a tenth of a half); 0 below 64 samples."""
    sums = [F.sum(F.shiftright("b", k).bitwiseAND(F.lit(1).cast("long"))).alias(f"_{k}") for k in range(cap)]
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    tail: Column = F.lit(0)
    ok: Column = F.col("n") >= 64
    for k in range(cap):
        ok = ok & (F.abs(2 * F.col(f"_{k}") - F.col("n")) <= F.floor(F.col("n") / 10))
        tail = F.when(ok, k + 1).otherwise(tail)
    return got.select(*keys, "n", tail.alias("tail"))


def error_diffused(df: DataFrame, bits: int) -> DataFrame:
    """Floyd-Steinberg dithered indices of each image channel.  Every sample's error reaches its neighbours, so an
    image channel is one group: a sequential scan of one plane, in columns img, y, x, c, v, lo, hi."""
    levels = (1 << bits) - 1

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x"]).reset_index(drop=True)
        width, rows = int(part["x"].max()) + 1, part.groupby("y", sort=True).indices
        below, out = np.zeros(width + 2), np.zeros(len(part), np.int64)
        lo, hi = float(part["lo"].iat[0]), float(part["hi"].iat[0])
        z = (part["v"].to_numpy(float) - lo) / (hi - lo) * levels if hi > lo else np.zeros(len(part))
        for _, at in rows.items():
            here, below, right = below, np.zeros(width + 2), 0.0
            for i in at:
                x = int(part["x"].iat[i])
                want = z[i] + here[x + 1] + right
                q = min(max(int(np.floor(want + 0.5)), 0), levels)
                e = want - q
                right = e * 7 / 16
                below[x] += e * 3 / 16
                below[x + 1] += e * 5 / 16
                below[x + 2] += e / 16
                out[i] = q
        return part[["img", "y", "x", "c"]].assign(q=out)

    return df.groupBy("img", "c").applyInPandas(scan, "img string, y long, x int, c int, q long")

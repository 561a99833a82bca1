"""Context families of bit planes, and adaptive counts of all planes in all families.

A family is a list of features, the first is the lowest bit of the context.
w n nw ne pc: the plane's bit of a neighbouring residual (pc: of the channel before); p1 to p4: the higher bits
of the residual itself; wp1 np1 ...: those of its west and north neighbours; c0 c1 c2: channel; xo yo: oddness.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predict import with_neighbours

# Names, features and their order, and the fold of the hashed family.
FAMILIES: dict[str, list[str]] = {
    "base": ["w", "n", "nw", "ne", "p1", "p2", "p3", "p4"],
    "prev": ["p1", "p2", "p3", "p4"],
    "wn_prev": ["w", "n", "p1", "p2", "p3", "p4"],
    "spatial_prev_pc": ["w", "n", "nw", "ne", "pc", "p1", "p2", "p3", "p4"],
    "spatial_prev_channel": ["w", "n", "nw", "ne", "c0", "c1", "c2", "p1", "p2", "p3", "p4"],
    "spatial_hi": ["w", "n", "nw", "ne", "p1", "wp1", "np1", "p2", "wp2", "np2"],
    "spatial_hi_channel": ["w", "n", "c0", "c1", "c2", "p1", "wp1", "np1", "p2", "wp2", "np2"],
    "spatial_hi_pc": ["w", "n", "nw", "ne", "pc", "p1", "wp1", "np1", "p2", "wp2", "np2"],
    "prev_xy_channel": ["p1", "p2", "xo", "yo", "c0", "c1", "c2"],
    "hash_all": ["w", "n", "nw", "ne", "pc", "p1", "p2", "p3", "p4", "wp1", "np1", "wp2", "np2", "xo", "yo", "c0", "c1", "c2"],
    "prev4_channel": ["p1", "p2", "p3", "p4", "c0", "c1", "c2"],
    "wn_prev4_channel": ["w", "n", "p1", "p2", "p3", "p4", "c0", "c1", "c2"],
    "wn_prev4_pc": ["w", "n", "pc", "p1", "p2", "p3", "p4"],
    "spatial_xy": ["w", "n", "nw", "ne", "xo", "yo", "p1", "p2"],
    "constant_zero": [],
}
HASHED, FOLDED = "hash_all", 1 << 11
#: The family that codes a plane without a one for nothing, and no other plane.
ZERO = "constant_zero"


def with_residual_neighbours(df: DataFrame, tile: int = 128) -> DataFrame:
    """df (img, y, x, c, r) with the residuals' neighbours inside tiles of tile by tile samples."""
    tiled = df.withColumn("ty", F.expr(f"y div {tile}")).withColumn("tx", F.expr(f"cast(x div {tile} as int)"))
    near = with_neighbours(tiled, "r", ("ty", "tx"))
    before = F.coalesce(F.lag("r").over(Window.partitionBy("img", "y", "x").orderBy("c")), F.lit(0))
    return near.withColumnsRenamed({"w": "rw", "n": "rn", "nw": "rnw", "ne": "rne"}).withColumn("rpc", before.cast("long"))


def _features(part: pd.DataFrame, bit: int) -> dict[str, np.ndarray]:
    """All features of the plane, as 0 or 1 for each sample."""
    r = {k: part[k].to_numpy(np.int64) for k in ("r", "rw", "rn", "rnw", "rne", "rpc")}
    out = {k: r[f"r{k}"] >> bit & 1 for k in ("w", "n", "nw", "ne", "pc")}
    out |= {f"p{i}": r["r"] >> (bit + i) & 1 for i in (1, 2, 3, 4)}
    out |= {f"{k}p{i}": r[f"r{k}"] >> (bit + i) & 1 for k in ("w", "n") for i in (1, 2)}
    out |= {f"c{i}": (part["c"].to_numpy() == i).astype(np.int64) for i in (0, 1, 2)}
    return out | {"xo": part["x"].to_numpy(np.int64) & 1, "yo": part["y"].to_numpy(np.int64) & 1}


def _folded(code: np.ndarray) -> np.ndarray:
    mixed = (code ^ code >> 11 ^ code >> 22) * 0x9E3779B1 & 0xFFFFFFFF
    return (mixed ^ mixed >> 16) & (FOLDED - 1)


def counted(near: DataFrame, families: list[str], bits: range) -> DataFrame:
    """img, ty, tx, bit, family, ord, ctx, n, ones: counts of every context that occurs, tile by tile.

    A row for each sample, plane and family would be hundreds of times the samples, so a tile (bounded by its sides)
    is counted in one task into tables of the families' sizes, and only their non-empty cells leave it.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for bit in bits:
            have, one = _features(part, bit), part["r"].to_numpy(np.int64) >> bit & 1
            for i, family in enumerate(families):
                ctx = sum((have[x] << k for k, x in enumerate(FAMILIES[family])), np.zeros(len(part), np.int64))
                ctx = _folded(ctx) if family == HASHED else ctx
                n, ones = np.bincount(ctx), np.bincount(ctx, one)
                at = np.flatnonzero(n)
                out.append(pd.DataFrame({"bit": bit, "family": family, "ord": i, "ctx": at, "n": n[at], "ones": ones[at].astype(np.int64)}))
        cells = pd.concat(out, ignore_index=True)
        return cells.assign(img=key[0], ty=key[1], tx=key[2])[["img", "ty", "tx", "bit", "family", "ord", "ctx", "n", "ones"]]

    schema = "img string, ty long, tx int, bit int, family string, ord int, ctx long, n long, ones long"
    return near.groupBy("img", "ty", "tx").applyInPandas(run, schema)


def family_bits(counts: DataFrame, keys: list[str], cost: Column) -> DataFrame:
    """keys (family among them) and `bits`: cost summed over contexts; null where the zero family meets a one."""
    got = counts.groupBy(*keys).agg(F.sum(cost).alias("_cost"), F.sum("ones").alias("_ones"))
    free = F.when(F.col("_ones") == 0, F.lit(0.0))
    return got.select(*keys, F.when(F.col("family") == ZERO, free).otherwise(F.col("_cost")).alias("bits"))

"""Choices between ways of coding, by cost; greedy selections over small results."""

from __future__ import annotations

import bz2
import lzma
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import entropy as E

c = F.col


def _table_cost(df: DataFrame, keys: list[str], parts: list[str], symbol: str, entry_bits: int) -> DataFrame:
    counts = E.histogram(df, [*keys, *parts], symbol).withColumn("_t", F.sum("n").over(Window.partitionBy(*keys, *parts)))
    return counts.groupBy(*keys).agg((F.sum(c("n") * F.log2(c("_t") / c("n"))) + entry_bits * F.count(F.lit(1))).alias("cost"))


def shared_or_split(df: DataFrame, key: str, part: str, symbol: str, entry_bits: int) -> DataFrame:
    """key, the cost of a table for all parts (shared) and of one for each (split), entries included, and which is less."""
    one = _table_cost(df, [key], [], symbol, entry_bits).withColumnRenamed("cost", "a")
    many = _table_cost(df, [key], [part], symbol, entry_bits).withColumnRenamed("cost", "b")
    return one.join(many, key).select(key, F.round("a", 3).alias("shared"), F.round("b", 3).alias("split"), (c("b") < c("a")).alias("splits"))


def top_k_escape(df: DataFrame, key: str, symbol: str, k: int, escape_bits: int, entry_bits: int) -> DataFrame:
    """key, how many samples escape, and the bits of a table of the k most frequent symbols."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), symbol))
    ranked = E.histogram(df, [key], symbol).withColumns({"_k": rank, "_t": F.sum("n").over(Window.partitionBy(key))})
    kept = F.when(c("_k") <= k, c(symbol)).otherwise(F.lit(-1))
    merged = ranked.groupBy(key, kept.alias("s")).agg(F.sum("n").alias("n"), F.max("_t").alias("t"))
    escaped = F.coalesce(F.max(F.when(c("s") == -1, c("n"))), F.lit(0))
    return merged.groupBy(key).agg(escaped.alias("escaped"), F.round(F.sum(c("n") * F.log2(c("t") / c("n"))) + escape_bits * escaped + entry_bits * F.count_if(c("s") >= 0), 3).alias("bits"))


def stream_methods(df: DataFrame, keys: list[str], context: str, symbol: str) -> DataFrame:
    """keys, the method (raw, order0, order1) of the least size in bytes, and that size; the first wins ties."""
    pairs = E.histogram(df, [*keys, context], symbol)
    one = pairs.withColumn("_t", F.sum("n").over(Window.partitionBy(*keys, context)))
    size = lambda bits: F.ceil(F.round(bits / 8, 6))
    order1 = one.groupBy(*keys).agg(F.sum("n").alias("raw"), (size(F.sum(c("n") * F.log2(c("_t") / c("n")))) + 3 * F.count(F.lit(1))).alias("order1"))
    zero = pairs.groupBy(*keys, symbol).agg(F.sum("n").alias("n")).withColumn("_t", F.sum("n").over(Window.partitionBy(*keys)))
    order0 = zero.groupBy(*keys).agg((size(F.sum(c("n") * F.log2(c("_t") / c("n")))) + 512).alias("order0"))
    sizes = F.array(*[F.struct(c(m).cast("long").alias("size"), F.lit(i).alias("ord"), F.lit(m).alias("method")) for i, m in enumerate(("raw", "order0", "order1"))])
    return order0.join(order1, keys).withColumn("m", F.array_min(sizes)).select(*keys, "m.method", "m.size")


def general_codecs(df: DataFrame, keys: list[str], index: str, byte: str, chunk: int = 1 << 18) -> DataFrame:
    """keys, `chunk`, `method`, raw and compressed bytes, and whether the bytes come back."""
    codecs = {"zlib9": (lambda x: zlib.compress(x, 9), zlib.decompress), "bz2_9": (lambda x: bz2.compress(x, 9), bz2.decompress), "xz6": (lambda x: lzma.compress(x, preset=6), lzma.decompress)}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        data = part.sort_values(index)[byte].to_numpy(np.uint8).tobytes()
        row = {k: part[k].iat[0] for k in [*keys, "chunk"]}
        made = [(m, pack(data), unpack) for m, (pack, unpack) in codecs.items()]
        return pd.DataFrame([row | {"method": m, "raw_bytes": len(data), "coded_bytes": len(x), "exact": unpack(x) == data} for m, x, unpack in made])

    cut = df.withColumn("chunk", F.expr(f"cast({index} div {chunk} as long)"))
    schema = ", ".join(f"{k} {cut.schema[k].dataType.simpleString()}" for k in [*keys, "chunk"])
    return cut.groupBy(*keys, "chunk").applyInPandas(run, f"{schema}, method string, raw_bytes long, coded_bytes long, exact boolean")


def separate_peaks(df: DataFrame, value: str, most: int, apart: int) -> DataFrame:
    """Greedy: for each image the greatest samples, each at least `apart` (in x or in y) from those before.

    Of a square of `apart` by `apart` samples one at most is chosen, and a sample hides others only of the nine squares
    around it, so the most * 9 squares with the greatest samples hold all that can be chosen; an image's samples in
    these, the `most` * 9 greatest of each square's are enough, are scanned in one task.
    """
    enough = 9 * most
    squares = df.select("img", "y", "x", c(value).cast("double").alias("v"), F.expr(f"y div {apart}").alias("_sy"), F.expr(f"x div {apart}").alias("_sx"))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v"), "y", "x"))
    tops = squares.groupBy("img", "_sy", "_sx").agg(F.max(F.struct(c("v"), -c("y"), -c("x"))).alias("m"))
    order = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("m")))
    chosen = tops.withColumn("_k", order).filter(c("_k") <= enough).select("img", "_sy", "_sx")
    left = squares.join(chosen, ["img", "_sy", "_sx"]).withColumn("_r", rank("img", "_sy", "_sx")).filter(c("_r") <= apart * apart)

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["v", "y", "x"], ascending=[False, True, True])
        out: list[tuple] = []
        for img, y, x, v in zip(part["img"], part["y"], part["x"], part["v"], strict=True):
            if all(abs(y - b) >= apart or abs(x - a) >= apart for _, _, b, a, _ in out):
                out.append((img, len(out) + 1, y, x, v))
                if len(out) == most:
                    break
        return pd.DataFrame(out, columns=["img", "rank", "y", "x", value])

    return left.select("img", "y", "x", "v").groupBy("img").applyInPandas(scan, f"img string, rank int, y long, x int, {value} double")


def context_tree(df: DataFrame, features: list[str], one: str, splits: int) -> DataFrame:
    """Greedy context tree of a bit: in each round the leaf and the feature whose split saves most bits (16 bits for a
    split) are split.  All samples are counted once by all features; rounds work on these 2^features cells (16 features
    at most)."""
    if len(features) > 16:
        raise ValueError("more than 16 features: the cells would not be a small table")
    cells = df.groupBy(*features).agg(F.count(F.lit(1)).alias("_n"), F.sum(one).alias("_k")).toPandas()

    def cost(rows):
        from math import lgamma, log

        n, k = float(rows["_n"].sum()), float(rows["_k"].sum())
        return (lgamma(n + 1) + log(np.pi) - lgamma(n - k + 0.5) - lgamma(k + 0.5)) / log(2) if n else 0.0

    leaves = [("", cells)]
    for _ in range(splits):
        best = (0.0, None)
        for i, (path, rows) in enumerate(leaves):
            for f in features:
                a, b = rows[rows[f] == 0], rows[rows[f] == 1]
                gain = cost(rows) - cost(a) - cost(b) - 16
                if gain > best[0]:
                    best = (gain, (i, f, a, b))
        if not best[1]:
            break
        i, f, a, b = best[1]
        path = leaves[i][0]
        leaves[i : i + 1] = [(f"{path}{f}=0 ", a), (f"{path}{f}=1 ", b)]
    out = [(p.strip(), int(r["_n"].sum()), int(r["_k"].sum()), round(cost(r), 4)) for p, r in leaves]
    return df.sparkSession.createDataFrame(out, "leaf string, n long, ones long, bits double")

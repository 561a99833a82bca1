"""Entropies and adaptive code lengths from counts.

Counts are aggregated with partial combination first, so what is shuffled is bounded by groups times alphabet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    return df.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("n"))


def entropy_bits(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """keys, `total` and order-0 entropy `bits` of all symbols: sum of n log2(total / n)."""
    counts = histogram(df, keys, symbol)
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy())
    shares = counts.withColumn("total", total)
    return shares.groupBy(*keys).agg(F.max("total").alias("total"), F.sum(F.col("n") * F.log2(F.col("total") / F.col("n"))).alias("bits"))


def conditional_entropy_bits(df: DataFrame, keys: list[str], context: str, symbol: str) -> DataFrame:
    inner = entropy_bits(df, [*keys, context], symbol)
    return inner.groupBy(*keys).agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("contexts"), F.sum("bits").alias("bits"))


def log_gamma(x: Column) -> Column:
    """log2 of the gamma function for x >= 0.5, by Stirling's series after moving x up by eight."""
    up = x + 8
    series = (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - 1 / (1680 * up**7)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return (series - F.log(product)) / math.log(2)


def kt_bits(zeros: Column, ones: Column, prior: float = 0.5) -> Column:
    """Bits that an adaptive binary coder with `prior` counts spends, in whatever order the bits come."""
    z, o = zeros.cast("double"), ones.cast("double")
    one = math.lgamma(prior) / math.log(2)
    both = math.lgamma(2 * prior) / math.log(2)
    return log_gamma(z + o + 2 * prior) - log_gamma(z + prior) - log_gamma(o + prior) + 2 * one - both


def dirichlet_bits(df: DataFrame, keys: list[str], count: str, alphabet: int) -> DataFrame:
    """keys and the adaptive bits of a multinomial with prior 1/2 for each of alphabet symbols; df has counts."""
    half, whole = math.lgamma(0.5) / math.log(2), math.lgamma(alphabet / 2) / math.log(2)
    got = df.groupBy(*keys).agg(F.sum(count).alias("_t"), F.sum(log_gamma(F.col(count) + 0.5) - half).alias("_s"))
    return got.select(*keys, (log_gamma(F.col("_t") + alphabet / 2) - whole - F.col("_s")).alias("bits"))


def plane_counts(df: DataFrame, keys: list[str], value: str, planes: range) -> DataFrame:
    """keys, `bit`, `n` and `ones` of each bit plane: one aggregate for each plane instead of a row for each bit."""
    sums = [F.sum(F.shiftright(F.col(value), k).bitwiseAND(F.lit(1).cast("long"))).alias(f"_b{k}") for k in planes]
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    pairs = F.array(*[F.struct(F.lit(k).alias("bit"), F.col(f"_b{k}").alias("ones")) for k in planes])
    return wide.select(*keys, "n", F.explode(pairs).alias("p")).select(*keys, "p.bit", "n", "p.ones")


def binary_entropy(n: Column, ones: Column) -> Column:
    term = lambda k: F.when((k > 0) & (k < n), k * F.log2(n / k)).otherwise(F.lit(0.0))
    return term(ones) + term(n - ones)


def context_bits(df: DataFrame, keys: list[str], context: str, bit: str) -> DataFrame:
    """keys and the adaptive bits of a bit plane split by contexts: one aggregation of counts, no order needed."""
    counts = df.groupBy(*keys, context).agg(F.count(F.lit(1)).alias("n"), F.sum(bit).alias("ones"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(kt_bits(F.col("n") - F.col("ones"), F.col("ones"))).alias("bits"))


def ks_distance(df: DataFrame, a: str, b: str, keys: list[str], bins: int = 256) -> DataFrame:
    """keys and the greatest difference of the cumulated bins-bin histograms of two columns."""
    ends = df.groupBy(*keys).agg(F.least(F.min(a), F.min(b)).alias("_lo"), F.greatest(F.max(a), F.max(b)).alias("_hi"))
    place = lambda v: F.least(F.floor(bins * (F.col(v) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))), F.lit(bins - 1))
    both = df.join(ends, keys).select(*keys, F.explode(F.array(F.struct(place(a).alias("k"), F.lit(1).alias("d")), F.struct(place(b).alias("k"), F.lit(-1).alias("d")))).alias("s"))
    counts = both.groupBy(*keys, "s.k").agg(F.sum("s.d").alias("d"), F.count(F.lit(1)).alias("m"))
    run = counts.withColumn("run", F.sum("d").over(Window.partitionBy(*keys).orderBy("k")))
    return run.groupBy(*keys).agg((F.max(F.abs("run")) / (F.sum("m") / 2)).alias("ks"))


def byte_pair_counts(df: DataFrame, text: str) -> DataFrame:
    """`ctx`, `byte`, `n`: how often each byte of the texts' UTF-8 follows each other (0 before the first).

    A row for each byte would be the whole text many times over, so each task counts into a table of 65,536
    cells and only its non-empty cells leave it.
    """

    def run(batches):
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                x = np.frombuffer((t or "").encode(), np.uint8).astype(np.int64)
                if len(x):
                    counts += np.bincount(np.concatenate([[0], x[:-1]]) * 256 + x, minlength=1 << 16)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at // 256, pa.int32()), pa.array(at % 256, pa.int32()), pa.array(counts[at])], ["ctx", "byte", "n"])

    cells = df.select(text).mapInArrow(run, "ctx int, byte int, n long")
    return cells.groupBy("ctx", "byte").agg(F.sum("n").alias("n"))


def conditional_from_counts(counts: DataFrame, context: str, symbol: str, n: str) -> DataFrame:
    """`total`, `contexts` and `bits` from counts of (context, symbol)."""
    t = counts.withColumn("_t", F.sum(n).over(Window.partitionBy(context)))
    return t.agg(F.sum(n).alias("total"), F.countDistinct(context).alias("contexts"), F.sum(F.col(n) * F.log2(F.col("_t") / F.col(n))).alias("bits"))

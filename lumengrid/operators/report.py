"""Roll-ups of result tables (img, method, ratio, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def geomean(x: Column) -> Column:
    return F.exp(F.avg(F.when(x > 0, F.log(x))))


def summary(results: DataFrame) -> DataFrame:
    """Per method: geometric mean of ratios, mean, least and greatest bits, median, images."""
    return results.groupBy("method").agg(geomean(c("ratio")).alias("ratio_geomean"), F.avg("bits").alias("bits_mean"), F.min("bits").alias("bits_min"), F.max("bits").alias("bits_max"), F.median("bits").alias("bits_median"), F.count(F.lit(1)).alias("images"))


def against_baseline(results: DataFrame, baseline: str) -> DataFrame:
    base = results.filter(c("method") == baseline).select("img", c("ratio").alias("base_ratio"))
    return results.filter(c("method") != baseline).join(base, "img", "left").withColumn("gain", c("ratio") / c("base_ratio"))


def reach_target(rows: DataFrame, target: float) -> DataFrame:
    """For each image: the first of its rows (by low_bits) that reaches the target ratio, else the best one."""
    row = F.struct("low_bits", "ratio")
    hit = F.min(F.when(c("ratio") >= target, row))
    best = F.max_by(row, F.struct(c("ratio"), -c("low_bits")))
    got = rows.groupBy("img").agg(F.coalesce(hit, best).alias("r"), hit.isNotNull().alias("reached"))
    return got.select("img", "r.low_bits", "r.ratio", "reached")


def keep_best(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(tie)))
    return rows.withColumn("_k", rank).filter("_k = 1").drop("_k")

"""Sample grids (img, y, x, c, v) over the driver's tables; pixels with one column for each channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["img", "y", "x", "c"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One image in sample-long form: y is a BIGINT, x and c are INT, v is a FLOAT."""
    if name in ("emb1", "emb4"):
        pos = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("pos", "v"))
        x, c = ("pos", "0") if name == "emb1" else ("pos div 4", "pos % 4")
        df = pos.select("y", F.expr(x).cast("int").alias("x"), F.expr(c).cast("int").alias("c"), F.col("v").cast("float").alias("v"))
    elif name == "ord3":
        p = "o_orderkey div 3"
        df = table(spark, sf_dir, "orders").select(F.expr(f"({p}) div 64").alias("y"), F.expr(f"cast(({p}) % 64 as int)").alias("x"), F.expr("cast(o_orderkey % 3 as int)").alias("c"), F.expr("cast(o_totalprice / 100000 as float)").alias("v"))
    elif name == "evt1":
        df = table(spark, sf_dir, "events").select(F.expr("event_id div 100").alias("y"), F.expr("cast(event_id % 100 as int)").alias("x"), F.lit(0).alias("c"), F.col("value").cast("float").alias("v"))
    elif name == "part1":
        df = table(spark, sf_dir, "part").select(F.expr("p_partkey div 50").alias("y"), F.expr("cast(p_partkey % 50 as int)").alias("x"), F.lit(0).alias("c"), F.col("p_retailprice").cast("float").alias("v"))
    else:
        raise ValueError(f"unknown grid: {name}")
    return df.select(F.lit(name).alias("img"), "y", "x", "c", "v")


def grids(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    out = grid(spark, sf_dir, names[0])
    for name in names[1:]:
        out = out.unionByName(grid(spark, sf_dir, name))
    return out


def raster(samples: DataFrame) -> DataFrame:
    """samples with the sides of their image (`width`, `channels`) and `i`, their place in raster order."""
    one = F.lit(1)
    channels = F.max("c") + one if "c" in samples.columns else one
    sides = samples.groupBy("img").agg((F.max("x") + one).cast("long").alias("width"), channels.cast("long").alias("channels"))
    place = (F.col("y") * F.col("width") + F.col("x")) * F.col("channels") + (F.col("c") if "c" in samples.columns else F.lit(0))
    return samples.join(sides, "img").withColumn("i", place)


def pixels(samples: DataFrame, value: str = "v", names: str = "rgb") -> DataFrame:
    """One row for each pixel that has all channels, which become columns r, g, b, ..."""
    picks = [F.max(F.when(F.col("c") == i, F.col(value))).alias(n) for i, n in enumerate(names)]
    wide = samples.groupBy("img", "y", "x").agg(*picks)
    return wide.dropna(subset=list(names))


def window_of(samples: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """The rectangle of an image; its predicates reach the scan where y and x are stored columns."""
    return samples.filter(F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1))


def crop_origins(width: int, height: int, crop: int, grid_size: int) -> list[tuple[int, int]]:
    """Top-left corners of grid_size by grid_size evenly spaced crops (one: the centre), without repeats."""
    if grid_size <= 1:
        return [(max(0, (width - crop) // 2), max(0, (height - crop) // 2))]
    step = lambda n, i: max(0, n - crop) * i // (grid_size - 1)
    return sorted({(step(width, i), step(height, j)) for i in range(grid_size) for j in range(grid_size)})

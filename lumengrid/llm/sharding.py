"""Operator 7: sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit in memory, by a seeded hash of the key and
the text; pass 2 loads one bucket at a time, puts it in a canonical order, shuffles it with a seeded
Fisher-Yates and writes it.  Buckets in sequence are the global order; shards are equal cuts of it, so
their row counts differ by one at most (law ``rows``).  The places of the buckets in the global order are a
table that is joined to the rows by bucket; the driver holds a number for every RANGE buckets.  The order depends
on the rows and the seed alone, never on how Spark had partitioned them, so a lost task writes the same rows again.

Defined results: a null text is an empty text of size 1; a null key is hashed as such; repeated rows
stay: those with the same key and text share a bucket (their other columns break ties), but where they are more
than REPEATED, which a bucket could not hold, they are spread over the buckets by their row number too; an empty
table gives no rows; further columns travel along, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKET_BYTES, BUCKET_ROWS, REPEATED, RANGE = 8 << 20, 200_000, 10_000, 4_096
SEED = 20_011


def shuffled(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All rows of docs with `_shard` (0 to shards - 1) and `_slot` (place in it, gapless from 0).

    Where docs has columns of these names, the new ones have one underscore more.
    """
    spark = docs.sparkSession
    b_name, h_name, g_name, a_name, shard_name, slot_name = (common.fresh(docs, x) for x in ("_bucket", "_h", "_g", "_again", "_shard", "_slot"))
    rows, size = common.in_bytes(docs, text)
    buckets = max(1, math.ceil(size / bucket_bytes), math.ceil(rows / BUCKET_ROWS))
    digest = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    again = docs.select(digest.alias(h_name)).groupBy(h_name).count().filter(F.col("count") > REPEATED)
    again = common.written(again.select(F.col(h_name).alias(a_name)), "repeated")
    placed = docs.withColumn(h_name, digest)
    if not again.isEmpty():
        spread = F.when(F.col(a_name).isNotNull(), F.xxhash64(h_name, F.monotonically_increasing_id())).otherwise(F.col(h_name))
        placed = placed.join(again, F.col(h_name) == F.col(a_name), "left").withColumn(h_name, spread).drop(a_name)
    placed = placed.withColumn(b_name, F.pmod(F.col(h_name), F.lit(buckets)).cast("int"))
    counts = common.written(placed.groupBy(b_name).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.expr(f"`{b_name}` div {RANGE}").cast("int")), "bucket-counts")
    firsts, so_far = [], 0
    for part, n in sorted(counts.groupBy("part").agg(F.sum("n")).collect()):
        firsts.append((part, so_far))
        so_far += n
    before = Window.partitionBy("part").orderBy(b_name).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = offsets.join(spark.createDataFrame(firsts, "part int, first long"), "part").select(b_name, (F.col("first") + F.col("inside")).alias("first"))
    schema = docs.withColumn(shard_name, F.lit(0)).withColumn(slot_name, F.lit(0).cast("long")).schema

    def one(bucket_key: tuple, part: pd.DataFrame, offset: pd.DataFrame) -> pd.DataFrame:
        b, first = int(bucket_key[0]), int(offset["first"].iat[0])
        part = part.drop(columns=b_name).sort_values([h_name, g_name], kind="stable").drop(columns=[h_name, g_name])
        order = np.arange(len(part))
        np.random.Generator(np.random.PCG64([seed, b])).shuffle(order)  # a Fisher-Yates shuffle
        part = part.iloc[order].reset_index(drop=True)
        at = first + np.arange(len(part), dtype=np.int64)
        shard = at * shards // rows
        part[shard_name] = shard.astype("int32")
        part[slot_name] = at - (shard * rows + shards - 1) // shards
        return part

    parts = min(buckets, common.partitions_for(spark, size))
    hashed = placed.withColumn(g_name, F.xxhash64(*[F.col(f"`{x}`") for x in docs.columns])).repartition(parts, b_name)
    return hashed.groupBy(b_name).cogroup(offsets.repartition(parts, b_name).groupBy(b_name)).applyInPandas(one, schema)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; rows in a file are in slot order."""
    placed.sortWithinPartitions("_shard", "_slot").write.option("compression", "zstd").partitionBy("_shard").parquet(path)


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 8 shuffled shards, written and read back; law `rows`."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    with common.scratch(spark) as kept:
        path = common.table_path(spark, "shards")
        placed = shuffled(docs, 8)
        write_shards(placed, path)
        text = F.coalesce("text", F.lit("")).cast("binary")
        found = spark.read.schema(placed.schema).parquet(path).select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.lit("rows").alias("law"),
            F.col("_shard").alias("shard"),
            F.col("_slot").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
        return kept(found, "shard-places")

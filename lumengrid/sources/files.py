"""Files: raw buffers and frames, nested result JSON, reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path and data of whole files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("content").alias("data"))


def write_frames(frames: DataFrame, path: str) -> None:
    """name and data as Parquet; one file can hold many frames, and readers prune the data column."""
    frames.write.option("compression", "zstd").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def samples(buffers: DataFrame) -> DataFrame:
    """Rows (img, width, height, channels, data) of interleaved little-endian float32 to a sample grid.

    Buffers whose size is not width * height * channels * 4 raise.
    """

    def run(batches):
        for batch in batches:
            for img, width, height, channels, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(data) != width * height * channels * 4:
                    raise ValueError(f"{img}: {len(data)} bytes are not {width} x {height} x {channels} samples")
                at = np.arange(width * height * channels)
                pixel = at // channels
                columns = [pa.array([img] * len(at)), pa.array(pixel // width, pa.int64()), pa.array(pixel % width, pa.int32()), pa.array(at % channels, pa.int32()), pa.array(np.frombuffer(data, "<f4"))]
                yield pa.RecordBatch.from_arrays(columns, ["img", "y", "x", "c", "v"])

    return buffers.select("img", "width", "height", "channels", "data").mapInArrow(run, "img string, y long, x int, c int, v float")


def nested_results(spark: SparkSession, pattern: str) -> DataFrame:
    """One row for each element of `rows` in result files (image, rows), with the file it came from."""
    found = spark.read.option("multiLine", True).schema("image string, rows array<struct<low_bits:int,ratio:double>>").json(pattern)
    return found.select("image", F.input_file_name().alias("file"), F.explode("rows").alias("r")).select("image", "file", "r.*")


def markdown(small: DataFrame) -> str:
    """A report's table as text; for results of a few rows."""
    lines = ["| " + " | ".join(small.columns) + " |", "|" + "---|" * len(small.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in row) + " |" for row in small.collect()])


def write_report(table: DataFrame, path: str) -> None:
    """A report as JSON lines and as CSV with a header, under path/json and path/csv."""
    table.write.json(f"{path}/json")
    table.write.option("header", True).csv(f"{path}/csv")


def byte_windows(spark: SparkSession, pattern: str, size: int, each: int, seed: int) -> DataFrame:
    """path, start and data: `each` seeded windows of `size` bytes of every file that has as many (the operator samples)."""
    files = raw_files(spark, pattern).withColumn("n", F.octet_length("data")).filter(F.col("n") >= size)
    starts = files.select("path", "data", "n", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k"))
    start = F.pmod(F.xxhash64(F.lit(seed), "path", "k"), F.col("n") - size + 1).cast("int")
    return starts.withColumn("start", start).select("path", "start", F.substring("data", F.col("start") + 1, F.lit(size)).alias("data"))


def json_arrays(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON lines with arrays, as a typed table; lines that are no JSON of the schema fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(pattern)

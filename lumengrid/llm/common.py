"""What the operators of this subpackage share: shared-folder tables, Arrow helpers, text guards."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}
#: Bytes of an Arrow batch, of the texts that Python works on at once, and of the texts of a shuffle partition.
BATCH_BYTES, SLICE_BYTES, PART_BYTES = 2 << 20, 1 << 20, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where that is unset, local sessions (tests) get a
    temporary folder of their own; on a cluster that is an error, for executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lumengrid-")
    return _OWN[context.applicationId]


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; an open `scratch` deletes it at its end."""
    path = f"{shared_folder(spark).rstrip('/')}/lumengrid/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts the lineage and survives lost executors."""
    path = table_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The tables that each open scratch has to delete, the innermost last.
_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Within, intermediate tables are written; at the end they are deleted.  What is given to the function that this
    yields is written as a table that stays (until the end of the scratch around this one, where there is one)."""
    own: list[str] = []
    _SCRATCH.append(own)

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        path = own.pop()
        if len(_SCRATCH) > 1:
            _SCRATCH[-2].append(path)
        return out

    try:
        yield kept
    finally:
        _SCRATCH.pop()
        delete(spark, own)


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that are written within and stay: for a caller who knows when they are read no more."""
    own: list[str] = []
    _SCRATCH.append(own)
    try:
        yield own
    finally:
        _SCRATCH.pop()
        if _SCRATCH:
            _SCRATCH[-1].extend(own)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores in front as it takes to be none of df's columns (whatever their case)."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bundled(df: DataFrame, **named: str) -> DataFrame:
    """df's columns `named` under these names, and all of its columns but `text`'s in a struct `rest`: then no name
    that an operator gives can clash with a column that only travels along."""
    others = [F.col(f"`{x}`") for x in df.columns if x != named["text"]]
    rest = F.struct(*others) if others else F.struct(F.lit(None).alias("none"))
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in named.items()], rest.alias("rest"))


def unbundled(df: DataFrame, like: DataFrame, text: str) -> DataFrame:
    """The columns of like again, in its order, from bundled columns."""
    return df.select(*[F.col("text").alias(x) if x == text else F.col("rest").getField(x).alias(x) for x in like.columns])


def mapped(df: DataFrame, schema, each: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 1_000) -> DataFrame:
    """df with each part of at most `rows` rows of its Arrow batches turned into another batch by each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield each(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Within: Arrow batches of about `size` bytes at most (one row at least), however long the rows' texts are.

    It holds for what runs within, not for what is only planned there.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of about most_bytes of the column each, one row at least, in order."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo modulus (null key: null)."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def crc_of(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def partitions_for(spark: SparkSession, size: int = 0) -> int:
    """Partitions for `size` bytes: of about PART_BYTES each, and as many as the session asks for at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def in_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows, and UTF-8 bytes of their texts."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(row[0]), int(row[1])

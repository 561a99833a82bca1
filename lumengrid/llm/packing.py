"""Operator 9: best-fit packing by minimum bin slack.

Only lengths matter to packing, and there are at most `capacity` of them, so the plan is made from the
histogram of lengths.  The largest remaining piece opens a bin; a bitset subset-sum over the available
lengths finds the fullest combination for the rest of it; that pattern is taken as often as the counts
allow and removed.  Each pattern uses up at least one length for its purpose, so there are few patterns
however many pieces there are.  Pieces are then ranked within their length without gathering a length in
one task: counts of each hash bucket give its first rank, and a task ranks its own bucket's rows.

Defined results: a null text is an empty document (one token, the end id); a document of more than
`capacity` tokens is cut, the remainder first; equal lengths are interchangeable (order: bucket, then columns);
repeated rows are packed each, and dealt to buckets by row number too, so no bucket is larger for them; an empty
table gives no rows; other columns than key and text are ignored; `packed` replaces columns named sequence_id
and offset.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
BUCKET_ROWS = 50_000


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of each document: key, piece, start, length, ids_crc32 (and ids: 16-bit little-endian)."""
    path = vocabulary or tokens.vocabulary_path()
    names = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = np.array([tokens.END_ID], dtype="<u2").tobytes()

    def run(batches):
        encoder = tokens.encoder(path)
        for whole in batches:
            for batch in common.slices(whole, text):
                rows: list[list] = [[] for _ in names]
                for k, ids in zip(batch.column(key).to_pylist(), encoder.encode(batch.column(text).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 2
                    wide = np.frombuffer(ids, "<u2").astype("<u4")
                    head = (n - 1) % capacity + 1
                    for piece, stop in enumerate(range(head, n + 1, capacity)):
                        start = max(0, stop - (head if piece == 0 else capacity))
                        row = [k, piece, start, stop - start, common.crc_of(wide[start:stop].tobytes())]
                        for column, x in zip(rows, row + [ids[2 * start : 2 * stop]] * with_ids, strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(key).type), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:5]], *[pa.array(x, pa.binary()) for x in rows[5:]]], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the available lengths, a combination whose sum is the greatest that is at most room."""
    mask, sums, taken = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            taken.append((length, k, sums))
            sums |= (sums << (length * k)) & mask
            left, k = left - k, k * 2
        if sums >> room:
            break
    best, used = sums.bit_length() - 1, {}
    for length, k, before in reversed(taken):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + k
            best -= length * k
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces of this length in a bin, offset in the bin), sorted."""
    counts, rank, rows, bins = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    for largest in sorted(histogram, reverse=True):
        while counts[largest]:
            counts[largest] -= 1
            used = fullest(counts, capacity - largest)
            counts[largest] += 1
            used[largest] = used.get(largest, 0) + 1
            times, offset = min(counts[x] // n for x, n in used.items()), 0
            for length, n in sorted(used.items(), reverse=True):
                rows.append((length, rank[length], bins, n, offset))
                offset += n * length
                rank[length] += n * times
                counts[length] -= n * times
            bins += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def packed(parts: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """parts (a written table, whose row numbers are the same each time; its column `length` is at most capacity) with `sequence_id` and `offset`."""
    parts = parts.drop("sequence_id", "offset")
    names, bucket = parts.columns, common.fresh(parts, "_bucket")
    total = parts.count()
    buckets = max(1, -(-total // bucket_rows))
    dealt = parts.withColumn(bucket, F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in names], F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    cells = common.written(dealt.groupBy(bucket, "length").agg(F.count(F.lit(1)).alias("count")), "length-counts")
    histogram = {int(n): int(c) for n, c in cells.groupBy("length").agg(F.sum("count")).collect()}  # capacity rows at most
    rules = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select(bucket, "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    reach = (1 << 62) // (capacity + 1)
    codes = rules[:, 0] * reach + rules[:, 1]

    def place(rows: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=bucket).sort_values(["length", *[x for x in names if x != "length"]], kind="stable").reset_index(drop=True)
        length = rows["length"].to_numpy(np.int64)
        at = np.arange(len(rows)) - np.searchsorted(length, length)
        rank = at + first.set_index("length")["first"].reindex(length).to_numpy(np.int64)
        rule = rules[np.searchsorted(codes, length * reach + rank, side="right") - 1]
        nth = rank - rule[:, 1]
        rows["sequence_id"] = rule[:, 2] + nth // rule[:, 3]
        rows["offset"] = rule[:, 4] + nth % rule[:, 3] * length
        return rows

    schema = parts.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return dealt.groupBy(bucket).cogroup(firsts.groupBy(bucket)).applyInPandas(place, schema)


def op9_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    with common.scratch(spark) as kept:
        return kept(packed(common.written(pieces(common.documents(spark, sf_dir)), "pieces")), "packed")

"""Operator 3: token-id files in canonical length-limited Huffman code.

Global counts of all ids give code lengths of at most 16 bits (package-merge: the best such code); codes
are canonical, so the lengths are all that a file's header holds.  Documents lie in ascending order of
their key.  A file is a Parquet table of segments: keys and lengths of its documents, the bit stream, and
the bit offset of every 256th id.  Each of these blocks can be decoded alone; a reader decodes all blocks
of a segment side by side, an id of each at a time, from one table of 2^16 entries.

Defined results: a null text is an empty document (the end id alone); null keys come first; rows with the
same key lie in order of a hash of their ids, however many they are (their range is cut there, and among equal rows
by row number, so no key has to fit in a task); an empty table gives no segments; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MOST_BITS = 16
BLOCK = 256
SEGMENT_IDS = 1 << 18


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key and `ids` (16-bit little-endian, the end id last)."""
    path = vocabulary or tokens.vocabulary_path()
    end = np.array([tokens.END_ID], dtype="<u2").tobytes()

    def run(batches):
        encoder = tokens.encoder(path)
        for whole in batches:
            for batch in common.slices(whole, text):
                made = [x + end for x in encoder.encode(batch.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(made, pa.binary())], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary")


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows; 65,536 numbers at most reach the driver."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for i, n in ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    return counts


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Bits of each symbol's code, at most `most`, of the least total (package-merge); 0: does not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError("more symbols than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    level, from_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        from_leaf.append(order < len(leaves))
    take = 2 * (len(leaves) - 1)
    for is_leaf in reversed(from_leaf):
        n = int(is_leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: shorter codes first, then by symbol."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    steps = np.int64(1) << (MOST_BITS - lengths[order].astype(np.int64))
    codes[order] = (np.cumsum(steps) - steps) >> (MOST_BITS - lengths[order].astype(np.int64))
    return codes


def decoding_table(lengths: np.ndarray) -> np.ndarray:
    """For the next 16 bits of a stream: symbol << 5 | bits of its code."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    bits = lengths[order].astype(np.int64)
    table = np.repeat(order << 5 | bits, np.int64(1) << (MOST_BITS - bits))
    return np.pad(table, (0, (1 << MOST_BITS) - len(table))).astype(np.int32)


def to_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids, and the bit offset of every BLOCK-th of them."""
    size, code = lengths[ids].astype(np.int64), codes[ids].astype(np.uint64)
    end = np.cumsum(size)
    at = end - size
    over = (at & 63) + size - 64  # bits that reach into the next word
    word = at >> 6
    up, down = np.maximum(-over, 0).astype(np.uint64), np.maximum(over, 0).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[: len(first)] = np.bitwise_or.reduceat((code >> down) << up, first)
    spill = np.flatnonzero(over > 0)
    words[word[spill] + 1] |= code[spill] << (np.uint64(64) - down[spill])
    return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], at[::BLOCK]


def from_bits(stream: bytes, offsets: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The n ids of a stream; all its blocks are decoded side by side."""
    raw = np.frombuffer(stream + bytes(BLOCK * MOST_BITS // 8 + 8), np.uint8).astype(np.int32)
    window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    at, out = offsets.astype(np.int64), np.empty((BLOCK, len(offsets)), np.uint16)
    for k in range(BLOCK):
        found = table[(window[at >> 3] >> (8 - (at & 7))) & 0xFFFF]
        out[k] = found >> 5
        at += found & 31
    return out.T.ravel()[:n]


def write_ids(ids: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write ids (key, `ids`) in ascending order of key: path/code holds the code lengths, path/segments the segments."""
    spark = ids.sparkSession
    counts = id_counts(ids)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    spark.createDataFrame([(bytes(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    names = ["part", "seq", "first", "n_ids", "keys", "counts", "offsets", "stream"]

    def run(batches):
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        keys, held, size = [], [], 0

        def segment():
            data = np.frombuffer(b"".join(held), "<u2")
            stream, offsets = to_bits(data, lengths, codes)
            row = [part, seq, first, len(data), keys, [len(x) // 2 for x in held], offsets.astype("<u8").tobytes(), stream]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                held.append(data)
                size += len(data) // 2
                if size >= SEGMENT_IDS:
                    yield segment()
                    seq, first = seq + 1, first + size
                    keys, held, size = [], [], 0
        if held:
            yield segment()

    simple = ids.schema[key].dataType.simpleString()
    by = ["key", "_hash", "_row"]
    rows = ids.select(F.col(key).alias("key"), "ids", F.xxhash64("ids").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(common.partitions_for(spark, 2 * int(counts.sum())), *by).sortWithinPartitions(*by).select("key", "ids")
    made = ordered.mapInArrow(run, f"part int, seq int, first long, n_ids long, keys array<{simple}>, counts array<long>, offsets binary, stream binary")
    with common.small_batches(spark):
        made.write.option("compression", "uncompressed").parquet(f"{path}/segments")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """key, `start` (ids of all documents before it), `n_tokens`, and `ids` (32-bit little-endian) or, with digest, their `ids_crc32`."""
    segments = spark.read.parquet(f"{path}/segments")
    table = decoding_table(np.frombuffer(spark.read.parquet(f"{path}/code").first()[0], np.uint8))
    totals = dict(segments.groupBy("part").agg(F.sum("n_ids")).collect())  # a number for each part
    base, so_far = {}, 0
    for part in sorted(totals):
        base[part] = so_far
        so_far += totals[part]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, n, keys, counts, offsets, stream = (batch.column(k)[i] for k in range(7))
                ids = from_bits(stream.as_py(), np.frombuffer(offsets.as_py(), "<u8"), n.as_py(), table).astype("<u4").tobytes()
                counts = np.asarray(counts.values)
                stop = np.cumsum(counts)
                start = stop - counts
                view = memoryview(ids)
                cut = [view[4 * a : 4 * b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                last = pa.array([common.crc_of(x) for x in cut], pa.int64()) if digest else pa.array([bytes(x) for x in cut], pa.binary())
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(start + (base[part.as_py()] + first.as_py())), pa.array(counts), last], names)

    names = ["key", "start", "n_tokens", "ids_crc32" if digest else "ids"]
    kind = segments.schema["keys"].dataType.elementType.simpleString()
    return segments.select("part", "first", "n_ids", "keys", "counts", "offsets", "stream").mapInArrow(run, f"key {kind}, start long, n_tokens long, {names[3]} " + ("long" if digest else "binary"))


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids through the file format and back."""
    with common.scratch(spark) as kept:
        path = common.table_path(spark, "ids")
        write_ids(common.written(tokenised(common.documents(spark, sf_dir)), "tokenised"), path)
        return kept(read_ids(spark, path, digest=True).withColumnRenamed("key", "doc_id"), "id-digests")

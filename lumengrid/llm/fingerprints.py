"""Operator 4: Lempel-Ziv phrase fingerprints.

A document's UTF-8 bytes are parsed from left to right into dictionary phrases: the shortest string that
is not yet in the document's dictionary is the next phrase and enters it.  The dictionary is a trie in one
hash table, so each byte costs one look-up and the parse of a text goes on from the parse of its beginning.
Each phrase has a 61-bit hash made from its parent's.  The fingerprint is the minimum-hash signature of the
phrase set: its SIZE smallest mixed hashes, 32 bits of each, in hex.  Two fingerprints are compared by the
share of the SIZE smallest hashes of their union that both hold: an estimate of the phrase sets' Jaccard
similarity (exact for sets of SIZE phrases or less), which falls as the texts compress less well together.

Defined results: a null text is an empty one; an empty text has the empty fingerprint, like 1.0 to another
empty one and 0.0 to others; equal texts have equal fingerprints; rows with the same key follow each other in order
of a hash of their texts; with one row the next document is itself; null keys come first; a key of very many rows
is cut into several ranges by that hash; rows of one key and one text share a task; texts are whole, however long;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZE = 64
#: A row counts once more for every so many bytes of its text where ranges are cut.
WEIGHT = 16 << 10
_MASK = (1 << 61) - 1
_STEP = 1_000_003


class Phrases:
    """The phrases of a text's beginning, and how far the unfinished phrase goes."""

    def __init__(self, data: bytes = b""):
        self.trie: dict[int, int] = {}
        self.hashes = [0]
        self.node = 0
        self.parse(data)

    def copy(self) -> Phrases:
        new = Phrases()
        new.trie, new.hashes, new.node = self.trie.copy(), self.hashes.copy(), self.node
        return new

    def parse(self, data: bytes) -> Phrases:
        trie, hashes, node = self.trie, self.hashes, self.node
        get = trie.get
        for x in data:
            found = get(node + x)
            if found is None:
                trie[node + x] = len(hashes) << 8
                hashes.append((hashes[node >> 8] * _STEP + x + 1) & _MASK)
                node = 0
            else:
                node = found
        self.node = node
        return self

    def signature(self) -> np.ndarray:
        """The SIZE smallest mixed hashes of the phrases, ascending."""
        x = np.array(self.hashes[1:], np.uint64)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        return np.unique(x)[:SIZE].astype(">u4")


def fingerprint(text: str | None) -> str:
    return Phrases((text or "").encode()).signature().tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SIZE]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / len(union)


def ranges(docs: DataFrame, key: str, parts: int) -> DataFrame:
    """docs (with `_h`, a hash of the text) and `_range`: at most `parts` ranges of ascending (key, _h) with about as many
    rows and bytes of text each."""
    known = F.col(key).cast("double")
    weight = F.explode(F.sequence(F.lit(0), F.expr(f"octet_length(text) div {WEIGHT}").cast("int")))
    found = docs.filter(known.isNotNull()).select(known.alias("k"), weight).approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds, times = np.unique(np.array(found or [], float), return_counts=True)
    if not len(bounds):
        return docs.withColumn("_range", F.lit(0))
    # the place of a key among the bounds, by binary search; a key that is `times` bounds at once has as many ranges and one more
    placed = Bucketizer(splits=[-np.inf, *bounds.tolist(), np.inf], inputCol="_known", outputCol="_place", handleInvalid="keep").transform(docs.withColumn("_known", F.coalesce(known, F.lit(-np.inf))))
    before = np.concatenate([[0], np.cumsum(times)]).tolist()  # ranges before each place
    first = F.element_at(F.array(*[F.lit(int(x)) for x in before]), (F.col("_place") + 1).cast("int"))
    many = [(b, int(n)) for b, n in zip(bounds.tolist(), times.tolist(), strict=True) if n > 1]
    if many:
        part = F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * (F.element_at(F.create_map(*[F.lit(x) for pair in many for x in pair]), F.col("_known")) + 1))
        n = F.element_at(F.create_map(*[F.lit(x) for pair in many for x in pair]), F.col("_known"))
        first = F.when(n.isNotNull(), first - n + F.least(part, n)).otherwise(first)
    return placed.withColumn("_range", first.cast("int")).drop("_known", "_place")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness (see op4's contract).

    Rows lie in ranges of ascending keys; the first row of the next range that has rows travels to the range
    before it as well.  A task reads its rows in order and holds two texts at a time.  key is a number.
    """
    spark = docs.sparkSession
    parts = common.partitions_for(spark, common.in_bytes(docs, text)[1])
    kind = docs.schema[key].dataType.simpleString()
    placed = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    placed = ranges(placed.withColumn("_h", F.xxhash64("text")), "key", parts)
    first = placed.groupBy("_range").agg(F.min(F.struct(F.col("key").isNotNull(), F.col("key"), F.col("_h"))).alias("head"))
    heads = sorted((r, h["key"], h["_h"]) for r, h in first.collect())  # a key and a hash for each range
    sent = [(r, k, h, heads[i - 1][0]) for i, (r, k, h) in enumerate(heads)]  # the first range's head follows the last range
    sent = spark.createDataFrame(sent, f"_r int, _k {kind}, _kh long, _before int")
    extra = placed.join(F.broadcast(sent), (F.col("_range") == F.col("_r")) & F.col("key").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_kh")))
    extra = extra.select("key", "text", "_h", F.col("_before").alias("_range"), F.lit(True).alias("_follows")).dropDuplicates(["_range"])
    both = placed.withColumn("_follows", F.lit(False)).unionByName(extra)
    sorted_rows = both.repartition(parts, "_range").sortWithinPartitions("_range", "_follows", "key", "_h").select("key", "text", "_range", "_follows")
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        range_now = before = None  # before: (key, text, kept part, its phrases, signature) of the row before
        for batch in batches:
            out: list[tuple] = []
            for k, t, r, follows in (row for part in common.slices(batch, "text") for row in zip(*[x.to_pylist() for x in part.columns], strict=True)):
                if r != range_now:
                    range_now, before = r, None
                elif before is None:
                    continue  # a copy of a row that has followed already
                cut = len(t) - len(t) // 4
                phrases = Phrases(t[:cut].encode())
                mine = phrases.copy().parse(t[cut:].encode()).signature()
                if before is not None:
                    k0, t0, kept, phrases0, mine0 = before
                    new = t[: len(t0) // 4]
                    edited = phrases0.parse(new.encode()).signature()
                    sha = hashlib.sha256((kept + new).encode()).hexdigest()
                    out.append((k0, len(t0), sha, mine0.tobytes().hex(), edited.tobytes().hex(), likeness(mine0, edited), likeness(mine0, mine)))
                before = None if follows else (k, t, t[:cut], phrases, mine)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, [batch.schema.field(0).type, *types], strict=True)], names)

    return sorted_rows.mapInArrow(run, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_lz_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lempel-Ziv fingerprints of all documents and of their edited texts."""
    with common.scratch(spark) as kept:
        return kept(with_next(common.documents(spark, sf_dir)), "fingerprints")

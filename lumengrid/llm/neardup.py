"""Operator 2: near-duplicates by b-bit MinHash.

Words are runs of other characters than white space (A-Z lower-cased); a document's set holds its distinct
5-word shingles as 64-bit hashes (with fewer words, the whole sequence as one).  PERMUTATIONS minima are cut
into bands whose equal values make candidates; of every minimum only the BITS low bits stay, packed into
longs.  Candidates first pass an estimate from the packed signatures (bit counts, corrected for chance
collisions, a margin of five standard errors), then a comparison of the full sets: linked is who has
100 * intersection >= 75 * union.

Equal sets are one node.  Two rounds compare every bucket's rows with one pivot (the row with the most candidates;
in round two, of another component).  Buckets whose rows are by then one component are done.  Of the rest no bucket is
held by one task and no text is copied: their rows get signatures of FINE one-bit minima (256 bytes), whose estimates
err by a seventieth, and these are compared in blocks of BLOCK by BLOCK rows.  Each row names the PARTNERS likeliest
rows of other components whose estimate passes; these pairs' full sets are compared and components joined, and so on
until a round links nothing: of a group of near copies few pairs are compared.  Rows of buckets that then still have
partners left in other components (texts with a passage that makes them nearly, but not quite, alike) are compared
with all of them, in blocks of SMALL by SMALL rows with their texts.  So no candidate link between different components
is lost.  A bucket of n rows that are of many components to the end costs n^2 / 2 comparisons of signatures in each
round, and n / SMALL copies of its texts in the last stage (see the README for figures).  Components are found by
alternating large-star and small-star steps over tables in the shared folder.

A pair at similarity 0.75 shares no band with probability (1 - 0.75^ROWS)^(PERMUTATIONS / ROWS) = 2e-5.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; rows with the
same key are one node; a row without a key is linked with nothing, its component is null and it is kept; an
empty table gives no rows; equal estimates or candidates in any order give the same components; texts are whole,
however long; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH, PERCENT = 5, 75
PERMUTATIONS, ROWS, BITS, BLOCK = 200, 5, 4, 2_000
FINE, PARTNERS, SMALL = 2_048, 4, 600
_LONGS = -(-PERMUTATIONS * BITS // 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A, _B = np.random.default_rng(2_027).integers(0, 1 << 32, (2, PERMUTATIONS), dtype=np.uint32)
_A |= np.uint32(1)
_PLACE = np.random.default_rng(2_028).integers(0, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
#: Estimates may be this much below the threshold: five standard errors.
_MARGIN = 5 * (0.25 * (0.75 + 1 / (2**BITS - 1)) / PERMUTATIONS) ** 0.5
_FINE_A, _FINE_B = np.random.default_rng(2_029).integers(0, 1 << 32, (2, FINE), dtype=np.uint32)
_FINE_A |= np.uint32(1)
_FINE_MARGIN = 5 * 2 * (0.875 * 0.125 / FINE) ** 0.5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def shingles(text: str | None) -> np.ndarray:
    """The document's set: sorted 64-bit hashes."""
    global _POWERS
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)  # bytes.lower() turns A-Z only
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    most = int((ends - starts).max())
    if most > len(_POWERS):
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, _BASE)]))
    offset = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if not starts[0] else np.arange(len(raw)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(raw))))])
    value = np.where(inside, (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[np.where(inside, offset, 0)], np.uint64(0))
    words = _mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    n = min(WIDTH, len(words))
    joined = sum(words[i : len(words) - n + 1 + i] * _PLACE[i] for i in range(n))
    return np.unique(_mixed(joined + np.uint64(n)))


def minima(shingle_set: np.ndarray) -> np.ndarray:
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 2048):
        np.minimum(out, (x[at : at + 2048, None] * _A + _B).min(0), out=out)
    return out


def fine(shingle_set: np.ndarray) -> np.ndarray:
    """The lowest bit of each of FINE minima, in longs."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = np.full(FINE, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 256):
        y = x[at : at + 256, None] * _FINE_A + _FINE_B
        np.minimum(out, (y ^ y >> np.uint32(15)).min(0), out=out)  # low bits of a product alone are not random
    return np.packbits((out & np.uint32(1)).astype(np.uint8), bitorder="little").view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The BITS low bits of each minimum, in longs."""
    per = 64 // BITS
    low = np.pad(low.astype(np.uint64) & np.uint64(2**BITS - 1), (0, _LONGS * per - PERMUTATIONS)).reshape(_LONGS, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_shingles, `same` (a 128-bit digest of the set), `bands` and the packed signature `bits`."""
    names = ["key", "n_shingles", "same", "bands", "bits"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, same, bands, bits = [], [], [], []
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = shingles(t)
            sizes.append(len(found))
            if not len(found) or k is None:
                same.append(None), bands.append(None), bits.append(None)
                continue
            low = minima(found)
            same.append(xxhash.xxh3_128_digest(found.tobytes()))
            rows = low.reshape(-1, ROWS)
            bands.append([xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) - (1 << 63) for i, r in enumerate(rows)])
            bits.append(packed(low).tolist())
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, longs), pa.array(bits, longs)], names)

    kind = docs.schema[key].dataType.simpleString()
    return common.mapped(docs.select(key, text), f"key {kind}, n_shingles long, same binary, bands array<long>, bits array<long>", each)


def estimate(a: str, b: str):
    """Similarity from two packed signatures, corrected for low bits that are equal by chance."""
    nibbles = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x ^ y), 0L, (n, x) -> n + bit_count((x | shiftright(x, 1) | shiftright(x, 2) | shiftright(x, 3)) & {0x1111111111111111}L))")
    equal = 1 - nibbles / PERMUTATIONS
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def verified(pairs: DataFrame, bits: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as a table; the pairs are read in order of b."""
    left, right = bits.select(F.col("key").alias("a"), F.col("bits").alias("bits_a")), bits.select(F.col("key").alias("b"), F.col("bits").alias("bits_b"))
    near = pairs.join(left, "a").join(right, "b").filter(estimate("bits_a", "bits_b") >= PERCENT / 100 - _MARGIN)
    near = common.written(near.select("a", "b"), "near-pairs")
    full = near.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        last = None
        for batch in (part for whole in batches for half in common.slices(whole, "text_a") for part in common.slices(half, "text_b")):
            good = []
            for a, b, ta, tb in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if last is None or last[0] != b:
                    last = (b, shingles(tb))
                good.append(linked(shingles(ta), last[1]))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return common.written(full.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}"), "links")


#: Links of a task of the component search: few links are few tasks, however many partitions a shuffle has.
LINKS = 100_000


def components(links: DataFrame) -> DataFrame:
    """`key` and `root` (the smallest key that links reach) of every key in links (a, b) but for the roots, as a table."""
    edges = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    tasks = edges.count() // LINKS + 1
    kept = lambda df, name: common.written(df.coalesce(tasks), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "minima")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = kept(large, "large-star")
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
        before = state


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def estimates(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of the fine signature x to each of others: bits that are equal by chance are taken off."""
    return 1 - 2 * np.bitwise_count(others ^ x).sum(1, dtype=np.int64) / FINE


def fine_signatures(texts: DataFrame, kind: str) -> DataFrame:
    """`key` and `bits` of texts (key, text), as a table."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fine(shingles(t)).tolist() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["key", "bits"])

    return common.written(common.mapped(texts.select("key", "text"), f"key {kind}, bits array<long>", each), "fine")


def cells(rows: DataFrame, block: int) -> DataFrame:
    """rows (band, key, root) once for each pair of blocks (i, j) that theirs, `c`, is one of; bands of the same rows once."""
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("key") % 1_000_003).alias("h1"), F.bit_xor(F.xxhash64("key")).alias("h2"))
    once = common.written(sizes.groupBy("n", "h1", "h2").agg(F.min("band").alias("band")).withColumn("chunks", F.ceil(F.col("n") / block).cast("int")).select("band", "chunks"), "blocks")
    chunk = F.pmod(F.xxhash64(F.lit(3), "key"), F.col("chunks")).cast("int")
    placed = rows.join(once, "band").withColumn("c", chunk)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
    return placed.select("band", "key", "root", "c", other).select("band", "key", "root", "c", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))


def in_blocks(rows: DataFrame, signed: DataFrame, kind: str, cap: int = PARTNERS) -> DataFrame:
    """Pairs (band, a, b) of rows (band, key, root) of the same band and of different roots whose estimate passes, and
    whether there are `more` in the band's block, as a table: of each row its `cap` likeliest partners.

    Rows of the component that most rows of a block are of name none: the other side of each of their pairs does.
    """

    def compare(cell: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        most = part["root"].mode().iat[0]
        left, right, more = [], [], False
        for side in sorted({0, cell[2] - cell[1]}):  # rows of chunk i name rows of chunk j, and the other way round
            mine, others = part[part["c"] == cell[1 + (side > 0)]], part[part["c"] == cell[2 - (side > 0)]]
            mine = mine[mine["root"] != most]
            if not len(mine) or not len(others):
                continue
            words = np.stack(others["bits"].to_numpy()).view(np.uint64)
            names, roots = others["key"].to_numpy(), others["root"].to_numpy()
            for k, r, x in zip(mine["key"], mine["root"], mine["bits"], strict=True):
                guess = estimates(np.asarray(x).view(np.uint64), words)
                found = np.flatnonzero((guess >= PERCENT / 100 - _FINE_MARGIN) & (roots != r))
                more |= len(found) > cap
                found = found[np.argsort(-guess[found], kind="stable")[:cap]]
                left += [k] * len(found)
                right += names[found].tolist()
        return pd.DataFrame({"band": [cell[0]] * len(left), "a": np.minimum(left, right), "b": np.maximum(left, right), "more": [more] * len(left)})

    found = cells(rows, BLOCK).join(signed, "key").groupBy("band", "i", "j").applyInPandas(compare, f"band long, a {kind}, b {kind}, more boolean")
    return common.written(found, "block-pairs")


def in_small_blocks(rows: DataFrame, signed: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """Links between rows (band, key, root) of the same band and of different roots: all pairs whose estimate passes
    and whose components no link of the block has joined are compared on their full sets."""

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key").reset_index(drop=True)
        names, roots, owner = part["key"].tolist(), part["root"].tolist(), {x: x for x in part["root"]}
        words, sets, found = np.stack(part["bits"].to_numpy()).view(np.uint64), {}, []

        def find(x):
            while owner[x] != x:
                owner[x] = owner[owner[x]]
                x = owner[x]
            return x

        def full(i):
            if i not in sets:
                sets[i] = shingles(part["text"].iat[i])
            return sets[i]

        for i in range(len(part) - 1):
            near = np.flatnonzero(estimates(words[i], words[i + 1 :]) >= PERCENT / 100 - _FINE_MARGIN) + i + 1
            for j in near.tolist():
                a, b = find(roots[i]), find(roots[j])
                if a != b and linked(full(i), full(j)):
                    owner[a] = b
                    found.append((names[i], names[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    held = cells(rows, SMALL).join(signed, "key").join(texts.select("key", "text"), "key")
    return common.written(held.groupBy("band", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}"), "block-links")


def linked_in_blocks(rows: DataFrame, bits: DataFrame, texts: DataFrame, kind: str) -> DataFrame | None:
    """All links (a, b) that rows (band, key, root) of shared bands need to become the components they belong to."""
    links = None
    if rows.isEmpty():
        return None
    signed = fine_signatures(texts.join(rows.select("key").distinct(), "key", "left_semi"), kind)
    while not rows.isEmpty():
        pairs = in_blocks(rows, signed, kind)
        found = verified(common.written(pairs.select("a", "b").distinct(), "new-pairs"), bits, texts, kind)
        left = common.written(pairs.filter("more").select("band").distinct(), "open")
        if left.isEmpty() or found.isEmpty():
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
            if not left.isEmpty():
                last = in_small_blocks(common.written(rows.join(left, "band", "left_semi"), "rooted"), signed, texts, kind)
                links = last if links is None else links.unionByName(last)
            break
        links = found if links is None else common.written(links.unionByName(found), "links")
        # the links between roots: components of these, few, are enough to go on with
        root = lambda k: rows.select(F.col("key").alias(k), F.col("root").alias(f"r{k}")).distinct()
        between = found.join(root("a"), "a").join(root("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        joined = components(between).select(F.col("key").alias("root"), F.col("root").alias("top"))
        rows = common.written(rows.join(joined, "root", "left").select("band", "key", F.coalesce("top", "root").alias("root")), "rooted")
        several = rows.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("band")
        rows = common.written(rows.join(several.join(left, "band"), "band", "left_semi"), "rooted")
    return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable) and kept for every row, as a table."""
    with common.scratch(docs.sparkSession) as kept:
        return kept(_near_duplicates(docs, key, text), "near-duplicates")


def _near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    signed = common.written(signatures(docs, key, text), "signatures")
    usable = signed.filter(F.col("same").isNotNull())
    groups = common.written(usable.groupBy("same").agg(F.min("key").alias("node")), "equal-sets")
    members = common.written(usable.select("key", "n_shingles", "same").join(groups, "same").select("key", "n_shingles", "node"), "members")
    nodes = usable.join(groups.select(F.col("node").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    nodes = common.written(nodes.select("key", "bands", "bits"), "nodes")
    banded = nodes.select("key", F.explode("bands").alias("band"))
    shared = common.written(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-bands")
    rows = common.written(banded.join(shared, "band"), "candidates")
    degree = common.written(rows.groupBy("key").agg(F.sum("n").alias("degree")), "degrees")
    bits = common.written(nodes.select("key", "bits").join(degree.select("key"), "key", "left_semi"), "bits")
    needed = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(degree.select("key"), "key", "left_semi").dropDuplicates(["key"])
    texts = common.written(needed, "texts")
    rows = common.written(rows.select("band", "key").join(degree, "key").withColumn("root", F.col("key")), "candidates")
    links = None
    for _ in range(2):
        best = F.max(F.struct("degree", "key", "root"))
        pivots = common.written(rows.groupBy("band").agg(best.alias("p")).select("band", F.col("p.key").alias("b"), F.col("p.root").alias("rb")), "pivots")
        pairs = rows.join(pivots, "band").filter("key <> b and root <> rb").select(F.col("key").alias("a"), "b").distinct()
        found = verified(common.written(pairs, "pairs"), bits, texts, kind)
        links = found if links is None else common.written(links.unionByName(found), "links")
        roots = components(links)
        # what is left: bands of three rows or more (two have met their pivot) and of two components or more;
        # the next pivot is of a component that the last one was not of
        rooted = common.written(_with_roots(rows.drop("root"), roots), "rooted")
        open_bands = rooted.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2")).filter("n > 2 and r1 <> r2").select("band")
        left = common.written(open_bands.join(pivots.select("band", "b"), "band"), "open")
        rows = rooted.join(left, "band").withColumn("degree", F.when(F.col("key") == F.col("b"), F.lit(0)).otherwise(F.col("degree")))
        rows = common.written(rows.select("band", "key", "degree", "root"), "candidates")
    found = linked_in_blocks(rows.select("band", "key", "root"), bits, texts, kind)
    if found is not None:
        roots = components(common.written(links.unionByName(found), "links"))
    found = members.join(roots.select(F.col("key").alias("node"), "root"), "node", "left").withColumn("own", F.coalesce("root", "node"))
    alone = signed.filter(F.col("same").isNull()).select("key", "n_shingles", F.col("key").alias("own"))
    found = found.select("key", "n_shingles", "own").unionByName(alone)
    own = F.col("own")
    return found.select(F.col("key").alias(key), "n_shingles", own.alias("component_id"), F.coalesce(F.col("key") == own, F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that near_duplicates keeps; rows without a key stay."""
    name = common.fresh(docs, "_kept")
    kept = near_duplicates(docs, key, text).filter("kept").select(F.col(key).alias(name)).filter(F.col(name).isNotNull()).distinct()
    return docs.join(kept, F.col(f"`{key}`") == F.col(name), "left_semi").unionByName(docs.filter(F.col(f"`{key}`").isNull()))


#: Exact sets, all pairs that share a shingle, and what links reach: an independent way to the same rows on small tables.
SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
    from words
), shingles as (
    select doc_id, unnest(s) as g from sets
), common as (
    select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
    select c.a, c.b from common c join sets x on x.doc_id = c.a join sets y on y.doc_id = c.b where 100 * c.n >= 75 * (len(x.s) + len(y.s) - c.n)
), edges as (
    select a, b from links union all select b, a from links
), reached as (
    select doc_id, doc_id as root from documents
    union
    select e.b, r.root from reached r join edges e on e.a = r.doc_id where r.root < e.b
), least as (
    select doc_id, min(root) as component_id from reached group by 1
)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join least using (doc_id)
"""


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(common.documents(spark, sf_dir))

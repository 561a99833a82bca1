import itertools
import random
import re

import numpy as np
import pytest

from lumengrid.llm import neardup
from lumengrid.llm.registry import QUERIES

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UP))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts):
    """component of each key, by comparing all pairs."""
    sets = {k: word_sets(t) for k, t in texts.items()}
    owner = {k: k for k in texts}

    def find(k):
        while owner[k] != k:
            k = owner[k]
        return k

    where = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    for a, b in {p for ks in where.values() for p in itertools.combinations(ks, 2)}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            u, v = find(a), find(b)
            owner[max(u, v)] = min(u, v)
    return sets, {k: find(k) for k in texts}


def check(rows, texts):
    sets, component = brute(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == component[r.doc_id], r.doc_id
        assert r.kept == (r.doc_id == r.component_id)


def test_all_documents(spark, data, texts):
    check(QUERIES["op2_bbit_minhash"](spark, data).collect(), texts)


def test_groups_chains_and_shared_passages(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    texts, base = {}, [rng.choice(words) for _ in range(120)]
    for i in range(60):  # copies of one text with edits
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(120)] = rng.choice(words)
        texts[len(texts)] = " ".join(t)
    chain = [rng.choice(words) for _ in range(100)]
    for i in range(12):  # a chain whose ends are far apart
        chain = chain[4:] + [rng.choice(words) for _ in range(4)]
        texts[len(texts)] = " ".join(chain)
    passage = [rng.choice(words) for _ in range(60)]
    for i in range(40):  # unlike texts with a common passage
        texts[len(texts)] = " ".join(passage + [rng.choice(words) for _ in range(rng.randint(20, 60))])
    texts |= {200: "A b C d e", 201: "a B c D e", 202: "a b c", 203: "a b c", 204: "", 205: "   ", 206: None, 207: "a b c d e"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    check(neardup.near_duplicates(docs).collect(), texts)


def test_blocks_link_what_pivots_leave(spark):
    """A band of many rows is compared in several blocks."""
    rng = random.Random(5)
    groups = [[f"g{g}x{rng.randrange(99999)}" for _ in range(80)] for g in range(30)]
    texts = {}
    for g, t in enumerate(groups):
        texts[2 * g] = " ".join(t)
        texts[2 * g + 1] = " ".join(t[:-3])
    ids = sorted(texts)
    rows = spark.createDataFrame([(1, k, k) for k in ids], "band long, key long, root long")
    bits = spark.createDataFrame([(k, neardup.fine(neardup.shingles(texts[k])).tolist()) for k in ids], "key long, bits array<long>")
    block, neardup.BLOCK = neardup.BLOCK, 13
    try:
        got = {(r.a, r.b) for r in neardup.in_blocks(rows, bits, "bigint", 1).collect()}
        held = spark.createDataFrame(list(texts.items()), "key long, text string")
        links = {(r.a, r.b) for r in neardup.linked_in_blocks(rows, bits, held, "bigint").collect()}
    finally:
        neardup.BLOCK = block
    assert got == links == {(2 * g, 2 * g + 1) for g in range(30)}


def test_links_among_many_that_fail(spark):
    """Texts near the threshold: most pairs pass the estimate and fail, and each text has its one partner hidden among them."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = {}
    for g in range(24):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(150)] = f"g{g}x{rng.randrange(999)}"
        texts[2 * g] = " ".join(t)
        texts[2 * g + 1] = " ".join(t[: 150 - g % 3])
    sets, component = brute(texts)
    ids = sorted(texts)
    rows = spark.createDataFrame([(b, k, k) for b in (1, 2) for k in ids if b == 1 or k % 3], "band long, key long, root long")
    bits = spark.createDataFrame([(k, neardup.packed(neardup.minima(neardup.shingles(texts[k]))).tolist()) for k in ids], "key long, bits array<long>")
    held = spark.createDataFrame(list(texts.items()), "key long, text string")
    links = neardup.linked_in_blocks(rows, bits, held, "bigint")
    roots = {r.key: r.root for r in neardup.components(links).collect()}
    assert {k: roots.get(k, k) for k in ids} == component


def test_sql_and_query_agree(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = sorted(con.execute(neardup.SQL).fetchall())
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in QUERIES["op2_bbit_minhash"](spark, data).collect()) == want


def test_hot_band_of_unlike_texts_and_late_links(spark):
    """A passage that makes up most of the minima of 400 texts, and pairs among them that only the block comparison links."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(90)]
    texts = {}
    for i in range(200):
        own = [f"o{i}w{k}" for k in range(70)]
        texts[2 * i] = " ".join(passage + own)
        texts[2 * i + 1] = " ".join(passage + own[:-6] + [f"z{rng.random()}"] * 6)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    block, neardup.BLOCK = neardup.BLOCK, 60
    try:
        check(neardup.near_duplicates(docs).collect(), texts)
    finally:
        neardup.BLOCK = block


def test_fine_estimates_are_nearer():
    rng = np.random.default_rng(4)
    off = []
    for share in (0.3, 0.6, 0.75, 0.9):
        for _ in range(12):
            common = rng.integers(1, 1 << 62, 400).astype(np.uint64)
            n = int(800 * share / (1 + share))
            a = np.unique(np.concatenate([common[:n], rng.integers(1, 1 << 62, 400 - n).astype(np.uint64)]))
            b = np.unique(np.concatenate([common[:n], rng.integers(1, 1 << 62, 400 - n).astype(np.uint64)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            off.append(neardup.estimates(neardup.fine(a).view(np.uint64), neardup.fine(b).view(np.uint64)[None])[0] - true)
    assert max(map(abs, off)) < neardup._FINE_MARGIN and abs(np.mean(off)) < 0.012


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.9):
        common = rng.integers(1, 1 << 62, 2000).astype(np.uint64)
        n = int(2000 * share)
        a = np.unique(np.concatenate([common[:n], rng.integers(1, 1 << 62, 2000 - n).astype(np.uint64)]))
        b = np.unique(np.concatenate([common[:n], rng.integers(1, 1 << 62, 2000 - n).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        df = spark.createDataFrame([(neardup.packed(neardup.minima(a)).tolist(), neardup.packed(neardup.minima(b)).tolist())], "x array<long>, y array<long>")
        assert df.select(neardup.estimate("x", "y")).first()[0] == pytest.approx(true, abs=0.16)


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (7, 7)], "a long, b long")
    got = {r.key: r.root for r in neardup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90}


def test_edge_rows(edges, empty):
    rows = neardup.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert by[8].component_id == 7 and not by[8].kept
    for k in (1, 2, 3):
        assert by[k].n_shingles == 0 and by[k].component_id == k and by[k].kept
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    left = neardup.without_near_copies(edges)
    assert left.columns == edges.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in edges.collect() if r.doc_id != 8)
    assert neardup.near_duplicates(empty).count() == 0

import heapq
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumengrid.llm import common, idfiles, packing, tokens

WEIRD = ["a  b\n\n c's 'sx ''s don't  \n", "  x", "é½ x", "a\t\tb  ", "x 12a3 ..'s", "\r\n\r\nq", " 's", "a\nb c\n", "\n x", "x ", "", " ", "don'\nt's", "<|endoftext|>", "漢字 ​ x", "a b", "ẞ ſ ﬁ"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.vocabulary_path())


def library(encoder, text):
    return encoder.library.encode(text or "", add_special_tokens=False).ids


def ids_of(data):
    return np.frombuffer(data, "<u2").tolist()


def test_encoder_equals_library(encoder, texts):
    for t in [*WEIRD, *texts.values()]:
        assert ids_of(encoder.encode([t])[0]) == library(encoder, t)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\t'abcst19.,!é漢_-", max_size=40))
def test_encoder_equals_library_on_any_text(text):
    encoder = tokens.encoder(tokens.vocabulary_path())
    assert ids_of(encoder.encode([text])[0]) == library(encoder, text)


def test_full_dictionaries_start_anew(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    for t in ["one two three four five six", "seven one eight two nine"]:
        assert ids_of(encoder.encode([t])[0]) == library(encoder, t)


def huffman_bits(counts):
    heap = [(n, i) for i, n in enumerate(counts) if n]
    heapq.heapify(heap)
    total, tick = 0, len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], tick := tick + 1))
    return total


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 200)
    lengths = idfiles.code_lengths(counts, 16)
    assert (counts * lengths).sum() == huffman_bits(counts.tolist())
    steep = np.array([1 << min(k, 40) for k in range(40)], np.int64)
    lengths = idfiles.code_lengths(steep, 16)
    assert lengths.max() <= 16 and sum(2.0 ** -int(x) for x in lengths) <= 1
    assert idfiles.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_limited_code_is_the_best_of_all():
    counts = np.array([1, 1, 2, 3, 5, 8])
    best = min((sum(c * x for c, x in zip(counts, ls)) for ls in __import__("itertools").product(range(1, 4), repeat=6) if sum(2.0**-x for x in ls) <= 1))
    assert (counts * idfiles.code_lengths(counts, 3)).sum() == best


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 60_000), min_size=1, max_size=1500))
def test_bit_streams_round_trip(ids):
    ids = np.array(ids, np.uint16)
    lengths = idfiles.code_lengths(np.bincount(ids, minlength=1 << 16))
    stream, offsets = idfiles.to_bits(ids, lengths, idfiles.canonical_codes(lengths))
    assert (idfiles.from_bits(stream, offsets, len(ids), idfiles.decoding_table(lengths)) == ids).all()


def test_files_hold_the_library_ids_in_order(spark, data, encoder, texts):
    from lumengrid.llm.registry import QUERIES

    rows = sorted(QUERIES["op3_huffman_ids"](spark, data).collect(), key=lambda r: r.doc_id)
    start = 0
    for r in rows:
        ids = [*library(encoder, texts[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(rows) == len(texts)


def test_files_of_edge_rows(spark, edges, empty, encoder):
    for docs in (edges, empty):
        path = common.table_path(spark, "test-ids")
        idfiles.write_ids(idfiles.tokenised(docs), path)
        got = idfiles.read_ids(spark, path).collect()
        want = sorted(([*library(encoder, r.text), 0] for r in docs.collect()))
        assert sorted(ids.tolist() for ids in (np.frombuffer(r.ids, "<u4") for r in got)) == want


def brute_fullest(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_fullest_combination():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 12))]
        room = rng.randint(0, 90)
        counts = {x: lengths.count(x) for x in lengths}
        used = packing.fullest(counts, room)
        assert all(counts[x] >= n for x, n in used.items())
        assert sum(x * n for x, n in used.items()) == brute_fullest(lengths, room)


def check_packing(rows, capacity=packing.CAPACITY):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_all_documents(spark, data, encoder, texts):
    from lumengrid.llm.registry import QUERIES

    rows = QUERIES["op9_minimum_bin_slack"](spark, data).collect()
    n = check_packing(rows)
    total = sum(r.length for r in rows)
    assert n <= -(-total // packing.CAPACITY) + 1
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
    for k, parts in seen.items():
        ids = [*library(encoder, texts[k]), 0]
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert sum(r.length for r in parts) == len(ids) and all(r.length == packing.CAPACITY for r in parts[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in parts)
    assert len(seen) == len(texts)


def test_packing_of_edge_rows(edges, empty):
    rows = packing.packed(common.written(packing.pieces(edges, with_ids=True), "test-pieces")).collect()
    check_packing(rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in edges.collect()} and all(len(r.ids) == 2 * r.length for r in rows)
    assert packing.packed(packing.pieces(empty)).count() == 0


def test_ranks_go_over_buckets(spark):
    parts = spark.createDataFrame([(i, 700 if i % 3 else 648) for i in range(1000)], "k int, length long")
    assert check_packing(packing.packed(parts, bucket_rows=64).collect()) == 334

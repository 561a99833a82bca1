import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import fingerprints, media, sharding
from lumengrid.llm.registry import QUERIES


def lz_phrases(data):
    known, at = set(), 0
    while at < len(data):
        end = at + 1
        while end <= len(data) and data[at:end] in known:
            end += 1
        if end <= len(data):
            known.add(data[at:end])
        at = end
    return known


def hashed(phrase):
    h = 0
    for x in phrase:
        h = (h * 1_000_003 + x + 1) & ((1 << 61) - 1)
    h = ((h ^ h >> 31) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    return h >> 32


def brute_fingerprint(text):
    return np.array(sorted({hashed(p) for p in lz_phrases(text.encode())})[:64], ">u4").tobytes().hex()


def test_phrases_against_brute_force(texts):
    for t in ["", "a", "aaaaaaa", "abababab", "ñandú", *[x[:400] for x in list(texts.values())[:40]]]:
        assert fingerprints.fingerprint(t) == brute_fingerprint(t)


def test_parsing_goes_on_from_a_beginning():
    whole = fingerprints.Phrases(b"the cat the cat sat")
    parts = fingerprints.Phrases(b"the cat t").copy().parse(b"he cat sat")
    assert parts.hashes == whole.hashes and parts.node == whole.node


def test_edited_and_next_documents(spark, data, texts):
    rows = {r.doc_id: r for r in QUERIES["op4_lz_phrases"](spark, data).collect()}
    keys = sorted(texts)
    assert sorted(rows) == keys
    for i, k in enumerate(keys):
        t, nxt, r = texts[k], texts[keys[(i + 1) % len(keys)]], rows[k]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fingerprint(t), fingerprints.fingerprint(edited))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.2


def test_fingerprints_of_edge_rows(spark, edges, empty):
    rows = fingerprints.with_next(edges).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert by[7].fingerprint == by[8].fingerprint and by[1].fingerprint == by[2].fingerprint == ""
    assert by[1].near_next == 1.0  # an empty text next to an empty text
    assert fingerprints.with_next(empty).count() == 0
    one = fingerprints.with_next(spark.createDataFrame([(5, "alone here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.near_edited > 0


def test_wav_round_trip_and_features(spark, data, texts):
    rows = QUERIES["op8_wav_peaks"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        stored = media.to_wav(payload)
        assert media.from_wav(stored) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.pair_codes([payload])[0].astype(">i8").tobytes().hex()


def test_peaks_of_a_tone():
    t = np.arange(192 * 12)
    tone = (128 + 100 * np.sin(2 * np.pi * 24 * t / media.FRAME)).astype(np.uint8).tobytes()
    codes = media.pair_codes([tone, b" " * 192])
    assert len(codes[1]) == 0
    assert {int(c) >> 16 & 0xFFFF for c in codes[0]} == {24}
    assert (np.diff(codes[0] >> 32) >= 0).all()


def test_other_sounds_are_refused():
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(b"abcd")
    with pytest.raises(ValueError):
        media.from_wav(out.getvalue())


def test_media_of_edge_rows(edges, empty):
    rows = media.features(media.with_media(edges)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == edges.count() and by[1].samples == by[2].samples == b" " * 192
    assert by[7].pairs == by[8].pairs and by[7].media_sha256 == by[8].media_sha256
    assert media.features(media.with_media(empty)).count() == 0


def test_shards_are_even_and_gapless(spark, data, texts):
    rows = QUERIES["op7_two_pass_shuffle"](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    shards = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        shards.setdefault(r.shard, []).append(r.slot)
    assert sorted(shards) == list(range(8)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.25


def test_order_does_not_depend_on_partitions(small):
    places = lambda df: {(r.doc_id, r._shard, r._slot) for r in sharding.shuffled(df, 3, bucket_bytes=40_000).collect()}
    assert places(small.repartition(7)) == places(small.coalesce(1))
    assert places(small) != {(k, s, n) for k, s, n in places(small) if s == 0}


def test_shards_of_edge_rows(edges, empty):
    got = sharding.shuffled(edges, 4, bucket_bytes=50_000)
    assert {"_shard", "__shard", "_slot"} <= set(got.columns)  # the table has a column _shard of its own
    rows = got.collect()
    assert len(rows) == edges.count()
    slots = {}
    for r in rows:
        slots.setdefault(r["__shard"], []).append(r["_slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((str(r.doc_id), str(r._bucket)) for r in rows) == sorted((str(r.doc_id), str(r._bucket)) for r in edges.collect())
    assert sharding.shuffled(empty, 4).count() == 0


def test_written_shards_are_in_slot_order(spark, small, tmp_path):
    placed = sharding.shuffled(small.select("doc_id", "text"), 2)
    sharding.write_shards(placed, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == small.count() and back.agg(F.countDistinct("_shard")).first()[0] == 2

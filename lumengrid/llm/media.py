"""Operator 8: text as sound.  WAV columns, short-time Fourier transforms, spectral-peak pairs.

A payload (a text's UTF-8 bytes, padded with byte 32 to a positive multiple of 192) becomes the samples
of an 8-bit mono WAV file, written by the wave module into a media column of a table and read back from there.
Its fingerprint: frames of 384 samples every 192, Hann window, power spectrum; the two strongest local maxima of
each frame are its peaks (of equally strong bins the lowest); the strongest one is paired with both peaks of the
next frame and the strongest of the one after.  A pair is the long  frame << 32 | f1 << 16 | f2 << 8 | frames between,
in order of time.  Sounds of fewer than LEAST frames are heard again and again until they have as many, so short
sounds have pairs, too.

Defined results: a null text is an empty one (192 spaces); a sound of one value throughout has no peaks and no
pairs; bytes that are no WAV file of 8-bit mono samples raise; equal texts give equal values; repeated rows give a
row each; an empty table gives no rows; texts of any length are whole, a text at a time where they are long; columns
other than key and text are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT = 192
FRAME, HOP, RATE, LEAST = 384, 192, 16_000, 4
BLOCK = 20_000  # frames transformed at once


def to_payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return len(data), data.ljust(size, b" ")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("expected 8-bit mono samples")
        return w.readframes(w.getnframes())


def peaks(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins of the strongest and the second strongest local maximum of each frame (0: none)."""
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    inner = power[:, 1:-1]
    inner = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
    rows = np.arange(len(frames))
    one = inner.argmax(1)
    found = inner[rows, one] > 1e-3
    inner[rows, one] = 0
    two = inner.argmax(1)
    return np.where(found, one + 1, 0), np.where(inner[rows, two] > 1e-3, two + 1, 0)


def pair_codes(payloads: list[bytes]) -> list[np.ndarray]:
    """Time-coded peak pairs of each payload; frames of all of them are transformed together."""
    counts = [max(LEAST, -(-len(x) // HOP) - 1) for x in payloads]
    firsts, seconds = [], []

    def frames():
        for data, n in zip(payloads, counts, strict=True):
            x = np.frombuffer(data, np.uint8).astype(np.float32) - 128
            x = np.resize(x, (n - 1) * HOP + FRAME) if n == LEAST else x
            yield np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]

    held, size = [], 0
    for f in [*frames(), None]:
        for at in range(0, 1 if f is None else len(f), BLOCK):
            if f is not None:
                held.append(f[at : at + BLOCK])
                size += len(held[-1])
            if held and (f is None or size >= BLOCK):
                block = np.concatenate(held)
                a, b = peaks(block - block.mean(1, keepdims=True))
                firsts.append(a)
                seconds.append(b)
                held, size = [], 0
    one = np.concatenate(firsts).astype(np.int64)
    two = np.concatenate(seconds).astype(np.int64)
    length = np.array(counts)
    time = np.arange(len(one)) - np.repeat(np.cumsum(length) - length, length)
    left = np.repeat(length, length) - time  # frames from here to the sound's end
    codes = np.zeros((len(one), 3), np.int64)
    for k, (other, gap) in enumerate(((one, 1), (two, 1), (one, 2))):
        target = np.zeros_like(other)
        target[:-gap] = other[gap:]
        good = (left > gap) & (one > 0) & (target > 0)
        codes[:, k] = np.where(good, time << 32 | one << 16 | target << 8 | gap, -1)
    ends = np.cumsum(length)
    return [(x := codes[e - n : e].ravel())[x >= 0] for e, n in zip(ends, counts, strict=True)]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays)))


def with_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, `n_bytes` of the text and its WAV file `media`."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [to_payload(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([to_wav(x) for _, x in made], pa.binary())], ["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return common.mapped(docs.select(key, text), f"key {kind}, n_bytes long, media binary", each).withColumnRenamed("key", key)


def features(sounds: DataFrame, media: str = "media") -> DataFrame:
    """The columns of sounds but for media, with `samples` (binary, read back), `media_bytes`, `media_sha256`
    and the time-coded peak pairs `pairs` (an array of longs in order of time)."""
    others = [x for x in sounds.columns if x != media]
    names = [*others, "samples", "media_bytes", "media_sha256", "pairs"]

    def run(batches):
        for whole in batches:
            for batch in common.slices(whole, media):
                stored = batch.column(media).to_pylist()
                samples = [from_wav(x) for x in stored]
                made = [pa.array(samples, pa.binary()), pa.array([len(x) for x in stored], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in stored]), _lists(pair_codes(samples))]
                yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in others], *made], names)

    schema = ", ".join(f"`{x}` {sounds.schema[x].dataType.simpleString()}" for x in others)
    return sounds.mapInArrow(run, f"{schema}, samples binary, media_bytes long, media_sha256 string, pairs array<long>")


def op8_wav_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a WAV file in a table, read back, with its spectral-peak pairs as hex."""
    with common.scratch(spark) as kept:
        found = features(common.written(with_media(common.documents(spark, sf_dir)), "media"))
        found = found.select(
            "doc_id",
            "n_bytes",
            F.octet_length("samples").cast("long").alias("payload_bytes"),
            F.sha2("samples", 256).alias("payload_sha256"),
            F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
            "media_bytes",
            "media_sha256",
            F.lower(F.array_join(F.transform("pairs", lambda x: F.lpad(F.hex(x), 16, "0")), "")).alias("feature"),
        )
        return kept(found, "media-features")

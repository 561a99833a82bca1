"""Entry points: lossless encoding of grids to tables of range-coded streams and back, presets, quantisers.

An encoded image is rows (img, mode, width, channels, chunk, n, streams): for each chunk of 2^18 samples in raster
order the four byte planes of its residual words.  A mode is chosen for each image by the preset.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import bits as B
from .functions import tone as T
from .operators import codecs as D
from .operators import containers as K
from .operators import entropy as E
from .operators import predict as P
from .operators import quantize as Q
from .operators import router as N
from .operators import streams as S
from .sources import images as I

#: Modes that a preset tries; the cheapest by adaptive bits of its planes is taken (the first wins ties).
PRESETS: dict[str, tuple[str, ...]] = {"fast": ("raw",), "compact": ("west",), "balanced": ("raw", "west"), "quality": ("raw", "west", "north"), "max": ("raw", "west", "north")}
ALIASES = {"log": "signed_log", "slog": "signed_log", "identity": "linear", "gamma": "gamma075"}
CHUNK = 1 << 18
c = F.col


def compose(*stages: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Stages one after the other."""

    def run(df: DataFrame) -> DataFrame:
        for stage in stages:
            df = df.transform(stage)
        return df

    return run


def _residuals(samples: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    near = P.with_neighbours(P.with_words(samples))
    value = {"raw": c("o"), "west": F.pmod(c("o") - c("w"), B.long(1 << 32)), "north": F.pmod(c("o") - c("n"), B.long(1 << 32))}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(i).alias("ord"), value[m].alias("r")) for i, m in enumerate(modes)])).alias("s")
    return near.select("img", "y", "x", "c", each).select("img", "y", "x", "c", "s.*")


def encode_lossless(samples: DataFrame, preset: str = "balanced") -> DataFrame:
    """samples (img, y, x, c, v), dense in raster order (the last row may be short), to encoded rows."""
    modes = PRESETS[preset]
    r = _residuals(samples, modes)
    if len(modes) > 1:
        planes = E.plane_counts(r, ["img", "mode", "ord"], "r", range(32))
        cost = planes.groupBy("img", "mode", "ord").agg(F.sum(E.kt_bits(c("n") - c("ones"), c("ones"))).alias("bits"))
        best = cost.groupBy("img").agg(F.min(F.struct("bits", "ord", "mode")).alias("m")).select("img", "m.mode")
        r = r.join(best, ["img", "mode"])
    shape = samples.groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("c") + 1).alias("channels"))
    placed = r.join(shape, "img").withColumn("i", (c("y") * c("width") + c("x")) * c("channels") + c("c"))

    def chunk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        at = part["i"].to_numpy()
        if at[-1] - at[0] + 1 != len(at):
            raise ValueError("samples are not dense in raster order")
        words = part["r"].to_numpy(np.int64)
        streams = [S.encode(((words >> 8 * k) & 255).astype(np.uint8).tobytes()) for k in range(4)]
        first = part.iloc[0]
        return pd.DataFrame([{"img": first["img"], "mode": first["mode"], "width": first["width"], "channels": first["channels"], "chunk": first["chunk"], "n": len(part), "streams": streams}])

    cut = placed.withColumn("chunk", F.expr(f"i div {CHUNK}")).select("img", "mode", "width", "channels", "chunk", "i", "r")
    return cut.groupBy("img", "chunk").applyInPandas(chunk, "img string, mode string, width int, channels int, chunk long, n long, streams array<binary>")


def decode_lossless(encoded: DataFrame) -> DataFrame:
    """Encoded rows back to samples with their words: img, y, x, c, b, v."""

    def words(batches):
        import pyarrow as pa

        names = ["img", "mode", "width", "channels", "i", "r"]
        for batch in batches:
            for img, mode, width, channels, chunk, n, streams in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                r = sum(np.frombuffer(S.decode(s, n), np.uint8).astype(np.int64) << 8 * k for k, s in enumerate(streams))
                same = [pa.array([v] * n, t) for v, t in ((img, pa.string()), (mode, pa.string()), (width, pa.int32()), (channels, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n) + chunk * CHUNK), pa.array(r)], names)

    flat = encoded.select("img", "mode", "width", "channels", "chunk", "n", "streams").mapInArrow(words, "img string, mode string, width int, channels int, i long, r long")
    pixel = F.expr("i div channels")
    placed = flat.select("img", "mode", F.expr("(i div channels) div width").alias("y"), (pixel % c("width")).cast("int").alias("x"), (c("i") % c("channels")).cast("int").alias("c"), "r")
    row = Window.partitionBy("img", "c", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy("img", "c", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    wrap = lambda v: F.pmod(v, B.long(1 << 32))
    # modes differ by image, and each image needs the sums of its own mode only
    raw = placed.filter("mode = 'raw'").withColumn("o", c("r"))
    west = placed.filter("mode = 'west'").withColumn("o", wrap(F.sum("r").over(row)))
    north = placed.filter("mode = 'north'").withColumn("o", wrap(F.sum("r").over(column)))
    out = raw.unionByName(west).unionByName(north)
    return out.select("img", "y", "x", "c", B.unordered(c("o")).alias("b")).withColumn("v", B.bits_float(c("b")))


def quantize_mantissa(samples: DataFrame, low_bits: int) -> DataFrame:
    """samples with `b`: words whose low mantissa bits are cleared."""
    return P.with_words(samples).withColumn("b", B.clear_low(c("b"), low_bits)).drop("o")


def quantize_transform(samples: DataFrame, transform: str = "linear", preset: str = "balanced") -> DataFrame:
    """samples with indices `q` and reconstructions `rec` by channel, in one of six domains."""
    mode = ALIASES.get(transform, transform)
    if mode not in T.TRANSFORMS:
        raise ValueError(f"unknown transform: {transform}")
    return Q.transform_index(samples, mode, Q.PRESETS[preset], ["img", "c"])


def encode_near_lossless(px: DataFrame, options: N.Options = N.USUAL) -> DataFrame:
    """Decoded pixels of the near-lossless router with their routes."""
    return N.reconstructed(px, options)


def encode_router(px: DataFrame) -> DataFrame:
    """Pixels (img, y, x, r, g, b), dense, to one container of twelve streams for each image."""
    return D.routed_images(px)


def decode_router(images: DataFrame) -> DataFrame:
    return D.unrouted(images)


def inspect_header(frames: DataFrame, data: str = "data") -> DataFrame:
    return frames.select("*", *[v.alias(k) for k, v in S.header(c(data)).items()])


# --- single files, without a session


def encode_bytes(pixels: np.ndarray, preset: str = "balanced") -> bytes:
    """Height x width x channels float32 to bytes: sides, the mode, and a byte-plane container of its residual words."""
    height, width, channels = pixels.shape
    bits = np.ascontiguousarray(pixels, "<f4").view("<u4").reshape(-1).astype(np.int64)
    words = np.where(bits >= B.SIGN, B.WORD - bits, bits + B.SIGN)
    made = []
    for k, mode in enumerate(PRESETS[preset]):
        r = _steps(words.reshape(height, width, channels), mode).reshape(-1).astype("<u4")
        planes = r.view(np.uint8).reshape(-1, 4).T
        parts = [K.plane_stream(np.ascontiguousarray(p[at : at + CHUNK]), at, width, channels) for at in range(0, len(r), CHUNK) for p in planes]
        made.append((sum(map(len, parts)), k, mode, parts))
    _, _, mode, parts = min(made)
    return K.FILE_MAGIC + struct.pack("<IIBB", width, height, channels, MODES.index(mode)) + K.container(parts, len(words), CHUNK)


MODES = ("raw", "west", "north")


def _steps(words: np.ndarray, mode: str) -> np.ndarray:
    if mode == "raw":
        return words
    return np.diff(words, axis=1 if mode == "west" else 0, prepend=0) % (1 << 32)


def file_header(data: bytes) -> dict:
    if not data.startswith(K.FILE_MAGIC):
        raise ValueError("not a file of this engine")
    width, height, channels, mode = struct.unpack("<IIBB", data[4:14])
    return {"width": width, "height": height, "channels": channels, "mode": MODES[mode], "bytes": len(data)}


def decode_bytes(data: bytes) -> np.ndarray:
    head = file_header(data)
    r = K.opened(data[14:], head["width"], head["channels"]).astype(np.int64).reshape(head["height"], head["width"], head["channels"])
    words = r if head["mode"] == "raw" else np.cumsum(r, axis=1 if head["mode"] == "west" else 0) % (1 << 32)
    bits = np.where(words >= B.SIGN, words - B.SIGN, B.WORD - words)
    return bits.astype("<u4").view("<f4")


def encode_file(source: Path | str, target: Path | str, preset: str = "balanced") -> None:
    Path(target).write_bytes(encode_bytes(I.read_exr(Path(source).read_bytes()), preset))


def decode_file(source: Path | str, target: Path | str) -> None:
    Path(target).write_bytes(I.write_exr(decode_bytes(Path(source).read_bytes())))

"""Image files without further libraries: scan-line EXR (half and float, raw or zip) and PNG (8 and 16 bits).

Both are written and read as bytes; `exr_samples` turns a table of files into a sample grid, in parallel by file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the two formats: magic numbers, pixel types, compressions and the lines of their chunks.
EXR_MAGIC, EXR_VERSION = 20000630, 2
HALF, FLOAT = 1, 2
NONE, ZIPS, ZIP = 0, 2, 3
LINES = {NONE: 1, ZIPS: 1, ZIP: 16}
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
GRAY, RGB = 0, 2
#: Channel names by count; files hold them in alphabetical order.
NAMES = {1: ("Y",), 2: ("Y", "A"), 3: ("R", "G", "B"), 4: ("R", "G", "B", "A")}


def _packed(raw: bytes) -> bytes:
    x = np.frombuffer(raw, np.uint8)
    parted = np.concatenate([x[0::2], x[1::2]])
    steps = np.diff(parted.astype(np.int16), prepend=parted[:1].astype(np.int16) - 128 if len(parted) else 0) + 128
    made = (steps % 256).astype(np.uint8)
    if len(made):
        made[0] = parted[0]
    out = zlib.compress(made.tobytes(), 6)
    return out if len(out) < len(raw) else raw


def _unpacked(data: bytes, size: int) -> bytes:
    if len(data) == size:
        return data
    steps = np.frombuffer(zlib.decompress(data), np.uint8).astype(np.int64)
    if len(steps) != size:
        raise ValueError("a chunk has another size than its lines")
    steps[1:] -= 128
    parted = (np.cumsum(steps) % 256).astype(np.uint8)
    out, half = np.empty(size, np.uint8), -(-size // 2)
    out[0::2], out[1::2] = parted[:half], parted[half:]
    return out.tobytes()


def _attribute(name: str, kind: str, value: bytes) -> bytes:
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<I", len(value)) + value


def write_exr(pixels: np.ndarray, compression: int = ZIP, half: bool = False) -> bytes:
    """Height x width x channels floats to a file."""
    height, width, channels = pixels.shape
    names = NAMES[channels]
    order = sorted(range(channels), key=lambda k: names[k])
    kind, dtype = (HALF, "<f2") if half else (FLOAT, "<f4")
    listed = b"".join(names[k].encode() + b"\0" + struct.pack("<IB3xII", kind, 0, 1, 1) for k in order) + b"\0"
    window = struct.pack("<4i", 0, 0, width - 1, height - 1)
    head = struct.pack("<II", EXR_MAGIC, EXR_VERSION) + _attribute("channels", "chlist", listed) + _attribute("compression", "compression", bytes([compression]))
    head += _attribute("dataWindow", "box2i", window) + _attribute("displayWindow", "box2i", window) + _attribute("lineOrder", "lineOrder", b"\0")
    head += _attribute("pixelAspectRatio", "float", struct.pack("<f", 1)) + _attribute("screenWindowCenter", "v2f", bytes(8)) + _attribute("screenWindowWidth", "float", struct.pack("<f", 1)) + b"\0"
    planes = np.ascontiguousarray(pixels[:, :, order].transpose(0, 2, 1)).astype(dtype)  # a line's channels one after the other
    step, chunks = LINES[compression], []
    for y in range(0, height, step):
        raw = planes[y : y + step].tobytes()
        data = raw if compression == NONE else _packed(raw)
        chunks.append(struct.pack("<iI", y, len(data)) + data)
    at, offsets = len(head) + 8 * len(chunks), []
    for chunk in chunks:
        offsets.append(at)
        at += len(chunk)
    return head + struct.pack(f"<{len(offsets)}Q", *offsets) + b"".join(chunks)


def exr_header(data: bytes) -> tuple[dict[str, bytes], int]:
    """Attributes by name, and where they end."""
    magic, version = struct.unpack("<II", data[:8])
    if magic != EXR_MAGIC or version & 0xFF != EXR_VERSION or version >> 8:
        raise ValueError("not a single-part scan-line EXR file")
    at, out = 8, {}
    while data[at]:
        end = data.index(b"\0", at)
        kind = data.index(b"\0", end + 1)
        size = struct.unpack("<I", data[kind + 1 : kind + 5])[0]
        out[data[at:end].decode()] = data[kind + 5 : kind + 5 + size]
        at = kind + 5 + size
    return out, at + 1


def _channels(listed: bytes) -> list[tuple[str, int]]:
    at, out = 0, []
    while listed[at]:
        end = listed.index(b"\0", at)
        kind, _, sx, sy = struct.unpack("<IB3xII", listed[end + 1 : end + 17])
        if kind not in (HALF, FLOAT) or (sx, sy) != (1, 1):
            raise ValueError("only half and float channels without subsampling are read")
        out.append((listed[at:end].decode(), kind))
        at = end + 17
    return out


def read_exr(data: bytes) -> np.ndarray:
    """Height x width x channels float32: Y, Y A, R G B or R G B A; other channels are left out."""
    header, at = exr_header(data)
    compression = header["compression"][0]
    if compression not in LINES:
        raise ValueError(f"compression {compression} is not read")
    x0, y0, x1, y1 = struct.unpack("<4i", header["dataWindow"])
    width, height, channels = x1 - x0 + 1, y1 - y0 + 1, _channels(header["channels"])
    found = {name for name, _ in channels}
    wanted = next((n for n in sorted(NAMES.values(), key=len, reverse=True) if set(n) <= found), None)
    if not wanted:
        raise ValueError(f"neither Y nor R, G and B among {sorted(found)}")
    out = np.zeros((height, width, len(wanted)), np.float32)
    line = sum(width * (2 if kind == HALF else 4) for _, kind in channels)
    step = LINES[compression]
    for offset in struct.unpack(f"<{-(-height // step)}Q", data[at : at + 8 * -(-height // step)]):
        y, size = struct.unpack("<iI", data[offset : offset + 8])
        rows = min(step, y1 - y + 1)
        raw, place = data[offset + 8 : offset + 8 + size], 0
        raw = raw if compression == NONE else _unpacked(raw, rows * line)
        for k in range(rows):
            for name, kind in channels:
                n = width * (2 if kind == HALF else 4)
                if name in wanted:
                    out[y - y0 + k, :, wanted.index(name)] = np.frombuffer(raw[place : place + n], "<f2" if kind == HALF else "<f4")
                place += n
    return out


def write_png(pixels: np.ndarray) -> bytes:
    """Height x width (gray) or height x width x 3, of uint8 or uint16."""
    height, width = pixels.shape[:2]
    depth = 16 if pixels.dtype == np.uint16 else 8
    rows = pixels.astype(">u2" if depth == 16 else np.uint8).reshape(height, -1).view(np.uint8).reshape(height, -1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, depth, GRAY if pixels.ndim == 2 else RGB, 0, 0, 0)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    return PNG_MAGIC + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Gray or RGB, 8 or 16 bits, without interlacing; all five line filters are undone."""
    if not data.startswith(PNG_MAGIC):
        raise ValueError("not a PNG file")
    at, body, head = len(PNG_MAGIC), b"", b""
    while at < len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a part's checksum is wrong")
        head, body = (part, body) if kind == b"IHDR" else (head, body + part if kind == b"IDAT" else body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth not in (8, 16) or colour not in (GRAY, RGB) or interlaced:
        raise ValueError("only gray and RGB of 8 or 16 bits without interlacing are read")
    step = (depth // 8) * (3 if colour == RGB else 1)
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    above, out = np.zeros(width * step, np.int64), []
    for line in lines:
        now = line[1:].astype(np.int64)
        if line[0] == 1:
            now = (now.reshape(-1, step).cumsum(0) % 256).ravel()
        elif line[0] == 2:
            now = (now + above) % 256
        elif line[0] in (3, 4):
            for i in range(len(now)):
                w, n, nw = now[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                a, b, c = abs(n - nw), abs(w - nw), abs(w + n - 2 * nw)
                guess = (w + n) // 2 if line[0] == 3 else w if a <= b and a <= c else n if b <= c else nw
                now[i] = (now[i] + guess) % 256
        out.append(now.astype(np.uint8))
        above = now
    flat = np.stack(out) if out else np.zeros((0, width * step), np.uint8)
    values = flat.view(">u2").astype(np.uint16) if depth == 16 else flat
    return values.reshape(height, width, 3) if colour == RGB else values.reshape(height, width)


def exr_samples(files: DataFrame, path: str = "path", data: str = "data") -> DataFrame:
    """Rows (path, data) of EXR files to a sample grid (img: the path); a file is read in one task."""

    def run(batches):
        for frame in batches:
            for name, blob in zip(frame["path"], frame["data"], strict=True):
                pixels = read_exr(bytes(blob))
                height, width, channels = pixels.shape
                at = np.arange(pixels.size)
                yield pd.DataFrame({"img": name, "y": at // channels // width, "x": (at // channels % width).astype("int32"), "c": (at % channels).astype("int32"), "v": pixels.ravel()})

    return files.select(F.col(path).alias("path"), F.col(data).alias("data")).mapInPandas(run, "img string, y long, x int, c int, v float")


def exr_files(samples: DataFrame, compression: int = ZIP) -> DataFrame:
    """A sample grid, dense, to rows (img, data): an image is written in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        shape = int(part["y"].max()) + 1, int(part["x"].max()) + 1, int(part["c"].max()) + 1
        pixels = np.zeros(shape, np.float32)
        pixels[part["y"], part["x"], part["c"]] = part["v"].to_numpy(np.float32)
        return pd.DataFrame({"img": [part["img"].iat[0]], "data": [write_exr(pixels, compression)]})

    return samples.groupBy("img").applyInPandas(run, "img string, data binary")

"""Image files, single-file entry points and sinks."""

import json

import numpy as np
import pytest

from lumengrid import __main__ as command
from lumengrid import api
from lumengrid.sources import files
from lumengrid.sources import images as I


@pytest.mark.parametrize("compression", [I.NONE, I.ZIPS, I.ZIP])
@pytest.mark.parametrize("shape", [(1, 1, 1), (37, 21, 3), (16, 5, 4), (33, 8, 2)])
def test_exr_round_trip(compression, shape):
    rng = np.random.default_rng(sum(shape))
    pixels = (rng.normal(size=shape) * 10).astype(np.float32)
    pixels.flat[0] = np.inf
    assert (I.read_exr(I.write_exr(pixels, compression)) == pixels).all()
    half = pixels.astype(np.float16).astype(np.float32)
    assert (I.read_exr(I.write_exr(half, compression, half=True)) == half).all()


def test_smooth_images_shrink_and_other_files_are_refused():
    ramp = np.repeat(np.linspace(0, 1, 256, dtype=np.float32)[None, :, None], 64, axis=0)
    data = I.write_exr(ramp)
    assert len(data) < ramp.nbytes / 4 and set(I.exr_header(data)[0]) >= {"channels", "compression", "dataWindow"}
    with pytest.raises(ValueError):
        I.read_exr(b"\0" * 64)


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
@pytest.mark.parametrize("shape", [(1, 1), (13, 7), (9, 11, 3)])
def test_png_round_trip(dtype, shape):
    pixels = np.random.default_rng(1).integers(0, np.iinfo(dtype).max, shape).astype(dtype)
    data = I.write_png(pixels)
    back = I.read_png(data)
    assert (back == pixels).all() and back.dtype == dtype
    with pytest.raises(ValueError):
        I.read_png(data[:-6] + b"x" + data[-5:])
    with pytest.raises(ValueError):
        I.read_png(b"GIF89a")


def test_png_filters_are_undone():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    rows, above = b"", np.zeros(18, np.int64)
    for kind, row in enumerate(pixels.reshape(5, 18).astype(np.int64)):
        left, corner = np.concatenate([np.zeros(3, np.int64), row[:-3]]), np.concatenate([np.zeros(3, np.int64), above[:-3]])
        p = left + above - corner
        far = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][kind]
        rows += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = I.PNG_MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, I.RGB, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
    assert (I.read_png(data) == pixels).all()


def test_files_as_grids(spark, tmp_path):
    pixels = {f"i{k}.exr": np.random.default_rng(k).random((6 + k, 5, 3)).astype(np.float32) for k in range(3)}
    for name, p in pixels.items():
        (tmp_path / name).write_bytes(I.write_exr(p))
    grid = I.exr_samples(files.raw_files(spark, f"{tmp_path}/*.exr"))
    got = grid.toPandas()
    for name, p in pixels.items():
        own = got[got["img"].str.endswith(name)].sort_values(["y", "x", "c"])
        assert (own["v"].to_numpy().reshape(p.shape) == p).all()
    back = I.exr_samples(I.exr_files(grid), "img")
    assert back.exceptAll(grid).count() == 0 == grid.exceptAll(back).count()


@pytest.mark.parametrize("preset", sorted(api.PRESETS))
def test_single_files(tmp_path, preset, capsys):
    pixels = np.cumsum(np.random.default_rng(4).random((20, 30, 3)), axis=1).astype(np.float32)
    pixels[0, 0] = [np.inf, np.nan, -0.0]
    (tmp_path / "a.exr").write_bytes(I.write_exr(pixels))
    assert command.main(["encode", str(tmp_path / "a.exr"), str(tmp_path / "a.lg"), "--preset", preset]) == 0
    assert command.main(["decode", str(tmp_path / "a.lg"), str(tmp_path / "b.exr")]) == 0
    back = I.read_exr((tmp_path / "b.exr").read_bytes())
    assert (back.view(np.uint32) == pixels.view(np.uint32)).all()
    assert command.main(["info", str(tmp_path / "a.lg")]) == 0 and "width 30" in capsys.readouterr().out
    assert command.main(["info", str(tmp_path / "a.exr")]) == 0 and "height 20" in capsys.readouterr().out
    with pytest.raises(ValueError):
        api.decode_bytes(b"nothing at all")


def test_reports_windows_and_arrays(spark, tmp_path):
    table = spark.createDataFrame([("a", 1, 2.5), ("b", 2, None)], "method string, n int, ratio double")
    files.write_report(table, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/json")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "report/csv")).columns == ["method", "n", "ratio"]
    (tmp_path / "r1.bin").write_bytes(bytes(range(200)))
    (tmp_path / "r2.bin").write_bytes(b"short")
    made = files.byte_windows(spark, f"{tmp_path}/*.bin", 16, 5, 3).collect()
    assert len(made) == 5 and all(bytes(r.data) == bytes(range(r.start, r.start + 16)) for r in made)
    assert made == files.byte_windows(spark, f"{tmp_path}/*.bin", 16, 5, 3).collect()
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"image": f"i{k}", "p": [0.5, k]}) + "\n" for k in range(3)))
    rows = files.json_arrays(spark, str(tmp_path / "x.jsonl"), "image string, p array<double>").orderBy("image").collect()
    assert [r.p for r in rows] == [[0.5, float(k)] for k in range(3)]

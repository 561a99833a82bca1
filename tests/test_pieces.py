"""Sources, sinks and helpers that no query covers."""

import json

from pyspark.sql import functions as F

from lumengrid.operators import report, streams
from lumengrid.sources import files
from lumengrid.sources import grids as G


def test_crops(spark, data):
    g = G.grid(spark, data, "part1")
    assert G.window_of(g, 3, 1, 4, 2).count() == 8
    assert G.crop_origins(100, 60, 20, 1) == [(40, 20)]
    assert G.crop_origins(100, 60, 20, 2) == [(0, 0), (0, 40), (80, 0), (80, 40)]


def test_result_files(spark, tmp_path):
    rows = [{"image": f"i{k}", "rows": [{"low_bits": b, "ratio": k + b / 10} for b in (0, 8)]} for k in (1, 2)]
    for r in rows:
        (tmp_path / f"{r['image']}.json").write_text(json.dumps(r))
    got = files.nested_results(spark, str(tmp_path / "*.json"))
    assert sorted((r.image, r.low_bits, r.ratio) for r in got.collect()) == [("i1", 0, 1.0), ("i1", 8, 1.8), ("i2", 0, 2.0), ("i2", 8, 2.8)]
    assert {r.file.rsplit("/", 1)[1] for r in got.collect()} == {"i1.json", "i2.json"}


def test_raw_frames(spark, tmp_path):
    frame = streams.frame(4, 2, 1, 0, 0, 0, 0, 0, 0, bytes(range(32)))
    files.write_frames(spark.createDataFrame([("a", frame)], "name string, data binary"), str(tmp_path / "f"))
    back = files.read_frames(spark, str(tmp_path / "f"))
    assert (back.first().name, bytes(back.first().data)) == ("a", frame)
    (tmp_path / "one.bin").write_bytes(frame)
    raw = files.raw_files(spark, str(tmp_path / "one.bin")).first()
    assert bytes(raw.data) == frame


def test_samples_of_raw_buffers(spark):
    import numpy as np

    px = np.arange(24, dtype="<f4").reshape(2, 4, 3)
    df = spark.createDataFrame([("im", 4, 2, 3, px.tobytes())], "img string, width int, height int, channels int, data binary")
    got = sorted((r.y, r.x, r.c, r.v) for r in files.samples(df).collect())
    assert got == [(y, x, c, float(px[y, x, c])) for y in range(2) for x in range(4) for c in range(3)]


def test_markdown_report(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "method string, ratio double").orderBy(F.desc("ratio"))
    assert files.markdown(df) == "| method | ratio |\n|---|---|\n| b | 2.0 |\n| a | 1.5 |"


def test_geomean_ignores_what_is_not_positive(spark):
    df = spark.createDataFrame([(2.0,), (8.0,), (0.0,), (None,)], "r double")
    assert abs(df.agg(report.geomean(F.col("r"))).first()[0] - 4.0) < 1e-12

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumengrid import api
from lumengrid.functions import bits as B
from lumengrid.operators import streams
from lumengrid.sources import grids as G


@pytest.fixture(scope="module")
def images(spark, tmp_path_factory):
    """A 64 x 32 x 3 ramp with Inf, NaN and -0, and a 9 x 5 constant."""
    y, x, ch = np.meshgrid(np.arange(32), np.arange(64), np.arange(3), indexing="ij")
    v = ((x + 0.5 * y + 100 * ch) * 0.01).astype(np.float32).ravel()
    v[5], v[17], v[23] = np.inf, np.nan, -0.0
    rows = pa.table({"img": ["ramp"] * v.size + ["flat"] * 45, "y": pa.array([*y.ravel().tolist(), *[i // 9 for i in range(45)]], pa.int64()), "x": pa.array([*x.ravel().tolist(), *[i % 9 for i in range(45)]], pa.int32()), "c": pa.array([*ch.ravel().tolist(), *[0] * 45], pa.int32()), "v": pa.array(np.concatenate([v, np.ones(45, np.float32)]))})
    path = tmp_path_factory.mktemp("images") / "v.parquet"
    pq.write_table(rows, path)
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("preset", sorted(api.PRESETS))
def test_lossless_round_trip(images, preset):
    encoded = api.encode_lossless(images, preset)
    back = {(r.img, r.y, r.x, r.c): r.b for r in api.decode_lossless(encoded).collect()}
    want = {(r.img, r.y, r.x, r.c): r.b for r in images.withColumn("b", B.float_bits(F.col("v"))).collect()}
    assert back == want


def test_short_last_row(spark, data):
    g = G.grid(spark, data, "ord3")
    back = api.decode_lossless(api.encode_lossless(g, "max"))
    assert back.count() == g.count()
    assert back.join(g.withColumnRenamed("v", "u"), ["img", "y", "x", "c"]).filter("u <> v").count() == 0


def test_gaps_are_refused(images):
    with pytest.raises(Exception, match="dense"):
        api.encode_lossless(images.filter("not (img = 'flat' and y = 2 and x = 3)"), "fast").collect()


def test_quantisers_and_composition(images):
    finite = images.filter("img = 'flat' or (y > 0 and c < 2)")
    stage = api.compose(lambda df: api.quantize_transform(df, "slog", "quality"), lambda df: df.withColumn("e", F.abs(F.col("rec") - F.col("v"))))
    assert stage(finite).agg(F.max("e")).first()[0] < 0.01
    assert api.quantize_mantissa(images, 12).filter(B.is_finite(F.col("b")) & (F.col("b") % 4096 != 0)).count() == 0
    with pytest.raises(ValueError):
        api.quantize_transform(images, "unknown")


def test_headers(spark):
    df = spark.createDataFrame([(streams.frame(3, 2, 1, 0, 0, 0, 0, 0, 0, b"x"),)], "data binary")
    assert api.inspect_header(df).first().width == 3

"""Error statistics against their SQL where quotients are over 0 and values have no whole neighbours."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumengrid import catalog
from lumengrid.operators import quality as Y

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("values", [[0.0, 1.3, 2.7], [-0.0, 0.5], [0.0, 0.0], [0.25, 3.0], [None, 1.3, None, 2.0], [None], [NAN, 1.3], [1e30, 1.3], [INF, 1.3], [-INF, 0.0]])
def test_errors_equal_sql(spark, tmp_path, values):
    n = len(values)
    pq.write_table(pa.table({"event_id": pa.array(range(n), pa.int64()), "value": pa.array(values, pa.float64())}), tmp_path / "events.parquet")
    pq.write_table(pa.table({"o_orderkey": pa.array(range(n), pa.int64()), "o_totalprice": pa.array([None if v is None else v * 1e5 for v in values], pa.float64())}), tmp_path / "orders.parquet")
    con = duckdb.connect()
    for name in ("events", "orders"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    got = {r["img"]: r.asDict() for r in catalog.QUERIES["g01_error_stats"](spark, str(tmp_path)).collect()}
    want = con.sql(catalog.SQL["g01_error_stats"])
    for row in want.fetchall():
        row = dict(zip(want.columns, row, strict=True))
        ours = got.pop(row["img"])
        for k, v in row.items():
            assert ours[k] == v or (v is not None and ours[k] is not None and np.isnan(v) and np.isnan(ours[k])), (k, ours[k], v)
    assert not got


def test_relative_errors_beside_zeros(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 1.0), ("b", 0.0, 1.0), ("b", 4.0, 3.0)], "img string, o double, d double")
    got = {r.img: r for r in Y.error_stats(df, ["img"], "o", "d").collect()}
    assert np.isnan(got["a"].max_rel) and got["a"].max_rel_nonzero == 0.5
    assert got["b"].max_rel == INF and got["b"].max_rel_nonzero == 0.25

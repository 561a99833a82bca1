"""Quantiles, separate peaks and bit planes against plain versions."""

import numpy as np
import pytest

from lumengrid.operators import order, routes, streams
from lumengrid.sources import tables


@pytest.mark.parametrize("small", [False, True])
def test_quantiles_equal_numpy(spark, monkeypatch, small):
    rng = np.random.default_rng(3)
    columns = {
        "uniform": rng.random(700),
        "heavy": np.where(rng.random(700) < 0.4, 5.0, rng.normal(size=700)),
        "far": np.concatenate([[1e12, -1e9], rng.random(698) * 1e-6]),
        "few": rng.integers(0, 3, 700).astype(float),
    }
    rows = [(g, i, *[float(v[i]) if (i + g) % 11 else None for v in columns.values()]) for g in (0, 1) for i in range(700)] + [(2, 0, *[7.0] * 4)]
    df = spark.createDataFrame(rows, "g int, i int, " + ", ".join(f"{k} double" for k in columns)).repartition(3)
    if small:
        monkeypatch.setattr(order, "SORTED", 5)
        monkeypatch.setattr(order, "CELLS", 16)
        monkeypatch.setattr(order, "ROUNDS", 40)
    qs = [0.0, 0.01, 0.25, 0.5, 0.97, 1.0]
    wanted = dict.fromkeys(columns, qs)
    plain = {r.g: r for r in order.quantiles(df, ["g"], wanted).collect()}
    nearest = {r.g: r for r in order.quantiles(df, ["g"], wanted, nearest=True).collect()}
    for g in (0, 1, 2):
        for k, v in columns.items():
            own = np.sort([x for i, x in enumerate(v) if (i + g) % 11]) if g < 2 else np.array([7.0])
            assert np.allclose(plain[g][k], np.quantile(own, qs), rtol=1e-12, atol=1e-18)
            assert nearest[g][k] == [own[max(int(np.ceil(round(len(own) * q, 9))) - 1, 0)] for q in qs]


def test_too_few_rounds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(order, "SORTED", 1)
    monkeypatch.setattr(order, "CELLS", 2)
    monkeypatch.setattr(order, "ROUNDS", 2)
    df = spark.createDataFrame([(0, float(i)) for i in range(100)], "g int, v double")
    with pytest.raises(ArithmeticError):
        order.quantiles(df, ["g"], {"v": [0.3]})


def test_separate_peaks_equal_a_plain_scan(spark):
    rng = np.random.default_rng(9)
    rows = [(img, y, x, float(v)) for img in ("a", "b") for y in range(40) for x in range(30) for v in [rng.integers(0, 60) + 100 * np.exp(-((y - 20) ** 2 + (x - 15) ** 2) / 40)]]
    got = routes.separate_peaks(spark.createDataFrame(rows, "img string, y long, x int, v double"), "v", 6, 7)
    for img in ("a", "b"):
        out = []
        for _, y, x, v in sorted((r for r in rows if r[0] == img), key=lambda r: (-r[3], r[1], r[2])):
            if len(out) < 6 and all(abs(y - b) >= 7 or abs(x - a) >= 7 for b, a, _ in out):
                out.append((y, x, v))
        assert [(r.y, r.x, r.v) for r in got.filter(f"img = '{img}'").orderBy("rank").collect()] == out


def test_bit_planes_come_back(spark):
    for n in (1, 8, 13, 64):
        words = [(i, int(w)) for i, w in enumerate(np.random.default_rng(n).integers(0, 1 << 32, n))]
        made = streams.bitshuffled(spark.createDataFrame(words, "i long, b long"), [], "i", "b")
        assert sorted((r["index"], r["word"]) for r in streams.unshuffled(made, []).collect()) == words


def test_context_trees_are_bounded(spark):
    names = [f"f{i}" for i in range(17)]
    with pytest.raises(ValueError):
        routes.context_tree(spark.createDataFrame([tuple([0] * 18)], ", ".join(f"{k} long" for k in [*names, "one"])), names, "one", 2)


def test_settled_tables_are_forgotten(spark, tmp_path):
    made = tables.settled(spark.range(5).toDF("v"), "test")
    assert made.count() == 5
    folder = tables.own_folder(spark).removeprefix("file://").removeprefix("file:")
    import os

    assert os.listdir(folder)
    tables.forget(spark)
    assert not os.path.exists(folder)

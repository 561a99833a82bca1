import pytest

CLASHING = ["_bucket", "_h", "_g", "_row", "_spans", "_all", "_k", "_kept", "_shard", "rest", "word", "score", "node", "length", "piece", "label", "term"]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty, blank, one-word and very long texts, a repeated row, a null key, clashing columns."""
    texts = ["plain words stand here in a row of ten", None, "", " \n\t ", "word", "long " * 40_000, "x" * 100_000, "tie tie tie", "tie tie tie", "é ü 漢字 \u0000  mixed"]
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "a row without a key has text", None, None, None), (None, None, None, None, None)]
    wide = [r + tuple(f"{c}{i}" for c in CLASHING) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(wide, schema)


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def small(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}

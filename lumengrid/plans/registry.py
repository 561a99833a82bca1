"""Where queries register, and the SQL fragments that their oracles are put together from."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_GRIDS = {
    "emb1": "SELECT 'emb1' AS img, vec_id AS y, CAST(unnest(range(64)) AS INTEGER) AS x, 0 AS c, CAST(unnest(embedding) AS FLOAT) AS v FROM embeddings",
    "emb4": "SELECT 'emb4' AS img, y, CAST(p // 4 AS INTEGER) AS x, CAST(p % 4 AS INTEGER) AS c, v FROM (SELECT vec_id AS y, unnest(range(64)) AS p, CAST(unnest(embedding) AS FLOAT) AS v FROM embeddings)",
    "ord3": "SELECT 'ord3' AS img, (o_orderkey // 3) // 64 AS y, CAST((o_orderkey // 3) % 64 AS INTEGER) AS x, CAST(o_orderkey % 3 AS INTEGER) AS c, CAST(o_totalprice / 100000 AS FLOAT) AS v FROM orders",
    "evt1": "SELECT 'evt1' AS img, event_id // 100 AS y, CAST(event_id % 100 AS INTEGER) AS x, 0 AS c, CAST(value AS FLOAT) AS v FROM events",
    "part1": "SELECT 'part1' AS img, p_partkey // 50 AS y, CAST(p_partkey % 50 AS INTEGER) AS x, 0 AS c, CAST(p_retailprice AS FLOAT) AS v FROM part",
}


def grid_sql(*names: str) -> str:
    return "g AS (" + " UNION ALL ".join(_GRIDS[n] for n in names) + ")"


#: Words: b (IEEE) and o (ordered).
WORDS = """gb AS (SELECT *, CAST(CAST(v AS BIT) AS BIGINT) AS b FROM g),
go AS (SELECT *, CASE WHEN b >= 2147483648 THEN 4294967295 - b ELSE b + 2147483648 END AS o FROM gb)"""

#: Neighbours of o, 0 outside.
NEIGHBOURS = """nr AS (SELECT *, lag(o, 1, 0) OVER (PARTITION BY img, c, y ORDER BY x) AS w, lead(o, 1, 0) OVER (PARTITION BY img, c, y ORDER BY x) AS e FROM go),
nb AS (SELECT *, lag(o, 1, 0) OVER k AS n, lag(w, 1, 0) OVER k AS nw, lag(e, 1, 0) OVER k AS ne FROM nr WINDOW k AS (PARTITION BY img, c, x ORDER BY y))"""

_PLANAR = "least(greatest(w + n - nw, 0), 4294967295)"
PREDICTIONS = {
    "raw": "0",
    "west": "w",
    "north": "n",
    "northwest": "nw",
    "northeast": "ne",
    "planar": _PLANAR,
    "med": f"CASE WHEN nw >= greatest(w, n) THEN least(w, n) WHEN nw <= least(w, n) THEN greatest(w, n) ELSE {_PLANAR} END",
    "select": "CASE WHEN abs((n & 2147483647) - (nw & 2147483647)) < abs((w & 2147483647) - (nw & 2147483647)) THEN w & 2147483647 ELSE n & 2147483647 END",
    "paeth": "CASE WHEN abs((n & 2147483647) - (nw & 2147483647)) <= abs((w & 2147483647) - (nw & 2147483647)) AND abs((n & 2147483647) - (nw & 2147483647)) <= abs((w & 2147483647) + (n & 2147483647) - 2 * (nw & 2147483647)) THEN w & 2147483647 WHEN abs((w & 2147483647) - (nw & 2147483647)) <= abs((w & 2147483647) + (n & 2147483647) - 2 * (nw & 2147483647)) THEN n & 2147483647 ELSE nw & 2147483647 END",
    "xor_planar": "xor(xor(w, n), nw)",
    "xor_majority": "(w & n) | (w & nw) | (n & nw)",
}


def residual_sql(mode: str) -> str:
    p = PREDICTIONS[mode]
    if mode == "raw":
        return "o & 2147483647"
    if mode.startswith("xor"):
        return f"xor(o, {p}) & 2147483647"
    return f"((o & 2147483647) - (({p}) & 2147483647) + 2147483648) % 2147483648"


def modes_sql(modes, keep: str = "img, y, x, c") -> str:
    return "r AS (" + " UNION ALL ".join(f"SELECT {keep}, '{m}' AS mode, {i} AS ord, {residual_sql(m)} AS r FROM nb" for i, m in enumerate(modes)) + ")"


KT = "(lgamma(n + 1) + ln(pi()) - lgamma(n - ones + 0.5) - lgamma(ones + 0.5)) / ln(2)"
BITS31 = "(SELECT unnest(range(31)) AS bit)"

"""Neighbours of samples, predictions from them and residuals.

Neighbours outside the image are 0 in the integer domain.  All neighbours of a sample need two shuffles, one by
rows and one by columns of the image; every predictor and every context of every bit is then a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B

MODES = ("raw", "west", "north", "northwest", "northeast", "planar", "med", "select", "paeth", "xor_planar", "xor_majority")


def with_words(samples: DataFrame) -> DataFrame:
    """samples with their word `b` and their ordered word `o`."""
    return samples.withColumn("b", B.float_bits(F.col("v"))).withColumn("o", B.ordered(F.col("b")))


def with_neighbours(samples: DataFrame, value: str = "o", within: tuple[str, ...] = (), fill: int | None = 0) -> DataFrame:
    """samples with w, n, nw, ne (of value; inside the groups that the columns `within` make)."""
    fill_with = F.lit(fill).cast(samples.schema[value].dataType) if fill is not None else F.lit(None)
    row = Window.partitionBy("img", "c", "y", *within).orderBy("x")
    column = Window.partitionBy("img", "c", "x", *within).orderBy("y")
    out = samples.withColumn("w", F.coalesce(F.lag(value).over(row), fill_with)).withColumn("_e", F.coalesce(F.lead(value).over(row), fill_with))
    above = {"n": value, "nw": "w", "ne": "_e"}
    return out.withColumns({k: F.coalesce(F.lag(v).over(column), fill_with) for k, v in above.items()}).drop("_e")


def with_channels(samples: DataFrame, value: str = "o") -> DataFrame:
    """samples with pc (the channel before) and green (channel 1, for channels 0 and 2 of three or more); else 0."""
    pixel = Window.partitionBy("img", "y", "x")
    green = F.max(F.when(F.col("c") == 1, F.col(value))).over(pixel)
    channels = F.count(F.lit(1)).over(pixel)
    before = F.coalesce(F.lag(value).over(pixel.orderBy("c")), F.lit(0))
    return samples.withColumn("pc", before).withColumn("green", F.when((channels >= 3) & F.col("c").isin(0, 2), F.coalesce(green, F.lit(0))).otherwise(F.lit(0)))


def planar(w: Column, n: Column, nw: Column, most: int = B.WORD) -> Column:
    return F.least(F.greatest(w + n - nw, B.long(0)), B.long(most))


def med(w: Column, n: Column, nw: Column, most: int = B.WORD) -> Column:
    high, low = F.greatest(w, n), F.least(w, n)
    return F.when(nw >= high, low).when(nw <= low, high).otherwise(planar(w, n, nw, most))


def select(w: Column, n: Column, nw: Column) -> Column:
    return F.when(F.abs(n - nw) < F.abs(w - nw), w).otherwise(n)


def paeth(w: Column, n: Column, nw: Column) -> Column:
    p = w + n - nw
    a, b, c = F.abs(p - w), F.abs(p - n), F.abs(p - nw)
    return F.when((a <= b) & (a <= c), w).when(b <= c, n).otherwise(nw)


def prediction(mode: str) -> Column:
    """The prediction of a sample from the columns w, n, nw and ne; select and paeth look at the 31-bit body."""
    w, n, nw, ne = (F.col(x) for x in ("w", "n", "nw", "ne"))
    body = [x.bitwiseAND(B.long(B.BODY)) for x in (w, n, nw)]
    return {
        "raw": lambda: B.long(0),
        "west": lambda: w,
        "north": lambda: n,
        "northwest": lambda: nw,
        "northeast": lambda: ne,
        "planar": lambda: planar(w, n, nw),
        "med": lambda: med(w, n, nw),
        "select": lambda: select(*body),
        "paeth": lambda: paeth(*body),
        "xor_planar": lambda: w.bitwiseXOR(n).bitwiseXOR(nw),
        "xor_majority": lambda: w.bitwiseAND(n).bitwiseOR(w.bitwiseAND(nw)).bitwiseOR(n.bitwiseAND(nw)),
        "channel": lambda: F.col("pc"),
        "green": lambda: F.col("green"),
    }[mode]()


def float_prediction(mode: str) -> Column:
    """Ordered word of the binary32 MED or planar prediction; columns fw, fn, fnw, w, n, x, y.  Borders differ from
    the integer rule: the first row takes the west word, the first column the north word, the origin that of 0.0."""
    w, n, nw = F.col("fw"), F.col("fn"), F.col("fnw")
    plane = n + w - nw
    inner = plane if mode == "planar" else F.when(nw >= F.greatest(n, w), F.least(n, w)).when(nw <= F.least(n, w), F.greatest(n, w)).otherwise(plane)
    word = B.ordered(B.float_bits(inner.cast("float")))
    return F.when((F.col("y") == 0) & (F.col("x") == 0), B.long(B.SIGN)).when(F.col("y") == 0, F.col("w")).when(F.col("x") == 0, F.col("n")).otherwise(word)


def body_residual(value: Column, predicted: Column) -> Column:
    """Difference of the 31-bit bodies modulo 2^31."""
    body = lambda x: x.bitwiseAND(B.long(B.BODY))
    return F.pmod(body(value) - body(predicted), B.long(1 << 31))


def xor_residual(value: Column, predicted: Column, mask: int = B.BODY) -> Column:
    return value.bitwiseXOR(predicted).bitwiseAND(B.long(mask))


def residuals(samples: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """samples (with o and its neighbours) times modes: `mode` and the payload `r` of the body, in one pass."""
    body = F.col("o").bitwiseAND(B.long(B.BODY))
    value = lambda m: body if m == "raw" else xor_residual(F.col("o"), prediction(m)) if m.startswith("xor") else body_residual(F.col("o"), prediction(m))
    each = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(i).alias("ord"), value(m).alias("r")) for i, m in enumerate(modes)])
    keep = [c for c in samples.columns if c not in ("v", "b", "o", "w", "n", "nw", "ne")]
    return samples.select(*keep, F.explode(each).alias("m")).select(*keep, "m.mode", "m.ord", "m.r")

"""All residual modes of sample words: payloads of the body (31 bits) and the sign (1 bit), and their inverse.

A mode is a way to take the difference (modular, or exclusive or) and a predictor.  Half modes predict ordered
half-precision words inside a tile, from neighbours that are half-precision values themselves.
Payloads are projections over neighbours; decoding needs the sample before, so an image channel is one sequential scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from . import predict as P

# The modes in their order (their numbers), and the candidates of each effort.
MODES = (
    "raw", "delta_zero", "delta_west", "delta_north", "delta_northwest", "delta_northeast", "delta_channel", "delta_green",
    "delta_med", "delta_planar", "delta_float_med", "delta_float_planar", "xor_zero", "xor_west", "xor_north", "xor_northwest",
    "xor_northeast", "xor_channel", "xor_green", "xor_bit_planar", "xor_bit_majority", "xor_float_med", "xor_float_planar",
    "delta_select", "delta_paeth", "half_raw", "half_west", "half_north", "half_med", "half_planar", "half_green", "half_paeth",
)
BODY_FAST = ("xor_zero", "delta_west", "delta_north", "delta_med")
BODY_FULL = (
    "xor_zero", "xor_west", "xor_north", "xor_green", "xor_float_med", "xor_float_planar", "delta_west", "delta_north", "delta_northwest",
    "delta_northeast", "delta_channel", "delta_green", "delta_med", "delta_planar", "delta_select", "delta_paeth", "delta_float_med", "delta_float_planar",
)
BODY_HALF = ("half_raw", "half_west", "half_north", "half_med", "half_planar", "half_green", "half_paeth")
SIGN_FAST = ("xor_zero", "xor_west", "xor_north")
SIGN_FULL = ("xor_zero", "xor_west", "xor_north", "xor_northwest", "xor_northeast", "xor_channel", "xor_bit_planar", "xor_bit_majority", "xor_float_med", "xor_float_planar")

c = F.col
_NAMES = {"channel": "channel", "green": "green", "bit_planar": "xor_planar", "bit_majority": "xor_majority"}


def with_context(samples: DataFrame) -> DataFrame:
    """samples (img, y, x, c, v) with words, neighbours (as words and as floats), and other channels."""
    n = P.with_channels(P.with_neighbours(P.with_words(samples)))
    row, column = Window.partitionBy("img", "c", "y").orderBy("x"), Window.partitionBy("img", "c", "x").orderBy("y")
    return n.withColumn("fw", F.lag("v").over(row)).withColumns({"fn": F.lag("v").over(column), "fnw": F.lag("fw").over(column)})


def predicted(mode: str) -> Column:
    kind, _, name = mode.partition("_")
    if name in ("", "zero"):
        return B.long(0)
    if name.startswith("float_"):
        return P.float_prediction(name.removeprefix("float_"))
    return P.prediction(_NAMES.get(name, name)).cast("long")


def payload(mode: str, mask: int = B.BODY) -> Column:
    """The residual of the bits under mask: the body, or the sign alone."""
    if mode == "raw":
        return c("o").bitwiseAND(B.long(mask))
    if mode.startswith("xor"):
        return c("o").bitwiseXOR(predicted(mode)).bitwiseAND(B.long(mask))
    if mask == B.SIGN:  # one digit: its difference modulo 2
        return c("o").bitwiseXOR(predicted(mode)).bitwiseAND(B.long(mask))
    return P.body_residual(c("o"), predicted(mode))


def payloads(near: DataFrame, modes: tuple[str, ...], mask: int = B.BODY, keep: tuple[str, ...] = ()) -> DataFrame:
    """near (with_context) times modes: img, y, x, c, columns to keep, mode, r."""
    each = F.array(*[F.struct(F.lit(m).alias("mode"), payload(m, mask).alias("r")) for m in modes])
    return near.select("img", "y", "x", "c", *keep, F.explode(each).alias("m")).select("img", "y", "x", "c", *keep, "m.*")


def half_context(samples: DataFrame, tile: int) -> DataFrame:
    """samples (img, y, x, c, h: ordered half word or null) with neighbours inside tiles, 0 for null ones."""
    tiled = samples.withColumns({"ty": F.expr(f"y div {tile}"), "tx": F.expr(f"cast(x div {tile} as int)"), "known": F.coalesce("h", B.long(0))})
    return P.with_channels(P.with_neighbours(tiled, "known", ("ty", "tx")), "known")


def half_payload(mode: str) -> Column:
    """The 16-bit residual of a half mode; 0 where the sample is no half-precision value."""
    w, n, nw = c("w"), c("n"), c("nw")
    guess = {"raw": B.long(0), "west": w, "north": n, "med": P.med(w, n, nw, 0xFFFF), "planar": P.planar(w, n, nw, 0xFFFF), "green": c("green").cast("long"), "paeth": P.paeth(w, n, nw)}[mode.removeprefix("half_")]
    return F.when(c("h").isNull(), B.long(0)).otherwise(F.pmod(c("h") - guess, B.long(1 << 16)))


# --- decoding

_WORD, _SIGN, _BODY = B.WORD, B.SIGN, B.BODY


def _float_of(word: int) -> np.float32:
    bits = word - _SIGN if word >= _SIGN else _WORD - word
    return np.array(bits, np.uint32).view(np.float32)[()]


def _word_of(value) -> int:
    bits = int(np.array(value, np.float32).view(np.uint32))
    return _WORD - bits if bits >= _SIGN else bits + _SIGN


def _median(w, n, nw, plane):
    return min(w, n) if nw >= max(w, n) else max(w, n) if nw <= min(w, n) else plane


def _clamped(w: int, n: int, nw: int) -> int:
    return min(max(w + n - nw, 0), _WORD)


def _paeth(w: int, n: int, nw: int) -> int:
    a, b, d = abs(n - nw), abs(w - nw), abs(w + n - 2 * nw)
    return w if a <= b and a <= d else n if b <= d else nw


def _from_floats(w: int, n: int, y: int, x: int, made) -> int:
    if y == 0:
        return w if x else _SIGN
    return n if x == 0 else _word_of(made())


def scalar_prediction(mode: str, w: int, n: int, nw: int, ne: int, y: int, x: int) -> int:
    """What `predicted` says of one sample, from its decoded neighbours."""
    name = mode.partition("_")[2]
    if name == "float_med":
        return _from_floats(w, n, y, x, lambda: _median(_float_of(w), _float_of(n), _float_of(nw), _float_of(n) + _float_of(w) - _float_of(nw)))
    if name == "float_planar":
        return _from_floats(w, n, y, x, lambda: _float_of(n) + _float_of(w) - _float_of(nw))
    bw, bn, bnw = w & _BODY, n & _BODY, nw & _BODY
    return {
        "": lambda: 0,
        "zero": lambda: 0,
        "west": lambda: w,
        "north": lambda: n,
        "northwest": lambda: nw,
        "northeast": lambda: ne,
        "med": lambda: _median(w, n, nw, _clamped(w, n, nw)),
        "planar": lambda: _clamped(w, n, nw),
        "select": lambda: bw if abs(bn - bnw) < abs(bw - bnw) else bn,
        "paeth": lambda: _paeth(bw, bn, bnw),
        "bit_planar": lambda: w ^ n ^ nw,
        "bit_majority": lambda: w & n | w & nw | n & nw,
    }[name]()


def decoded(residuals: DataFrame) -> DataFrame:
    """residuals (img, y, x, c, mode, r: body payload, s: sign bit) to words: img, y, x, c, mode, o.

    Modes that look at no other channel.  Rows are scanned in order; a sample's neighbours are the samples decoded
    before it in its row and in its column, as where the payloads were made.
    """

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x"]).reset_index(drop=True)
        mode, out = part["mode"].iat[0], np.zeros(len(part), np.int64)
        xor = mode.startswith("xor")
        above: dict[int, tuple[int, int, int]] = {}  # of each x: the sample decoded last, its west and its east one
        xs, rs, ss = part["x"].tolist(), part["r"].tolist(), part["s"].tolist()
        for y, at in part.groupby("y", sort=True).indices.items():
            west = 0
            for i in at.tolist():
                n, nw, ne = above.get(xs[i], (0, 0, 0))
                guess = scalar_prediction(mode, west, n, nw, ne, int(y), xs[i])
                body = rs[i] ^ guess & _BODY if xor else (rs[i] + guess) & _BODY
                west = out[i] = body | ss[i] << 31
                west = int(west)
            row = out[at].tolist()
            for k, i in enumerate(at.tolist()):
                above[xs[i]] = (row[k], row[k - 1] if k else 0, row[k + 1] if k + 1 < len(row) else 0)
        return part[["img", "y", "x", "c", "mode"]].assign(o=out)

    return residuals.groupBy("img", "c", "mode").applyInPandas(scan, "img string, y long, x int, c int, mode string, o long")

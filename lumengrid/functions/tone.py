"""Tone, colour and variance-stabilising maps of samples as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The SMPTE ST 2084 and ACEScct constants, BT.709 luma weights.
PQ_M1, PQ_M2 = 2610 / 16384, 2523 / 32
PQ_C1, PQ_C2, PQ_C3 = 3424 / 4096, 2413 / 128, 2392 / 128
ACES_CUT, ACES_A, ACES_B = 0.0078125, 10.5402377416545, 0.0729055341958355
ACES_LOG_A, ACES_LOG_B = 9.72, 17.52
LUMA = (0.2126, 0.7152, 0.0722)

TRANSFORMS = ("linear", "signed_log", "sqrt", "gamma075", "gamma025", "asinh")


def _signed(v: Column, magnitude: Column) -> Column:
    return F.when(v < 0, -magnitude).otherwise(magnitude)


def forward(v: Column, mode: str) -> Column:
    v, a = v.cast("double"), F.abs(v.cast("double"))
    return {
        "linear": v,
        "signed_log": _signed(v, F.log2(a + 1)),
        "sqrt": _signed(v, F.sqrt(a)),
        "gamma075": _signed(v, F.pow(a, F.lit(0.75))),
        "gamma025": _signed(v, F.pow(a, F.lit(0.25))),
        "asinh": F.asinh(v),
    }[mode]


def inverse(t: Column, mode: str) -> Column:
    a = F.abs(t)
    return {
        "linear": t,
        "signed_log": _signed(t, F.pow(F.lit(2.0), a) - 1),
        "sqrt": _signed(t, t * t),
        "gamma075": _signed(t, F.pow(a, F.lit(1 / 0.75))),
        "gamma025": _signed(t, F.pow(a, F.lit(4.0))),
        "asinh": F.sinh(t),
    }[mode]


def vst(v: Column) -> Column:
    return forward(v, "gamma075")


def vst_inverse(t: Column) -> Column:
    return _signed(t, F.pow(F.abs(t), F.lit(4 / 3)))


def signed_power(v: Column, p: float) -> Column:
    return _signed(v, F.pow(F.abs(v.cast("double")), F.lit(p)))


def vst_mode(v: Column, mode: str, a: float, b: float, eps: float) -> Column:
    x, m = v.cast("double"), F.abs(v.cast("double"))
    if mode == "log":
        return _signed(x, F.log2(1 + m / eps))
    if mode == "asinh":
        return F.asinh(x / eps)
    if mode == "sqrt":
        return _signed(x, (2 / a) * (F.sqrt(m * a + b) - b**0.5))
    return forward(v, mode)


def pq(v: Column, scale: float) -> Column:
    m = F.pow(F.abs(v.cast("double")) / scale, F.lit(PQ_M1))
    return _signed(v, F.pow((PQ_C1 + PQ_C2 * m) / (1 + PQ_C3 * m), F.lit(PQ_M2)))


def pq_inverse(t: Column, scale: float) -> Column:
    m = F.pow(F.abs(t), F.lit(1 / PQ_M2))
    return _signed(t, F.pow(F.greatest(m - PQ_C1, F.lit(0.0)) / F.greatest(PQ_C2 - PQ_C3 * m, F.lit(1e-12)), F.lit(1 / PQ_M1)) * scale)


def acescct(v: Column, scale: float) -> Column:
    a = F.abs(v.cast("double")) / scale
    return _signed(v, F.when(a >= ACES_CUT, (F.log2(a) + ACES_LOG_A) / ACES_LOG_B).otherwise(ACES_A * a + ACES_B))


def acescct_inverse(t: Column, scale: float) -> Column:
    a, cut = F.abs(t), ACES_A * ACES_CUT + ACES_B
    return _signed(t, F.when(a > cut, F.pow(F.lit(2.0), a * ACES_LOG_B - ACES_LOG_A)).otherwise((a - ACES_B) / ACES_A) * scale)


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r.cast("double") + LUMA[1] * g.cast("double") + LUMA[2] * b.cast("double")


def log_luma(y: Column) -> Column:
    return F.log2(1 + F.greatest(y, F.lit(0.0)))


def display(v: Column, exposure: float = 0.0, white: float = 4.0, gamma: float = 2.2) -> Column:
    scaled = v.cast("double") * (2.0**exposure) / white
    return F.pow(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)), F.lit(1 / gamma))


def ycocg(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return (r + 2 * g + b) / 4, r - b, g - (r + b) / 2


def ycocg_inverse(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    half = y - cg / 2
    return half + co / 2, y + cg / 2, half - co / 2


def smoothstep(low: float, high: float, v: Column) -> Column:
    t = F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)

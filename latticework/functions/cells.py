"""Elementwise functions: thresholds, displayable ranges, colours, channels, borders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = {"uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 2**32 - 1), "int8": (-128, 127), "int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1)}


def truncated(v: Column, kind: str = "bigint") -> Column:
    """Towards zero, as an integer."""
    return v.cast("double").cast(kind)


def wrapped(v: Column, bits: int, signed: bool = False) -> Column:
    """Integer arithmetic of a narrow type: modulo 2^bits."""
    low = F.pmod(v, F.lit(2**bits))
    return F.when(low >= 2 ** (bits - 1), low - 2**bits).otherwise(low) if signed else low


def threshold(v: Column, t, on=1, off=0) -> Column:
    return F.when(v > t, F.lit(on)).otherwise(F.lit(off))


def invert(v: Column) -> Column:
    return F.when(v == 0, F.lit(1)).otherwise(F.lit(0))


def to_displayable(v: Column, bias: float = 0.0, kind: str = "uint8") -> Column:
    """Shifted by ``bias``, clamped to 0 and the largest value of ``kind``, truncated."""
    return truncated(F.greatest(F.lit(0.0), F.least(F.lit(float(RANGES[kind][1])), v + F.lit(bias))), "int")


def normalize_u8(v: Column, low: float, high: float) -> Column:
    """The window low..high spread over 0..255; all 0 if it is empty."""
    if high <= low:
        return F.lit(0)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.lit(float(low))) / F.lit(float(high) - float(low))))
    return F.floor(part * 255 + 0.5).cast("int")


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """Red, green and blue from 0 to 1; hue from 0 to 1 in six sectors."""
    six = h * 6
    sector = F.floor(six) % 6
    f = six - F.floor(six)
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    table = ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))
    out = []
    for channel in range(3):
        pick = F.when(sector == 0, table[0][channel])
        for k in range(1, 6):
            pick = pick.when(sector == k, table[k][channel])
        out.append(pick)
    return out


def rgb_to_yuv(r: Column, g: Column, b: Column) -> list[Column]:
    """Integer studio-range luma and chroma."""
    # fixed values: weights of the video standard in 1/256, and offsets
    rows = ((66, 129, 25, 16), (-38, -74, 112, 128), (112, -94, -18, 128))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c))
    return [clamp(F.shiftright(r * a + g * c + b * d + 128, 8) + e) for a, c, d, e in rows]


def reduce_channels(values: list[Column], mode: str) -> Column:
    """One value from channels: phase (of 2), magnitude, sum, mean or max; rgb is the array of its 3."""
    if not values or (mode == "phase" and len(values) != 2) or (mode == "rgb" and len(values) != 3):
        raise ValueError(f"{mode} does not take {len(values)} channels")
    if mode == "phase":
        return F.atan2(values[1], values[0])
    if mode == "rgb":
        return F.array(*values)
    total = values[0] if mode != "magnitude" else values[0] * values[0]
    for v in values[1:]:
        total = F.greatest(total, v) if mode == "max" else total + (v * v if mode == "magnitude" else v)
    if mode == "magnitude":
        return F.sqrt(total)
    if mode == "mean":
        return total / len(values)
    if mode in ("sum", "max"):
        return total
    raise ValueError(f"unknown mode {mode}")


def bucket(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin from 0 to bins - 1, ``high`` in the last one; an empty range has one bin."""
    part = F.try_divide((v - low).cast("double"), (high - low).cast("double"))
    return F.when(high <= low, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), (part * bins).cast("int"))))


def fold(i: Column, n: int, border: str) -> Column:
    """Index of the cell that stands in for ``i`` beyond an axis of ``n``: clamp, wrap or reflect, one fold."""
    if border == "clamp":
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), i))
    if border == "wrap":
        return F.when(i < 0, i + n).when(i >= n, i - n).otherwise(i)
    if border == "reflect":
        return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)
    raise ValueError(f"unknown border {border}")


def fold_index(i: int, n: int, border: str) -> int:
    if border == "clamp":
        return max(0, min(n - 1, i))
    if border == "wrap":
        return i + n if i < 0 else i - n if i >= n else i
    if border == "reflect":
        return -i - 1 if i < 0 else 2 * n - 1 - i if i >= n else i
    raise ValueError(f"unknown border {border}")


def gaussian_weights(sigma: float) -> list[float]:
    """Normalised weights from -ceil(3 sigma) to ceil(3 sigma)."""
    r = math.ceil(3 * sigma)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    total = sum(w)
    return [x / total for x in w]

"""Scalar formulas: units, windows, clamps, colours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def clamp255(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(255))


def to_byte(x: Column) -> Column:
    """A value of [0, 1] as a byte, truncated."""
    return F.floor(x * 255).cast("int")


def threshold(x: Column, at: float) -> Column:
    return F.when(x >= at, 255).otherwise(0)


def mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_to_hz(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)


def bin_to_hz(i: Column, band_low: int, sample_rate: float, window_size: int) -> Column:
    """Frequency of a spectrogram bin, the ``band_low`` dropped bins counted in."""
    return (i + band_low) * float(sample_rate) / float(window_size)


def frame_to_seconds(i: Column, window_size: int, step: int, sample_rate: int) -> Column:
    return i / F.lit((window_size / step) * sample_rate / window_size)


def seconds_to_frame(t: Column, window_size: int, step: int, sample_rate: int) -> Column:
    """The frame at a time, with the whole number of steps in a window."""
    return (t * float(window_size // step) * sample_rate / window_size).cast("int")


def window(kind: int, i: Column, n: int) -> Column:
    """Weight of sample ``i`` of ``n``: 0 rectangular, 1 Bartlett, 2 Hamming, 3 Hann."""
    if kind == 0:
        return F.lit(1.0)
    if kind == 1:
        return F.when(i < n / 2, i / (n / 2)).otherwise(2.0 - i / (n / 2))
    a = 0.54 if kind == 2 else 0.5
    return a - (1 - a) * F.cos(2 * math.pi * i / (n - 1))


WINDOW_NAMES = ("Rectangular", "Bartlett", "Hamming", "Hanning")


def max3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(a, b, c)


def min3(a: Column, b: Column, c: Column) -> Column:
    return F.least(a, b, c)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct<h, s, v>: channels of [0, 1], hue in degrees (0 for greys)."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    h = F.when(d == 0, 0.0).when(high == r, (g - b) / d).when(high == g, 2 + (b - r) / d).otherwise(4 + (r - g) / d) * 60
    return F.struct(F.when(h < 0, h + 360).otherwise(h).alias("h"), F.when(high == 0, 0.0).otherwise(d / high).alias("s"), high.alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """struct<r, g, b>: all of [0, 1], hue as a share of the circle."""
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    k = i % 6
    pick = lambda *six: F.when(k == 0, six[0]).when(k == 1, six[1]).when(k == 2, six[2]).when(k == 3, six[3]).when(k == 4, six[4]).otherwise(six[5])
    return F.struct(pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b"))

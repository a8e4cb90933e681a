"""Frames as arrays: letterbox geometry and reconstruction metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letterbox(width: Column, height: Column, to_width: int, to_height: int, half_up: bool = False) -> dict[str, Column]:
    """The size of a frame fitted into another, and the margins left of and above it.

    Sizes are rounded to even at ties, or upwards with ``half_up``.
    """
    scale = F.least(F.lit(float(to_width)) / width, F.lit(float(to_height)) / height)
    whole = (lambda x: F.floor(x + 0.5)) if half_up else F.rint
    w = F.greatest(whole(width * scale), F.lit(1)).cast("int")
    h = F.greatest(whole(height * scale), F.lit(1)).cast("int")
    return {"w": w, "h": h, "left": F.floor((F.lit(to_width) - w) / 2).cast("int"), "top": F.floor((F.lit(to_height) - h) / 2).cast("int")}


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)


def l1(a: Column, b: Column) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def mse(a: Column, b: Column) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def psnr(a: Column, b: Column, peak: float = 1.0, most: float = 100.0) -> Column:
    """In decibels; ``most`` for equal frames, and never above it."""
    error = mse(a, b)
    return F.when(error == 0, F.lit(most)).otherwise(F.least(F.lit(most), 10 * F.log10(F.lit(peak * peak) / error)))


def masked_l1(a: Column, b: Column, mask: Column) -> Column:
    """Mean absolute error where the mask is set; 0 if it never is."""
    errors = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    held = F.zip_with(errors, mask, lambda e, m: e * m.cast("double"))
    weight = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double"))
    return F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.greatest(weight, F.lit(1.0))


def motion_mask(frame: Column, first: Column, threshold: float) -> Column:
    """Where a frame differs from the first one."""
    return F.zip_with(frame, first, lambda x, y: F.abs(x.cast("double") - y.cast("double")) > threshold)


def is_same_first_frame(a: Column, b: Column, most_mae: float = 8.0, least_psnr: float = 28.0) -> Column:
    """The gate on a first frame, in 8-bit values."""
    return (l1(a, b) <= most_mae) & (psnr(a, b, 255.0) >= least_psnr)

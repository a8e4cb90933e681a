"""Index arithmetic and array operations on fixed-length windows of a series."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def resample_rint(length: Column, wanted: int, fps: Column, target: Column, start: Column) -> Column:
    """Indices of a uniform resampling, ties to even, clipped to the series; zeros for an empty one."""
    steps = F.sequence(F.lit(0), F.lit(wanted - 1))
    at = F.transform(steps, lambda i: clip_long(F.rint(i * fps / target).cast("long") + start, length))
    return F.when(length < 1, F.array_repeat(F.lit(0).cast("long"), wanted)).otherwise(at)


def clip_long(x: Column, length: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0).cast("long")), (length - 1).cast("long"))


def resample_half_up(wanted: int, fps: Column, target: Column) -> Column:
    """Offsets of a uniform resampling, ties upwards."""
    return F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: half_up(i * fps / target))


def source_offsets(wanted: int, fps: Column, target: Column) -> Column:
    """As :func:`resample_half_up`; a source slower than the target, and a repeated index, raise an error."""
    at = resample_half_up(wanted, fps, target)
    slow = F.raise_error(F.lit("the source is slower than the target rate"))
    twice = F.raise_error(F.lit("a frame would be taken twice"))
    return F.when(~(fps > 0) | ~(target > 0) | (fps + 1e-9 < target), slow).when(~is_increasing(at), twice).otherwise(at)


def native_stride(stride: int, fps: Column, target: Column) -> Column:
    """A stride in target frames as frames of the source, one at least."""
    return F.greatest(half_up(F.lit(stride) * fps / target), F.lit(1).cast("long"))


def eval_window(values: Column, steps: int = 16) -> Column:
    """The first steps of an array, its last element repeated where it is shorter."""
    last = F.size(values) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.get(values, F.least(i, last)))


def causal_split(values: Column, steps: int = 16) -> tuple[Column, Column]:
    """What a window may see, all its steps but the last, and the last one."""
    return F.slice(values, 1, steps - 1), F.get(values, F.lit(steps - 1))


def selected_actions(values: Column, indices: Column, frames: Column) -> Column:
    """Values at indices held within the array, as many as frames with the last one repeated, and then without the last."""
    at = lambda i: F.get(values, F.least(F.greatest(i, F.lit(0)), F.size(values) - 1))
    chosen = F.when(F.size(indices) > 0, F.transform(indices, at)).otherwise(values)
    chosen = F.slice(chosen, 1, frames)
    more = F.array_repeat(F.element_at(chosen, -1), F.greatest(frames - F.size(chosen), F.lit(0)))
    return F.slice(F.concat(chosen, more), 1, frames - 1)


def first_frame_only(frame: Column, steps: int) -> Column:
    """A flat clip whose first frame is this one, and whose others are zeros."""
    return F.concat(frame, F.array_repeat(F.lit(0.0).cast("double"), F.size(frame) * (steps - 1)))


def is_increasing(values: Column) -> Column:
    pairs = F.arrays_zip(F.slice(values, 1, F.size(values) - 1).alias("a"), F.slice(values, 2, F.size(values) - 1).alias("b"))
    return F.forall(pairs, lambda p: p["a"] < p["b"])


def max_window_start(length: Column, wanted: int, fps: Column, target: Column) -> Column:
    return F.greatest(length - 1 - F.rint((wanted - 1) * fps / target).cast("long"), F.lit(0).cast("long"))


def required_length(wanted: int, fps: Column, target: Column) -> Column:
    return F.rint((wanted - 1) * fps / target).cast("long") + 1


def hop_starts(length: Column, last_offset: Column, stride: Column, tail: bool = True) -> Column:
    """Starts of hopping windows, the last one at the end of the series; empty if none fits."""
    last = (length - 1 - last_offset).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long")), stride.cast("long"))
    starts = F.array_union(starts, F.array(last)) if tail else starts
    return F.when(last >= 0, starts).otherwise(F.array().cast("array<bigint>"))


def tail_repeat(values: Column, length: int) -> Column:
    """An array made this long by its last element; longer ones are cut."""
    more = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.slice(F.concat(values, F.array_repeat(F.element_at(values, -1), more)), 1, length)


def along(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def displacement(x: Column, w: WindowSpec) -> Column:
    return x - F.first(x).over(w)


def velocity(x: Column, w: WindowSpec) -> Column:
    return x - F.coalesce(F.lag(x).over(w), x)


def shifted(x: Column, w: WindowSpec, fill: Column) -> Column:
    """The value before; ``fill`` for the first."""
    return F.coalesce(F.lag(x).over(w), fill)


def second_difference(x: Column, w: WindowSpec) -> Column:
    return F.lead(x).over(w) - 2 * x + F.lag(x).over(w)


def lerp(values: Column, length: int) -> Column:
    """Linear interpolation of an array to another length, ends kept."""
    span = (F.size(values) - 1) / F.lit(max(1, length - 1))

    def at(i: Column) -> Column:
        x = i * span
        low = F.floor(x).cast("int")
        high = F.least(low + 1, F.size(values) - 1)
        return F.get(values, low) + (x - low) * (F.get(values, high) - F.get(values, low))

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)


def smooth_l1(error: Column, beta: float = 1.0) -> Column:
    e = F.abs(error)
    return F.when(e < beta, 0.5 * e * e / beta).otherwise(e - 0.5 * beta)


def state_losses(a: Column, b: Column, steps: int, width: int, beta: float = 1.0, weights: tuple[float, float, float] = (1.0, 1.0, 0.25)) -> dict[str, Column]:
    """Smooth errors of flat state series (steps of this width): of the first state, of the others, of differences, and their weighted sum."""

    def mean(errors: Column, n: int) -> Column:
        return F.aggregate(errors, F.lit(0.0), lambda s, x: s + smooth_l1(x, beta)) / n

    error = F.zip_with(a, b, lambda x, y: x - y)
    initial = mean(F.slice(error, 1, width), width)
    rest = (steps - 1) * width
    later = F.slice(error, width + 1, rest)
    none = F.lit(0.0)
    rollout = mean(later, rest) if rest else none
    # The difference of two series' differences is that of their errors.
    velocity = mean(F.zip_with(later, F.slice(error, 1, rest), lambda x, y: x - y), rest) if rest else none
    total = weights[0] * initial + weights[1] * rollout + weights[2] * velocity
    return {"initial": initial, "rollout": rollout, "velocity": velocity, "total": total}


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: mean where the mask is set; 0 if it never is."""
    m = mask.cast("double")
    return F.sum(value * m) / F.greatest(F.sum(m), F.lit(1.0))

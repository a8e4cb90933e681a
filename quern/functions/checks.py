"""Predicates that records are held against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.keys import is_sha256  # noqa: F401

def is_finite_vector(values: Column, width: int | None = None) -> Column:
    """Whether an array has numbers alone, at least one, and this many if it is told."""
    fits = F.size(values) > 0 if width is None else F.size(values) == width
    infinite = F.lit(float("inf"))
    return F.coalesce(fits & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)), F.lit(False))


def is_key_list(values: Column) -> Column:
    """Whether an array has strings alone, none empty or twice, and at least one."""
    return F.coalesce(
        (F.size(values) > 0) & (F.size(F.array_distinct(values)) == F.size(values)) & F.forall(values, lambda x: x != ""), F.lit(False)
    )


def is_safe_path(path: Column, forbidden: tuple[str, ...] = ()) -> Column:
    """Whether a relative path stays below its root and has no forbidden part."""
    parts = F.split(F.lower(path), "/")
    banned = F.array(*[F.lit(x) for x in ("..", *forbidden)])
    return F.coalesce(~path.startswith("/") & ~F.arrays_overlap(parts, banned), F.lit(False))


def is_source_index(indices: Column, start: Column) -> Column:
    """Whether indices begin at the start and never go back."""
    steps = F.zip_with(indices, F.slice(indices, 2, F.size(indices)), lambda a, b: F.coalesce(b >= a, F.lit(True)))
    return F.coalesce((F.size(indices) > 0) & (indices[0] == start) & (start >= 0) & F.forall(steps, lambda x: x), F.lit(False))


def is_included(flag: Column, default: bool) -> Column:
    return F.coalesce(flag, F.lit(default))


def is_stats(center: Column, scale: Column) -> Column:
    """Whether statistics are finite vectors of one width, with positive scales."""
    fits = is_finite_vector(center) & is_finite_vector(scale) & (F.size(center) == F.size(scale))
    return F.coalesce(fits & F.forall(scale, lambda x: x > 0), F.lit(False))


def is_eval_action(rows: Column, steps: int = 16, width: int = 6) -> Column:
    """Whether an array of vectors has these steps, each finite and of this width."""
    return F.coalesce((F.size(rows) == steps) & F.forall(rows, lambda x: is_finite_vector(x, width)), F.lit(False))


def one_of(value: Column, allowed: tuple[str, ...], name: str) -> Column:
    """The value; one that is not among the allowed ones raises an error."""
    bad = F.raise_error(F.concat(F.lit(f"unknown {name}: "), F.coalesce(value.cast("string"), F.lit("null"))))
    return F.when(value.isin(*allowed), value).otherwise(bad)


def is_identity(repository: Column, index: Column, width: Column, height: Column) -> Column:
    """Whether a sample's identity has a repository, an index that is not negative, and a positive size."""
    return F.coalesce((repository != "") & (index >= 0) & (width > 0) & (height > 0), F.lit(False))

"""Clips of frames as flat arrays: motion, structure and reconstruction metrics, and a digest of their content.

A clip is a row: an array of numbers in the order of time, channel, row and
column. Clips of one shape are worked through many at a time by numpy in the
tasks; a clip has bounded size, and none meets another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Shape = tuple[int, int, int, int]  # time, channels, rows, columns
METRICS = (
    "l1 psnr ssim edge_l1 temporal_l1 motion_amplitude_error foreground_l1 background_l1 first_frame_l1 moving_fraction "
    "charbonnier edge_charbonnier temporal_charbonnier loss"
).split()
#: Weights of a loss's terms.
WEIGHTS = {"charbonnier": 1.0, "ssim": 0.25, "edge": 0.1, "temporal": 0.25}


def window_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Means over squares around each pixel, with zeros beyond the border."""
    half = size // 2
    padded = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(half + 1, half), (half + 1, half)])
    sums = padded.cumsum(axis=-1).cumsum(axis=-2)
    return (sums[..., size:, size:] - sums[..., :-size, size:] - sums[..., size:, :-size] + sums[..., :-size, :-size]) / size**2


def ssim(x: np.ndarray, y: np.ndarray, size: int = 7, peak: float = 1.0) -> np.ndarray:
    """The structural similarity of each pixel's surroundings."""
    a, b = window_mean(x, size), window_mean(y, size)
    var_x, var_y = window_mean(x * x, size) - a * a, window_mean(y * y, size) - b * b
    cov = window_mean(x * y, size) - a * b
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return (2 * a * b + c1) * (2 * cov + c2) / np.maximum((a * a + b * b + c1) * (var_x + var_y + c2), 1e-8)


def gradients(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel differences along columns and rows, with zeros beyond the border."""
    p = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(1, 1), (1, 1)])
    across, down = p[..., :, 2:] - p[..., :, :-2], p[..., 2:, :] - p[..., :-2, :]
    return (
        across[..., :-2, :] + 2 * across[..., 1:-1, :] + across[..., 2:, :],
        down[..., :, :-2] + 2 * down[..., :, 1:-1] + down[..., :, 2:],
    )


def moving(x: np.ndarray, threshold: float, dilation: int) -> np.ndarray:
    """Where frames differ from the first in the mean of channels, spread to squares of ``dilation`` pixels; never in the first."""
    mask = np.abs(x - x[:, :1]).mean(axis=2, keepdims=True) > threshold
    half = dilation // 2
    p = np.pad(mask, [(0, 0)] * 3 + [(half, half), (half, half)])
    rows, columns = mask.shape[-2:]
    out = np.zeros_like(mask)
    for i in range(2 * half + 1):
        for j in range(2 * half + 1):
            out |= p[..., i : i + rows, j : j + columns]
    out[:, 0] = False
    return out


def _mean(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Of each clip, the mean where the mask is set; 0 if it never is."""
    mask = np.broadcast_to(mask, values.shape)
    axes = tuple(range(1, values.ndim))
    return (values * mask).sum(axis=axes) / np.maximum(mask.sum(axis=axes), 1.0)


def measured(a: np.ndarray, b: np.ndarray, valid: np.ndarray, threshold: float, dilation: int, epsilon: float = 1e-3) -> list[np.ndarray]:
    """The columns of ``METRICS`` for predictions a and targets b, arrays of clips."""
    error, soft = np.abs(a - b), lambda x, y: np.sqrt((x - y) ** 2 + epsilon**2)
    edges = [*zip(gradients(a), gradients(b), strict=True)]
    structure = _mean(ssim(a, b), valid)
    motion = moving(b, threshold, dilation) * valid
    zero = np.zeros(len(a))
    temporal = amplitude = smooth = zero
    if a.shape[1] > 1:
        da, db = np.diff(a, axis=1), np.diff(b, axis=1)
        axes = tuple(range(1, a.ndim))
        temporal, smooth = _mean(np.abs(da - db), valid[:, 1:]), _mean(soft(da, db), valid[:, 1:])
        amplitude = np.abs(np.abs(da).mean(axis=axes) - np.abs(db).mean(axis=axes))
    char = _mean(soft(a, b), valid)
    edge_char = _mean(sum(soft(x, y) for x, y in edges), valid)
    w = WEIGHTS
    loss = w["charbonnier"] * char + w["ssim"] * (1 - structure) + w["edge"] * edge_char + w["temporal"] * smooth
    return [
        _mean(error, valid),
        -10 * np.log10(np.maximum(_mean((a - b) ** 2, valid), 1e-12)),
        structure,
        _mean(sum(np.abs(x - y) for x, y in edges), valid),
        temporal,
        amplitude,
        _mean(error, motion),
        _mean(error, (1 - motion) * valid),
        error[:, 0].mean(axis=(1, 2, 3)),
        motion.sum(axis=(1, 2, 3, 4)) / np.maximum(valid.sum(axis=(1, 2, 3, 4)), 1.0),
        char,
        edge_char,
        smooth,
        loss,
    ]


def _arrays(column: pa.Array, shape: Shape) -> np.ndarray:
    size = int(np.prod(shape))
    lists = column.to_pylist()
    wrong = [v for v in lists if v is None or len(v) != size]
    if wrong:
        raise ValueError(f"a clip does not have {size} numbers")
    return np.asarray(lists, dtype=np.float64).reshape(-1, *shape)


def reconstruction_metrics(
    clips: DataFrame,
    shape: Shape,
    *,
    id_col: str = "clip_id",
    prediction: str = "prediction",
    target: str = "target",
    valid: str | None = None,
    threshold: float = 3 / 255,
    dilation: int = 5,
) -> DataFrame:
    """(id, the columns of ``METRICS``) of clips and their targets.

    ``valid`` names a column of weights, one for each time, row and column, or
    for each row and column alone; without it every pixel counts. A clip that
    is null or of another size is an error. Repeated ids each get a row.
    """
    steps, _, rows, columns = shape

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            a, b = (_arrays(batch.column(i), shape) for i in (1, 2))
            if valid is None:
                mask = np.ones((len(a), steps, 1, rows, columns))
            else:
                flat = [np.asarray(v, dtype=np.float64) for v in batch.column(3).to_pylist()]
                mask = np.stack([np.broadcast_to(v.reshape(-1, 1, rows, columns), (steps, 1, rows, columns)) for v in flat])
            found = measured(a, b, mask, threshold, dilation)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names=[id_col, *METRICS])

    kind = dict(clips.dtypes)[id_col]
    wanted = [id_col, *[F.col(c).cast("array<double>").alias(c) for c in (prediction, target, *([valid] if valid else []))]]
    return clips.select(*wanted).mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{m} double" for m in METRICS))


def motion_masks(clips: DataFrame, shape: Shape, *, id_col: str = "clip_id", frames: str = "frames", threshold: float = 3 / 255, dilation: int = 5) -> DataFrame:
    """(id, mask): for each time, row and column whether it moves."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                mask = moving(_arrays(batch.column(1), shape), threshold, dilation)
                values = pa.array(mask.reshape(len(mask), -1).tolist(), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[id_col, "mask"])

    kind = dict(clips.dtypes)[id_col]
    return clips.select(id_col, F.col(frames).cast("array<double>").alias(frames)).mapInArrow(run, f"{id_col} {kind}, mask array<boolean>")


def restored(canvas: np.ndarray, box: tuple[int, int, int, int], size: tuple[int, int]) -> np.ndarray:
    """The part (left, top, width, height) of frames (..., rows, columns), stretched to (rows, columns) on straight lines between pixels' centres."""
    left, top, width, height = box
    part = canvas[..., top : top + height, left : left + width]

    def along(x: np.ndarray, axis: int, wanted: int) -> np.ndarray:
        have = x.shape[axis]
        at = np.clip((np.arange(wanted) + 0.5) * have / wanted - 0.5, 0, have - 1)
        low = np.floor(at).astype(np.int64)
        share = (at - low).reshape([-1 if i == axis % x.ndim else 1 for i in range(x.ndim)])
        return x.take(low, axis) * (1 - share) + x.take(np.minimum(low + 1, have - 1), axis) * share

    return along(along(part, -2, size[0]), -1, size[1])


def letterboxed(frame: np.ndarray, size: tuple[int, int], half_up: bool = False, pad: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A frame (..., rows, columns) fitted into a size (rows, columns), and where it lies; the rest is padding.

    Shrinking takes the mean of the area that a pixel covers, growing lies on
    straight lines. Sizes are rounded to even at ties, or upwards.
    """
    rows, columns = frame.shape[-2:]
    scale = min(size[0] / rows, size[1] / columns)
    whole = (lambda x: int(np.floor(x + 0.5))) if half_up else (lambda x: int(np.rint(x)))
    h, w = (max(1, min(s, whole(n * scale))) for s, n in zip(size, (rows, columns), strict=True))

    def areas(have: int, wanted: int) -> np.ndarray:
        edge = np.arange(wanted + 1) * have / wanted
        cell = np.arange(have)
        return np.clip(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0, None) * wanted / have

    small = areas(rows, h) @ frame @ areas(columns, w).T if scale < 1 else restored(frame, (0, 0, columns, rows), (h, w))
    top, left = (size[0] - h) // 2, (size[1] - w) // 2
    out, mask = np.full((*frame.shape[:-2], *size), pad), np.zeros(size, dtype=bool)
    out[..., top : top + h, left : left + w] = small
    mask[top : top + h, left : left + w] = True
    return out, mask


def fitted(frames: DataFrame, to: tuple[int, int], *, id_col: str = "frame_id", values: str = "values", half_up: bool = False, back: bool = False) -> DataFrame:
    """(id, values, mask) of frames (id, height, width, values), a row of numbers each, in a box of one size; with ``back``, and restored again."""

    def one(v: list, h: int, w: int) -> tuple[list, list]:
        made, mask = letterboxed(np.asarray(v, dtype=np.float64).reshape(h, w), to, half_up)
        if back:
            (top, left), (low, right) = np.argwhere(mask)[0], np.argwhere(mask)[-1]
            made = restored(made, (left, top, right - left + 1, low - top + 1), (h, w))
        return made.ravel().tolist(), mask.ravel().tolist()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = [one(v, h, w) for h, w, v in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            columns = [pa.array([m[0] for m in made], pa.list_(pa.float64())), pa.array([m[1] for m in made], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "values", "mask"])

    kind = dict(frames.dtypes)[id_col]
    return frames.select(id_col, "height", "width", F.col(values).cast("array<double>").alias(values)).mapInArrow(
        run, f"{id_col} {kind}, values array<double>, mask array<boolean>"
    )


def content_hash(values: list, shape: tuple[int, ...]) -> str:
    """Digest of the shape as 8-byte and the values as 4-byte little-endian numbers."""
    return hashlib.sha256(np.asarray(shape, dtype="<i8").tobytes() + np.asarray(values, dtype="<f4").tobytes()).hexdigest()


def content_hashes(rows: DataFrame, width: int, *, id_col: str, values: str) -> DataFrame:
    """(id, rows, content_sha256) of flat matrices of this width; nulls where a matrix is null or has another."""
    schema = pa.schema([("n", pa.int64()), ("h", pa.string())])

    def one(v: list | None) -> tuple:
        return (None, None) if v is None or len(v) % width else (len(v) // width, content_hash(v, (len(v) // width, width)))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = [one(v) for v in batch.column(1).to_pylist()]
            columns = [pa.array([m[i] for m in made], schema[i].type) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "rows", "content_sha256"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(id_col, F.col(values).cast("array<float>").alias(values)).mapInArrow(run, f"{id_col} {kind}, rows long, content_sha256 string")

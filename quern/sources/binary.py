"""Binary formats that columns hold: numpy arrays and the boxes of MP4 files."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def npy_arrays(files: DataFrame) -> DataFrame:
    """(path, shape, values) of files (path, content) in numpy's format; the values are flat, in row order."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in source:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in part["content"]]
            values = [a.astype(np.float64).ravel() for a in arrays]
            yield pd.DataFrame({"path": part["path"], "shape": [list(a.shape) for a in arrays], "values": values})

    return files.select("path", "content").mapInPandas(run, "path string, shape array<long>, values array<double>")


def boxes(data: bytes, first: int, last: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the boxes in a part of an MP4 file."""
    while first + 8 <= last:
        size, kind = struct.unpack_from(">I4s", data, first)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, first + 8)[0], 16
        size = size or last - first
        if size < head:
            return
        yield kind, first + head, min(last, first + size)
        first += size


def probe(data: bytes) -> tuple[int, float, int, int] | None:
    """(frames, frames a second, width, height) of the first video track; None if there is none."""

    def inside(span: tuple[int, int], *path: bytes) -> Iterator[tuple[int, int]]:
        for kind, start, end in boxes(data, *span):
            if kind == path[0]:
                yield from inside((start, end), *path[1:]) if len(path) > 1 else [(start, end)]

    for track in inside((0, len(data)), b"moov", b"trak"):
        handler = next(inside(track, b"mdia", b"hdlr"), None)
        if handler is None or data[handler[0] + 8 : handler[0] + 12] != b"vide":
            continue
        clock, head = next(inside(track, b"mdia", b"mdhd")), next(inside(track, b"tkhd"))
        scale, length = struct.unpack_from(">IQ" if data[clock[0]] else ">II", data, clock[0] + (20 if data[clock[0]] else 12))
        width, height = (v >> 16 for v in struct.unpack_from(">II", data, head[1] - 8))
        sizes = next(inside(track, b"mdia", b"minf", b"stbl", b"stsz"))
        frames = struct.unpack_from(">I", data, sizes[0] + 8)[0]
        return frames, frames * scale / length if length else 0.0, width, height
    return None


def video_probes(files: DataFrame) -> DataFrame:
    """(path, frames, fps, width, height) of MP4 files (path, content); nulls for what isn't one."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in source:
            found = [probe(c) or (None,) * 4 for c in part["content"]]
            out = pd.DataFrame(found, columns=["frames", "fps", "width", "height"]).astype({"frames": "Int64", "width": "Int64", "height": "Int64"})
            yield out.assign(path=part["path"].to_numpy())[["path", "frames", "fps", "width", "height"]]

    return files.select("path", "content").mapInPandas(run, "path string, frames long, fps double, width long, height long")

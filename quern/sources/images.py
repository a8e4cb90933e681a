"""PNG images as columns, decoded on numpy, and conditions of an evaluation: an image and an array of one stem."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.binary import npy_arrays
from quern.sources.episodes import paired_by_stem

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel, and the depths that it can have, by colour type; fixed values of the format.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, content) up to the end chunk; a chunk that is cut off or has another checksum is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at = 8
    while True:
        if at + 12 > len(data):
            raise ValueError("PNG is cut off")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        content, end = data[at + 8 : at + 8 + n], at + 12 + n
        if end > len(data):
            raise ValueError("PNG is cut off")
        if zlib.crc32(kind + content) != struct.unpack_from(">I", data, end - 4)[0]:
            raise ValueError(f"PNG chunk {kind!r} has another checksum")
        yield kind, content
        if kind == b"IEND":
            return
        at = end


def unfiltered(raw: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Rows (row, unit, byte of the unit) without their filters.

    A unit hangs on the one before it, the one above and the one before that,
    so all units on a line from lower left to upper right are worked out at
    once, whatever filters their rows have.
    """
    if (filters > 4).any():
        raise ValueError("PNG row has an unknown filter")
    rows, units, size = raw.shape
    out = np.zeros((rows + 1, units + 1, size), np.int16)
    for d in range(rows + units - 1):
        r = np.arange(max(0, d - units + 1), min(rows, d + 1))
        c, kind = d - r, filters[r, None]
        left, up, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[r + 1, c + 1] = (raw[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes. Grey stands for all three colours, alpha is left out, 16 bits are cut to their upper 8; interlaced files are an error."""
    head, palette, body = None, None, []
    for kind, content in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"PLTE":
            palette = np.frombuffer(content, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(content)
    if head is None:
        raise ValueError("PNG has no header")
    width, height, depth, colour, _, _, interlaced = head
    if depth not in DEPTHS.get(colour, ()) or interlaced or not width or not height:
        raise ValueError(f"PNG of colour type {colour}, depth {depth}, interlace {interlaced} and size {width} x {height} is not read")
    channels = CHANNELS[colour]
    stride, size = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    reader = zlib.decompressobj()
    flat = reader.decompress(b"".join(body), height * (stride + 1) + 1)
    if len(flat) != height * (stride + 1):
        raise ValueError("PNG has another size than its header says")
    rows = np.frombuffer(flat, np.uint8).reshape(height, stride + 1)
    samples = unfiltered(rows[:, 1:].reshape(height, stride // size, size).astype(np.int16), rows[:, 0]).reshape(height, stride)
    if depth < 8:
        bits = np.unpackbits(samples, axis=1)[:, : width * depth].reshape(height, width, depth)
        values = bits @ (1 << np.arange(depth)[::-1])
        samples = values if colour == 3 else values * (255 // ((1 << depth) - 1))
    elif depth == 16:
        samples = samples[:, ::2]
    pixels = samples.reshape(height, width, channels)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise ValueError("PNG has a colour that its palette lacks")
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2).astype(np.uint8) if channels < 3 else pixels[..., :3].astype(np.uint8)


def png_images(files: DataFrame) -> DataFrame:
    """(path, height, width, pixels) of files (path, content); pixels are bytes, row by row, three for each."""
    schema = pa.schema([("path", pa.string()), ("height", pa.int64()), ("width", pa.int64()), ("pixels", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # one at a time: pixels are larger than files
                try:
                    made = png_pixels(content)
                except (ValueError, zlib.error, struct.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                row = [[path], [made.shape[0]], [made.shape[1]], [made.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, height long, width long, pixels binary")


def conditions(images: DataFrame, arrays: DataFrame) -> DataFrame:
    """(sample_id, height, width, pixels, image_sha256, shape, values, array_sha256) of PNG and numpy files (path, content) of one stem.

    One without the other, a file that doesn't parse, and two of one stem are errors. Digests are of the files.
    """
    pairs = paired_by_stem(images.select("path"), arrays.select("path"))
    many = F.raise_error(F.concat(F.lit("more than one file of "), F.col("stem")))
    once = pairs.groupBy("stem").agg(F.count("*").alias("n"), F.min("a_path").alias("image_path"), F.min("b_path").alias("array_path"))
    named = once.select(F.when(F.col("n") == 1, F.col("stem")).otherwise(many).alias("sample_id"), "image_path", "array_path")
    digest = lambda files, name: files.select(F.col("path").alias("_path"), F.sha2("content", 256).alias(name))
    seen = png_images(images).withColumnRenamed("path", "image_path").join(digest(images, "image_sha256"), F.col("image_path") == F.col("_path")).drop("_path")
    held = npy_arrays(arrays).withColumnRenamed("path", "array_path").join(digest(arrays, "array_sha256"), F.col("array_path") == F.col("_path")).drop("_path")
    out = named.join(seen, "image_path").join(held, "array_path")
    return out.select("sample_id", "height", "width", "pixels", "image_sha256", "shape", "values", "array_sha256")

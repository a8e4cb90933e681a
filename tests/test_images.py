import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest

from quern.sources import images


def chunk(kind, content):
    return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))


def filtered(rows, size, kinds):
    """Rows of bytes with their filters, byte by byte."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        line = []
        for i, x in enumerate(row):
            a, b, c = row[i - size] if i >= size else 0, above[i], above[i - size] if i >= size else 0
            p = a + b - c
            near = min(((abs(p - v), k, v) for k, v in enumerate((a, b, c))))[2]
            line.append((x - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out, above = out + bytes([kind, *line]), row
    return out


def made(colour, depth, width, height, rng, kinds=None, palette=None, interlaced=0, parts=2):
    """(file, pixels) with random samples."""
    channels = images.CHANNELS[colour]
    most = len(palette) if palette is not None else 1 << depth
    samples = np.asarray([[[rng.randrange(most) for _ in range(channels)] for _ in range(width)] for _ in range(height)])
    bits = ((samples.reshape(height, -1, 1) >> np.arange(depth)[::-1]) & 1).reshape(height, -1)
    rows = [np.packbits(r).tobytes() for r in bits.astype(np.uint8)]
    body = zlib.compress(filtered(rows, max(1, channels * depth // 8), kinds or [rng.randrange(5) for _ in rows]))
    cut = len(body) // parts
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    data = images.SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"x") + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"")
    data += chunk(b"IDAT", body[:cut]) + chunk(b"IDAT", body[cut:]) + chunk(b"IEND", b"")
    if palette is not None:
        return data, palette[samples[..., 0]]
    grey = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
    return data, grey[..., :3] if channels > 2 else np.repeat(grey[..., :1], 3, axis=2)


@pytest.mark.parametrize("colour", sorted(images.DEPTHS))
def test_round_trip_of_all_depths_and_filters(colour):
    rng = random.Random(colour)
    for depth in images.DEPTHS[colour]:
        for width, height in ((1, 1), (7, 5), (16, 9), (3, 20)):
            palette = np.asarray([[rng.randrange(256) for _ in range(3)] for _ in range(1 << depth)], np.uint8) if colour == 3 else None
            data, want = made(colour, depth, width, height, rng, palette=palette)
            assert np.array_equal(images.png_pixels(data), want), (colour, depth, width, height)
    for kind in range(5):
        data, want = made(2, 8, 11, 6, rng, kinds=[kind] * 6)
        assert np.array_equal(images.png_pixels(data), want)


def test_what_is_refused():
    rng = random.Random(1)
    good, _ = made(2, 8, 4, 3, rng)
    short = np.zeros((1, 3), np.uint8)
    faults = {
        "no PNG": b"GIF" + good,
        "cut off": good[:-6],
        "another checksum": good[:30] + bytes([good[30] ^ 1]) + good[31:],
        "interlace 1": made(2, 8, 4, 3, rng, interlaced=1)[0],
        "unknown filter": images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x05\x00")) + chunk(b"IEND", b""),
        "another size": images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x00\x00")) + chunk(b"IEND", b""),
        "palette lacks": images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 3, 0, 0, 0)) + chunk(b"PLTE", short.tobytes()) + chunk(b"IDAT", zlib.compress(b"\x00\x01")) + chunk(b"IEND", b""),
        "depth 3": images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 3, 0, 0, 0, 0)) + chunk(b"IEND", b""),
        "no header": images.SIGNATURE + chunk(b"IEND", b""),
    }
    for said, data in faults.items():
        with pytest.raises(ValueError, match=said):
            images.png_pixels(data)


def npy(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def test_conditions(spark, tmp_path):
    rng, want = random.Random(5), {}
    for folder in ("images", "actions"):
        (tmp_path / folder).mkdir()
    for k in range(6):
        data, pixels = made(2, 8, 5 + k, 4, rng)
        action = npy(np.arange(6.0 * k + 6).reshape(-1, 6))
        (tmp_path / f"images/s{k}.png").write_bytes(data)
        (tmp_path / f"actions/s{k}.npy").write_bytes(action)
        want[f"s{k}"] = (4, 5 + k, pixels.astype(np.uint8).tobytes(), hashlib.sha256(data).hexdigest(), [k + 1, 6], hashlib.sha256(action).hexdigest())
    read = lambda folder: spark.read.format("binaryFile").load(str(tmp_path / folder)).select("path", "content")
    found = images.conditions(read("images"), read("actions")).collect()
    assert {r.sample_id: (r.height, r.width, bytes(r.pixels), r.image_sha256, r.shape, r.array_sha256) for r in found} == want
    (tmp_path / "images/s9.png").write_bytes(data)
    with pytest.raises(Exception, match="without its pair: s9"):
        images.conditions(read("images"), read("actions")).collect()
    (tmp_path / "actions/s9.npy").write_bytes(action)
    (tmp_path / "images/s9.png").write_bytes(data[:-3])
    with pytest.raises(Exception, match=r"s9\.png: PNG is cut off"):
        images.conditions(read("images"), read("actions")).collect()

"""Media columns: telephony audio.

Companded 8-bit samples (mu-law and A-law) are expanded by tables of 256
entries. ADPCM blocks are decoded together: a step of the decoder is one numpy
operation over all blocks at hand, so the loop is as long as a block, however
many blocks there are. Linear PCM is resampled by an integer factor and stored
as 16-bit little-endian samples; a stored stream is a WAV file with its codec
in the header.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batches

RATE = 8000
BLOCK = 576
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
#: Bits of a sample in each of them.
BITS = {PCM: 16, ALAW: 8, MULAW: 8, IMA: 4}

# Fixed values of the IMA ADPCM format: how the step index moves for each
# magnitude, and the quantizer's 89 step sizes.
INDEX_MOVES = np.asarray([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
STEP_SIZES = np.asarray(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
        107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
        876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428,
        4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
        24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)


def mulaw_table() -> np.ndarray:
    """16-bit values of the 256 mu-law codes, from the G.711 rule: sign, 3 bits of exponent, 4 of mantissa, inverted."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit values of the 256 A-law codes, from the G.711 rule: even bits inverted, sign set for positive values."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def _adpcm_moves() -> tuple[np.ndarray, np.ndarray]:
    """For each step index and 4-bit code: how the sample moves, and the next index."""
    code, step = np.arange(16, dtype=np.int32)[None, :], STEP_SIZES[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    moves = np.where(code & 8, -size, size).astype(np.int32)
    index = np.clip(np.arange(len(STEP_SIZES))[:, None] + INDEX_MOVES[None, :], 0, len(STEP_SIZES) - 1)
    # An index is kept as the place of its row, so that adding a code gives an entry.
    return moves.ravel(), (index * 16).astype(np.int32).ravel()


ADPCM_MOVES, ADPCM_NEXT = _adpcm_moves()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of IMA ADPCM blocks of one channel, a row of bytes each.

    A block starts with a 16-bit sample, a step index (greater ones count as
    the greatest) and a byte that is passed over; every further byte holds two
    codes, the lower half first.
    """
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), dtype=np.int16)
    sample = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    row = np.minimum(blocks[:, 2], len(STEP_SIZES) - 1).astype(np.int32) * 16
    out[0] = sample
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    low, high = codes & 15, codes >> 4
    for i in range(size - 4):
        for k, half in enumerate((low, high)):
            at = row + half[i]
            sample = sample + ADPCM_MOVES.take(at)
            np.maximum(sample, -32768, out=sample)
            np.minimum(sample, 32767, out=sample)
            row = ADPCM_NEXT.take(at)
            out[1 + 2 * i + k] = sample
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, factor: int) -> np.ndarray:
    """``factor`` times as many samples, on straight lines between neighbours; the last one is held."""
    x = pcm.astype(np.int32)
    step = np.empty_like(x)
    np.subtract(x[1:], x[:-1], out=step[:-1])
    step[-1:] = 0
    out = np.empty((len(x), factor), dtype=np.int16)
    for k in range(factor):
        out[:, k] = x + step * k // factor
    return out.ravel()


def stored_pcm(pcm: np.ndarray, factor: int, rate: int) -> bytes:
    """A WAV file of 16-bit samples: these, resampled."""
    return wav(resample(pcm, factor).astype("<i2").tobytes(), PCM, rate * factor)


def wav(data: bytes, codec: int, rate: int = RATE, block: int = 1) -> bytes:
    """A WAV file of one channel: these bytes, as 8-bit codes, ADPCM blocks or 16-bit samples."""
    bits, align, per = {PCM: (16, 2, 1), IMA: (4, block, 2 * (block - 4) + 1)}.get(codec, (8, 1, 1))
    extra = b"" if codec == PCM else struct.pack("<H", 0) if codec != IMA else struct.pack("<HH", 2, per)
    form = struct.pack("<HHIIHH", codec, 1, rate, rate * align // per, align, bits) + extra
    fact = struct.pack("<4sII", b"fact", 4, len(data) // align * per)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data))
    body += data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wav(file: bytes) -> tuple[int, int, int, bytes]:
    """(codec, rate, block size, stored bytes) of a WAV file of one channel whose samples have the bits that its codec has here."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(file):
        kind, size = struct.unpack_from("<4sI", file, at)
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", file, at + 8)
        elif kind == b"data":
            data = file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None or form[1] != 1:
        raise ValueError("not a WAV file of one channel")
    if form[5] != BITS.get(form[0]):
        raise ValueError("samples of another size than the codec's")
    return form[0], form[2], form[4], data


def decode(codec: int, data: bytes, block: int = BLOCK) -> np.ndarray:
    """Linear 16-bit samples of a stored stream."""
    if codec == PCM:
        return np.frombuffer(data, dtype="<i2")
    codes = np.frombuffer(data, dtype=np.uint8)
    if codec == IMA:
        return decode_adpcm(codes.reshape(-1, block)).ravel()
    return TABLES[codec].take(codes)


def payload(raw: bytes, unit: int = BLOCK) -> bytes:
    """The bytes with bytes 255 after them, up to a positive multiple of the unit."""
    return raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def loudness(pcm: np.ndarray) -> tuple[int, int, int]:
    """Whole-number features: root mean square, peak, changes of sign."""
    x = pcm.astype(np.int64)
    negative = x < 0
    return (
        int(np.sqrt(int(np.dot(x, x)) / max(1, len(x)))),
        int(np.abs(x).max(initial=0)),
        int(np.count_nonzero(negative[1:] != negative[:-1])),
    )


def _resampled(factor: int) -> Callable:
    schema = pa.schema([("media_id", pa.int64()), ("codec", pa.int32()), ("rate", pa.int64()), ("pcm", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for media_id, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    codec, rate, block, data = read_wav(file or b"")
                    row = (media_id, codec, rate * factor, stored_pcm(decode(codec, data, block), factor, rate))
                except (ValueError, KeyError, struct.error):
                    row = (media_id, None, None, None)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return run


def resample_media(media: DataFrame, *, id_col: str = "media_id", media_col: str = "media", factor: int = 2) -> DataFrame:
    """Decode WAV files of one channel (mu-law, A-law, IMA ADPCM or PCM) and store resampled PCM.

    Columns: media_id, codec, rate, pcm (a WAV file of 16-bit samples). A file
    that is null or can't be read gives nulls; every row gives a row, repeated
    ones too. A file is decoded in one task, in memory of its own size.
    """
    return media.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(
        _resampled(factor), "media_id long, codec int, rate long, pcm binary"
    )


def _stored(factor: int) -> Callable:
    names = "n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema([("doc_id", pa.int64()), *zip(names, kinds, strict=True)])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Some megabytes at a time, so that thousands of ADPCM blocks are decoded together.
        for ids, texts in batches(source, 2 << 20):
            files = [wav(payload(text), MULAW) for text in texts]
            read = [read_wav(file)[-1] for file in files]
            joined = np.frombuffer(b"".join(read), dtype=np.uint8)
            expanded = {codec: table.take(joined) for codec, table in TABLES.items()}
            adpcm = decode_adpcm(joined.reshape(-1, BLOCK))
            rows, at = [], 0
            for doc_id, text, file, data in zip(ids, texts, files, read, strict=True):
                streams = [expanded[codec][at : at + len(data)] for codec in (MULAW, ALAW)]
                streams.append(adpcm[at // BLOCK : (at + len(data)) // BLOCK].ravel())
                at += len(data)
                parts = []
                for name, stream in zip(("mulaw", "alaw", "adpcm"), streams, strict=True):
                    _, rate, _, kept = read_wav(stored_pcm(stream, factor, RATE))
                    pcm = decode(PCM, kept)
                    parts.append(":".join(map(str, (name, rate, len(pcm), *loudness(pcm), zlib.crc32(kept)))))
                digest = hashlib.sha256(data).hexdigest()
                media = hashlib.sha256(file).hexdigest()
                rows.append((doc_id, len(text), len(data), digest, zlib.crc32(data[-32:]), len(file), media, ";".join(parts)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )

    return run


def text_as_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", factor: int = 2) -> DataFrame:
    """Store every text's bytes as a mu-law WAV file, read it back, and describe it.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature. The feature has, for the stored codes
    taken as mu-law, as A-law and as ADPCM blocks, resampled, stored as 16-bit
    PCM in a WAV file and read back: name, rate, samples, root mean square, peak, changes of sign, and the samples' CRC.
    All are whole numbers, so equal texts have equal values.

    Null and empty texts give one unit of padding. Repeated rows and null ids
    each give a row. A very long text is decoded in memory of some times its
    size. An empty table gives an empty result; other columns are not looked
    at.
    """
    fields = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_stored(factor), fields)

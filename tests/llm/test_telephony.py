import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import telephony as T


def plain_adpcm(block):
    sample = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [int.from_bytes(block[:2], "little", signed=True)]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(T.STEP_SIZES[index])
            diff = step >> 3
            diff += step * bool(code & 4) + (step >> 1) * bool(code & 2) + (step >> 2) * bool(code & 1)
            sample = max(-32768, min(32767, sample - diff if code & 8 else sample + diff))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(sample)
    return out


@given(st.lists(st.binary(min_size=20, max_size=20), min_size=1, max_size=5))
@settings(max_examples=60)
def test_adpcm_blocks(blocks):
    got = T.decode_adpcm(np.frombuffer(b"".join(blocks), dtype=np.uint8).reshape(-1, 20))
    assert got.tolist() == [plain_adpcm(b) for b in blocks]


def test_tables():
    # Known values of G.711: silence, the extremes, and one step from them.
    mu, a = T.TABLES[T.MULAW], T.TABLES[T.ALAW]
    assert [int(mu[c]) for c in (0xFF, 0x7F, 0x00, 0x80, 0xFE, 0x01)] == [0, 0, -32124, 32124, 8, -31100]
    assert [int(a[c]) for c in (0xD5, 0x55, 0x2A, 0xAA, 0xD4)] == [8, -8, -32256, 32256, 24]
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255


@given(st.binary(max_size=2000))
def test_wav_round_trip(raw):
    data = T.payload(raw)
    assert len(data) % 576 == 0 and len(data) > 0 and data.startswith(raw) and set(data[len(raw) :]) <= {255}
    for codec in (T.MULAW, T.ALAW, T.IMA):
        assert T.read_wav(T.wav(data, codec, block=576)) == (codec, 8000, 576 if codec == T.IMA else 1, data)


def test_resample():
    assert T.resample(np.asarray([0, 10, -10], dtype=np.int16), 2).tolist() == [0, 5, 10, 0, -10, -10]
    with pytest.raises(ValueError):
        T.read_wav(b"RIFF")


def test_text_as_media(spark):
    texts = [(None, 1), ("", 2), ("é" * 288, 3), ("é" * 288, 3), ("x" * 577, None), ("long " * 40000, 5)]
    df = spark.createDataFrame([(t, i, "z") for t, i in texts], "text string, doc_id long, feature string")
    rows = T.text_as_media(df).collect()
    assert len(rows) == len(texts)
    by = {r.n_bytes: r for r in rows}
    assert len({r.feature for r in rows if r.n_bytes == 0}) == len({r.feature for r in rows if r.n_bytes == 576}) == 1
    for text, _ in texts:
        raw = (text or "").encode()
        data, r = T.payload(raw), by[len(raw)]
        assert (r.payload_bytes, r.payload_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.tail_crc32 == zlib.crc32(data[-32:])
        file = T.wav(data, T.MULAW)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        pcm = T.resample(T.decode(T.IMA, data), 2)
        assert r.feature.split(";")[2].split(":")[2:] == list(map(str, (len(pcm), *T.loudness(pcm), zlib.crc32(pcm.tobytes()))))
    assert T.text_as_media(df.limit(0)).count() == 0


def test_resample_media(spark):
    data = T.payload(b"some speech")
    files = [(1, T.wav(data, T.IMA, block=576)), (2, T.wav(data, T.ALAW)), (3, b"no"), (4, None)]
    out = {r.media_id: r for r in T.resample_media(spark.createDataFrame(files, "media_id long, media binary")).collect()}
    codec, rate, _, pcm = T.read_wav(bytes(out[1].pcm))
    assert (codec, rate, out[1].codec) == (T.PCM, 16000, T.IMA)
    assert np.array_equal(np.frombuffer(pcm, dtype="<i2"), T.resample(T.decode(T.IMA, data), 2))
    assert out[2].codec == T.ALAW and out[3].pcm is None and out[4].pcm is None


def test_files_of_other_sample_sizes_give_nulls(spark):
    import struct

    good = T.wav(bytes(range(200)), T.PCM)
    at = good.index(b"fmt ") + 8 + 14
    bad = good[:at] + struct.pack("<H", 8) + good[at + 2 :]
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(bad)), (3, None)], "media_id long, media binary")
    rows = {r.media_id: r for r in T.resample_media(df).collect()}
    assert T.read_wav(bytes(rows[1].pcm))[1] == 16000
    assert [tuple(rows[i])[1:] for i in (2, 3)] == [(None, None, None)] * 2

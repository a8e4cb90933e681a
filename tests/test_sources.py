"""Collections on disk, binary columns and sinks."""

import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import binary, episodes, outputs


def collection(root, name, features, lines):
    meta = root / name / "meta"
    meta.mkdir(parents=True)
    info = {
        "fps": 0,
        "chunks_size": 2,
        "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet",
        "video_path": "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4",
        "features": features,
    }
    (meta / "info.json").write_text(json.dumps(info))
    (meta / "episodes.jsonl").write_text("\n\n".join(map(json.dumps, lines)))


ACTION = {"dtype": "float32", "shape": [6]}


def camera(fps=None):
    return {"dtype": "video", "shape": [4, 4, 3]} | ({"info": {"video.fps": fps}} if fps else {})


def test_episodes_are_discovered_with_their_paths(spark, tmp_path):
    two = [{"episode_index": i, "length": 9, "tasks": ["t"]} for i in (0, 2)]
    collection(tmp_path, "a/one", {"action": ACTION, "observation.images.left": camera(10.0), "observation.images.wrist": camera(30.0)}, two)
    collection(tmp_path, "b/two", {"observation.images.top": camera()}, two)
    collection(tmp_path, "c/three", {"action": ACTION, "observation.images.top": camera()}, two[:1])
    collection(tmp_path, "d/four", {"action": ACTION, "observation.images.wrist": camera()}, two)
    found = {r.episode_key: r for r in episodes.episodes(spark, str(tmp_path)).collect()}
    assert sorted(found) == ["a/one/episode_000000", "a/one/episode_000002", "c/three/episode_000000"]
    last = found["a/one/episode_000002"]
    assert last.fps == 10.0 and last.parquet_path == "data/chunk-001/episode_000002.parquet"
    assert last.video_path == "videos/chunk-001/observation.images.left/episode_000002.mp4"
    assert found["c/three/episode_000000"].fps == 6.0


def test_action_that_is_no_vector_is_an_error(spark, tmp_path):
    collection(tmp_path, "a/one", {"action": {"dtype": "float32", "shape": [2, 3]}, "observation.images.top": camera()}, [])
    with pytest.raises(Exception, match="no vector"):
        episodes.repositories(spark, str(tmp_path)).collect()


def test_stems_must_pair(spark):
    a = spark.createDataFrame([("x/1.png",), ("x/2.png",)], "path string")
    b = spark.createDataFrame([("y/1.npy",), ("y/2.npy",)], "path string")
    assert [r.stem for r in episodes.paired_by_stem(a, b).orderBy("stem").collect()] == ["1", "2"]
    with pytest.raises(Exception, match="without its pair"):
        episodes.paired_by_stem(a, b.limit(1)).collect()


def test_numpy_files(spark):
    out = io.BytesIO()
    np.save(out, np.arange(6, dtype=np.float32).reshape(2, 3))
    rows = binary.npy_arrays(spark.createDataFrame([("p", bytearray(out.getvalue()))], "path string, content binary")).collect()
    assert rows[0].shape == [2, 3] and rows[0].values == [0, 1, 2, 3, 4, 5]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def movie():
    clock = box(b"mdhd", bytes(12), struct.pack(">II", 600, 1600), bytes(4))
    handler = box(b"hdlr", bytes(8), b"vide", bytes(12))
    sizes = box(b"stsz", bytes(8), struct.pack(">I", 16))
    media = box(b"mdia", clock, handler, box(b"minf", box(b"stbl", sizes)))
    head = box(b"tkhd", bytes(76), struct.pack(">II", 320 << 16, 256 << 16))
    return box(b"ftyp", b"isom") + box(b"moov", box(b"trak", head, media))


def test_video_probe(spark):
    rows = spark.createDataFrame([("a", bytearray(movie())), ("b", bytearray(b"no movie"))], "path string, content binary")
    good, bad = binary.video_probes(rows).orderBy("path").collect()
    assert (good.frames, good.fps, good.width, good.height) == (16, 6.0, 320, 256)
    assert bad.frames is None and bad.fps is None


def test_sinks_do_not_overwrite(spark, tmp_path):
    rows = spark.range(3)
    outputs.write_new(rows, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        outputs.write_new(rows, str(tmp_path / "t"))
    bad = spark.createDataFrame([("r", 1, False)], "rule string, violations long, ok boolean")
    with pytest.raises(ValueError, match="broken: r"):
        outputs.write_checked(rows, bad, str(tmp_path / "u"))
    outputs.write_lines(rows.withColumn("a", F.lit("x")), str(tmp_path / "j"), "id")
    assert (tmp_path / "j").exists() and not (tmp_path / "u").exists()
    for _ in range(2):
        outputs.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6

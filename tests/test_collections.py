import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.sources import collections, episodes


def camera(name="observation.images.top", fps=30.0):
    return {name: {"dtype": "video", "shape": [2, 2, 3], "info": {"video.fps": fps}}}


def collection(root, name, features, indices, info=None):
    folder = root / name
    (folder / "meta").mkdir(parents=True)
    made = {"fps": 10, "chunks_size": 2, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "features": features}
    made["video_path"] = "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"
    (folder / "meta/info.json").write_text(json.dumps(made) if info is None else info)
    (folder / "meta/episodes.jsonl").write_text("\n\n".join(json.dumps({"episode_index": i, "length": i + 3, "tasks": ["pick"]}) for i in indices) + "\n")
    for i in indices:
        path = folder / f"data/chunk-{i // 2:03d}/episode_{i:06d}.parquet"
        path.parent.mkdir(parents=True, exist_ok=True)
        values = [[float(i), float(t)] for t in range(i + 3)]
        pq.write_table(pa.table({"action": pa.array(values, pa.list_(pa.float32())), "observation.state": values, "extra": list(range(i + 3))}), path)


ACTION = {"action": {"dtype": "float32", "shape": [2]}}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    collection(root, "a/x", ACTION | camera(), [0, 1, 4])
    collection(root, "a/y", ACTION | camera("observation.images.wrist") | camera("observation.images.side", None), [2])
    collection(root, "b/z", ACTION | camera(), [0, 3, 5, 7])
    collection(root, "b/blind", ACTION | camera("observation.images.gripper_cam"), [0])
    collection(root, "c/still", camera(), [0])
    (root / "c/empty").mkdir()
    collections.register(spark)
    return root


def read(spark, root, table="episodes", schema=None):
    reader = spark.read.format("quern_episodes").option("table", table)
    return (reader.schema(schema) if schema else reader).load(str(root))


def test_episodes_are_those_of_the_other_reader(spark, tree):
    found = read(spark, tree)
    want = episodes.episodes(spark, str(tree))
    assert sorted(found.columns) == sorted(want.columns)
    rows = lambda df: sorted(str(r) for r in df.select(*sorted(want.columns)).collect())
    assert rows(found) == rows(want) and found.count() == 8
    assert found.rdd.getNumPartitions() == 5  # one for each collection with metadata


def test_frames_in_batches_and_columns(spark, tree):
    found = read(spark, tree, "frames")
    rows = {(r.episode_key, r.at): (r.action, r.state) for r in found.collect()}
    assert len(rows) == sum(i + 3 for i in (0, 1, 4, 2, 0, 3, 5, 7)) and rows["b/z/episode_000003", 5] == ([3.0, 5.0], [3.0, 5.0])
    narrow = read(spark, tree, "frames", "episode_index long, at long, action array<double>")
    assert narrow.count() == len(rows) and narrow.columns == ["episode_index", "at", "action"]
    assert read(spark, tree, "frames", "episode_key string").distinct().count() == 8


def test_filters_leave_collections_and_files_unopened(spark, tree, tmp_path):
    import shutil

    root = tmp_path / "broken"
    shutil.copytree(tree, root)
    (root / "a/x/meta/info.json").write_text("{broken")
    (root / "b/z/data/chunk-002/episode_000005.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="Expecting property name"):
        read(spark, root).collect()
    assert read(spark, root).where("owner = 'b'").count() == 4
    assert read(spark, root).where("repository_id in ('a/y', 'b/z') and length > 4").count() == 4
    assert read(spark, root, "frames").where("repository_id = 'b/z' and episode_index < 5").select("episode_index").distinct().count() == 2
    assert read(spark, root, "frames").where("owner = 'b' and episode_index >= 7").count() == 10
    with pytest.raises(Exception, match="arquet"):
        read(spark, root, "frames").where("owner = 'b'").collect()
    assert read(spark, root).where("owner = 'nobody'").count() == 0


def test_readers_partitions_are_pruned_before_reading():
    reader = collections.EpisodeReader("/nowhere", "episodes", None)
    pushed = [collections.EqualTo(("owner",), "b"), collections.GreaterThan(("length",), 3), collections.In(("episode_index",), (1, 2))]
    assert list(reader.pushFilters(pushed)) == pushed
    assert [(w.column, w.value) for w in reader.wanted] == [("owner", "b"), ("episode_index", (1, 2))]


def test_bad_vectors_and_actions(spark, tmp_path):
    for k, bad in enumerate(([[1.0], None], [[1.0], []], [[float("nan")]], [[1.0, None]])):
        with pytest.raises(ValueError, match="null, empty or not finite: p"):
            collections.checked_vectors(pa.array(bad, pa.list_(pa.float32())), "p")
    assert collections.checked_vectors(pa.array([[1], [2, 3]]), "p").to_pylist() == [[1.0], [2.0, 3.0]]
    collection(tmp_path, "a/x", {"action": {"dtype": "float32", "shape": [2, 2]}} | camera(), [0])
    with pytest.raises(Exception, match="action is no vector: a/x"):
        read(spark, tmp_path).collect()
    with pytest.raises(Exception, match="unknown table"):
        read(spark, tmp_path, "videos").collect()
    with pytest.raises(Exception, match="lacks"):
        read(spark, lacking(tmp_path / "other"), "frames").collect()


def lacking(root):
    collection(root, "a/x", ACTION | camera(), [0])
    pq.write_table(pa.table({"action": [[1.0]]}), root / "a/x/data/chunk-000/episode_000000.parquet")
    return root

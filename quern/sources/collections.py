"""Collections of episodes as a data source: ``spark.read.format("quern_episodes")``.

One partition is one collection. Filters on ``repository_id`` and ``owner``
choose collections before any is opened, and filters on ``episode_index``
choose a collection's lines and frame files. Option ``table`` is ``episodes``,
a row for each episode as :func:`quern.sources.episodes.episodes` has them, or
``frames``, a row for each frame; of frame files only the columns of the
schema are read, which a reader may cut down by ``.schema(...)``.

Files are opened by pyarrow, so the path is a local one that driver and tasks
share, or a URI that pyarrow knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from quern.sources.episodes import CLOSE_CAMERAS

EPISODES = (
    "episode_key string, repository_id string, owner string, episode_index long, length long, tasks array<string>, "
    "fps double, video_key string, parquet_path string, video_path string"
)
FRAMES = "episode_key string, repository_id string, owner string, episode_index long, at long, action array<double>, state array<double>"
#: What a frame table calls its vectors.
VECTORS = {"action": "action", "state": "observation.state"}
_TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
}


@dataclass(frozen=True)
class Wanted:
    """What pushed filters ask of one column; all must hold."""

    column: str
    kind: type
    value: object

    def holds(self, x) -> bool:
        return _TESTS[self.kind](x, self.value)


@dataclass(frozen=True)
class Info:
    """What a collection's metadata says of all its episodes."""

    fps: float
    chunks_size: int
    data_path: str
    video_path: str
    video_key: str

    def path(self, template: str | None, index: int) -> str | None:
        if template is None:
            return None
        made = template.replace("{episode_chunk:03d}", f"{index // self.chunks_size:03d}").replace("{episode_index:06d}", f"{index:06d}")
        return made.replace("{video_key}", self.video_key)


def parsed_info(text: str, name: str) -> Info | None:
    """None for a collection without actions or an eligible camera; an action that is no vector is an error."""
    made = json.loads(text)
    features = made.get("features") or {}
    close = re.compile(CLOSE_CAMERAS)
    plain = lambda k: re.sub(r"^observation\.(images\.)?", "", k).lower()
    cameras = sorted(k for k, v in features.items() if v.get("dtype") == "video" and not close.search(plain(k)))
    if features.get("action") is None or not cameras:
        return None
    if len(features["action"].get("shape") or []) != 1:
        raise ValueError(f"action is no vector: {name}")
    fps = float((features[cameras[0]].get("info") or {}).get("video.fps") or made.get("fps") or 6.0)
    return Info(fps, made.get("chunks_size") or 1000, made.get("data_path"), made.get("video_path"), cameras[0])


class Collection(InputPartition):
    def __init__(self, repository_id: str):
        super().__init__(repository_id)
        self.repository_id = repository_id


class EpisodeReader(DataSourceReader):
    def __init__(self, root: str, table: str, schema: StructType):
        self.root, self.table, self.schema = root.rstrip("/"), table, schema
        self.wanted: list[Wanted] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and column in ("repository_id", "owner", "episode_index"):
                self.wanted.append(Wanted(column, type(f), f.value))
            yield f  # the engine looks at what comes again

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def _holds(self, **values) -> bool:
        return all(w.holds(values[w.column]) for w in self.wanted if w.column in values)

    def partitions(self) -> list[Collection]:
        """Folders two levels down that have metadata; the metadata itself is left to the tasks."""
        files, root = self._open()
        folders = lambda p: [x.base_name for x in files.get_file_info(fs.FileSelector(p)) if x.type == fs.FileType.Directory]
        names = [f"{o}/{d}" for o in sorted(folders(root)) if self._holds(owner=o) for d in sorted(folders(f"{root}/{o}"))]
        names = [n for n in names if self._holds(repository_id=n)]
        there = files.get_file_info([f"{root}/{n}/meta/info.json" for n in names]) if names else []
        return [Collection(n) for n, x in zip(names, there, strict=True) if x.type == fs.FileType.File] or [Collection("")]

    def read(self, partition: Collection) -> Iterator[pa.RecordBatch]:
        name = partition.repository_id
        if not name:
            return
        files, root = self._open()
        folder = f"{root}/{name}"
        with files.open_input_stream(f"{folder}/meta/info.json") as f:
            info = parsed_info(f.read().decode(), name)
        if info is None:
            return
        made = self._frames(files, folder, name, info) if self.table == "frames" else self._episodes(files, folder, name, info)
        yield from made

    def _listed(self, files: fs.FileSystem, folder: str) -> Iterator[dict]:
        with files.open_input_stream(f"{folder}/meta/episodes.jsonl") as f:
            for line in f.read().decode().splitlines():
                if line.strip():
                    row = json.loads(line)
                    if row.get("episode_index") is not None and self._holds(episode_index=row["episode_index"]):
                        yield row

    def _batch(self, columns: dict[str, pa.Array | list]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def _episodes(self, files: fs.FileSystem, folder: str, name: str, info: Info) -> Iterator[pa.RecordBatch]:
        rows = list(self._listed(files, folder))
        at = [r["episode_index"] for r in rows]
        n = len(rows)
        yield self._batch(
            {
                "episode_key": [f"{name}/episode_{i:06d}" for i in at],
                "repository_id": [name] * n,
                "owner": [name.split("/")[0]] * n,
                "episode_index": at,
                "length": [r.get("length") for r in rows],
                "tasks": [r.get("tasks") for r in rows],
                "fps": [info.fps] * n,
                "video_key": [info.video_key] * n,
                "parquet_path": [info.path(info.data_path, i) for i in at],
                "video_path": [info.path(info.video_path, i) for i in at],
            }
        )

    def _frames(self, files: fs.FileSystem, folder: str, name: str, info: Info) -> Iterator[pa.RecordBatch]:
        vectors = {f.name: VECTORS[f.name] for f in self.schema if f.name in VECTORS}
        for row in self._listed(files, folder):
            index, first = row["episode_index"], 0
            path = info.path(info.data_path, index)
            with files.open_input_file(f"{folder}/{path}") as f:
                frames = pq.ParquetFile(f)
                if lacking := [v for v in vectors.values() if v not in frames.schema_arrow.names]:
                    raise ValueError(f"{name}/{path} lacks {lacking}")
                # Without a vector in the schema rows are still counted, by one narrow column.
                for batch in frames.iter_batches(columns=list(vectors.values()) or frames.schema_arrow.names[:1]):
                    n = batch.num_rows
                    own = {k: checked_vectors(batch.column(batch.schema.names.index(v)), f"{name}/{path}") for k, v in vectors.items()}
                    yield self._batch(
                        {
                            "episode_key": [f"{name}/episode_{index:06d}"] * n,
                            "repository_id": [name] * n,
                            "owner": [name.split("/")[0]] * n,
                            "episode_index": [index] * n,
                            "at": np.arange(first, first + n).tolist(),
                            **own,
                        }
                    )
                    first += n


def checked_vectors(column: pa.Array, path: str) -> pa.Array:
    """Vectors as lists of doubles; a null or empty one, or a value that is null or not finite, is an error."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten()
    if lists.null_count or (sizes == 0).any() or values.null_count or not np.isfinite(values.to_numpy(zero_copy_only=False)).all():
        raise ValueError(f"a vector is null, empty or not finite: {path}")
    return lists


class EpisodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_episodes"

    @property
    def table(self) -> str:
        kind = self.options.get("table", "episodes")
        if kind not in ("episodes", "frames"):
            raise ValueError(f"unknown table {kind!r}")
        return kind

    def schema(self) -> str:
        return FRAMES if self.table == "frames" else EPISODES

    def reader(self, schema: StructType) -> EpisodeReader:
        return EpisodeReader(self.options["path"], self.table, schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpisodeSource)

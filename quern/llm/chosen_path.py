"""N-gram Jaccard join by chosen paths.

Texts are sets of word shingles. A min-wise hash of a set samples one of its
shingles; two sets with Jaccard similarity s sample the same one with
probability s. A run deals the sets into buckets by one sampled shingle, and
splits buckets that stay large by further ones, in two branches a level, so
that a pair keeps together on some path. Small buckets are compared by brute
force. Runs are repeated until a pair at the threshold is missed with less
than the wanted probability.

The order of work keeps groups of copies from being compared pair by pair:

1. Equal texts are one text from the start.
2. In every bucket each text is first held against one of the bucket's, the
   pivot. Pairs whose sketches agree enough are checked exactly, and what they
   link is joined into components.
3. Buckets whose texts are all in one component can add nothing. Others are
   split; texts whose sketch agrees with one of another component are compared
   exactly, and of the links only those that join components leave the task.
   Texts of buckets that splitting does not thin out, over all runs, are dealt
   anew by the rarest of their samples, as many as it takes for any two that
   agree enough to meet; a passage that many texts have in common does not
   bring them together any more. Large ones of these groups are merged to
   clusters first, so that a large group of like texts is compared once.
4. Links are counted exactly, block by block, within each component; every
   link lies in one.

Pairs are verified on whole texts. Large buckets, components and groups are
cut into parts of bounded size, each the work of one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, slices, text_digest


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    recall: float = 0.999_999
    #: Sampled shingles of each text; the first ones start the runs, the others split large buckets.
    samples: int = 64
    #: Buckets up to this size are compared by brute force.
    bucket: int = 256
    branches: int = 2
    depth: int = 3
    #: Texts in one side of a block that is compared in one task, and their bytes where texts are long.
    block: int = 512
    block_bytes: int = 4 << 20
    #: A list of at most so many digests is sent to every executor; a longer one is joined by a shuffle.
    broadcast_rows: int = 500_000
    seed: int = 11

    @cached_property
    def runs(self) -> int:
        """Runs after which a pair at the threshold has been together once, with the wanted probability."""
        stay = 1 - (1 - self.similarity) ** self.branches
        once = self.similarity * stay**self.depth
        return math.ceil(math.log(1 - self.recall) / math.log(1 - once))

    @cached_property
    def agreeing(self) -> int:
        """Samples that must agree: a pair at the threshold has fewer with probability 1e-7 at most."""
        n, s, below, k = self.samples, self.similarity, 0.0, 0
        while (below := below + math.comb(n, k) * s**k * (1 - s) ** (n - k)) <= 1e-7:
            k += 1
        return k


_NO_WORDS = np.asarray([0x9E3779B97F4A7C15], dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_ANY_BYTES = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)


def word_values(texts: pa.Array) -> Iterator[np.ndarray]:
    """64-bit values of each text's words, in order; of words that occur often one value is worked out."""
    for first, last in slices(texts, 1 << 20):
        split = pc.ascii_split_whitespace(texts.slice(first, last - first).cast(options=_ANY_BYTES))
        found = split.flatten().dictionary_encode()
        words = found.dictionary.cast(pa.binary())
        known = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(words))
        codes = found.indices.to_numpy()
        # White space at a text's ends leaves empty words there.
        real = pc.binary_length(words).to_numpy()[codes] > 0
        ends = np.r_[0, np.cumsum(real)][split.offsets.to_numpy() - split.offsets[0].as_py()]
        values = known[codes[real]]
        for i in range(len(split)):
            yield values[ends[i] : ends[i + 1]]


def shingles(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """64-bit values of each text's runs of words, with repeats.

    A text with fewer words has one shingle, all it has; one without words has
    a shingle that stands for that.
    """
    for values in word_values(texts):
        if not len(values):
            yield _NO_WORDS
            continue
        size = min(words, len(values))
        n = len(values) - size + 1
        with np.errstate(over="ignore"):
            out = np.full(n, size, dtype=np.uint64)
            for i in range(size):
                out = out * _BASE + values[i : i + n]
            out ^= out >> np.uint64(32)
            out *= _BASE
            out ^= out >> np.uint64(29)
        yield out


def shingle_sets(column: pa.ChunkedArray, words: int) -> list[np.ndarray]:
    """The shingles of each text of a column, sorted and without repeats."""
    return [np.unique(x) for chunk in column.chunks for x in shingles(chunk.cast(pa.binary()), words)]


def _sampled(settings: Settings) -> Callable:
    rng = np.random.default_rng(settings.seed)
    factors = rng.integers(0, 1 << 63, settings.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, settings.samples, dtype=np.uint64)
    schema = pa.schema([("tid", pa.binary()), ("size", pa.int64()), ("sig", pa.list_(pa.int32()))])

    def sketch(values: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, values[:-1])])
        flat = np.concatenate(values)
        out = np.empty((len(values), settings.samples), dtype=np.int32)
        with np.errstate(over="ignore"):
            for k in range(settings.samples):
                least = np.minimum.reduceat(flat * factors[k] + shifts[k], starts)
                out[:, k] = ((least ^ (least >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        return out

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def made(tids: list, sizes: list, values: list) -> pa.RecordBatch:
            flat = pa.array(sketch(values).ravel())
            offsets = pa.array(np.arange(len(tids) + 1, dtype=np.int32) * settings.samples)
            columns = [pa.array(tids, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in source:
            new = []
            for tid in batch.column(0).to_pylist():
                new.append(tid not in seen)
                if len(seen) < 100_000:
                    seen.add(tid)
            batch = batch.filter(pa.array(new, pa.bool_()))
            texts = batch.column(1).cast(pa.binary())
            lengths = pc.binary_length(texts).to_numpy()
            tids, sizes, values, size = [], [], [], 0
            for tid, length, found in zip(batch.column(0).to_pylist(), lengths, shingles(texts, settings.words), strict=True):
                tids.append(tid)
                sizes.append(length)
                values.append(found)
                size += len(found)
                # Few enough values that they stay in the processor's cache while they are sampled.
                if size > 1 << 15:
                    yield made(tids, sizes, values)
                    tids, sizes, values, size = [], [], [], 0
            if tids:
                yield made(tids, sizes, values)
        pa.default_memory_pool().release_unused()

    return run


def runs_of_key(source: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it."""
    held: list[pa.Table] = []
    last = None
    for batch in source:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        values = list(zip(*(table[k].to_pylist() for k in keys), strict=True))
        first = 0
        for i, value in enumerate(values):
            if value != last:
                if i > first:
                    held.append(table.slice(first, i - first))
                if held:
                    yield pa.concat_tables(held)
                held, first, last = [], i, value
        held.append(table.slice(first))
    if held:
        yield pa.concat_tables(held)


def _matrix(column: pa.ChunkedArray, samples: int) -> np.ndarray:
    flat = [np.asarray(chunk.flatten()) for chunk in column.chunks]
    return np.concatenate(flat).reshape(-1, samples)


def _brute_force(settings: Settings) -> Callable:
    """Rows (key, side, tid, comp, cluster, sig) sorted by key, side and tid to those whose sketch agrees with one of another component and cluster.

    Where there are two sides, with one of the other side. The new key tells
    which texts these are, so that the same ones from several buckets are the
    same rows.
    """
    schema = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("tid", pa.binary()), ("comp", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for rows in runs_of_key(source, ["key"]):
            sigs, n = _matrix(rows["sig"], settings.samples), rows.num_rows
            labels = [np.unique(np.asarray(rows[c].to_pylist(), dtype=object), return_inverse=True)[1] for c in ("comp", "cluster")]
            side = np.asarray(rows["side"])
            if side.any():
                labels.append(side)
            found = np.zeros(n, dtype=bool)
            for i in range(n - 1):
                agree = np.count_nonzero(sigs[i + 1 :] == sigs[i], axis=1) >= settings.agreeing
                for label in labels:
                    agree &= label[i + 1 :] != label[i]
                found[i] |= agree.any()
                found[i + 1 :] |= agree
            if found.any():
                kept = rows.select(["side", "tid", "comp"]).filter(pa.array(found))
                first = int(np.count_nonzero(~side[found].astype(bool)))
                key = xxhash.xxh3_64_intdigest(b"".join(kept["tid"].to_pylist()), seed=first) - (1 << 63)
                held.append(kept.add_column(0, "key", pa.array([key] * len(kept), pa.int64())).cast(schema))
                n_held += int(found.sum())
            if n_held > 5_000:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, n_held = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return run


def spanning(linked: np.ndarray, comps: np.ndarray, first: int) -> Iterator[tuple[int, int]]:
    """Links that join the components as all links do, at most one fewer than there are components.

    ``linked`` has a row for each of the first members, and a column for each of those from ``first`` on.
    """
    root = comps.copy()
    for i in range(len(linked)):
        js = np.flatnonzero(linked[i]) + first
        js = js[root[js] != root[i]]
        for j in js[np.unique(root[js], return_index=True)[1]]:
            yield i, int(j)
            root[root == root[j]] = root[i]


def _exact(settings: Settings) -> Callable:
    """Rows (key, side, tid, comp, text) sorted by key and side to links (a, b) between components."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of_key(source, ["key"]):
            tids = rows["tid"].to_pylist()
            comps = np.unique(np.asarray(rows["comp"].to_pylist(), dtype=object), return_inverse=True)[1]
            sets = shingle_sets(rows["text"], settings.words)
            split = int(len(sets) - np.count_nonzero(np.asarray(rows["side"])))
            if split == 0:
                continue
            x, y, first = (sets, sets, 0) if split == len(sets) else (sets[:split], sets[split:], split)
            pairs = [sorted((tids[i], tids[j])) for i, j in spanning(linked(x, y, settings.similarity), comps, first)]
            if pairs:
                columns = [pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        pa.default_memory_pool().release_unused()

    return run


def _verify(settings: Settings) -> Callable:
    """Rows (a, part, b, text), the head with b null first, to the pairs that reach the similarity."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_key = None, None
        for batch in source:
            left, right = [], []
            found = shingles(batch.column(3).cast(pa.binary()), settings.words)
            for a, part, b, own in zip(*(batch.column(i).to_pylist() for i in range(3)), found, strict=True):
                values = np.unique(own)
                if b is None:
                    head, head_key = values, (a, part)
                    continue
                if head_key != (a, part):
                    raise ValueError("a pair came without its head")
                if similar(head, values, settings.similarity):
                    left.append(a)
                    right.append(b)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], schema=schema)
        pa.default_memory_pool().release_unused()

    return run


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets without repeats have this Jaccard similarity at least."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= similarity * (len(both) - common) - 1e-9


def linked(x: list[np.ndarray], y: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of y have the similarity to each of x. Sets are sorted and without repeats."""
    sizes_x = np.asarray([len(v) for v in x], dtype=np.int64)
    sizes_y = np.asarray([len(v) for v in y], dtype=np.int64)
    values = np.concatenate([*x, *y])
    known, code = np.unique(values, return_inverse=True)
    n_x = int(sizes_x.sum())
    code_x, code_y = code[:n_x], code[n_x:]
    row_x, row_y = np.repeat(np.arange(len(x)), sizes_x), np.repeat(np.arange(len(y)), sizes_y)
    both = np.zeros(len(known), dtype=bool)
    both[code_x] = True
    in_y = np.zeros(len(known), dtype=bool)
    in_y[code_y] = True
    both &= in_y
    place = np.cumsum(both) - 1
    keep_x, keep_y = both[code_x], both[code_y]
    row_x, code_x = row_x[keep_x], place[code_x[keep_x]]
    row_y, code_y = row_y[keep_y], place[code_y[keep_y]]
    common = np.zeros((len(x), len(y)), dtype=np.float32)
    step = 1 << 13
    by_x, by_y = np.argsort(code_x, kind="stable"), np.argsort(code_y, kind="stable")
    row_x, code_x, row_y, code_y = row_x[by_x], code_x[by_x], row_y[by_y], code_y[by_y]
    for first in range(0, int(both.sum()), step):
        (a, b), (c, d) = (np.searchsorted(v, [first, first + step]) for v in (code_x, code_y))
        p, q = np.zeros((len(x), step), dtype=np.float32), np.zeros((len(y), step), dtype=np.float32)
        p[row_x[a:b], code_x[a:b] - first] = 1
        q[row_y[c:d], code_y[c:d] - first] = 1
        common += p @ q.T
    union = sizes_x[:, None] + sizes_y[None, :] - common
    return common >= similarity * union - 1e-9


def link_counts(x: list[np.ndarray], y: list[np.ndarray], similarity: float) -> np.ndarray:
    """How many of y have the similarity to each of x."""
    return np.count_nonzero(linked(x, y, similarity), axis=1)


def _count_links(settings: Settings) -> Callable:
    """Rows (key, side, tid, text) sorted by key and side to (tid, links) in this block; a text is not linked to itself."""
    schema = pa.schema([("tid", pa.binary()), ("links", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of_key(source, ["key"]):
            tids, side = rows["tid"].to_pylist(), np.asarray(rows["side"])
            sets = shingle_sets(rows["text"], settings.words)
            first = int(len(sets) - np.count_nonzero(side))
            if first == len(sets):
                links = link_counts(sets, sets, settings.similarity) - 1
            else:
                x, y = sets[:first], sets[first:]
                links = np.r_[link_counts(x, y, settings.similarity), link_counts(y, x, settings.similarity)]
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(links.astype(np.int64))], schema=schema)
        pa.default_memory_pool().release_unused()

    return run


def _union_find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) to (node, comp)."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in source:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        columns = [list(root), [find(x) for x in root]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["node", "comp"])


def components(edges: DataFrame, in_one_task: int = 500_000) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the least node of its component.

    As many edges as fit in a task with ease are joined in one. More take
    rounds of alternating stars: each node hands its greater neighbours, and
    then the lesser ones, to the least of its neighbours, until only stars are
    left. The rounds grow with the logarithm of the size.
    """
    now = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    if now.count() <= in_one_task:
        return checkpointed(now.coalesce(1).mapInArrow(_union_find, "node binary, comp binary"))
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # From here every edge goes from the greater node to the lesser one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        new = tuple(now.select(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if new == mark:
            break
        mark = new
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return checkpointed(pairs.unionByName(pairs.select(F.col("comp").alias("node"), "comp")).distinct())


#: How many parts the rows of one key are dealt to.
SALTS = 64


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows with a salt, so that those of a very frequent key are worked on in many tasks."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def counted(rows: DataFrame, key: str, of: str) -> DataFrame:
    """(key, n, low, high, salts) of dealt rows: how many a key has, the least and greatest ``of``, and its salts."""
    parts = rows.groupBy(key, "salt").agg(F.count("*").alias("n"), F.min(of).alias("low"), F.max(of).alias("high"))
    return parts.groupBy(key).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("salt").alias("salts")
    )


def told(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Dealt rows with what is known of their key, which is repeated for the salts that it has, and no others."""
    return rows.join(known.withColumn("salt", F.explode("salts")).drop("salts"), [key, "salt"]).drop("salt")


class Join:
    """The steps of the join over one table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, settings: Settings):
        self.s = settings
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        self.base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
            "doc_id", text_digest(F.col("text")).alias("tid"), "text"
        )

    def texts(self, tids: DataFrame) -> DataFrame:
        """(tid, text), one row for each of these distinct digests."""
        wanted = F.broadcast(tids) if tids.count() <= self.s.broadcast_rows else tids
        return self.base.select("tid", "text").join(wanted, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))

    def sketches(self) -> DataFrame:
        rows = self.base.select("tid", "text").mapInArrow(_sampled(self.s), "tid binary, size long, sig array<int>")
        return checkpointed(rows.groupBy("tid").agg(F.first("size").alias("size"), F.first("sig").alias("sig")))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that have the similarity; a text with many partners is sent to many tasks."""
        pairs = checkpointed(pairs)
        texts = checkpointed(self.texts(checkpointed(pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).distinct())))
        salted = dealt(pairs, "b")
        items = told(salted, counted(salted, "a", "b"), "a").select(
            "a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / 64)).cast("int").alias("part"), "b"
        )
        heads = items.select("a", "part").distinct().withColumn("b", F.lit(None).cast("binary"))
        text_a, text_b = texts.withColumnRenamed("tid", "a"), texts.withColumnRenamed("tid", "b")
        rows = heads.join(text_a, "a").select("a", "part", "b", "text").unionByName(
            items.join(text_b, "b").select("a", "part", "b", "text")
        )
        return checkpointed(
            rows.repartition("a", "part")
            .sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
            .mapInArrow(_verify(self.s), "a binary, b binary")
        )

    def sample(self, i: int):
        return F.get("sig", F.lit(i))

    def first_buckets(self, sketches: DataFrame) -> DataFrame:
        """(run, key, tid, n, pivot) of the buckets with at least two texts."""
        keys = F.array(*[F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), self.sample(r)).alias("key")) for r in range(self.s.runs)])
        members = dealt(sketches.select("tid", F.inline(keys)), "tid")
        sizes = counted(members, "key", "tid").where("n > 1").select("key", "n", F.col("low").alias("pivot"), "salts")
        return checkpointed(told(members, sizes, "key"))

    def agreeing(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs whose sketches agree often enough."""
        a = sketches.select(F.col("tid").alias("a"), F.col("sig").alias("sig_a"))
        b = sketches.select(F.col("tid").alias("b"), F.col("sig").alias("sig_b"))
        same = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
        salted = dealt(pairs, "b")
        heads = salted.groupBy("a", "salt").count().join(a, "a").drop("count")
        return salted.join(heads, ["a", "salt"]).drop("salt").join(b, "b").where(same >= self.s.agreeing).select("a", "b")

    def compared(self, rows: DataFrame, sketches: DataFrame) -> DataFrame:
        """Of bounded buckets (key, side, tid, comp, cluster), the rows (key, side, tid, comp) that can have a link to look for."""
        full = rows.join(sketches, "tid").select("key", "side", "tid", "comp", "cluster", "sig")
        found = full.repartition("key").sortWithinPartitions("key", "side", "tid").mapInArrow(
            _brute_force(self.s), "key long, side int, tid binary, comp binary"
        )
        return found.distinct()

    def exact(self, rows: DataFrame) -> DataFrame:
        """Links (a, b) between components in bounded buckets (key, side, tid, comp), enough of them to join the components."""
        rows = checkpointed(rows)
        texts = self.texts(checkpointed(rows.select("tid").distinct()))
        full = rows.join(texts, "tid").select("key", "side", "tid", "comp", "text")
        return checkpointed(
            full.repartition("key").sortWithinPartitions("key", "side", "tid").mapInArrow(_exact(self.s), "a binary, b binary").distinct()
        )

    def blocks(self, rows: DataFrame, by: str) -> DataFrame:
        """(key, side, tid, ...) of blocks: the rows (by, n, bytes, tid, ...) of each key in parts, every part with itself and every other.

        A text is sent to as many blocks as its key has parts, so parts are as
        large as a task can hold.
        """
        parts = F.ceil(F.greatest(F.col("n") / self.s.block, F.col("bytes") / self.s.block_bytes)).cast("int")
        own = F.pmod(F.xxhash64("tid"), "parts").cast("int")
        low, high = F.least("own", "other"), F.greatest("own", "other")
        return (
            rows.withColumn("parts", parts)
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0))
            .withColumn("key", F.xxhash64(by, low, high))
            .drop("parts", "own", "other", "n", "bytes")
        )

    def split(self, buckets: DataFrame, comps: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Small and dense buckets (key, tid, comp) of texts of several components, from splitting level by level.

        A large bucket of which a sampled shingle keeps half is dense: its
        texts are alike, and splitting it further would only repeat it. What
        is still large at the last level counts as dense too.
        """
        s, small, dense = self.s, None, None
        rows = buckets.where("n > 2").join(comps, buckets["tid"] == comps["node"], "left").select(
            "run", "key", "tid", F.coalesce("comp", "tid").alias("comp"), F.lit(1 << 62).alias("above")
        )
        for level in range(s.depth + 1):
            rows = dealt(rows, "tid")
            mixed = checkpointed(told(rows, counted(rows, "key", "comp").where("low < high").select("key", "n", "salts"), "key"))
            done = F.lit(True) if level == s.depth else F.col("n") * 2 > F.col("above")
            large = mixed.where(F.col("n") > s.bucket)
            own, alike = (x.select("key", "tid", "comp") for x in (mixed.where(F.col("n") <= s.bucket), large.where(done)))
            small = own if small is None else small.unionByName(own)
            dense = alike if dense is None else dense.unionByName(alike)
            if level == s.depth or large.isEmpty():
                break
            others = s.samples - s.runs
            place = [
                F.lit(s.runs) + F.pmod((F.col("run") * s.depth + level) * s.branches + b, F.lit(others)) for b in range(s.branches)
            ]
            keys = F.array(*[F.xxhash64("key", F.lit(b), F.get("sig", p)) for b, p in enumerate(place)])
            rows = (
                large.where(~done)
                .join(sketches, "tid")
                .select("run", F.explode(keys).alias("key"), "tid", "comp", F.col("n").alias("above"))
            )
        return small, checkpointed(dense)

    def alike(self, dense: DataFrame, sketches: DataFrame) -> DataFrame:
        """(key, tid, comp, n) of groups in which any two texts of dense buckets, of different components, meet if their sketches agree enough.

        Two texts with ``agreeing`` samples in common have at least one of them
        among those that are left when each text drops its last ``agreeing`` - 1
        in a common order. The rarest come first. Samples of texts of one
        component alone can't be such texts' common ones and do not count.
        """
        s = self.s
        # The samples' number below zero, so that keys are not those of buckets.
        keys = F.array(*[F.xxhash64(F.lit(-1 - i), self.sample(i)) for i in range(s.samples)])
        texts = dense.select("tid", "comp").distinct().join(sketches, "tid")
        samples = dealt(texts.select("tid", "comp", F.explode(keys).alias("key")), "tid")
        shared = counted(samples, "key", "comp").where("low < high").select("key", "n", "salts")
        of_text = told(samples, shared, "key").groupBy("tid", "comp").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("ranked"))
        left = F.slice("ranked", 1, F.size("ranked") - (s.agreeing - 1))
        first = of_text.where(F.size("ranked") >= s.agreeing).select("tid", "comp", F.explode(left.getField("key")).alias("key"))
        groups = dealt(checkpointed(first), "tid")
        return checkpointed(told(groups, counted(groups, "key", "comp").where("low < high").select("key", "n", "salts"), "key"))

    def joined(self, comps: DataFrame, small: DataFrame, dense: DataFrame, sketches: DataFrame) -> DataFrame:
        """Links (a, b) that join components.

        Texts of dense buckets meet in groups of their own, so in small
        buckets they need no more comparing. Large ones of these groups that
        share texts are one cluster, and all of its texts are compared in
        blocks, once; so texts of one cluster need no comparing in small groups.
        Whole texts are sent of those alone whose sketches agree.
        """
        groups = self.alike(dense, sketches)
        large = groups.where(F.col("n") > self.s.bucket)
        heads = large.groupBy("key").agg(F.min("tid").alias("a"))
        clusters = components(large.join(heads, "key").select("a", F.col("tid").alias("b"))).select(
            F.col("node").alias("tid"), F.col("comp").alias("cluster")
        )
        known = clusters.join(comps.withColumnRenamed("node", "tid"), "tid", "left").select(
            "tid", "cluster", F.coalesce("comp", "tid").alias("comp")
        )
        known = dealt(known.join(sketches.select("tid", "size"), "tid"), "tid")
        sizes = counted(known, "cluster", "comp").where("low < high").select("cluster", "n", "salts")
        mixed = told(known, sizes.join(self.bytes_of(known, "cluster"), "cluster"), "cluster").drop("size")
        sources = [
            small.withColumn("side", F.lit(0)),
            groups.where(F.col("n") <= self.s.bucket).drop("n").withColumn("side", F.lit(0)),
            self.blocks(mixed, "cluster").select("key", "tid", "comp", "side"),
        ]
        own = [F.when(F.col("dense"), F.lit(b"")).otherwise(F.col("tid")), F.coalesce("cluster", "tid"), F.col("tid")]
        rows = reduce(DataFrame.unionByName, [x.withColumn("source", F.lit(i)) for i, x in enumerate(sources)])
        known = dense.select("tid").distinct().join(clusters, "tid", "left").withColumn("dense", F.lit(True))
        together = F.get(F.array(*own), F.col("source"))
        marked = rows.join(known, "tid", "left").select("key", "side", "tid", "comp", together.alias("cluster"))
        return self.exact(self.compared(marked, sketches))

    def bytes_of(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, bytes) of the texts of rows (key, size)."""
        return rows.groupBy(key).agg(F.sum("size").alias("bytes"))

    def classes(self) -> DataFrame:
        """(tid, size, comp) of the texts that are linked to another."""
        sketches = self.sketches()
        buckets = self.first_buckets(sketches)
        pivots = buckets.where("tid <> pivot").select(F.col("pivot").alias("a"), F.col("tid").alias("b")).distinct()
        links = self.verified(self.agreeing(pivots, sketches))
        comps = components(links)
        more = self.joined(comps, *self.split(buckets, comps, sketches), sketches)
        if not more.isEmpty():
            comps = components(links.unionByName(more))
        return sketches.select("tid", "size").join(comps.withColumnRenamed("node", "tid"), "tid")

    def links(self, classes: DataFrame) -> DataFrame:
        """(tid, links): the other texts that each text is linked to."""
        salted = dealt(classes, "tid")
        sizes = counted(salted, "comp", "tid").select("comp", "n", "salts").join(self.bytes_of(classes, "comp"), "comp")
        rows = told(salted, sizes, "comp").drop("size")
        keyed = self.blocks(rows, "comp").select("key", "side", "tid")
        texts = self.texts(classes.select("tid"))
        found = (
            keyed.join(texts, "tid")
            .select("key", "side", "tid", "text")
            .repartition("key")
            .sortWithinPartitions("key", "side", "tid")
            .mapInArrow(_count_links(self.s), "tid binary, links long")
        )
        return found.groupBy("tid").agg(F.sum("links").alias("links"))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """One row for each document: doc_id, class_id, n_copies, n_links.

    ``class_id`` is the least doc_id of the documents that links and equal
    texts connect. ``n_copies`` counts the documents with this very text,
    itself included; ``n_links`` counts the other texts with at least the
    similarity.

    Words are what white space parts, as they are written. Null text is
    empty; texts without words are similar to one another only. Repeated rows
    are copies. A class whose ids are all null has a null class_id; null ids
    are otherwise passed over for it. An empty table gives an empty result;
    other columns are not looked at. ``docs`` must give the same rows each
    time it is read, as files do.
    """
    join = Join(docs, id_col, text_col, settings)
    classes = checkpointed(join.classes())
    links = join.links(classes)
    # A text of very many copies, and a class of very many texts, are dealt to many tasks.
    ids = dealt(join.base.select("doc_id", "tid"), "doc_id")
    parts = ids.groupBy("tid", "salt").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    per_text = parts.groupBy("tid").agg(
        F.sum("n").alias("n_copies"), F.min("least").alias("least"), F.collect_list("salt").alias("salts")
    )
    known = checkpointed(
        per_text.join(classes.drop("size"), "tid", "left")
        .join(links, "tid", "left")
        .select("tid", "n_copies", "least", "salts", F.coalesce("comp", "tid").alias("comp"), F.coalesce("links", F.lit(0)).alias("n_links"))
    )
    members = dealt(known.withColumnRenamed("salts", "own_salts"), "tid")
    least = counted(members, "comp", "least").select("comp", F.col("low").alias("class_id"), "salts")
    by_text = told(members, least, "comp").select("tid", "class_id", "n_copies", F.col("n_links").cast("long"), F.col("own_salts").alias("salts"))
    return told(ids, by_text, "tid").select("doc_id", "class_id", "n_copies", "n_links")


def keep_one_of_each(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """``docs`` with one document of each class: of those with the least id, one with the least text digest.

    Columns stay as they are, whatever their names. Of rows that share id and
    text one stays: that whose columns, written as JSON, have the least
    digest. Edge cases are as in :func:`near_duplicates`.
    """
    join = Join(docs, id_col, text_col, settings)
    classes = join.classes().select("tid", "comp")
    last = F.lit((1 << 63) - 1)
    ids = join.base.select(F.coalesce("doc_id", last).alias("doc"), "tid")
    per_text = ids.groupBy("tid", "doc").agg(F.count("*").alias("rows"))
    ranked = per_text.join(classes, "tid", "left").groupBy(F.coalesce("comp", "tid").alias("comp"))
    best = checkpointed(ranked.agg(F.min(F.struct("doc", "tid", "rows")).alias("m")).select("m.tid", "m.doc", "m.rows"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        text_digest(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tid"),
        F.coalesce(F.col(id_col).cast("long"), last).alias("doc"),
    )
    kept = rows.join(best.where("rows = 1").select("tid", "doc"), ["tid", "doc"], "left_semi").select("row")
    again = rows.join(best.where("rows > 1").select("tid", "doc"), ["tid", "doc"], "left_semi")
    one = again.groupBy("tid", "doc").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row")).select("row")
    return kept.unionByName(one).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

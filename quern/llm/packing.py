"""Packing: first-fit decreasing in randomised groups of documents.

Every document is turned into ids once. Its ids are cut at multiples of the
sequence length: whole cuts fill sequences of their own, and what remains of
each document is an item. Items are dealt out by a seeded hash, sorted by it,
and every run of ``group_docs`` of them is one group, which is packed on its
own: the largest item first, each into the first bin that has room. A
tournament tree over the bins' free room finds that bin in O(log bins).

Rows that cross the shuffle hold lengths and checksums (and the ids only when
they are asked for). A task never holds more than one group.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batches, id_and_text, task_partition

SEQUENCE = 4096
END_ID = 2

_PIECE = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
]
_PLACE = [("sequence_id", pa.int64()), ("offset", pa.int64())]


class WordIds:
    """Ids of whole words, kept in a bounded table.

    The tokenizer replaces white space by one space, and its pre-tokenizer
    never joins what white space parts, so a text's ids are its words' ids in
    a row. ``encode`` gives little-endian unsigned 32-bit ids.

    New words go to the tokenizer many at a time. Words of letters alone are
    one pre-token each, whose last id ends a word, so they are encoded as one
    text and parted again; if the count of ends differs, or a word has other
    characters, it is encoded by itself.
    """

    def __init__(self, path: str, keep: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.keep = keep
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        # ASCII letters are made lower early, so that fewer words differ. Not before
        # combining marks: the tokenizer composes them first, which depends on case.
        texts = [t if b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
        words = [t.split() for t in texts]
        distinct = set().union(*words)
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        self.learn(distinct.difference(self.known))
        get = self.known.__getitem__
        for some in words:
            yield b"".join(map(get, some))

    def forget(self) -> None:
        """Give the tables' memory back: the worker may serve quite other tasks next."""
        self.known, self.older = {}, {}

    def learn(self, words: set[bytes]) -> None:
        known, older = self.known, self.older
        stopped, letters, others = [], {}, []
        for word in words:
            if (ids := older.get(word)) is not None:
                known[word] = ids
            elif word[-1] in b".," and word[:-1].isalpha():
                stopped.append(word)
                if word[:-1] not in known:
                    letters[word[:-1]] = None
            elif word.isalpha() or word.decode().isalpha():
                letters[word] = None
            else:
                others.append(word)
        self.learn_letters(list(letters))
        self.learn_each(others + [b".", b","])
        for word in stopped:
            known[word] = known[word[:-1]] + known[word[-1:]]

    def learn_letters(self, words: list[bytes]) -> None:
        for first in range(0, len(words), 1000):
            some = words[first : first + 1000]
            ids = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids
            ids = np.asarray(ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(some):
                self.learn_each(some)
                continue
            flat, starts = ids.tobytes(), [0, *stops[:-1].tolist()]
            self.known.update(zip(some, map(flat.__getitem__, map(slice, starts, stops.tolist())), strict=True))

    def learn_each(self, words: list[bytes]) -> None:
        for first in range(0, len(words), 4096):
            some = words[first : first + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            for word, one in zip(some, found, strict=True):
                self.known[word] = np.asarray(one.ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder for each worker process, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item. ``tree[i]`` is the most room in any bin below node i."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins, offsets


def _cut(path: str, end_id: int, length: int, seed: int, with_ids: bool) -> Callable:
    end = np.asarray([end_id], dtype="<u4").tobytes()
    schema = pa.schema([*_PIECE, ("deal", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = word_ids(path), Counter()
        for ids, texts in batches(source, 4 << 20):
            rows = []
            for doc_id, tokens in zip(ids, encoder.encode(texts), strict=True):
                tokens += end
                # Equal rows get 0, 1, 2 ... here, in whatever order they come, so that they spread.
                key = xxhash.xxh3_64_intdigest(b"%d %s" % (doc_id if doc_id is not None else -1, tokens), seed)
                deal = xxhash.xxh3_64_intdigest(b"%d %d" % (key, seen[key]), seed) - (1 << 63)
                seen[key] += 1
                count = len(tokens) // 4
                for start in range(0, count, length):
                    part = tokens[4 * start : 4 * (start + length)]
                    row = (doc_id, start, len(part) // 4, zlib.crc32(part), count, deal)
                    rows.append(row + (part,) * with_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )
        encoder.forget()

    return cut


def _place(length: int, group_docs: int, with_ids: bool) -> Callable:
    carried = [*_PIECE] + [("ids", pa.binary())] * with_ids
    schema = pa.schema([*carried, *_PLACE])
    names = [name for name, _ in carried]

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = task_partition() << 33

        def packed(piece: pa.Table) -> pa.RecordBatch:
            nonlocal next_id
            bins, offsets = first_fit_decreasing(piece["length"].to_pylist(), length)
            ids = np.asarray(bins, dtype=np.int64) + next_id
            next_id += max(bins) + 1
            return whole(piece, ids, np.asarray(offsets, dtype=np.int64))

        def whole(piece: pa.Table, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
            columns = [piece[n].combine_chunks() for n in names]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ids), pa.array(offsets)], schema=schema)

        waiting, n_waiting = [], 0
        for batch in source:
            rows = pa.Table.from_batches([batch]).select(names)
            is_full = np.asarray(rows["length"]) == length
            full, rest = rows.filter(pa.array(is_full)), rows.filter(pa.array(~is_full))
            if full.num_rows:
                yield whole(full, np.arange(full.num_rows) + next_id, np.zeros(full.num_rows, dtype=np.int64))
                next_id += full.num_rows
            while rest.num_rows:
                take = min(group_docs - n_waiting, rest.num_rows)
                waiting.append(rest.slice(0, take))
                n_waiting += take
                rest = rest.slice(take)
                if n_waiting == group_docs:
                    yield packed(pa.concat_tables(waiting).combine_chunks())
                    waiting, n_waiting = [], 0
        if waiting:
            yield packed(pa.concat_tables(waiting).combine_chunks())

    return place


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_length: int = SEQUENCE,
    end_id: int = END_ID,
    group_docs: int = 8192,
    seed: int = 17,
    with_ids: bool = False,
) -> DataFrame:
    """Cut and place every document; one row for each piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id,
    offset. A sequence holds at most ``sequence_length`` ids; offsets in it
    run from 0 without gaps; ``sequence_id`` is unique but not consecutive.

    Null or empty text: one piece with the end id alone. Null ids and repeated
    rows: each row is packed on its own, and equal rows spread over groups.
    Very long text: as many full sequences as it fills, and one rest. An empty
    table gives an empty result. Other columns are not looked at. The same
    table read again gives the same groups.
    """
    piece = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    ids = ", ids binary" if with_ids else ""
    pieces = id_and_text(docs, id_col, text_col).mapInArrow(
        _cut(tokenizer_path, end_id, sequence_length, seed, with_ids), f"{piece}, deal long{ids}"
    )
    dealt = pieces.repartition("deal").sortWithinPartitions("deal", "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(
        _place(sequence_length, group_docs, with_ids), f"{piece}{ids}, sequence_id long, offset long"
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences of ``pack_documents(..., with_ids=True)``.

    One row for each sequence: sequence_id, n_tokens, n_pieces and ids, the
    pieces' ids in a row. A sequence is at most one sequence length long, so
    what is gathered for a row is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), parts.alias("parts"))
        .select(
            "sequence_id",
            "n_tokens",
            "n_pieces",
            F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"),
        )
    )

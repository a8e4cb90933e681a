"""Quality rules: repetition found with a suffix array.

For every document a suffix array over its words is built by prefix doubling,
and with it the lengths of the longest common prefixes of neighbours. The
deepest longest-common-prefix interval that holds a suffix has the greater of
the two lengths beside it; that many words, from where the suffix starts, are
found elsewhere in the document, and no longer run from there is. The union of
these spans is the repeated part. A document is rejected if the repeated part
takes too much of it, or if its longest repeat is too long.

Many documents are sorted in one array: a word's first rank holds its
document, so suffixes of different documents never tie. Ranks that are single
take no part in later rounds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batches, slices

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
_NOT_COUNTED = SPACES + bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    """What makes a document fail. Lengths are in words, shares in hundredths of a document's words."""

    least_words: int = 50
    window: int = 3
    most_window_percent: int = 50
    #: Repeats of fewer words are ordinary phrases.
    least_repeat: int = 8
    most_covered_percent: int = 30
    longest_repeat: int = 200


def suffix_array(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, longest common prefix with the one before) of a sequence.

    ``first`` holds a rank for each position. The end sorts before everything.
    """
    n = len(first)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(first, kind="stable")
    sorted_ranks = first[order]
    starts = np.flatnonzero(np.r_[True, sorted_ranks[1:] != sorted_ranks[:-1]])
    sizes = np.diff(np.r_[starts, n])
    # A suffix's rank is where its group starts, from 1; 0 is the end.
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[order] = np.repeat(starts, sizes) + 1
    levels, step = [rank.astype(np.int32)], 1
    active = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in order that are not settled
    while len(active):
        at = order[active]
        key = rank[at] * (n + 1) + rank[np.minimum(at + step, n)]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[active] = at
        new = np.r_[True, key[1:] != key[:-1]]
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[at] = active[heads][group] + 1
        sizes = np.diff(np.r_[heads, len(at)])
        active = active[sizes[group] > 1]
        step *= 2
        levels.append(rank.astype(np.int32))
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)]
        same &= (a < n) & (b < n)
        add = same.astype(np.int64) << k
        common[1:] += add
        a += add
        b += add
    return order, common


def longest_repeats(first: np.ndarray) -> np.ndarray:
    """For each position, the words from it that are found elsewhere too."""
    order, common = suffix_array(first)
    found = np.zeros(len(first), dtype=np.int64)
    if len(first):
        found[order] = np.maximum(common, np.r_[common[1:], 0])
    return found


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n positions lies in one of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def maximal_repeats(words: list, least: int) -> list[tuple[int, int]]:
    """(start, length) of each repeated run that can't be made longer on either side."""
    ids: dict = defaultdict(count().__next__)
    found = longest_repeats(np.fromiter((ids[w] for w in words), dtype=np.int64, count=len(words)))
    before = np.r_[0, found[:-1]]
    return [(int(i), int(found[i])) for i in np.flatnonzero((found >= least) & (before <= found))]


_FIELDS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("n_covered_words", pa.int64()),
    ("longest_repeat", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
]


def measure(texts: list[bytes], limits: Limits) -> list[np.ndarray]:
    """The columns of ``_FIELDS`` for some texts."""
    ids: dict = defaultdict(count().__next__)
    words = [text.split() for text in texts]
    n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n = int(n_words.sum())
    flat = np.fromiter((i for w in words for i in map(ids.__getitem__, w)), dtype=np.int64, count=n)
    doc = np.repeat(np.arange(len(texts)), n_words)
    found = longest_repeats(doc * max(1, len(ids)) + flat)

    def words_in(least: int, length: np.ndarray | int) -> np.ndarray:
        starts = np.flatnonzero(found >= least)
        lengths = length[starts] if isinstance(length, np.ndarray) else np.full(len(starts), length)
        return np.bincount(doc[covered(starts, lengths, n)], minlength=len(texts))

    in_windows = words_in(limits.window, limits.window)
    in_repeats = words_in(limits.least_repeat, found)
    longest = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(longest, doc, found)
    chars = [len(t.translate(None, _NOT_COUNTED)) for t in texts]
    symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
    lines = [[line for line in t.split(b"\n") if line.strip()] for t in texts]
    dup_lines = [len(x) - len(set(x)) for x in lines]
    failed = (n_words < limits.least_words) | (100 * in_windows > limits.most_window_percent * n_words)
    repeats = (100 * in_repeats > limits.most_covered_percent * n_words) | (longest > limits.longest_repeat)
    return [n_words, chars, symbols, dup_lines, in_windows, in_repeats, longest, failed, ~failed & ~repeats]


def _measured(limits: Limits) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), *_FIELDS])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(source, 1 << 20):
            columns = [ids, *measure(texts, limits)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return run


def repetition_report(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """One row for each document: its id, what was measured, and whether it is kept.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_covered_words, longest_repeat, base_failed, kept.
    No rows are shuffled.

    Null and empty texts have no words, so they fail. Repeated rows and null
    ids each get a row. A very long text is sorted in one task, in some 60
    bytes a word, and 4 more for each doubling up to its longest repeat. An empty table gives an empty result; other columns are not
    looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fields = ", ".join(f"{name} {'boolean' if kind == pa.bool_() else 'long'}" for name, kind in _FIELDS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        _measured(limits), f"doc_id long, {fields}"
    )


def keep_unrepetitive(docs: DataFrame, *, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they have.

    Decisions are made where the rows are, so nothing is joined back. Edge
    cases are as in :func:`repetition_report`.
    """
    place = docs.columns.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            text, kept = batch.column(place).cast(pa.binary()), []
            for first, last in slices(text, 1 << 20):
                kept.append(measure([t or b"" for t in text.slice(first, last - first).to_pylist()], limits)[-1])
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)

"""Phrases whose words stand together more often than chance has it.

A task is a shard. It puts its pieces' words into generalised suffix automata
with counts of end positions, handed up the suffix links, and enumerates their
substrings of up to five words; counts of shards are then summed.

What can't reach the least count is cut away beforehand, level by level: a
phrase is as frequent as any phrase inside it at most. Words, then pairs, and
so on up to the longest phrases are counted first, and those that are frequent
enough set bits of a bitmap of fixed size, which all tasks get. Words are
counted as they are, the others by 64-bit hashes; a hash that several share,
in the counts or in the bitmap, lets more through and nothing less. Stretches
in which all runs pass are what automata are made of, and the counts of what
they hold are exact.

A phrase is subsumed by a longer one that is as frequent. In the automaton of
the whole corpus a phrase without its first word is either in the same state,
with the same count, or the state's suffix link; the reversed corpus's says
the same of the last word. So each candidate tells its count to the two
phrases that are a word shorter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, slices

MOST_WORDS = 5
#: Bits of a level's bitmap, as a power of two: 8 MiB at any size of the corpus.
BITS = 26
#: Bits of one piece of a bitmap; what ``bitmap_construct_agg`` makes.
PIECE_BITS = 15
#: What a task gathers of texts, of counts, and of words for one automaton.
SLICE_BYTES, MOST_COUNTS, MOST_TOKENS = 2 << 20, 1 << 20, 200_000
#: Words of a shard whose phrases are counted together, if the scan's tasks have less: more of a phrase's occurrences meet before the shuffle.
SHARD_WORDS = 24_000_000
#: Longer runs are cut.
LONGEST_RUN = 20_000

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = re.compile(b"[" + PIECE_ENDS + b"]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANKED = bytes(0x20 if i in PIECE_ENDS else b for i, b in enumerate(_LOWER))
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]], _KIND[list(PIECE_ENDS)] = 1, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a hash hangs on all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, for texts of less than 2**bits bytes."""
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << bits) - 1, x, np.uint64)])) for x in (_STEP, _BACK))


class Shard:
    """Words of texts of one language: where they begin and end, their hashes, and which have their next in the same piece."""

    def __init__(self, texts: list[bytes], lang: str):
        self.text = b"\n".join(texts).translate(_LOWER)
        letters = np.frombuffer(self.text, np.uint8)
        kind = _KIND[letters]
        edges = np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        pieces = np.cumsum(kind == 2)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.joined = np.append(pieces[1:] == pieces[:-1], False)[: len(self.starts)]
        up, down = _powers(max(21, len(letters).bit_length()))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[: len(letters)])])
        own = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.hashes = _mixed(own ^ np.uint64(zlib.crc32(lang.encode()) << 20))

    def word(self, i: int) -> bytes:
        return self.text[self.starts[i] : self.ends[i]]


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64((1 << BITS) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def runs(shard: Shard, filters: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, passed) of runs of 1, 2... words, by their first word: one more length than there are filters, unfiltered."""
    n = len(shard.starts)
    hashes, passed, out = shard.hashes, np.ones(n, bool), []
    for k in range(len(filters) + 1):
        if k:
            nexts = np.zeros_like(hashes)
            nexts[: n - k] = shard.hashes[k:]
            hashes = _mixed(hashes * _STEP + nexts)
            passed = passed & np.append(passed[1:], False)[:n] & (shard.joined if k == 1 else True)
        if k < len(filters):
            passed = passed & _passes(filters[k], hashes)
        out.append((hashes, passed))
    return out


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about ``SLICE_BYTES`` that end with pieces; only a piece that is longer makes a longer part."""
    first = 0
    while len(text) - first > SLICE_BYTES and (end := _END.search(text, first + SLICE_BYTES)):
        yield text[first : end.end()]
        first = end.end()
    yield text[first:]


def _shards(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) from (lang, text) rows; a long text comes in parts."""
    for batch in source:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        for first, last in slices(texts, SLICE_BYTES):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(langs[first:last], texts.slice(first, last - first).to_pylist(), strict=True):
                if len(text) > SLICE_BYTES:
                    for part in _parts(text):
                        yield lang, [part]
                else:
                    by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                yield lang, own


def _count_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task's words, and with no word how many there are in all."""

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, count in counts.items():
            words = [*count, None]
            n = [*count.values(), sum(count.values())]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])
        counts.clear()

    counts: dict[str, Counter] = {}
    for lang, texts in _shards(source):
        for text in texts:
            counts.setdefault(lang, Counter()).update(text.translate(_BLANKED).split())
        if sum(map(len, counts.values())) > MOST_COUNTS // 4:
            yield from rows()
    yield from rows()


def _hash_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h) of (lang, word) rows."""
    for lang, words in _shards(source):
        yield pa.RecordBatch.from_arrays([pa.array(Shard(words, lang).hashes.view(np.int64))], ["h"])


def _count_runs(filters: list) -> callable:
    """(h, n) of a task's runs that are a word longer than the last filter's."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(f.value, np.uint8) for f in filters]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))[: len(h)]
            return h[first], np.add.reduceat(n, first) if len(first) else n

        def rows() -> pa.RecordBatch:
            h, n = summed()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        size = 0
        for lang, texts in _shards(source):
            hashes, passed = runs(Shard(texts, lang), bits)[-1]
            found = hashes[passed]
            held.append((found, np.ones(len(found), np.int64)))
            size += len(found)
            if size > MOST_COUNTS:
                held = [summed()]
                size = len(held[0][0])
                if size > MOST_COUNTS // 2:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    return count


class Automaton:
    """A generalised suffix automaton over sequences of numbers. ``count`` is how often a state's substrings end somewhere."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, next: dict[int, int], link: int) -> int:
        self.next.append(next)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A state for those substrings of q that end in p's longest and w."""
        made = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = made
            p = self.link[p]
        self.link[q] = made
        return made

    def add(self, words: tuple[int, ...], weight: int) -> None:
        """Count a sequence ``weight`` times."""
        last = 0
        for w in words:
            there = self.next[last].get(w)
            if there is None:
                made, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = made
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
                last = made
            else:
                last = there if self.length[there] == self.length[last] + 1 else self._split(last, there, w)
            self.count[last] += weight

    def settle(self) -> None:
        """Hand counts up the suffix links, the longest states first."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def substrings(self, least: int, most: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Every distinct substring of so many words with its count; each is one path from the root."""
        open_ = [((), 0)]
        while open_:
            path, state = open_.pop()
            for w, s in self.next[state].items():
                longer = (*path, w)
                if len(longer) >= least:
                    yield longer, self.count[s]
                if len(longer) < most:
                    open_.append((longer, s))


def segments(shard: Shard, filters: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(first word, after the last, weight) of stretches that hold every run that passes, each once by the sum of weights.

    A stretch is as long as all runs in it of each filter's length pass.
    Stretches next to each other may share words; these are taken off again.
    """
    k, n = len(filters), len(shard.starts)
    reach = np.zeros(n, np.int64)  # words of the longest run from here that passes
    for _, passed in runs(shard, filters)[:k]:
        reach += passed
    at = np.arange(n)
    # A run of full length goes on as far as the next one does.
    ends = np.minimum.accumulate(np.where(reach < k, at + reach, n)[::-1])[::-1]
    firsts = np.flatnonzero(np.append(True, ends[1:] > ends[:-1])[:n] & (ends - at > 1))
    lasts = ends[firsts]
    yield from zip(firsts.tolist(), lasts.tolist(), [1] * len(firsts), strict=True)
    shared = np.flatnonzero(lasts[:-1] - firsts[1:] > 1)
    yield from zip(firsts[shared + 1].tolist(), lasts[shared].tolist(), [-1] * len(shared), strict=True)


def cut(words: tuple[int, ...], most_words: int, longest: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(part, weight) of a sequence's parts, which overlap by a word less than a phrase has; overlaps, counted twice, are taken off."""
    shared = most_words - 1
    for first in range(0, max(1, len(words) - shared), longest):
        yield words[first : first + longest + shared], 1
        if first:
            yield words[first : first + shared], -1


def _count_phrases(filters: list, most_words: int) -> callable:
    """(lang, phrase, n) of a task's phrases, by automata of its stretches; counts of several automata are added up."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(f.value, np.uint8) for f in filters]
        held: dict[str, tuple[Counter, dict[bytes, int]]] = {}
        counts: dict[str, dict[str, int]] = {}
        tokens: Counter = Counter()

        def settled(lang: str) -> None:
            """Add what an automaton of the gathered stretches counts to the task's counts."""
            stretches, names = held.pop(lang)
            automaton, words, own = Automaton(), [x.decode() for x in names], counts.setdefault(lang, {})
            for part, weight in stretches.items():
                automaton.add(part, weight)
            automaton.settle()
            for path, n in automaton.substrings(2, most_words):
                if n:
                    phrase = " ".join([words[w] for w in path])
                    own[phrase] = own.get(phrase, 0) + n

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                columns = [pa.array([lang] * len(own), pa.string()), pa.array([*own], pa.string()), pa.array([*own.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])
            counts.clear()

        for lang, texts in _shards(source):
            shard = Shard(texts, lang)
            own, names = held.setdefault(lang, (Counter(), {}))
            for first, last, sign in segments(shard, bits):
                words = tuple([names.setdefault(shard.word(i), len(names)) for i in range(first, last)])
                for part, weight in cut(words, most_words, LONGEST_RUN) if len(words) > LONGEST_RUN else ((words, 1),):
                    if part not in own:
                        tokens[lang] += len(part)
                    own[part] += weight * sign
            if tokens[lang] > MOST_TOKENS:
                settled(lang)
                tokens[lang] = 0
            if sum(map(len, counts.values())) > MOST_COUNTS // 2:
                yield from rows()
        for lang in [*held]:
            settled(lang)
        yield from rows()

    return count


def _bitmap(hashes: DataFrame) -> bytes:
    """2**BITS bits; set are those at the hashes' last bits. The driver gets 8 MiB at most, whatever the number of hashes."""
    at = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    pieces = hashes.select(F.shiftright(at, PIECE_BITS).alias("piece"), at.bitwiseAND(F.lit((1 << PIECE_BITS) - 1)).alias("bit"))
    bits = bytearray(1 << (BITS - 3))
    for piece, content in pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit")).collect():
        bits[piece << (PIECE_BITS - 3) : (piece + 1) << (PIECE_BITS - 3)] = content
    return bytes(bits)


def phrase_counts(texts: DataFrame, least: int, most_words: int) -> DataFrame:
    """(lang, phrase, n): words and phrases of up to ``most_words`` words that are found ``least`` times; with no phrase, all words of a language."""
    sc = texts.sparkSession.sparkContext
    words = texts.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = words.where(F.col("word").isNull() | (F.col("n") >= least)).select("lang", F.col("word").cast("string").alias("phrase"), "n")
    words = checkpointed(words)
    filters = [sc.broadcast(_bitmap(words.where("phrase is not null").select("lang", "phrase").mapInArrow(_hash_words, "h long")))]
    while len(filters) < most_words:
        counts = texts.mapInArrow(_count_runs(list(filters)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        filters.append(sc.broadcast(_bitmap(counts.where(F.col("n") >= least))))
    in_all = words.where("phrase is null").agg(F.sum("n")).first()[0] or 0
    shards = texts.coalesce(1 + in_all // SHARD_WORDS)  # never more than there are
    phrases = shards.mapInArrow(_count_phrases(filters, most_words), "lang string, phrase string, n long")
    phrases = checkpointed(phrases.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    for f in filters:
        f.destroy()
    return words.unionByName(phrases)


def collocations(
    docs: DataFrame, least: int = 100, most_words: int = MOST_WORDS, top: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score.

    A phrase of 2 to ``most_words`` words of one piece, found a >= ``least``
    times, has the score floor(1000 * a * n / (l * r)) at the cut where that is
    lowest, the first of such cuts. Phrases inside a longer one that is as
    frequent are left out.

    A null language is ``und``; null and empty texts have no words. Repeated
    rows count each for itself, overlapping occurrences too. Texts are read
    whole, however long. Equal scores go by a, then by the phrase's bytes. No
    documents or no frequent phrases give no rows; other columns, whatever
    their names, are not looked at.
    """
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counts = phrase_counts(docs.select(lang.alias("lang"), text.alias("text")), least, most_words)
    totals = counts.where("phrase is null").select("lang", F.col("n").alias("total"))
    counts = counts.where("phrase is not null")
    words = F.split("phrase", " ")
    held = counts.select("lang", "phrase", F.col("n").alias("a"), words.alias("w")).where(F.size("w") > 1)
    side = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    at = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    cuts = held.select("lang", "phrase", "a", "w", at).select(
        "lang", "phrase", "a", "k", F.size("w").alias("words"), side(F.lit(1), F.col("k")).alias("left"), side(F.col("k") + 1, F.size("w")).alias("right")
    )
    known = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(1000 * cast(a as decimal(20,0)) * cast(total as decimal(20,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))
    inside = F.array(F.when(F.col("k") == 1, F.col("right")), F.when(F.col("k") == F.col("words") - 1, F.col("left")))
    inner = cuts.where("words > 2").select("lang", "a", F.explode(inside).alias("phrase")).where("phrase is not null")
    subsumed = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(subsumed, ["lang", "phrase"], "left").where("longer is null or longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", F.col("total").alias("n"), "low.score")

"""Language-model scoring: a probabilistic suffix tree.

A text is the sequence of its words' bytes, each word closed by a space and
the text by a line feed; neither occurs in words. Runs of bytes, a symbol and
what stands before it, are counted over all texts. From the root on, a context
is retained if it occurs an absolute number of times in training texts and
what follows it diverges enough from what follows its longest retained suffix,
both weighed by how often it occurs. So the tree grows with the corpus.
Next-symbol distributions are smoothed towards that suffix's.

The tree is a table of the chance of the symbol in every run of the texts. It
is made level by level, a context met with its suffix, in groups of contexts
that end alike. Frequent runs (each a least share of all, so their number is bounded)
are looked up in the tasks; the others are joined by a shuffle on the run.

:class:`Tree` is the same model as an automaton in the memory of one process,
for tables of contexts that fit there: reading a symbol leads to the longest
suffix of what was read that is a state. It forgets what is further back than
the depth, so a batch of texts is cut into many rows with a short run-up, and
each numpy step reads one symbol of every row.

Beside it stands the unigram model over words, whose frequent words are looked
up and others joined in the same way.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batches, checkpointed, id_and_text, task_partition

END = 10
SYMBOLS = 256


@dataclass(frozen=True)
class Settings:
    #: Bytes of context, at most 6.
    depth: int = 5
    #: Contexts that occur fewer times are not retained.
    least_count: int = 2
    #: The same as a share of all symbols; a positive one bounds the tree whatever the input.
    least_share: float = 0.0
    #: Nats by which a context's followers must be better told by it than by its suffix.
    least_gain: float = 8.0
    #: Words of a greater share of all tokens are sent to every task; at most 1 / share are.
    head_share: float = 2e-6
    #: The same for runs of symbols. It says where they are looked up, and changes no result.
    run_share: float = 5e-8
    fold: int = 10


def held_out(doc_id: int | None, fold: int) -> bool:
    """By the id's digits; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % fold == 0


def stream(words: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, where each text starts): each text comes after as many ends as the depth, so that none sees the one before."""
    start = bytes([END]) * depth
    texts = [start + b" ".join([*w, bytes([END])]) for w in words]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(sizes) - sizes


def counted(starts: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Which of n symbols belong to the texts, and not to the ends before them."""
    keep = np.ones(n, dtype=bool)
    keep[np.add.outer(starts, np.arange(depth)).ravel()] = False
    return keep


def grams(symbols: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """A number for each symbol of the texts together with the ``depth`` before it."""
    n = max(0, len(symbols) - depth)
    out = np.zeros(n, dtype=np.int64)
    for i in range(depth + 1):
        out <<= 8
        out |= symbols[i : i + n]
    return out[counted(starts, len(symbols), depth)[depth:]]


class Tree:
    """The automaton of a suffix tree in memory: ``follow`` and ``score`` by state and symbol class."""

    def __init__(self, rows: pa.Table, settings: Settings):
        """``rows``: depth, context, symbol, n of every candidate context, each at most ``depth`` bytes as a number."""
        depth, context, symbol, n = (np.asarray(rows[c]).astype(np.int64) for c in ("depth", "context", "symbol", "n"))
        self.depth = settings.depth
        seen = np.unique(symbol)
        # Bytes that were never seen share one class, the last; each has an equal part of its probability.
        self.classes = np.full(SYMBOLS, len(seen), dtype=np.int32)
        self.classes[seen] = np.arange(len(seen))
        self.width = len(seen) + 1
        apart = np.ones(self.width)
        apart[-1] = max(1, SYMBOLS - len(seen))
        code, inverse = np.unique((depth << 48) | context, return_inverse=True)
        place = {int(c): i for i, c in enumerate(code)}
        counts = np.zeros((max(1, len(code)), self.width))
        np.add.at(counts, (inverse, self.classes[symbol]), n)
        level, context = code >> 48, code & ((1 << 48) - 1)
        chance = np.empty_like(counts)  # what each context or its longest retained suffix says
        keep = np.zeros(len(counts), dtype=bool)
        suffix = np.zeros(len(counts), dtype=np.int64)
        for d in range(settings.depth + 1):
            at = np.flatnonzero(level == d) if len(code) else np.zeros(1, dtype=np.int64)
            if d == 0:
                before = np.broadcast_to(apart / SYMBOLS, (len(at), self.width))
            else:
                tail = ((d - 1) << 48) | (context[at] & ((1 << (8 * (d - 1))) - 1))
                suffix[at] = [place[int(t)] for t in tail]
                before = chance[suffix[at]]
            own = counts[at]
            kinds, total = (own > 0).sum(axis=1, keepdims=True), own.sum(axis=1, keepdims=True)
            smooth = (own + np.maximum(kinds, 1) * before) / (total + np.maximum(kinds, 1))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(own > 0, own * np.log(own / np.maximum(total, 1) / before), 0).sum(axis=1)
            keep[at] = (gain >= settings.least_gain) | (d == 0)
            chance[at] = np.where(keep[at][:, None], smooth, before)
            if not len(code):
                break
        self.retained = int(keep.sum())
        # States: what is retained, and all prefixes and suffixes of it.
        for d in range(settings.depth, 0, -1):
            at = np.flatnonzero((level == d) & keep)
            keep[suffix[at]] = True
            keep[[place[int(((d - 1) << 48) | (c >> 8))] for c in context[at]]] = True
        states = np.flatnonzero(keep)
        number = np.full(len(counts), -1, dtype=np.int64)
        number[states] = np.arange(len(states))
        follow = np.zeros((len(states), self.width), dtype=np.int32)
        for d in range(settings.depth + 1):
            at = states[level[states] == d] if len(code) else states
            if d:
                follow[number[at]] = follow[number[suffix[at]]]
            longer = states[level[states] == d + 1] if len(code) else states[:0]
            if len(longer):
                prefix = [number[place[int((d << 48) | (c >> 8))]] for c in context[longer]]
                follow[prefix, self.classes[context[longer] & 255]] = number[longer]
        self.follow = (follow * self.width).astype(np.int32).ravel()  # a state is where its row starts
        self.score = np.log10(chance[states] / apart).ravel()

    def scores(self, words: list[list[bytes]], row: int = 512) -> np.ndarray:
        """log10 probability of each text."""
        symbols, starts = stream(words, self.depth)
        n, d = len(symbols), self.depth
        if not n:
            return np.zeros(0)
        rows = -(-n // row)
        padded = np.full(d + rows * row, END, dtype=np.uint8)
        padded[d : d + n] = symbols
        classes = self.classes.take(padded)
        # Column i of every row is symbol i - d of it; the first d lead to its state.
        table = np.lib.stride_tricks.as_strided(classes, (rows, row + d), (classes.strides[0] * row, classes.strides[0])).T.copy()
        state = np.zeros(rows, dtype=np.int32)
        found = np.empty((row, rows))
        for i in range(row + d):
            at = state + table[i]
            if i >= d:
                found[i - d] = self.score.take(at)
            state = self.follow.take(at)
        flat = found.T.ravel()[:n]
        flat = np.where(counted(starts, n, d), flat, 0)
        return np.add.reduceat(flat, starts)


def _lower_words(texts: list[bytes]) -> list[list[bytes]]:
    return [t.lower().split() for t in texts]


def _training(source: Iterator[pa.RecordBatch], fold: int) -> Iterator[list[list[bytes]]]:
    for ids, texts in batches(source, 4 << 20):
        yield _lower_words([t for i, t in zip(ids, texts, strict=True) if not held_out(i, fold)])


def _count_words(settings: Settings, at_most: int = 600_000) -> Callable:
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=schema)

        for words in _training(source, settings.fold):
            for some in words:
                counts.update(some)
            if len(counts) > at_most:
                yield made()
                counts.clear()
        if counts:
            yield made()

    return run


def _tally(keys: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of their numbers."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[edges], *(np.add.reduceat(n[by], edges) for n in numbers)


def _count_grams(settings: Settings, at_most: int = 2_000_000) -> Callable:
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("seen", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, dtype=np.int64),) * 3
        held = none
        for ids, texts in batches(source, 4 << 20):
            words = _lower_words(texts)
            apart = [held_out(i, settings.fold) for i in ids]
            for out in (False, True):
                some = [w for w, o in zip(words, apart, strict=True) if o == out]
                if not some:
                    continue
                new = grams(*stream(some, settings.depth), settings.depth)
                new.sort()
                edges = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])
                n = np.diff(np.r_[edges, len(new)])
                held = _tally(*map(np.concatenate, zip(held, (new[edges], n * (not out), n), strict=True)))
            if len(held[0]) > at_most:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], schema=schema)
                held = none
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], schema=schema)

    return run


def _level(pairs: np.ndarray, n: np.ndarray, before: np.ndarray, least: float, settings: Settings) -> np.ndarray:
    """The chance of each pair's symbol after its context.

    ``pairs``: contexts of one length with the symbol behind, in order; ``n``:
    how often each is in training texts; ``before``: the chance after the
    context's suffix. The root is always retained.
    """
    context = pairs >> 8
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(pairs)]))
    total = np.add.reduceat(n, first)
    kinds = np.maximum(1, np.add.reduceat((n > 0).astype(np.int64), first))
    better = np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(total, 1)[of] / before), 0.0)
    keep = (total >= least) & (np.add.reduceat(better, first) >= settings.least_gain)
    smooth = (n + kinds[of] * before) / (total + kinds)[of]
    return np.where(keep[of], smooth, before)


def _low(numbers: np.ndarray, n_bytes: int) -> np.ndarray:
    return numbers & ((1 << (8 * n_bytes)) - 1)


#: Runs are dealt by so many last bytes of their contexts, and shorter contexts make the stem of all.
STEM = 2


def _stem(pairs: np.ndarray, n: np.ndarray, least: float, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, chances) of contexts shorter than ``STEM``, or of the depth if that is less."""
    known = chance = None
    for d in range(min(STEM, settings.depth + 1)):
        keys, sums = _tally(_low(pairs, d + 1), n)
        if known is None:
            kinds = max(1, np.count_nonzero(sums))
            chance = (sums + kinds / SYMBOLS) / (sums.sum() + kinds)
        else:
            chance = _level(keys, sums, chance[np.searchsorted(known, _low(keys, d))], least, settings)
        known = keys
    return known, chance


def _chances(stem, least: float, settings: Settings) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        gram, n, seen = (group[c].to_numpy() for c in ("gram", "n", "seen"))
        known, chance = stem.value
        for d in range(STEM, settings.depth + 1):
            keys, sums = _tally(_low(gram, d + 1), n)
            chance = _level(keys, sums, chance[np.searchsorted(known, _low(keys, d))], least, settings)
            known = keys
        found = np.log10(chance[np.searchsorted(known, gram)])
        return pa.table({"gram": gram, "seen": seen, "chance": found})

    return run


def gram_chances(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(gram, seen, chance) of every run in (doc_id, text): how often it is there, and log10 of its symbol's chance.

    Runs of held-out texts have a chance too, but count for nothing in the
    model. A context and its suffixes end alike, so the distinct runs of equal
    last bytes of context are a group that has all it needs but the stem, which
    has at most 65,536 pairs. A group is worked through in memory.
    """
    if settings.depth > 6:
        raise ValueError("a context has 6 bytes at most")
    counts = docs.mapInArrow(_count_grams(settings), "gram long, n long, seen long")
    counts = checkpointed(counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")))
    pairs = counts.groupBy(F.expr(f"gram & {(1 << (8 * STEM)) - 1}L").alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    pair, n = pairs["pair"].to_numpy(), pairs["n"].to_numpy()
    least = max(1.0, settings.least_count, settings.least_share * n.sum())
    stem = _stem(pair, n, least, settings) if len(pair) else (pair, n.astype(np.float64))
    stem = docs.sparkSession.sparkContext.broadcast(stem)
    tail = F.expr(f"(gram >> 8) & {(1 << (8 * STEM)) - 1}L")
    groups = counts.groupBy(tail.alias("tail"))
    return checkpointed(groups.applyInArrow(_chances(stem, least, settings), "gram long, seen long, chance double"))


def _gram_keys(found: np.ndarray) -> pa.Array:
    """Runs as join keys, which are no words, as they start with a line feed."""
    made = np.empty((len(found), 9), dtype=np.uint8)
    made[:, 0] = END
    made[:, 1:] = found.astype(">i8").view(np.uint8).reshape(-1, 8)
    offsets = np.arange(len(found) + 1, dtype=np.int32) * 9
    return pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(made)])


def _score(settings: Settings, runs, head, unit: dict) -> Callable:
    fields = [
        ("uid", pa.int64()),
        ("word", pa.binary()),
        ("n", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
    schema = pa.schema(fields)
    kinds = [f.type for f in schema]

    def looked_up(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What each text's frequent runs score; and (text, run, times) of the others."""
        symbols, starts = stream(words, settings.depth)
        sizes = np.diff(np.r_[starts, len(symbols)]) - settings.depth
        found, inverse = np.unique(grams(symbols, starts, settings.depth), return_inverse=True)
        known, chances = runs.value
        at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
        hit = known[at] == found if len(known) else np.zeros(len(found), dtype=bool)
        value = np.where(hit, chances[at], 0.0) if len(known) else np.zeros(len(found))
        scores = np.add.reduceat(value[inverse], np.cumsum(sizes) - sizes)
        rare = np.flatnonzero(~hit[inverse])
        text = np.searchsorted(np.cumsum(sizes), rare, side="right")
        both, times = np.unique(text * len(found) + inverse[rare], return_counts=True)
        return scores, both // len(found), found[both % len(found)], times

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        uid = task_partition() << 40
        for ids, texts in batches(source, 2 << 20):
            words = _lower_words(texts)
            scores, where, rare_runs, run_times = looked_up(words)
            top: list[list] = [[] for _ in kinds[3:]]
            uids, rare, times = [], [], []
            for doc_id, some in zip(ids, words, strict=True):
                n_known, base = int(unit["end"] > 0), unit["end_score"]
                counts = Counter(some)
                for word in counts.keys() & known.keys():
                    n = counts.pop(word)
                    n_known += n
                    base += n * known[word]
                rare.extend(counts.keys())
                times.extend(counts.values())
                uids.extend([uid] * len(counts))
                values = (doc_id, held_out(doc_id, settings.fold), len(some) + 1, n_known, base)
                for column, value in zip(top, values, strict=False):
                    column.append(value)
                uid += 1
            top[-1] = scores.tolist()
            first = uid - len(ids)
            # A row for the document itself, whose key is no word, as it has a space.
            own = [range(first, uid), [b" %d" % u for u in range(first, uid)], [0] * len(ids), *top]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(own, kinds, strict=True)], schema=schema)
            if rare:
                more = [pa.array(c, k) for c, k in zip((uids, rare, times), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*more, *(pa.nulls(len(rare), k) for k in kinds[3:])], schema=schema)
            if len(rare_runs):
                more = [pa.array(first + where), _gram_keys(rare_runs), pa.array(run_times, pa.int64())]
                yield pa.RecordBatch.from_arrays([*more, *(pa.nulls(len(rare_runs), k) for k in kinds[3:])], schema=schema)

    return run


def score_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """Score every document by models of those that are not held out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (unigrams of words), score (the suffix tree), both log10.

    Null text is empty, and has the one token that ends each text. Null ids
    are held out or not as an empty text is; repeated rows each get a row. A
    very long text is scored in memory of some times its size. With no
    training text both models are uniform; an empty table gives an empty
    result; other columns are not looked at. ``docs`` must give the same rows
    each time it is read, as files do.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    counts = checkpointed(rows.mapInArrow(_count_words(settings), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    digits = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    ends = rows.where(F.crc32(digits.cast("binary")) % settings.fold != 0).count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = words + ends, distinct + (ends > 0)
    below = total + 0.1 * (kinds + 1)
    frequent = counts.where(F.col("n") > settings.head_share * total).toArrow()
    logs = np.log10((np.asarray(frequent["n"]).astype(np.float64) + 0.1) / below).tolist()
    head = spark.sparkContext.broadcast(dict(zip(frequent["word"].to_pylist(), logs, strict=True)))
    table = gram_chances(rows, settings)
    least_seen = settings.run_share * (table.agg(F.sum("seen")).first()[0] or 0)
    runs = table.where(F.col("seen") > least_seen).select("gram", "chance").orderBy("gram").toArrow()
    runs = spark.sparkContext.broadcast((runs["gram"].to_numpy(), runs["chance"].to_numpy()))
    unit = {"end": ends, "end_score": float(np.log10((ends + 0.1) / below))}
    fields = (
        "uid long, word binary, n long, doc_id long, held_out boolean, n_tokens long, n_known long, "
        "base_score double, score double"
    )
    parts = rows.mapInArrow(_score(settings, runs, head, unit), fields)
    rare = counts.where(F.col("n") <= settings.head_share * total).select("word", F.col("n").alias("c"), F.lit(None).cast("double").alias("chance"))
    key = F.concat(F.lit(bytes([END])), F.unhex(F.lpad(F.hex("gram"), 16, "0")))
    rare_runs = table.where(F.col("seen") <= least_seen).select(key.alias("word"), F.lit(None).cast("long").alias("c"), "chance")
    c = F.coalesce("c", F.lit(0))
    known = F.coalesce("n_known", F.when(c > 0, F.col("n")).otherwise(0))
    base = F.coalesce("base_score", F.when(F.col("chance").isNotNull(), 0.0), F.col("n") * F.log10((c + 0.1) / F.lit(float(below))))
    return (
        parts.join(rare.unionByName(rare_runs), "word", "left")
        .groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(known).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            F.sum(base).alias("base_score"),
            (F.max("score") + F.coalesce(F.sum(F.col("n") * F.col("chance")), F.lit(0.0))).alias("score"),
        )
        .drop("uid")
    )

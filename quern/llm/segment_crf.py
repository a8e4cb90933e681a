"""Personal data: a semi-Markov conditional random field over whole spans.

Fixed patterns with checks find the plain cases. A model finds more: it scores
whole candidate segments (their digits, groups, separators, checksums, what
stands beside them) for each kind, and dynamic programming over segments of
bounded length chooses boundaries and kinds together. What is outside of
entities scores nothing, and an entity must hold digits or an at sign and only
characters that its kind can have, so the programme runs over the stretches
that can hold one; the rest of a text can't change its result.

The model is fitted at the driver, on a bounded sample of documents: what the
patterns find there, in the forms that they find and in some that they don't,
and spoiled copies as counterexamples. It is sent to the tasks as one array.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import id_and_text

KINDS = ("email", "ip", "card", "phone")
#: Words before an entity that tell of one.
CUES = frozenset("address call card contact credit email e-mail fax host ip mail mastercard mobile phone server tel telephone visa".split())
Span = tuple[int, int, int]  # start, end, place in KINDS


@dataclass(frozen=True)
class Settings:
    #: Documents with a digit or an at sign that the model is fitted on, those of the least hash.
    sample_docs: int = 1000
    #: The sample ends before its texts have more bytes than this, but has one text at least.
    sample_bytes: int = 64 << 20
    #: Longer texts are not in the sample.
    sample_text_bytes: int = 1 << 20
    #: Fitting takes no more stretches once they have so many candidate segments.
    sample_segments: int = 1 << 20
    #: The longest entity, in atoms, and for numbers in groups of digits and digits.
    longest: int = 24
    most_groups: int = 8
    most_digits: int = 20
    epochs: int = 12
    rate: float = 0.5
    #: Places in the weight array; features are hashed to them.
    features: int = 1 << 14
    #: What a segmentation must gain by an entity that the patterns don't find.
    margin: float = 2.0
    seed: int = 5


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that fails from a run's first digit fails from its others, so these begin at it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9+(][0-9\x20().+/-]*")
_ATOM = re.compile(r"[0-9]+|[A-Za-z_%]+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlap, looked for from each at sign, so that long runs without one cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by start and then kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append((*m.span(), 1))
        for m in _CARD.finditer(text):
            digits = only_digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(only_digits(m.group())) <= 15:
                    out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text that can hold entities, apart from each other."""
    found = []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if sum(map(m.group().count, "0123456789")) >= 4:
                found.append((m.start(), m.start() + len(m.group().rstrip(" (.+/-"))))
    at, last = text.find("@"), -1
    while at >= 0:
        if at >= last:
            start, end = at, at + 1
            while start > max(last, 0) and text[start - 1] in _LOCAL:
                start -= 1
            while end < len(text) and (text[end] in _LOCAL or text[end] == "@"):
                end += 1
            found.append((start, end))
            last = end
        at = text.find("@", at + 1)
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _beside(c: str) -> str:
    return "edge" if not c else "digit" if "0" <= c <= "9" else "letter" if c.isalpha() else "space" if c.isspace() else c


def segment_features(text: str, start: int, end: int, kind: int) -> list[str]:
    """What tells of a whole segment. Texts are looked at no further than a word before it."""
    span = text[start:end]
    digits = only_digits(span)
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    before = text[max(0, start - 24) : start].rstrip(" :=#(").rsplit(None, 1)
    out = [
        "bias",
        f"before {_beside(text[start - 1 : start])}",
        f"after {_beside(text[end : end + 1])}",
        f"cue {bool(before) and before[-1].lower() in CUES}",
    ]
    if kind == 0:
        local, _, domain = span.partition("@")
        parts = domain.split(".")
        out += [f"labels {min(4, len(parts))}", f"local {min(3, len(local) // 4)}", f"top {len(parts[-1]) >= 2 and parts[-1].isalpha()}"]
        out += [f"empty {'' in parts or not local}"]
        return out
    shape = re.sub(r"[0-9]+", "9", span)
    separators = "".join(sorted(set(re.sub(r"[0-9]", "", span))))
    quad = len(groups) == 4 and shape == "9.9.9.9" and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    out += [
        f"digits {min(21, len(digits))}",
        f"groups {min(8, len(groups))}",
        f"sizes {'-'.join(str(min(9, len(g))) for g in groups[-3:])}",
        f"separators {separators}",
        f"shape {shape}",
        f"plus {span[0] == '+'}",
        f"quad {quad}",
        f"luhn {12 <= len(digits) <= 19 and luhn(digits)}",
    ]
    return out


def candidates(text: str, start: int, end: int, s: Settings) -> tuple[int, list[Span], list[tuple[int, int, int]]]:
    """(atoms, spans, (first atom, atom after, kind) of each) of the segments in a stretch that can be entities."""
    atoms = [m.span() for m in _ATOM.finditer(text, start, end)]
    spans, places = [], []
    for i, (first, _) in enumerate(atoms):
        c = text[first]
        numeric, mail = "0" <= c <= "9" or c in "+(", c in _LOCAL
        if not (numeric or mail):
            continue
        ats = digits = groups = 0
        for j in range(i, min(len(atoms), i + s.longest)):
            a, b = atoms[j]
            c = text[a]
            is_digit = "0" <= c <= "9"
            digits += (b - a) * is_digit
            groups += is_digit
            ats += c == "@"
            numeric = numeric and (is_digit or c in " ().+/-") and digits <= s.most_digits and groups <= s.most_groups
            mail = mail and (c in _LOCAL or c == "@") and ats < 2
            if not (numeric or mail):
                break
            if numeric and is_digit and digits >= 4:
                for kind in (1, 2, 3):
                    spans.append((first, b, kind))
                    places.append((i, j + 1, kind))
            if mail and ats == 1 and c.isalnum():
                spans.append((first, b, 0))
                places.append((i, j + 1, 0))
    return len(atoms), spans, places


def hashed(text: str, spans: list[Span], size: int) -> list[list[int]]:
    """Places of the weights of each span's features. Kinds of numbers share features, each with weights of its own."""
    out, last, values = [], None, []
    for start, end, kind in spans:
        if last != (start, end, kind > 0):
            last = (start, end, kind > 0)
            values = [zlib.crc32(f.encode()) * len(KINDS) for f in segment_features(text, start, end, kind)]
        out.append([(v + kind) % size for v in values])
    return out


def best_segments(n: int, places: list[tuple[int, int, int]], scores: list[float]) -> list[int]:
    """The candidates of the best segmentation of n atoms. Of equal ones, fewer entities."""
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j, _) in enumerate(places):
        ending[j].append(k)
    best, chosen = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ending[j]:
            if (value := best[places[k][0]] + scores[k]) > best[j]:
                best[j], chosen[j] = value, k
    out, j = [], n
    while j:
        k = chosen[j]
        if k < 0:
            j -= 1
        else:
            out.append(k)
            j = places[k][0]
    return out[::-1]


def expected(n: int, places: list[tuple[int, int, int]], scores: np.ndarray) -> np.ndarray:
    """The probability of each candidate, over all segmentations."""
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j, _) in enumerate(places):
        ending[j].append(k)
        starting[i].append(k)
    forward, backward = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[places[k][0]] + scores[k] for k in ending[j])])
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[places[k][1]] + scores[k] for k in starting[i])])
    first = np.fromiter((p[0] for p in places), dtype=np.int64, count=len(places))
    after = np.fromiter((p[1] for p in places), dtype=np.int64, count=len(places))
    return np.exp(forward[first] + scores + backward[after] - forward[n])


def variants(text: str, span: Span, rng: Random) -> Iterator[tuple[str, int, int, list[Span]]]:
    """Other texts around an entity, with its place: forms that the patterns miss, and spoiled ones that are no entity."""
    start, end, kind = span
    left, own, right = text[max(0, start - 40) : start], text[start:end], text[end : end + 40]

    def put(new: str, is_one: bool) -> tuple[str, int, int, list[Span]]:
        end = len(left) + len(new)
        return left + new + right, len(left), end, [(len(left), end, kind)] if is_one else []

    digits = only_digits(own)
    if kind == 3:
        groups = re.findall(r"[0-9]+", own)
        yield put(own.lstrip("+"), True)
        if len(groups) > 3:
            for mark in ("-", ".", " "):
                yield put(mark.join(groups[1:]), True)
                yield put(mark.join(groups), True)
            yield put(f"({groups[1]}) {'-'.join(groups[2:])}", True)
        yield put(digits[:5], False)
    elif kind == 2:
        for mark in ".", "/":
            yield put(mark.join(digits[i : i + 4] for i in range(0, len(digits), 4)), True)
        yield put(digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10), False)
        yield put("".join(rng.choices("0123456789", k=rng.randint(4, 11))), False)
    elif kind == 1:
        yield put(own.replace(".", ".9", 1).replace(".9", ".999", 1), False)
        yield put(".".join(own.split(".")[:3]), False)
    else:
        local, _, domain = own.partition("@")
        yield put(f"{local}@{domain.split('.')[0]}", False)


def apart(spans: list[Span]) -> list[Span]:
    """Spans without overlap, longer ones first."""
    out: list[Span] = []
    starts: list[int] = []  # of the taken ones in order, and where each ends
    ends: list[int] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        at = bisect_right(ends, s[0])
        if at == len(starts) or s[1] <= starts[at]:
            starts.insert(at, s[0])
            ends.insert(at, s[1])
            out.append(s)
    return out


def clear_of(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of ``spans`` that overlap none of ``taken``, which are in the order of their starts and may overlap each other."""
    starts: list[int] = []  # of what the taken ones cover together
    ends: list[int] = []
    for start, end, _ in taken:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    out = []
    for s in spans:
        at = bisect_right(ends, s[0])
        if at == len(starts) or s[1] <= starts[at]:
            out.append(s)
    return out


def fit(texts: list[str], s: Settings) -> np.ndarray:
    """Weights that make the sample's spans likely, by gradient steps on the conditional log-likelihood."""
    rng, examples, segments = Random(s.seed), [], 0

    def add(text: str, first: int, last: int, gold: list[Span]) -> None:
        nonlocal segments
        want = set(gold)
        for start, end in stretches(text):
            if end <= first or last <= start or segments >= s.sample_segments:
                continue
            n, spans, places = candidates(text, start, end, s)
            if spans:
                segments += len(spans)
                matrix = hashed(text, spans, s.features)
                width = max(map(len, matrix))
                # The last weight stays 0 and fills short rows.
                rows = np.asarray([m + [s.features] * (width - len(m)) for m in matrix])
                examples.append((n, places, rows, np.asarray([span in want for span in spans], dtype=float)))

    for text in texts:
        gold = apart(base_spans(text))
        add(text, 0, len(text), gold)
        for span in gold:
            for other in variants(text, span, rng):
                add(*other)
    weights, squares = np.zeros(s.features + 1), np.ones(s.features + 1)
    for _ in range(s.epochs):
        rng.shuffle(examples)
        for n, places, rows, gold in examples:
            wrong = gold - expected(n, places, weights[rows].sum(axis=1))
            if np.abs(wrong).max() > 1e-3:
                step = np.zeros_like(weights)
                np.add.at(step, rows, np.broadcast_to(wrong[:, None], rows.shape))
                squares += step * step
                weights += s.rate * step / np.sqrt(squares)
                weights[-1] = 0
    return weights


def model_spans(text: str, weights: np.ndarray, s: Settings) -> list[Span]:
    """Entities of the best segmentation of each stretch."""
    out, weight = [], weights.item
    for start, end in stretches(text):
        n, spans, places = candidates(text, start, end, s)
        if spans:
            scores = [sum(map(weight, row)) - s.margin for row in hashed(text, spans, s.features)]
            out += [spans[k] for k in best_segments(n, places, scores)]
    return out


def find(text: str, weights: np.ndarray, s: Settings) -> tuple[list[Span], list[Span]]:
    """(what the patterns find, that and what the model adds beside it), by start and kind."""
    base = base_spans(text)
    more = clear_of(model_spans(text, weights, s), base)
    return base, sorted(base + more, key=lambda x: (x[0], x[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def sampled(docs: DataFrame, s: Settings) -> list[str]:
    """The distinct texts of least hash, of those of (doc_id, text) that have marks."""
    short = F.octet_length("text") <= s.sample_text_bytes
    marked = docs.where(F.col("text").rlike("[0-9@]") & short).select("text", F.xxhash64("text").alias("hash"))
    sizes = marked.groupBy("hash").agg(F.max(F.octet_length("text")).cast("long").alias("size")).orderBy("hash").limit(s.sample_docs).collect()
    if not sizes:
        return []
    within = np.count_nonzero(np.cumsum([r["size"] for r in sizes]) <= s.sample_bytes)
    last = sizes[max(1, within) - 1]["hash"]
    rows = marked.where(F.col("hash") <= last).distinct().orderBy("hash", "text").limit(s.sample_docs).collect()
    return [r.text for r in rows]


def fitted(docs: DataFrame, s: Settings) -> np.ndarray:
    """A model fitted on the bounded sample of (doc_id, text)."""
    return fit(sampled(docs, s), s)


def _found(weights, s: Settings) -> Callable:
    names = "doc_id n_email n_ip n_card n_phone n_added base_sha256 spans".split()
    schema = pa.schema([(n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in names])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base, every = find(text, weights.value, s)
                counts = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((doc_id, *counts, len(every) - len(base), digest, written(every)))
            if rows:
                columns = zip(zip(*rows, strict=True), schema, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=schema)

    return run


def find_personal_data(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans.

    The counts and the digest are of what the fixed patterns find; ``n_added``
    counts the model's spans, and ``spans`` has all, as kind:start:end in code
    points, end exclusive. The model's spans keep clear of the patterns'.

    Null and empty texts have no spans. Repeated rows and null ids each get a
    row. Texts are worked through whole, in time proportional to their length
    (spans are held against each other by bisection). Very long texts are not
    in the sample that the model is fitted on.
    An empty table gives an empty result, and a table without personal data a
    model that adds nothing; other columns are not looked at.
    """
    rows = id_and_text(docs, id_col, text_col)
    weights = docs.sparkSession.sparkContext.broadcast(fitted(rows, settings))
    fields = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    return rows.mapInArrow(_found(weights, settings), fields)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the name of its first kind."""
    out, last = [], 0
    for start, end, kind in spans:
        if start >= last:
            out += [text[last:start], f"<{KINDS[kind]}>"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redact(
    docs: DataFrame, *, text_col: str = "text", length_col: str | None = None, settings: Settings = Settings()
) -> DataFrame:
    """``docs`` with personal data replaced in the text, and its length in ``length_col`` put right.

    A null text stays null. Columns and other rows stay as they are; edge
    cases are as in :func:`find_personal_data`.
    """
    sample = docs.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    weights = docs.sparkSession.sparkContext.broadcast(fitted(sample, settings))
    place = docs.columns.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(place).to_pylist()
            new = [t and redacted(t, find(t, weights.value, settings)[1]) for t in texts]
            columns = list(batch.columns)
            columns[place] = pa.array(new, columns[place].type)
            if length_col is not None:
                at = batch.schema.names.index(length_col)
                old = columns[at].to_pylist()
                sizes = [o if n == t else len(n) for o, t, n in zip(old, texts, new, strict=True)]
                columns[at] = pa.array(sizes, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import suffix_tree as S
from quern.llm.common import WORD

SETTINGS = S.Settings(depth=3, least_share=0.002, least_gain=2.0, head_share=0.05)
SCHEMA = "text string, doc_id long, word string, score string"


def tokens(text):
    return re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))


def out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def symbols(text, depth):
    return b"\n" * depth + b"".join(w.encode() + b" " for w in tokens(text)) + b"\n"


class Plain:
    """Contexts in a dict, the longest suffix looked for by hand."""

    def __init__(self, texts, s):
        self.s, follow = s, defaultdict(Counter)
        for text in texts:
            x = symbols(text, s.depth)
            for i in range(s.depth, len(x)):
                for d in range(s.depth + 1):
                    follow[x[i - d : i]][x[i]] += 1
        total = sum(follow[b""].values())
        self.kept = {}
        for ctx in sorted(follow, key=len):
            own = follow[ctx]
            n = sum(own.values())
            if n < max(1.0, s.least_share * total) and ctx:
                continue
            before = self.longest(ctx[1:]) if ctx else None
            p = lambda b: before[b] if before else 1 / 256
            gain = sum(c * math.log(c / n / p(b)) for b, c in own.items())
            if not ctx or gain >= s.least_gain:
                self.kept[ctx] = {b: (own[b] + len(own) * p(b)) / (n + len(own)) for b in range(256)}
        self.kept.setdefault(b"", dict.fromkeys(range(256), 1 / 256))

    def longest(self, ctx):
        while ctx not in self.kept:
            ctx = ctx[1:]
        return self.kept[ctx]

    def score(self, text):
        x, d = symbols(text, self.s.depth), self.s.depth
        return sum(math.log10(self.longest(x[i - d : i])[x[i]]) for i in range(d, len(x)))


def corpus(n=60):
    rng = random.Random(5)
    bits = ["the", "re", "on", "An", "é", "st", "ing"]
    docs = [(" ".join("".join(rng.choices(bits, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 60))), i) for i in range(n)]
    return docs + [(None, 100), ("", 101), ("  \n", 102), ("zq 你 " * 700, None), docs[1], docs[1]]


def test_scores_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(t, i, "a", "b") for t, i in docs], SCHEMA)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r) for r in S.score_documents(df, settings=SETTINGS).collect())
    train = [t for t, i in docs if not out(i)]
    counts = Counter(w for t in train for w in tokens(t))
    ends = len(train)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    plain = Plain(train, SETTINGS)
    want = sorted(((i if i is not None else -1), t or "", out(i)) for t, i in docs)
    assert len(got) == len(want)
    for (i, text, held), (j, r) in zip(want, got, strict=True):
        words = tokens(text)
        base = sum(math.log10(((counts[w]) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        base += math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert (i, held, len(words) + 1, n) == (j, r.held_out, r.n_tokens, r.train_tokens)
        assert r.n_known == sum(counts[w] > 0 for w in words) + 1
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(plain.score(text))


def test_rows_and_batches_do_not_matter():
    texts = [t.encode() if t else b"" for t, _ in corpus()]
    words = S._lower_words(texts)
    gram, n = np.unique(S.grams(*S.stream(words, 3), 3), return_counts=True)
    rows = Counter()
    for g, c in zip(gram.tolist(), n.tolist(), strict=True):
        for d in range(4):
            rows[d, (g >> 8) & ((1 << 8 * d) - 1), g & 255] += c
    table = pa.table(dict(zip(("depth", "context", "symbol", "n"), map(list, zip(*((*k, c) for k, c in rows.items()), strict=True)), strict=True)))
    tree = S.Tree(table, SETTINGS)
    whole = tree.scores(words)
    assert np.allclose(whole, tree.scores(words, row=7))
    assert np.allclose(whole, np.concatenate([tree.scores([w]) for w in words]))
    assert tree.retained > 5


def test_distributions_sum_to_one():
    table = pa.table({"depth": [0, 0, 1], "context": [0, 0, 97], "symbol": [97, 98, 98], "n": [50, 50, 50]})
    tree = S.Tree(table, S.Settings(depth=2, least_gain=1.0))
    p = 10 ** tree.score.reshape(-1, tree.width)
    assert np.allclose((p * np.bincount(tree.classes, minlength=tree.width)).sum(axis=1), 1)


def test_no_training_text_and_empty_table(spark):
    held = [(f"word {i}", i, "", "") for i in range(300) if out(i)]
    rows = S.score_documents(spark.createDataFrame(held, SCHEMA)).collect()
    assert len(rows) == len(held) and {r.n_known for r in rows} == {0} and {r.train_tokens for r in rows} == {0}
    assert all(r.score == pytest.approx(-(len(f"word {r.doc_id} ") + 1) * math.log10(256)) for r in rows)
    assert S.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_contexts_are_retained_whatever_the_rest_of_the_corpus(spark):
    """Five texts tell each next symbol of theirs, though they are less than 1e-5 of all symbols."""
    rng = random.Random(3)
    other = ["".join(rng.choices("bcdfgh", k=6)) for _ in range(4000)]
    train = [i for i in range(500) if not out(i)]
    docs = [("qzxwv", i) for i in train[:5]] + [(" ".join(rng.choices(other, k=250)), i) for i in train[5:405]]
    df = spark.createDataFrame([(t, i, "", "") for t, i in docs], SCHEMA)
    # Contexts tell the letters after the first; as a share of all symbols they would not be kept, and each letter costs 5.
    for settings, known in ((S.Settings(), True), (S.Settings(depth=5, least_share=1e-5), False)):
        got = {r.doc_id: r.score for r in S.score_documents(df, settings=settings).collect()}
        assert all((got[i] > -10) == known for i in train[:5])


def test_shared_and_joined_runs_score_alike(spark):
    docs = spark.createDataFrame([(t, i, "", "") for t, i in corpus()], SCHEMA)
    found = []
    for share in (0.0, 1e-3, 1.0):
        rows = S.score_documents(docs, settings=S.Settings(run_share=share)).collect()
        found.append(sorted((r.doc_id or -1, r.n_known, r.base_score, r.score) for r in rows))
    for other in found[1:]:
        assert all(a == pytest.approx(b) for a, b in zip(found[0], other, strict=True))

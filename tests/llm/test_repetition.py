import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import repetition as R
from quern.llm.common import WORD


def plain_suffixes(x):
    order = sorted(range(len(x)), key=lambda i: x[i:])
    common = [0] * len(x)
    for p in range(1, len(x)):
        a, b = x[order[p - 1] :], x[order[p] :]
        while common[p] < min(len(a), len(b)) and a[common[p]] == b[common[p]]:
            common[p] += 1
    return order, common


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=200)
def test_suffix_array(x):
    order, common = R.suffix_array(np.asarray(x, dtype=np.int64))
    assert (order.tolist(), common.tolist()) == plain_suffixes(x)


def plain(text, limits):
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n, spans, longest = len(words), set(), 0
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= limits.least_repeat:
                spans |= set(range(i, i + k))
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    again = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    failed = n < limits.least_words or 100 * len(again) > limits.most_window_percent * n
    bad = 100 * len(spans) > limits.most_covered_percent * n or longest > limits.longest_repeat
    return (
        n,
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(again),
        len(spans),
        longest,
        failed,
        not failed and not bad,
    )


LIMITS = R.Limits(least_words=5, least_repeat=4, longest_repeat=9)


@given(st.lists(st.text(st.sampled_from("ab é\n\t\x85#|\xa0"), max_size=80), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_measures(texts):
    got = R.measure([t.encode() for t in texts], LIMITS)
    assert [tuple(x) for x in zip(*(np.asarray(c).tolist() for c in got), strict=True)] == [plain(t, LIMITS) for t in texts]


def test_edge_rows(spark):
    rows = [(None, 1, "x"), ("", 2, "x"), ("a b c " * 30, None, "x"), ("w " * 4000, 4, "x"), ("z y", 4, "x"), ("z y", 4, "x")]
    rows.append((" ".join(f"w{i}" for i in range(300)), 7, "x"))
    df = spark.createDataFrame(rows, "text string, doc_id long, kept string")
    out = R.repetition_report(df)
    assert out.count() == len(rows)
    assert [r.doc_id for r in out.where("kept").collect()] == [7]
    kept = R.keep_unrepetitive(df)
    assert kept.columns == df.columns
    assert [r.doc_id for r in kept.collect()] == [7]
    assert R.repetition_report(df.limit(0)).count() == R.keep_unrepetitive(df.limit(0)).count() == 0


def test_maximal_repeats():
    words = "q a b c d r a b c d s".split()
    assert R.maximal_repeats(words, 3) == [(1, 4), (6, 4)]

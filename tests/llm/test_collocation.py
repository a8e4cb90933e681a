import random
import re
from collections import Counter

import duckdb
import pytest

from quern.llm import collocation, entries, oracles

SCHEMA = "doc_id long, text string, lang string, phrase string, rank int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least=100, most=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for i in range(len(words)) for k in range(1, min(most, len(words) - i) + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = set()
    for (lang, *w), a in held.items():
        inner = {(lang, *w[i : i + k]) for k in range(2, len(w)) for i in range(len(w) - k + 1)}
        covered |= {p for p in inner if a >= f[p]}
    rows = {}
    for (lang, *w), a in held.items():
        if (lang, *w) not in covered:
            cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, lft, r, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, lft, r) in enumerate(sorted(own)[:top]))


def found(spark, docs, **options):
    df = spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(docs)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collocation.collocations(df, **options).collect())


@pytest.fixture
def corpus():
    rng = random.Random(9)
    words = ["the", "Old", "red", "house", "naïve", "ÉTÉ", "x-y", "a b", "of", "stone"]
    docs = []
    for lang in ("en", "de", None, "und"):
        for _ in range(60):
            text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
            docs.append((text + rng.choice(["", " red house of stone by the sea", "!New York City; new york city"]), lang))
    docs += [("a a a a a a a a", "en")] * 12 + [(None, "en"), ("", None), (" \t. ", "fr"), (None, None), ("alone", "it")]
    return docs


@pytest.mark.parametrize("options", [{}, {"least": 7}, {"least": 12, "top": 5}, {"least": 3, "most_words": 3}, {"least": 10**6}])
def test_against_plain_version(spark, corpus, options):
    assert found(spark, corpus, **options) == plain(corpus, **{{"most_words": "most"}.get(k, k): v for k, v in options.items()})


def test_small_shards_and_cut_runs_count_the_same(spark, corpus, monkeypatch):
    """Many automata, runs cut into parts, and counts handed on before a task's end."""
    rows = [({"en": "en"}.get(lang, "und"), (t or "").encode()) for t, lang in corpus] + [("en", b"one and the same run of words " * 300)]
    batch = collocation.pa.RecordBatch.from_arrays([[r[0] for r in rows], [r[1] for r in rows]], ["lang", "text"])
    every = type("Bits", (), {"value": b"\xff" * (1 << (collocation.BITS - 3))})

    def counts():
        out = Counter()
        for made in collocation._count_phrases([every] * 5, 5)(iter([batch])):
            for lang, phrase, n in zip(*(c.to_pylist() for c in made.columns), strict=True):
                out[lang, phrase] += n
        return +out

    def words():
        out = Counter()
        for made in collocation._count_words(iter([batch])):
            out.update({(lang, w): n for lang, w, n in zip(*(c.to_pylist() for c in made.columns), strict=True)})
        return out

    whole, singles = counts(), words()
    for name, value in (("MOST_TOKENS", 50), ("LONGEST_RUN", 13), ("SLICE_BYTES", 500)):
        monkeypatch.setattr(collocation, name, value)
    assert counts() == whole and len(whole) > 1000 and words() == singles


@pytest.mark.parametrize("seed", range(6))
def test_stretches_hold_each_passing_run_once(seed):
    """Bitmaps that let some runs through: weights of the stretches around a run add up to 1, and to 0 around what doesn't pass."""
    rng = random.Random(seed)
    text = " ".join(rng.choice("abcd") + rng.choice(["", "", "", "."]) for _ in range(400)).encode()
    shard = collocation.Shard([text], "en")
    share, filters = rng.choice([0.5, 0.8, 0.95]), []
    for _ in range(4):
        bits = collocation.np.frombuffer(rng.randbytes(1 << 10), collocation.np.uint8) if share == 0.5 else None
        if bits is None:
            bits = collocation.np.packbits(collocation.np.random.default_rng(seed).random(1 << 13) < share)
        filters.append(collocation.np.tile(bits, 1 << (collocation.BITS - 13)))
    held = Counter()
    for first, last, weight in collocation.segments(shard, filters):
        for k in range(2, 5):
            for i in range(first, last - k + 1):
                held[i, k] += weight
    want = {(i, k + 1) for k, (_, passed) in enumerate(collocation.runs(shard, filters)[:4]) if k for i in passed.nonzero()[0].tolist()}
    assert {p for p, w in held.items() if w} == want and set(held.values()) <= {0, 1} and want


def test_automaton_counts_every_substring():
    rng = random.Random(3)
    for _ in range(60):
        held = Counter(tuple(rng.choices(range(3), k=rng.randint(1, 12))) for _ in range(8))
        automaton, want = collocation.Automaton(), Counter()
        for words, weight in held.items():
            automaton.add(words, weight)
            for i in range(len(words)):
                want.update({words[i:j]: 0 for j in range(i + 2, min(len(words), i + 5) + 1)})
                for j in range(i + 2, min(len(words), i + 5) + 1):
                    want[words[i:j]] += weight
        automaton.settle()
        assert dict(automaton.substrings(2, 5)) == dict(want) and len(automaton.link) <= 2 * sum(map(len, held)) + 1


def test_levels_let_all_frequent_runs_through():
    shard = collocation.Shard([b"New York, new york", b"", b"\n a", b"new\tYORK city x"], "en")
    assert [shard.word(i) for i in range(len(shard.starts))] == b"new york new york a new york city x".split()
    assert shard.joined.tolist() == [True, False, True, False, False, True, True, True, False]
    assert len(set(shard.hashes.tolist())) == 5 and shard.hashes[0] == shard.hashes[2] == shard.hashes[5]
    assert collocation.Shard([b"new"], "en").hashes[0] == shard.hashes[0] != collocation.Shard([b"new"], "de").hashes[0]
    pairs, passed = collocation.runs(shard, [collocation.np.full(1 << (collocation.BITS - 3), 255, collocation.np.uint8)])[1]
    assert passed.tolist() == shard.joined.tolist() and pairs[0] == pairs[2] == pairs[5] != pairs[6]
    assert len(collocation.Shard([], "en").starts) == len(collocation.Shard([b" ., "], "en").starts) == 0


def test_long_texts_come_in_parts_that_end_with_pieces(monkeypatch):
    monkeypatch.setattr(collocation, "SLICE_BYTES", 40)
    rng = random.Random(2)
    text = "".join(rng.choice(["one two ", "three", ". ", "\n", " four five six"]) for _ in range(200)).encode()
    parts = list(collocation._parts(text))
    assert b"".join(parts) == text and len(parts) > 10 and all(p[-1:] in (b".", b"\n") for p in parts[:-1])
    assert list(collocation._parts(b"x" * 100)) == [b"x" * 100] and list(collocation._parts(b"")) == [b""]
    shards = list(collocation._shards(iter([collocation.pa.RecordBatch.from_arrays([["en", "en", "de"], [b"short", text, b"kurz"]], ["lang", "text"])])))
    assert sorted(x for _, own in shards for x in own) == sorted([b"short", b"kurz", *parts])


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = sorted(con.execute(oracles.SQL["op12_collocation"]).fetchall())
    assert sorted(tuple(r) for r in entries.op12_collocation(spark, f"/root/testdata/{sf}").collect()) == want and want

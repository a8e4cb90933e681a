import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "text string, doc_id long, start string, offset int"


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def plain_first_fit(sizes, capacity):
    room, bins, offsets = [], {}, {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - room[b]
        room[b] -= sizes[i]
    return [bins[i] for i in range(len(sizes))], [offsets[i] for i in range(len(sizes))]


@given(st.lists(st.integers(1, 50), max_size=80))
def test_tournament_tree_finds_the_first_bin(sizes):
    assert packing.first_fit_decreasing(sizes, 50) == plain_first_fit(sizes, 50)


MIXED = st.lists(st.text(st.sampled_from("aZ é É\u0301İß.,'s t1٣ #\u0308ǰJ\u030c\n\u00a0"), max_size=30), min_size=1, max_size=5)


@given(MIXED)
@settings(max_examples=300, deadline=None)
def test_words_give_the_texts_ids(texts):
    got = list(packing.word_ids(PATH).encode([t.encode() for t in texts]))
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [plain_ids(t)[:-1] for t in texts]


TEXTS = ["it's   a TEST,\n\tof 12 things here ́x", "", None, "don't stop " * 900, "Ünïcodé ẞ İ \x1c\x0b\x85 <|endoftext|> ok", "a" * 5000]


def held(rows, docs, length):
    """Every id lies in one piece, and sequences are gapless."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    starts = {}
    for r in rows:
        starts.setdefault(r.doc_id, []).append(r)
    for doc_id, text in docs:
        ids = plain_ids(text)
        at = 0
        for r in sorted(starts[doc_id], key=lambda r: r.start):
            part = np.asarray(ids[at : at + r.length], dtype="<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)


def test_pieces_hold_every_id(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame([(t, i, "x", 1) for i, t in docs], SCHEMA)
    out = packing.pack_documents(df, PATH, sequence_length=64, group_docs=5)
    held(out.collect(), docs, 64)
    seqs = packing.sequences(packing.pack_documents(df, PATH, sequence_length=64, group_docs=5, with_ids=True))
    total = seqs.select(F.sum("n_tokens"), F.sum(F.length("ids") / 4)).first()
    assert total[0] == total[1] == sum(len(plain_ids(t)) for _, t in docs)


def test_little_padding(spark):
    docs = [(i, "word " * (1 + i * 37 % 400)) for i in range(600)]
    df = spark.createDataFrame([(t, i, "x", 1) for i, t in docs], SCHEMA)
    rows = packing.pack_documents(df, PATH).collect()
    assert sum(r.length for r in rows) > 0.9 * 4096 * len({r.sequence_id for r in rows})


def test_repeated_and_null_ids_spread(spark):
    df = spark.createDataFrame([("same text", None, "x", 1)] * 500, SCHEMA).repartition(1)
    out = packing.pack_documents(df, PATH, group_docs=50)
    assert out.count() == 500


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.llm import longest_match as L


def plain(word, pieces):
    """Greedy longest match, piece by piece; None if it gets stuck."""
    text, at, count = L.START + word, 0, 0
    while at < len(text):
        own = {p for p in pieces if p.startswith(L.START)} if at == 0 else {p for p in pieces if not p.startswith(L.START)}
        end = next((e for e in range(len(text), at, -1) if text[at:e] in own), None)
        if end is None:
            return 0
        at, count = end, count + 1
    return count


VOCABULARY = st.sets(st.tuples(st.sampled_from(["", L.START]), st.text("abc", max_size=4)).map("".join), max_size=14)


@given(VOCABULARY, st.text("abcd", max_size=12))
def test_counts_equal_greedy_matching(pieces, word):
    pieces = {p for p in pieces if p}
    assert L.Automaton(pieces).count(word) == plain(word, pieces)


def test_real_vocabulary(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    pieces = set(L.pieces_of(path))
    texts = ["The quick brown foxes jump over intercontinental ballistic", "Straße über 你好 \U0001f600 ok", "", None, "x" * 3000, "a\x85b \t\n c", "The quick brown foxes jump over intercontinental ballistic"]
    df = spark.createDataFrame([(t, i if i else None, 5) for i, t in enumerate(texts)], "text string, doc_id long, n_words int")
    got = sorted(map(tuple, L.count_pieces(df, path).collect()), key=lambda r: -1 if r[0] is None else r[0])
    for (doc_id, n_words, n_pieces, n_unknown), (i, text) in zip(got, enumerate(texts), strict=True):
        counts = [plain(w.decode(), pieces) for w in (text or "").encode().split()]
        assert (doc_id, n_words) == (i or None, len(counts))
        assert (n_pieces, n_unknown) == (sum(counts) + counts.count(0), counts.count(0))
    assert L.count_pieces(df.limit(0), path).count() == 0

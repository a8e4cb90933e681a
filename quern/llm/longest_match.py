"""Token counts: a linear longest-match automaton.

Greedy longest-match pieces of a word are counted without building them. A
trie holds the vocabulary, pieces that start words and pieces inside words
under two roots. Where a word can't go on in the trie, the failure link leads
to the node that stands for what is left after the pieces popped on the way,
whose number is stored with the link. So each character is read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import batches, id_and_text

#: What a piece that starts a word begins with.
START = "▁"


class Automaton:
    """Counts of greedy longest-match pieces; 0 for a word that pieces can't make up."""

    def __init__(self, pieces: Iterable[str]):
        self.first, self.inner = 0, 1
        self.next: list[dict[str, int]] = [{}, {}]
        is_piece = [False, False]
        for piece in pieces:
            node = self.first if piece.startswith(START) else self.inner
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    is_piece.append(False)
                node = self.next[node][c]
            if piece:
                is_piece[node] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        level = [(self.first, c, n) for c, n in self.next[self.first].items()]
        level += [(self.inner, c, n) for c, n in self.next[self.inner].items()]
        while level:
            for above, c, node in level:
                if is_piece[node]:
                    self.fail[node], self.popped[node] = self.inner, 1
                    continue
                back, count = self.fail[above], self.popped[above]
                while back >= 0 and c not in self.next[back]:
                    count += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[node], self.popped[node] = self.next[back][c], count
            level = [(node, c, n) for _, _, node in level for c, n in self.next[node].items()]

    def count(self, word: str) -> int:
        node, pieces = self.first, 0
        step, fail, popped = self.next, self.fail, self.popped
        for c in START + word:
            while (to := step[node].get(c)) is None:
                pieces += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = to
        while node != self.inner:
            pieces += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return pieces


class Counts(dict):
    """Counts of words, found when first asked for; a bounded table."""

    def __init__(self, automaton: Automaton, keep: int = 300_000):
        super().__init__()
        self.automaton, self.keep = automaton, keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        value = self[word] = self.automaton.count(word.decode())
        return value


def pieces_of(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


_COUNTS: dict[str, Counts] = {}


def _counted(path: str) -> Callable:
    names = "doc_id n_words n_pieces n_unknown".split()
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTS:
            _COUNTS[path] = Counts(Automaton(pieces_of(path)))
        get = _COUNTS[path].__getitem__
        for ids, texts in batches(source):
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                found = list(map(get, text.split()))
                unknown = found.count(0)
                rows.append((doc_id, len(found), sum(found) + unknown, unknown))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def count_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_pieces, n_unknown.

    A word that the vocabulary can't make up is one unknown piece. Nothing is
    shuffled.

    Null and empty texts have no words. Repeated rows and null ids each get a
    row. A very long word takes time in proportion to its length. An empty
    table gives an empty result; other columns are not looked at.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(
        _counted(model_path), "doc_id long, n_words long, n_pieces long, n_unknown long"
    )

"""Token counts by a linear longest-match automaton: greedy word-piece lengths without building pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "▁"
#: Words whose counts a task remembers.
MOST_WORDS = 200_000


def pieces_of(path: str) -> list[str]:
    """Pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))]


class Automaton:
    """A trie of the pieces; each node has a failure link and the number of tokens popped on following it.

    A node's text is split greedily: popping removes its longest pieces from the left until the rest is again a path
    from the root. A character that is no piece counts as its UTF-8 bytes, so every failure link leads somewhere.
    """

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        pieces = set(pieces) - {""}
        for text in sorted(pieces | {c for x in pieces for c in x}):
            node = 0
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                node = self.next[node][c]
            ends[node] = 1 if text in pieces else len(text.encode())
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if v in ends:
                        self.popped[v] = ends[v]
                        continue
                    n, z = self.popped[u], self.fail[u]
                    while c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    self.fail[v], self.popped[v] = self.next[z][c], n
            level = below

    def count(self, word: str) -> int:
        """Tokens of one word (with its start sign, if the pieces have one). Each character moves on or pops: linear."""
        n = node = 0
        for c in word:
            while c not in self.next[node]:
                if not node:
                    n += len(c.encode())
                    break
                n += self.popped[node]
                node = self.fail[node]
            else:
                node = self.next[node][c]
        while node:
            n += self.popped[node]
            node = self.fail[node]
        return n


class Counts(dict):
    """Word -> tokens, filled by the automaton; forgets everything when full."""

    def __init__(self, pieces: Iterable[str], start: str):
        self.automaton, self.start = Automaton(pieces), start

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        n = self.automaton.count(self.start + word)
        if len(word) < 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", start: str = START) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row. Words are separated by any Unicode white space, as in ``str.split``, not
    by ASCII blanks alone as in the other operators; each starts with ``start``.

    Null and empty texts have 0 of both. Rows are independent: no shuffle; the automaton is built once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(pieces_of(model), start)
        for batch in batches:
            words = [len(x := (t.as_py() or "").split()) and (len(x), sum(map(counts.__getitem__, x))) or (0, 0) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[k] for x in words], pa.int64()) for k in (0, 1))], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")

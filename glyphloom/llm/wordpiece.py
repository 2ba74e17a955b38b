"""Token counts by greedy longest match, with an automaton that never builds the pieces.

A trie over the vocabulary has failure links, each with the number of pieces that
following it completes; a word is read once from left to right, and its length in
pieces is the sum of these numbers. A word with a character that no piece covers is
one unknown token.

Null and empty texts have no words and no tokens. Rows are counted one by one; other
columns pass through :func:`count`, and a column named like its result is replaced.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import LONGEST, MARK, REMEMBERED, default_model

#: In a word's number, what one unknown word adds.
UNKNOWN = 1 << 40


class Automaton(dict):
    """As a dict: UTF-8 word -> tokens, plus UNKNOWN if the word is unknown."""

    def __init__(self, first: set[str], later: set[str]):
        """first: pieces at the start of a word; later: those inside it."""
        super().__init__()
        self.next: list[dict[str, int]] = [{}, {}]  # 0: start of a word, 1: start of a later piece
        ends = {0: False, 1: False}
        for root, vocabulary in ((0, first), (1, later)):
            for piece in vocabulary:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                    at = self.next[at][c]
                ends[at] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if ends.get(node):
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                z, n = self.fail[parent], self.popped[parent]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.next[z][c], n

    def tokens(self, word: str) -> int:
        at, n = 0, 0
        for c in word:
            while c not in self.next[at]:
                if self.fail[at] < 0:
                    return 1 + UNKNOWN
                n += self.popped[at]
                at = self.fail[at]
            at = self.next[at][c]
        while at != 1:
            if self.fail[at] < 0:
                return 1 + UNKNOWN
            n += self.popped[at]
            at = self.fail[at]
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.tokens(MARK + word.decode())
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


@functools.lru_cache(2)
def automaton(path: str) -> Automaton:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    return Automaton({p for p in pieces if p.startswith(MARK)}, {p for p in pieces if not p.startswith(MARK)})


def count(docs: DataFrame, text: str = "text", model: str | None = None, result: str = "tokens") -> DataFrame:
    """Adds a struct: n_words, n_tokens and n_unknown (words that are one unknown token each)."""
    path = model or default_model()

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton(path)
        for texts in batches:
            rows = []
            for t in texts:
                words = (t or "").encode().split()
                n = sum(map(a.__getitem__, words))
                rows.append((len(words), n % UNKNOWN, n // UNKNOWN))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])

    return docs.withColumn(result, run(F.col(text)))

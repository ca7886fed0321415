"""Token counts by greedy longest match, in one pass over the bytes and without building pieces.

The vocabulary is a trie. Every node also has a failure link: where matching stops at a node, the greedy algorithm would
take a fixed run of pieces off the front of what has been matched, and what is left is a shorter path of the trie. The
link leads to that path, and the number of pieces it takes off is worked out beforehand, so a byte costs one step plus
links whose total is at most the number of bytes (LinMaxMatch, Song et al. 2021).
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from quern.llm.common import worker_table

#: Words whose counts a worker keeps; the table is emptied when full.
KEPT_WORDS = 300_000
_NOWHERE = -1


class LongestMatch:
    """Counts the pieces of greedy longest match over ``vocabulary``, in which single bytes count even if they are not listed."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.step: list[dict[int, int]] = [{}]
        self.popped, self.link = [0], [_NOWHERE]
        ends = {self._add(piece) for piece in vocabulary if piece} | {self._add(bytes([b])) for b in range(256)}
        level = [(0, child) for child in self.step[0].values()]
        byte_into = {child: byte for steps in self.step for byte, child in steps.items()}
        while level:
            below = []
            for parent, node in level:
                self._connect(parent, node, byte_into[node], node in ends)
                below += [(node, child) for child in self.step[node].values()]
            level = below

    def _add(self, piece: bytes) -> int:
        node = 0
        for byte in piece:
            nearest = self.step[node]
            if byte not in nearest:
                nearest[byte] = len(self.step)
                self.step.append({})
                self.popped.append(0)
                self.link.append(_NOWHERE)
            node = nearest[byte]
        return node

    def _connect(self, parent: int, node: int, byte: int, is_piece: bool) -> None:
        if is_piece:
            self.popped[node], self.link[node] = 1, 0
            return
        taken, at = self.popped[parent], self.link[parent]
        while at != _NOWHERE and byte not in self.step[at]:
            taken += self.popped[at]
            at = self.link[at]
        if at != _NOWHERE:
            self.popped[node], self.link[node] = taken, self.step[at][byte]

    def count(self, word: bytes) -> int:
        step, popped, link = self.step, self.popped, self.link
        pieces = node = 0
        for byte in word:
            while (after := step[node].get(byte)) is None:
                pieces += popped[node]
                node = link[node]
            node = after
        while node:
            pieces += popped[node]
            node = link[node]
        return pieces


@functools.cache
def automaton(rank_file: str) -> LongestMatch:
    """One per Python worker, over the tokens of a rank file."""
    with open(rank_file, "rb") as lines:
        return LongestMatch(base64.b64decode(line.split()[0]) for line in lines)


class _Counts(dict):
    """Pieces of each word with the space before it."""

    def __init__(self, rank_file: str):
        self.automaton = automaton(rank_file)

    def __missing__(self, word: bytes) -> int:
        pieces = self.automaton.count(b" " + word)
        if len(word) <= 100:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = pieces
        return pieces


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rank_file: str) -> DataFrame:
    """``id_col``, ``n_words``, ``n_tokens`` of every row, over its whole text.

    Words are what stands between ASCII white space. Each is matched in UTF-8 with one space before it, longest piece
    first, over the tokens of ``rank_file`` and all single bytes; ``n_tokens`` is the number of pieces of all words.
    Null and empty texts have no words. Repeated rows are counted each for itself; other columns are ignored. An empty table
    gives no rows.
    """

    @pandas_udf("n_words long, n_tokens long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept = worker_table(("counts", rank_file), lambda: _Counts(rank_file))
        for texts in batches:
            rows = []
            for text in texts:
                words = (text or "").encode().split()
                rows.append((len(words), sum(map(kept.__getitem__, words))))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens"], dtype="int64")

    return docs.select(id_col, counts(text_col).alias("c")).select(id_col, F.col("c.*"))

"""Text quality by supervised subword embeddings (Joulin et al. 2016): hashed vectors of words, pairs of words and
character n-grams are averaged over a document and go through a softmax, all learned by stochastic gradient descent in numpy.

The hash of a pair is the exclusive or of its words' hashes, so all words that follow themselves share one vector, from
which the model can learn what repetition says. Buckets that no training text reached have no vector. The model is
linear in the averaged vectors, so for scoring each bucket shrinks to one number: what its vector adds to the difference
of the two logits. A document's score is then the mean over its features.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from quern.llm.common import KEPT_BYTES, worker_table
from quern.llm.samples import labelled_sample, remainder

BITS = 18
BUCKETS = 1 << BITS
#: Fixed-point steps of a gain, so that sums do not depend on their order.
STEPS = 1 << 24
#: Characters of text that are scored together.
TOGETHER = 500_000
#: Tokens whose features are worked out at once.
LEARNED = 20_000


def word_hashes(parts: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(p.encode()) for p in parts], np.uint32)


def spread(x: np.ndarray) -> np.ndarray:
    """Buckets of 32-bit hashes."""
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return (x >> np.uint32(32 - BITS)).astype(np.int64)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Of each word with the next one, in either order."""
    return spread((hashes[1:] ^ hashes[:-1]) * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F))


def features(parts: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature that a token has by itself, and which token it belongs to.

    These are the token and its runs of 3 and of 4 characters, a space standing at either end.
    """
    x = np.frombuffer(f" {' '.join(parts)} ".encode("utf-32-le", "surrogatepass"), "<u4")
    space = x == 32
    owner = np.cumsum(space) - 1
    three = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    four = three[:-1] * np.uint32(0x27D4EB2F) + x[3:] * np.uint32(0x165667B1)
    inner = ~space
    keep_three, keep_four = inner[1:-1], inner[1:-2] & inner[2:-1]
    ids = np.concatenate([spread(hashes), spread(three[keep_three]), spread(four[keep_four])])
    owners = np.concatenate([np.arange(len(parts)), owner[:-2][keep_three], owner[:-3][keep_four]])
    return ids, owners


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their shares among its features."""
    parts = text.split()
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    hashes = word_hashes(parts)
    ids = np.concatenate([features(parts, hashes)[0], pair_buckets(hashes)])
    distinct, counts = np.unique(ids, return_counts=True)
    return distinct.astype(np.int32), (counts / len(ids)).astype(np.float32)


@dataclass(eq=False)
class Model:
    gain: np.ndarray  # float32: what each bucket adds to the logit of label 1 over that of label 0
    bias: float
    two_classes: bool = True  # false where all texts get one score, for want of labels of both classes

    @property
    def key(self) -> tuple:
        return "quality", self.bias, zlib.crc32(self.gain.tobytes())

    def score_all(self, texts: list[str]) -> list[float]:
        return worker_table(self.key, lambda: _Scorer(self))(texts)

    def scorer(self) -> Callable[[str], float]:
        return lambda text: self.score_all([text])[0]


class _Scorer:
    """Scores of texts. For each token it keeps the sum of its own features' gains, their number and its hash, in arrays
    that a text's tokens pick from; only pairs are looked up anew."""

    def __init__(self, model: Model):
        self.bias = model.bias
        self.gain = np.rint(model.gain.astype(np.float64) * STEPS)
        self._start()

    def _start(self) -> None:
        self.place: dict[str, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.room = KEPT_BYTES // 2

    def _learn(self, new: list[str]) -> None:
        hashes = word_hashes(new)
        ids, owners = features(new, hashes)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.sums = np.concatenate([self.sums, np.bincount(owners, self.gain[ids], len(new))])
        self.counts = np.concatenate([self.counts, np.bincount(owners, minlength=len(new))])
        self.hashes = np.concatenate([self.hashes, hashes])
        self.room -= sum(map(sys.getsizeof, new)) + 150 * len(new)

    def __call__(self, texts: list[str]) -> list[float]:
        """``texts`` have about ``TOGETHER`` characters in all, or are one text."""
        split = [t.split() for t in texts]
        distinct = set().union(*split)
        new = distinct - self.place.keys()
        if self.room < 0:
            self._start()
            new = distinct
        new = list(new)
        for at in range(0, len(new), LEARNED):
            self._learn(new[at : at + LEARNED])
        sizes = np.array([len(parts) for parts in split])
        at = np.fromiter((self.place[p] for parts in split for p in parts), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        total = np.bincount(owner, self.sums[at], len(texts))
        number = np.bincount(owner, self.counts[at], len(texts))
        within = owner[1:] == owner[:-1]
        total += np.bincount(owner[1:][within], self.gain[pair_buckets(self.hashes[at])[within]], len(texts))
        number += np.bincount(owner[1:][within], minlength=len(texts))
        z = self.bias + total / STEPS / np.maximum(number, 1)
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def together(texts: pd.Series) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``TOGETHER`` characters; null counts as empty."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(texts: list[str], labels: list[int], *, dim: int = 8, epochs: int = 5, rate: float = 1.0, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, with a rate that falls to zero and classes weighted alike.

    Without texts, or with one class only, every text gets that class's share (0.5 without texts).
    """
    y = np.asarray(labels, dtype=np.int64)
    positive = y.mean() if len(y) else 0.5
    if positive in (0.0, 1.0) or not len(y):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((positive + 1e-3) / (1 - positive + 1e-3))), two_classes=False)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    bags = [bag(text) for text in texts]
    weight = np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive))
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in random.permutation(len(y)):
            now = np.float32(rate * (1 - done / steps) * min(weight[i], 4.0))
            done += 1
            ids, share = bags[i]
            hidden = share @ vectors[ids]
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ output
            output -= now * np.outer(p, hidden)
            bias -= now * np.float32(0.1) * p
            vectors[ids] -= (now * share * len(share) ** 0.5)[:, None] * back
    reached = np.zeros(BUCKETS, bool)
    for ids, _ in bags:
        reached[ids] = True
    gain = np.where(reached, vectors @ (output[1] - output[0]), 0)
    return Model(gain.astype(np.float32), float(bias[1] - bias[0]))


def fit_on_labels(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 4_000, max_chars: int = 16_000_000) -> Model:
    """Fit on at most ``max_docs`` labelled documents (and ``max_chars`` characters) whose crc32(id) mod 4 is not 2."""
    sample = labelled_sample(docs, labels, "quality", id_col=id_col, text_col=text_col, modulus=4, held_out=2, max_docs=max_docs, max_chars=max_chars)
    return fit(sample["text"].tolist(), sample["label"].tolist())


def scores(model: Model, text_col: str) -> Column:
    """The score of each whole text, 0 to 1; null counts as empty and gets the model's bias."""

    @pandas_udf("double")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([s for part in together(texts) for s in model.score_all(part)], dtype="float64")

    return of_texts(F.col(text_col))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` and ``score`` (:func:`scores`), ``predicted`` (1 if the score reaches ``threshold``), ``held_out``.

    Repeated rows get equal scores; columns of ``docs`` with the names of the new ones are replaced. An empty table gives no rows.
    """
    return docs.withColumn("score", scores(model, text_col)).withColumns(
        {"predicted": (F.col("score") >= threshold).cast("int"), "held_out": remainder(id_col, 4) == 2}
    )

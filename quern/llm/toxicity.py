"""Toxicity by a counterfactually regularised logistic classifier on hashed words.

Training sentences that name a group of people are repeated with the group swapped for another one; the loss adds the
squared change of the score. The weights of the group terms, and of whatever goes along with them, are pulled together,
so that naming a group does not by itself move a score (counterfactual logit pairing, Garg et al. 2019).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from quern.llm.common import KEPT_BYTES, Kept, worker_table
from quern.llm.samples import labelled_sample, remainder

# Terms for groups of people that may stand in for one another, by kind and language.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("old", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
)
BITS = 20
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def swaps() -> dict[str, str]:
    """Each term with the next one of its kind."""
    return {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}


def buckets(token: str) -> tuple[int, ...]:
    """Of the words in a lower-case token without white space."""
    return tuple(zlib.crc32(word.encode()) & ((1 << BITS) - 1) for word in _WORD.findall(token))


def features(text: str) -> np.ndarray:
    """The distinct buckets of a text's words, in order."""
    return np.array(sorted({b for token in set(text.lower().split()) for b in buckets(token)}), dtype=np.int64)


def counterfactual(text: str, table: dict[str, str]) -> tuple[np.ndarray, np.ndarray] | None:
    """Features of the sentences that name a group, before and after the swap; None if there is no such sentence."""
    named = [s for s in _SENTENCE.split(text.lower()) if any(w in table for w in _WORD.findall(s))]
    if not named:
        return None
    before = " ".join(named)
    return features(before), features(_WORD.sub(lambda m: table.get(m[0], m[0]), before))


@dataclass(frozen=True)
class Model:
    """A few thousand weights at most, so it travels with the tasks."""

    weights: dict[int, float]  # of the buckets that have one
    bias: float

    @property
    def key(self) -> tuple:
        return "toxicity", self.bias, hash(tuple(sorted(self.weights.items())))

    def scorer(self) -> Callable[[str], float]:
        """A function from a text to its score, the same one each time in a process."""
        return worker_table(self.key, lambda: _scorer(self))


def _scorer(model: Model) -> Callable[[str], float]:
    weights, bias = model.weights, model.bias
    weighted = Kept(lambda token: tuple(b for b in buckets(token) if b in weights), KEPT_BYTES // 2)

    def score(text: str) -> float:
        hit = set().union(*filter(None, map(weighted.__getitem__, set(text.lower().split()))))
        return sigmoid(bias + math.fsum(weights[b] for b in hit))

    return score


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def evidence(with_1: np.ndarray, with_0: np.ndarray, n_1: int, n_0: int) -> np.ndarray:
    """Twice the log-likelihood ratio of a word's documents falling into the classes as they do, against by chance."""
    total = with_1 + with_0
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = with_1 * np.log(with_1 / (total * n_1 / (n_1 + n_0))), with_0 * np.log(with_0 / (total * n_0 / (n_1 + n_0)))
    return 2 * (np.nan_to_num(ratio[0]) + np.nan_to_num(ratio[1]))


def fit(
    texts: list[str],
    labels: list[int],
    *,
    counterfactual_weight: float = 1.0,
    l2: float = 1e-3,
    min_evidence: float = 12.0,
    epochs: int = 400,
    rate: float = 0.3,
) -> Model:
    """Full-batch Adagrad on the logistic loss plus the penalty on swapped sentences.

    Words whose split between the classes has less than ``min_evidence``, and words never seen, have no weight; group
    terms and the words of the swapped sentences are always learned. Without texts, or with one class only, the model
    gives every text that class's share (0.5 without texts).
    """
    y = np.asarray(labels, dtype=np.float64)
    positive = y.mean() if len(y) else 0.5
    if positive in (0.0, 1.0) or not len(y):
        return Model({}, float(np.log((positive + 1e-3) / (1 - positive + 1e-3))))
    found = [features(t) for t in texts]
    split = [np.bincount(np.concatenate([f for f, v in zip(found, y, strict=True) if v == side]), minlength=1 << BITS) for side in (1, 0)]
    columns = np.flatnonzero(evidence(*split, int(y.sum()), int((1 - y).sum())) >= min_evidence)
    table = swaps()
    terms = [b for term in table for b in buckets(term)]
    pairs = [p for t, f in zip(texts, found, strict=True) if np.isin(f, terms).any() and (p := counterfactual(t, table))]
    if pairs:
        columns = np.union1d(columns, np.concatenate([x for p in pairs for x in p]))
    place = np.full(1 << BITS, -1)
    place[columns] = np.arange(len(columns))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kept = [place[r][place[r] >= 0] for r in rows]
        return np.repeat(np.arange(len(rows)), [len(k) for k in kept]), np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int64)

    row, col = matrix(found)
    before, after = matrix([a for a, _ in pairs]), matrix([b for _, b in pairs])
    w, b = np.zeros(len(columns)), float(np.log(positive / (1 - positive)))
    sum_w, sum_b = np.full(len(columns), 1e-12), 1e-12
    for _ in range(epochs):
        z = b + np.bincount(row, w[col], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.bincount(col, error[row], minlength=len(w)) + l2 / len(y) * w
        if pairs:
            change = np.bincount(after[0], w[after[1]], minlength=len(pairs)) - np.bincount(before[0], w[before[1]], minlength=len(pairs))
            pull = 2 * counterfactual_weight / len(pairs) * change
            grad += np.bincount(after[1], pull[after[0]], minlength=len(w)) - np.bincount(before[1], pull[before[0]], minlength=len(w))
        sum_w += grad**2
        sum_b += error.sum() ** 2
        w -= rate / np.sqrt(sum_w) * grad
        b -= rate / np.sqrt(sum_b) * error.sum()
    return Model({k: v for k, v in zip(columns.tolist(), w.tolist(), strict=True) if v}, float(b))


def fit_on_labels(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 8_000, max_chars: int = 32_000_000) -> Model:
    """Fit on at most ``max_docs`` labelled documents (and ``max_chars`` characters) whose crc32(id) mod 3 is not 1."""
    sample = labelled_sample(docs, labels, "toxic", id_col=id_col, text_col=text_col, modulus=3, held_out=1, max_docs=max_docs, max_chars=max_chars)
    return fit(sample["text"].tolist(), sample["label"].tolist())


def scores(model: Model, text_col: str) -> Column:
    """The score of each whole text, 0 to 1; null counts as empty and gets the model's bias."""

    @pandas_udf("double")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.scorer()
        for texts in batches:
            yield texts.map(lambda t: own(t or "")).astype("float64")

    return of_texts(F.col(text_col))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` and ``score`` (:func:`scores`), ``predicted`` (1 if the score reaches ``threshold``), ``held_out``.

    Repeated rows get equal scores; columns of ``docs`` with the names of the new ones are replaced. An empty table gives no rows.
    """
    return docs.withColumn("score", scores(model, text_col)).withColumns(
        {"predicted": (F.col("score") >= threshold).cast("int"), "held_out": remainder(id_col, 3) == 1}
    )

"""Phrase collocations: phrases of a few words that occur together more often than their parts would let expect.

Counting is by top-order marginalisation. Each word of a text starts one window: it and the words that follow it, padded
at the end of its piece. Only these longest windows are counted; a rollup over their columns, the last one left out first,
sums them up to the counts of all shorter phrases, since a phrase occurs just where a window begins with it. There is no
explosion of n-grams by length.

Most windows of a corpus occur once, and a phrase that occurs fewer than ``min_count`` times is never reported. So a
window also ends where its words do not stand together that often, which is looked up in bitmaps of the hashes of
frequent runs of two, three... words. A false hit costs a longer window and changes no count: every occurrence of a run hits alike.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import SharedBits, forget_tables, remove_written, shared_bits, written
from quern.llm.shingles import mixed

#: The characters at which texts are cut into pieces, and a language where none is given.
CUTS, UNDETERMINED = ".,;:!?\n\x0b\x0c\r", "und"
_CUT = bytes.maketrans(CUTS.encode(), b"\n" * len(CUTS))
#: Characters of text that are taken apart together, and entries after which a task hands on its counts.
TOGETHER, HELD = 1_000_000, 100_000
#: Parts of a language that are ranked apart first.
PARTS = 64
#: Bytes whose words are hashed together; the base of their polynomial, and its inverse modulo 2**64.
HASHED = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
_APART = np.isin(np.arange(256), list(b" \t\n"))


def plain_bytes(text: str) -> bytes:
    """A text in UTF-8, A-Z lower-cased, with line feeds for all characters at which it is cut."""
    return text.encode().lower().translate(_CUT)


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of each piece of a text, A-Z lower-cased; pieces without words are left out."""
    for piece in plain_bytes(text).split(b"\n"):
        if words := piece.split():
            yield words


@dataclass(frozen=True)
class Words:
    """Words of texts of one language, one after the other."""

    lang: str
    distinct: list[bytes]
    number: np.ndarray  # of each word, its place in ``distinct``
    goes_on: np.ndarray  # whether the next word is of the same piece


def by_language(frame: pd.DataFrame) -> Iterator[Words]:
    """The words of rows with ``lang`` and ``text``, of some whole texts of a language at once."""
    for lang, texts in frame["text"].groupby(frame["lang"].fillna(UNDETERMINED)):
        words, sizes, held = [], [], 0
        for at, text in enumerate(texts, 1):
            for piece in pieces(text or ""):
                words += piece
                sizes.append(len(piece))
            held += len(text or "")
            if words and (held > TOGETHER or at == len(texts)):
                goes_on = np.ones(len(words), bool)
                goes_on[np.cumsum(sizes) - 1] = False
                places = dict(zip(dict.fromkeys(words), itertools.count()))
                yield Words(lang, list(places), np.fromiter(map(places.__getitem__, words), np.int64, len(words)), goes_on)
                words, sizes, held = [], [], 0


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of :func:`plain_bytes`, a polynomial in its bytes by running sums, and for each whether the next is of the same piece."""
    hashes, lines, begin, line = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0
    while begin < len(data):
        end = begin + HASHED
        if end < len(data):  # not within a word
            while end < len(data) and not _APART[data[end]]:
                end += 1
        a = np.frombuffer(data, np.uint8, min(end, len(data)) - begin, begin)
        room = HASHED
        while room < len(a):
            room *= 2
        within = np.concatenate([[False], ~_APART[a], [False]])
        edges = np.flatnonzero(within[1:] != within[:-1])
        starts, stops = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[a] * _powers(BASE, room)[: len(a)])])
        hashes.append(mixed((sums[stops] - sums[starts]) * _powers(INVERSE, room)[starts]))
        ended = np.cumsum(a == 10)
        lines.append(ended[starts] + line)
        line += int(ended[-1])
        begin += len(a)
    place = np.concatenate(lines)
    return np.concatenate(hashes), np.append(place[1:] == place[:-1], False)[: len(place)]


def hashed_by_language(frame: pd.DataFrame) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Of rows with ``lang`` and ``text``: a language and :func:`word_hashes` of some whole texts of it."""
    for lang, texts in frame["text"].groupby(frame["lang"].fillna(UNDETERMINED)):
        held, size = [], 0
        for at, text in enumerate(texts, 1):
            held.append(plain_bytes(text or ""))
            size += len(held[-1])
            if size > TOGETHER or at == len(texts):
                yield lang, *word_hashes(b"\n".join(held))
                held, size = [], 0


def run_hashes(h: np.ndarray, lang: str, size: int) -> np.ndarray:
    """A hash of the language and every ``size`` consecutive words, given the words' hashes."""
    n = max(0, len(h) - size + 1)
    total = np.full(n, xxhash.xxh3_64_intdigest(f"{size} {lang}"), np.uint64)
    for i in range(size):
        total += h[i : i + n] * np.uint64(xxhash.xxh3_64_intdigest(b"word %d" % i) | 1)
    return mixed(total)


def reached(h: np.ndarray, goes_on: np.ndarray, lang: str, bits: list[SharedBits]) -> tuple[list[np.ndarray], np.ndarray]:
    """Given hashes of words: for 1, 2... words where a run of so many begins that is frequent by ``bits`` (of 2, 3... words),
    with all runs within it; and the hashes of the runs one word longer that are frequent but for one of all their words."""
    begins, next_to = [np.ones(len(h), bool)], goes_on[:-1]
    for size, frequent in enumerate(bits, 2):
        hit = np.zeros(len(next_to), bool)
        hit[next_to] = frequent.hit(run_hashes(h, lang, size)[next_to])
        begins.append(np.concatenate([hit, np.zeros(len(h) - len(hit), bool)]))
        next_to = hit[:-1] & hit[1:]
    return begins, run_hashes(h, lang, len(bits) + 2)[next_to]


def counted(words: Words, at: np.ndarray, size: int) -> Iterator[tuple[tuple[str, ...], int]]:
    """Each distinct run of ``size`` words that begins at one of the places ``at``, and at how many of them."""
    code = words.number[at]
    for i in range(1, size):
        if i > 1:  # numbered anew, so that codes stay below the square of the number of words
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(words.distinct) + words.number[at + i]
    _, first, k = np.unique(code, return_index=True, return_counts=True)
    columns = ([words.distinct[j].decode() for j in words.number[at[first] + i].tolist()] for i in range(size))
    return zip(zip(*columns, strict=True), k.tolist(), strict=True)


def _frequent_runs(texts: DataFrame, bits: list[SharedBits], min_count: int) -> DataFrame:
    """``hash`` of each run one word longer than those of ``bits`` that a language has ``min_count`` times or more."""

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        for frame in frames:
            for lang, h, goes_on in hashed_by_language(frame):
                found, k = np.unique(reached(h, goes_on, lang, bits)[1].view(np.int64), return_counts=True)
                yield pd.DataFrame({"hash": found, "k": k})

    return texts.mapInPandas(runs, "hash long, k long").groupBy("hash").agg(F.sum("k").alias("k")).where(F.col("k") >= min_count).select("hash")


def _windows(texts: DataFrame, bits: list[SharedBits]) -> DataFrame:
    """Counts ``k`` of windows: ``lang`` and a column for each word, ``w0``, ``w1``..., padded with empty ones."""
    max_words = len(bits) + 1
    columns = [f"w{i}" for i in range(max_words)]

    def frame_of(lang: str, counts: dict[tuple[str, ...], int]) -> pd.DataFrame:
        rows = [(*window, *[""] * (max_words - len(window)), k) for window, k in counts.items()]
        return pd.DataFrame(rows, columns=[*columns, "k"]).assign(lang=lang)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        counts: dict[str, dict[tuple[str, ...], int]] = {}
        for frame in frames:
            for words in by_language(frame):
                h = word_hashes(b"\n".join(words.distinct))[0][words.number]
                begins, own = [*reached(h, words.goes_on, words.lang, bits)[0], np.zeros(len(h), bool)], counts.setdefault(words.lang, {})
                for size in range(1, max_words + 1):
                    for window, k in counted(words, np.flatnonzero(begins[size - 1] & ~begins[size]), size):
                        own[window] = own.get(window, 0) + k
                if sum(map(len, counts.values())) > HELD:
                    for key, held in counts.items():
                        yield frame_of(key, held)
                    counts = {}
        for key, held in counts.items():
            yield frame_of(key, held)

    schema = ", ".join(f"{c} string" for c in columns)
    return texts.mapInPandas(count, f"{schema}, k long, lang string")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, min_count: int = 10, max_words: int = 3) -> DataFrame:
    """``lang``, ``phrase``, ``n_words`` and ``f`` of every phrase of up to ``max_words`` words that occurs ``min_count``
    times or more in a language, and a row with ``n_words`` 0 for all words of the language. A stored table."""
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    bits: list[SharedBits] = []
    for _ in range(max_words - 1):
        frequent = written(_frequent_runs(texts, bits, min_count))
        bits.append(shared_bits(frequent, "hash", frequent.count()))
        remove_written(frequent)
    columns = [f"w{i}" for i in range(max_words)]
    windows = _windows(texts, bits).groupBy("lang", *columns).agg(F.sum("k").alias("k"))
    sums = docs.sparkSession.sql(
        f"SELECT lang, {', '.join(columns)}, grouping_id() AS left_out, sum(k) AS f FROM {{windows}} GROUP BY lang, ROLLUP({', '.join(columns)})", windows=windows
    )
    n_words = sum((F.col("left_out").bitwiseAND(F.lit(1 << i)) == 0).cast("int") for i in range(max_words))
    last_word = F.when(F.col("n_words") > 0, F.get(F.array(*columns), F.col("n_words") - 1)).otherwise(F.lit("."))
    phrase = F.array_join(F.slice(F.array(*columns), F.lit(1), F.col("n_words")), " ")
    counted = sums.withColumn("n_words", n_words).where((last_word != "") & ((F.col("f") >= min_count) | (F.col("n_words") == 0)))
    out = written(counted.select("lang", phrase.alias("phrase"), "n_words", "f"))
    for frequent in bits:
        frequent.destroy()
    return out


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    min_count: int = 10,
    max_words: int = 3,
    absorbed_percent: int = 50,
    per_language: int = 2000,
) -> DataFrame:
    """The first ``per_language`` collocations of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts (null: empty) are lower-cased (A-Z), cut into pieces at ``CUTS`` and these into words at spaces and tabs;
    a null language is ``und``. Candidates are phrases of 2 to ``max_words`` words of one piece that occur ``a`` >= ``min_count``
    times. Cut after its first k words a candidate scores floor(1000000 * a * a / (l * r)), l and r being the counts of
    its two parts; the cut with the lowest score counts, of equal ones that after the fewest words. A candidate is dropped
    if it stands within a longer one that occurs at least ``absorbed_percent`` percent as often. Ranks go by score and ``a``, both
    descending, then phrase. Products are decimals of 38 digits, so counts up to 10**15 are exact. Rows that repeat count
    each time. Other columns are ignored; an empty table, or one without words, gives no rows.
    """
    known = phrase_counts(docs, text_col, lang_col, min_count=min_count, max_words=max_words)
    words = known.where("n_words = 0").select("lang", F.col("f").alias("n"))
    candidates = known.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.split("phrase", " ").alias("__w"))
    part = lambda start, size: F.array_join(F.slice("__w", start, size), " ")
    cut = candidates.select("lang", "phrase", "a", "__w", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    counts = known.where("n_words > 0")
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"1000000BD * ({exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    size, start = F.sequence(F.lit(2), F.col("n_words") - 1), lambda s: F.sequence(F.lit(1), F.col("n_words") - s + 1)
    within = F.flatten(F.transform(size, lambda s: F.transform(start(s), lambda i: F.array_join(F.slice("__w", i, s), " "))))
    longer = candidates.where("n_words > 2").select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("__longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("__longer") < absorbed_percent * F.col("a"), F.lit(True)))
    order = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    for groups in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))], ["lang"]):  # so that the last window has a bounded number of rows
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= per_language)
    ranked = kept
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))

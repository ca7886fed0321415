"""Repeated passages within and across documents, found by relative Lempel-Ziv parsing and taken out.

A text is a row of windows, each of ``window`` consecutive words, and stands for it as a row of hashes. Parsing a text against
a reference means to take, from left to right, the longest factor that the reference holds from the place where
the first window is found, and to go on at the factor's end: the windows that straddle it are looked up anew, so
nothing is lost where one factor ends and another begins. Each factor is at least a window long and so a repeated passage.

The reference is the whole corpus, cut into blocks that one task holds. A window belongs to its anchor, the one with
the smallest hash (the first of equal ones) among its runs of a few words. Equal windows have equal anchors, so what a text
has around an anchor is parsed against the block of that anchor and no other, and every earlier place where the
window could stand is in that block. Anchors that occur once are counted out before, and their surroundings never leave the task.
Within a block, texts come in the order of their ids and each is added after it is parsed.

An anchor that very many places share is refined to whole windows: their first places are a grouped minimum, joined
back, so that a passage of a third of all documents is no group in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quern.llm.common import Bitmap, SharedBits, forget_tables, remove_written, shared_bits, sized, written
from quern.llm.shingles import mixed

#: Places of an anchor up to which they are parsed in one task.
HOT = 20_000
#: Characters of text that are taken apart together.
TOGETHER = 1_000_000
#: Documents and passages up to which the passages to remove are broadcast.
BROADCAST_DOCUMENTS, BROADCAST_PASSAGES = 100_000, 1_000_000


def anchor_words(window: int) -> int:
    return max(1, 2 * window // 5)


def _places(kind: bytes, n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(kind + b" %d" % i) | 1 for i in range(n)], np.uint64)


def run_hashes(h: np.ndarray, kind: bytes, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words, given the words' hashes."""
    places = _places(kind, n)
    total = h[: len(h) - n + 1] * places[0]
    for i in range(1, n):
        total += h[i : len(h) - n + 1 + i] * places[i]
    return mixed(total)


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive values the place of the smallest, the first one of equals."""
    at, covered = np.arange(len(values)), 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = at[: len(at) - step], at[step:]
        at, covered = np.where(values[left] <= values[right], left, right), covered + step
    return at


def anchored(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts and their anchors: hashes of the windows, which text each is of, where it starts there, the
    number of its piece (a piece: consecutive windows with one anchor), and of each piece the anchor's hash."""
    split = [t.encode().split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    n = int(sizes.sum())
    none = np.zeros(0, np.int64)
    if n < window:
        return none.view(np.uint64), none, none, none, none.view(np.uint64)
    h = np.frombuffer(b"".join(xxhash.xxh3_64_digest(w) for s in split for w in s), np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    own = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    short = anchor_words(window)
    grams = run_hashes(h, b"anchor", short)
    anchor = first_least(grams, window - short + 1)[own]
    new = np.ones(len(own), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    starts = own - (np.cumsum(sizes) - sizes)[owner[own]]
    return run_hashes(h, b"window", window)[own], owner[own], starts, np.cumsum(new) - 1, grams[anchor[new]]


def _parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Slices of about ``TOGETHER`` characters."""
    begin = held = 0
    for at, text in enumerate(frame["text"], 1):
        held += len(text or "")
        if held > TOGETHER or at == len(frame):
            yield frame.iloc[begin:at]
            begin, held = at, 0


def _texts(frame: pd.DataFrame) -> list[str]:
    return [t or "" for t in frame["text"]]


def _anchors(texts: DataFrame, window: int) -> DataFrame:
    """``anchor``, ``k``: in how many pieces each anchor occurs, of those in two or more."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        for frame in frames:
            for part in _parts(frame):
                found, k = np.unique(anchored(_texts(part), window)[4].view(np.int64), return_counts=True)
                yield pd.DataFrame({"anchor": found, "k": k})

    return texts.select("text").mapInPandas(count, "anchor long, k long").groupBy("anchor").agg(F.sum("k").alias("k")).where("k > 1")


def _pieces(texts: DataFrame, window: int, met: SharedBits, hot: SharedBits | None, want_hot: bool) -> DataFrame:
    """Pieces whose anchor occurs elsewhere: ``anchor``, the text's ``late``, ``id`` and ``mark``, ``start`` and ``windows``.
    Those with a hot anchor are left out, or, with ``want_hot``, they alone are given, a row for each of their windows."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        for frame in frames:
            for part in _parts(frame):
                windows, owner, starts, piece, anchors = anchored(_texts(part), window)
                wanted = met.hit(anchors)
                if hot is not None:
                    is_hot = hot.hit(anchors)
                    wanted &= is_hot if want_hot else ~is_hot
                kept = wanted[piece]
                windows, owner, starts, piece = windows[kept].view(np.int64), owner[kept], starts[kept], piece[kept]
                first = np.arange(len(piece)) if want_hot else np.flatnonzero(np.diff(piece, prepend=-1))
                keys = part[["late", "id", "mark"]].iloc[owner[first]].reset_index(drop=True)
                rows = np.split(windows, first[1:]) if len(first) else []
                yield keys.assign(anchor=anchors[piece[first]].view(np.int64), start=starts[first], windows=pd.Series(rows, dtype=object))

    return texts.mapInPandas(cut, "late boolean, id long, mark long, anchor long, start long, windows array<long>")


class Block:
    """The reference around one anchor: where its windows stand first. Pieces are added in the order of their places."""

    def __init__(self):
        self.index: dict[int, tuple[list[int], int, tuple]] = {}

    def factors(self, piece: list[int], place: tuple) -> list[tuple[int, int]]:
        """(First window, number of windows) of each factor of a piece at ``place`` (of its text, and its start) that the block holds from earlier on; then the piece is added."""
        found, at, (text, start) = [], 0, place
        while at < len(piece):
            known = self.index.get(piece[at])
            if known is None or known[2] >= (text, start + at):
                at += 1
                continue
            reference, there, _ = known
            n = 1
            while at + n < len(piece) and there + n < len(reference) and piece[at + n] == reference[there + n]:
                n += 1
            found.append((at, n))
            at += n
        for at, w in enumerate(piece):
            if w not in self.index:
                self.index[w] = (piece, at, (text, start + at))
        return found


def _parsed(pieces: DataFrame, window: int) -> DataFrame:
    """``late``, ``id``, ``mark``, and ``passage``: starts and lengths of the factors of all pieces, parsed block by block."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block = None, Block()
        for frame in frames:
            rows = []
            columns = (frame[c].tolist() for c in ("anchor", "late", "id", "mark", "start"))
            for anchor, late, key, mark, start, windows in zip(*columns, frame["windows"], strict=True):
                if anchor != now:
                    now, block = anchor, Block()
                for at, n in block.factors(windows.tolist(), ((late, key), start)):
                    rows.append((late, key, mark, (start + at << 32) + n + window - 1))
            yield pd.DataFrame(rows, columns=["late", "id", "mark", "passage"])

    in_order = pieces.repartition("anchor").sortWithinPartitions("anchor", "late", "id", "start")
    return in_order.mapInPandas(parse, "late boolean, id long, mark long, passage long")


def _refined(windows: DataFrame, window: int) -> DataFrame:
    """The same for the windows of hot anchors, each by the first place of its like."""
    place = F.expr("cast(id as decimal(19,0)) * 4294967296BD + cast(start as decimal(10,0)) + if(late, 1e30BD, 0BD)").cast("decimal(38,0)")
    rows = windows.select("late", "id", "mark", "start", "anchor", F.col("windows")[0].alias("w"), place.alias("place"))
    firsts = written(rows.groupBy("anchor", "w").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last"))
    later = rows.join(sized(firsts, firsts.count()), ["anchor", "w"]).where("place > first")
    return later.select("late", "id", "mark", (F.shiftleft("start", 32) + window).alias("passage"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    carried = F.struct(F.col(id_col).alias("__id"), *(F.col(c) for c in carry))
    return docs.select(key.isNull().alias("late"), F.coalesce(key, F.lit(0)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"), carried.alias("__carry"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 20, hot: int = HOT) -> DataFrame:
    """``late`` (whether the id is null), ``id``, ``mark`` (a hash of the text), ``passages`` of every text with repeated
    passages: start << 32 + length, in words; they may overlap. A stored table; see :func:`remove_repeats`."""
    texts = _keyed(docs, id_col, text_col, ()).select("late", "id", "mark", "text")
    counts = written(_anchors(texts, window))
    n, n_hot = counts.agg(F.count("*"), F.count(F.when(F.col("k") > hot, 1))).first()
    met = shared_bits(counts, "anchor", n)
    hottest = shared_bits(counts.where(F.col("k") > hot), "anchor", n_hot) if n_hot else None
    found = _parsed(_pieces(texts, window, met, hottest, False), window)
    if n_hot:
        found = found.unionByName(_refined(_pieces(texts, window, met, hottest, True), window))
    out = written(found.groupBy("late", "id", "mark").agg(F.collect_set("passage").alias("passages")))
    for bits in (met, hottest):
        if bits is not None:
            bits.destroy()
    remove_written(counts)
    return out


def _with_passages(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """``rows`` with the passages of their texts. Few are broadcast; of many, only the rows that may have any are shuffled."""
    n, total = passages.agg(F.count("*"), F.coalesce(F.sum(F.size("passages")), F.lit(0))).first()
    key = ["late", "id", "mark"]
    if n <= BROADCAST_DOCUMENTS and total <= BROADCAST_PASSAGES:
        return rows.join(F.broadcast(passages), key, "left")
    hashed = F.xxhash64(*key)
    marked = Bitmap(passages.select(hashed.alias("__key")), "__key", n).marked(rows.withColumn("__key", hashed), "__key", "__hit").drop("__key")
    alone = marked.where("not __hit").withColumn("passages", F.lit(None).cast("array<bigint>"))
    return marked.where("__hit").join(passages, key, "left").unionByName(alone).drop("__hit")


def _removed(passages: np.ndarray | None, n: int) -> np.ndarray:
    """Which of a text's ``n`` words are in a passage."""
    change = np.zeros(n + 1, np.int64)
    if passages is not None:
        starts = passages >> 32
        np.add.at(change, starts, 1)
        np.add.at(change, starts + (passages & 0xFFFFFFFF), -1)
    return np.cumsum(change)[:n] > 0


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, carry: Sequence[str] = (), window: int = 20, hot: int = HOT
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the columns of ``carry``, ``n_words``, ``n_removed``, ``removed`` (starts
    and lengths, in words, of what is taken out) and ``kept``: the other words with single spaces between them.

    Words are what stands between ASCII white space, unchanged. A window is ``window`` consecutive words of a document;
    every word is removed that lies in a window whose words also start earlier: in a document with a smaller id, or at an
    earlier place of the same one. All windows are judged on the texts as given, so what is removed also counts as earlier.

    Ids must be integers. Rows that share an id are one document for this order: of what starts at the same
    place in both, neither is earlier, so repeated rows have equal results. Null ids come after all others and count as
    one id. A null or empty text, or one of fewer words than a window, loses nothing. Other columns are ignored unless
    carried. An empty table gives no rows. Windows are compared by a hash of 64 bits of all their words among those that share an anchor, by
    another hash of 64 bits.
    """
    passages = repeated_passages(docs, id_col, text_col, window=window, hot=hot)

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        for frame in frames:
            rows = []
            for text, found in zip(frame["text"], frame["passages"], strict=True):
                words = text.encode().split()
                if found is None or not len(found):
                    rows.append((len(words), 0, [], b" ".join(words).decode()))
                    continue
                gone = _removed(np.asarray(found), len(words))
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                rows.append((len(words), int(gone.sum()), [{"start": a, "length": b - a} for a, b in edges], kept.decode()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "removed", "kept"])
            yield pd.concat([frame[["__carry"]].reset_index(drop=True), out], axis=1)

    rows = _with_passages(_keyed(docs, id_col, text_col, carry), passages).select("__carry", "text", "passages")
    span = StructType([StructField("start", LongType()), StructField("length", LongType())])
    schema = StructType([rows.schema["__carry"]]).add("n_words", LongType()).add("n_removed", LongType()).add("removed", ArrayType(span)).add("kept", StringType())
    done = rows.mapInPandas(remove, schema)
    carried: list[Column] = [F.col("__carry.__id").alias(id_col), *(F.col(f"__carry.`{c}`").alias(c) for c in carry)]
    return done.select(*carried, "n_words", "n_removed", "removed", "kept")

"""Ranked lexical search: the exact best documents for each item, by inner products over sparse ball trees.

A score is the inner product of an item's weights and a document's saturated term frequencies, all whole numbers. Only the
terms of items matter to it, so a document is a short row over those. Each task gathers its documents in blocks and
makes a ball tree of each: a node has a centroid and a radius around all its documents, halves lie around two far
apart ones. For an item q, no document below a node with centroid c and radius r scores more than q.c + |q| r. Nodes are
opened best first, with that bound rounded up beyond what floating point may lose, until none can reach the item's
k-th best so far; what a leaf holds is scored in 64-bit integers. A task carries its best from block to block and hands on
``k`` rows an item, so what is shuffled does not depend on how many documents it has read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import forget_tables, remove_written, shared_bits, written

#: Bytes that end a term (what is not an ASCII letter or digit, nor part of a character beyond ASCII).
_ENDS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TERMS = bytes.maketrans(_ENDS, b" " * len(_ENDS))
#: Documents in a tree and in a leaf, and numbers in a tree's centroids, at most.
BLOCK, LEAF, CENTROIDS = 8192, 32, 1 << 22
#: Entries of sparse rows after which a tree is made of fewer documents.
ENTRIES = 2_000_000
#: Items, and terms of theirs, that are searched for together; an item with more terms is searched for alone.
ITEMS, ITEM_TERMS = 512, 8192
#: Characters of text taken apart together, and terms after which a task hands on its counts.
TOGETHER, HELD = 1_000_000, 100_000


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_TERMS).split()


def _parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    begin = held = 0
    for at, text in enumerate(frame["text"], 1):
        held += len(text or "")
        if held > TOGETHER or at == len(frame):
            yield frame.iloc[begin:at]
            begin, held = at, 0


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``term``, ``k``: how often an item has a term. Items without an id are left out."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, t.decode(), k) for key, text in zip(frame["item"], frame["text"], strict=True) for t, k in Counter(terms(text)).items()]
            yield pd.DataFrame(rows, columns=["item", "term", "k"])

    texts = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    return texts.mapInPandas(count, "item long, term string, k long").groupBy("item", "term").agg(F.sum("k").alias("k"))


def term_statistics(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """``term``, ``docs``, ``terms``: for the terms of ``wanted`` in how many documents they are; and, with a null term,
    how many documents have any term, and how many terms all have. Over all of ``docs`` (column ``text``)."""

    def hash_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"hash": np.array([_term_hash(t.encode()) for t in frame["term"]], np.uint64).view(np.int64)})

    hashes = written(wanted.select("term").mapInPandas(hash_terms, "hash long"))
    bits = shared_bits(hashes, "hash", n_wanted)
    remove_written(hashes)

    def flushed(held: Counter) -> pd.DataFrame:
        hashes = np.array([_term_hash(t) for t in held], np.uint64)
        hit = bits.hit(hashes).tolist()
        return pd.DataFrame([(t.decode(), k, 0) for (t, k), h in zip(held.items(), hit, strict=True) if h], columns=["term", "docs", "terms"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        held, n_docs, n_terms = Counter(), 0, 0
        for frame in frames:
            for text in frame["text"]:
                own = terms(text)
                n_docs, n_terms = n_docs + bool(own), n_terms + len(own)
                held.update(set(own))
                if len(held) > HELD:
                    yield flushed(held)
                    held = Counter()
        yield flushed(held)
        yield pd.DataFrame({"term": [None], "docs": [n_docs], "terms": [n_terms]})

    counts = docs.select("text").mapInPandas(count, "term string, docs long, terms long")
    out = written(counts.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")))
    bits.destroy()
    return out


def _term_hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Tree:
    """A ball tree over the rows of a sparse matrix. Rows are in the order of the leaves; node 0 is the root."""

    centroids: np.ndarray
    radii: np.ndarray
    children: list[tuple[int, int] | None]  # None: a leaf
    leaves: dict[int, tuple[int, int]]  # the rows of a leaf, from and to
    order: np.ndarray  # which row of the matrix stands where


def ball_tree(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, width: int, *, leaf: int = LEAF, most: int = CENTROIDS) -> Tree:
    """Built level by level, all nodes of a level at once. ``row`` ascends; every row has an entry.

    Radii are rounded up. A node stays whole when it has at most ``leaf`` rows, when they are all alike, or when the centroids would take more than ``most`` numbers.
    """
    value = value.astype(np.float64)
    squares = np.bincount(row, value**2, n)
    node, active = np.zeros(n, np.int64), np.array([0])
    centroids, radii, children = [], [], [None]
    while len(active):
        place = np.full(len(children), -1)
        place[active] = np.arange(len(active))
        k, at = len(active), place[node]
        rows = np.flatnonzero(at >= 0)
        within = at[row] >= 0
        entry_row, entry_col, entry_value = row[within], col[within], value[within]
        size = np.bincount(at[rows], minlength=k)
        centre = np.bincount(at[entry_row] * width + entry_col, entry_value, k * width).reshape(k, width) / size[:, None]
        squared = (centre**2).sum(1)

        def away(points: np.ndarray, norms: np.ndarray) -> np.ndarray:
            """Squared distances of all rows to the point of their node."""
            dot = np.bincount(entry_row, entry_value * points[at[entry_row], entry_col], n)  # noqa: B023
            return squares[rows] + norms[at[rows]] - 2 * dot[rows]  # noqa: B023

        def farthest(distance: np.ndarray) -> np.ndarray:
            """Of each node the row that is farthest."""
            order = np.lexsort((distance, at[rows]))  # noqa: B023
            return rows[order[np.cumsum(size) - 1]]  # noqa: B023

        def dense(chosen: np.ndarray) -> np.ndarray:
            out = np.zeros((k, width))  # noqa: B023
            mine = chosen[at[entry_row]] == entry_row  # noqa: B023
            out[at[entry_row[mine]], entry_col[mine]] = entry_value[mine]  # noqa: B023
            return out

        distance = away(centre, squared)
        slack = 1e-9 * (squares[rows] + squared[at[rows]]) + 1e-9
        radius = np.zeros(k)
        np.maximum.at(radius, at[rows], np.sqrt(np.maximum(distance, 0) + slack))
        centroids.append(centre)
        radii.append(radius)
        one = farthest(distance)
        from_one = away(dense(one), squares[one])
        other = farthest(from_one)
        from_other = away(dense(other), squares[other])
        apart = np.zeros(k)
        np.maximum.at(apart, at[rows], from_one - slack)
        split = (size > leaf) & (apart > 0)
        room = (most // width - len(children)) // 2
        split &= np.cumsum(split) <= room
        nearer = (from_other < from_one) & (rows != one[at[rows]])
        split &= (np.bincount(at[rows], nearer, k) > 0)
        first = len(children) + 2 * (np.cumsum(split) - 1)
        for parent, child in zip(active[split].tolist(), first[split].tolist(), strict=True):
            children[parent] = (child, child + 1)
        moved = split[at[rows]]
        node[rows[moved]] = first[at[rows]][moved] + nearer[moved]
        active = np.arange(len(children), len(children) + 2 * int(split.sum()))
        children += [None] * len(active)
    order = np.argsort(node, kind="stable")
    ends = np.cumsum(np.bincount(node, minlength=len(children)))
    leaves = {x: (int(ends[x - 1]) if x else 0, int(ends[x])) for x, c in enumerate(children) if c is None}
    return Tree(np.concatenate(centroids), np.concatenate(radii), children, leaves, order)


class Searcher:
    """The best documents of each item among those given so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k  # whole numbers, one row an item
        self.dense = queries.astype(np.float64)
        self.length = np.sqrt((self.dense**2).sum(1))
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id), best first
        self.scored = 0

    def bounds(self, tree: Tree) -> np.ndarray:
        """For each item and node what no score below it exceeds."""
        inner, reach = self.dense @ tree.centroids.T, self.length[:, None] * tree.radii
        return inner + reach + 1e-9 * (inner + reach) + 1

    def add(self, ids: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, **sizes: int) -> None:
        """A block of documents as a sparse matrix of whole numbers; each has an entry."""
        if not len(ids):
            return
        tree = ball_tree(row, col, value, len(ids), self.queries.shape[1], **sizes)
        bounds = self.bounds(tree)
        starts = np.searchsorted(row, np.arange(len(ids) + 1))
        lengths = np.diff(starts)[tree.order]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        pick = np.repeat(starts[:-1][tree.order] - offsets[:-1], lengths) + np.arange(offsets[-1])
        col, value, ids = col[pick], value[pick], ids[tree.order].tolist()
        for item, own in enumerate(self.best):
            of_item = bounds[item].tolist()
            weights = self.queries[item]
            open_nodes = [(-of_item[0], 0)]
            while open_nodes:
                bound, node = heapq.heappop(open_nodes)
                least = -own[-1][0] if len(own) == self.k else 1
                if -bound < least:
                    break
                if tree.children[node]:
                    for child in tree.children[node]:
                        if of_item[child] >= least:
                            heapq.heappush(open_nodes, (-of_item[child], child))
                    continue
                a, b = tree.leaves[node]
                entries = slice(offsets[a], offsets[b])
                scores = np.add.reduceat(weights[col[entries]] * value[entries], offsets[a:b] - offsets[a])
                self.scored += b - a
                reached = np.flatnonzero(scores >= least).tolist()
                if reached:
                    own += [(-int(scores[x]), ids[a + x]) for x in reached]
                    own.sort()
                    del own[self.k :]


def _found(docs: DataFrame, queries: list[tuple[int, dict[str, int]]], n_docs: int, n_terms: int, k: int, block: int) -> DataFrame:
    """``item_id``, ``doc_id``, ``score``: the best of each task for ``queries``, the weights of the terms of each item."""
    columns = {t: i for i, t in enumerate(sorted({t for _, own in queries for t in own}))}
    matrix = np.zeros((len(queries), len(columns)), np.int64)
    for i, (_, own) in enumerate(queries):
        for t, w in own.items():
            matrix[i, columns[t]] = w
    items = [item for item, _ in queries]
    shared = docs.sparkSession.sparkContext.broadcast((matrix, {t.encode(): i for t, i in columns.items()}))

    def vectors(part: pd.DataFrame, index: dict[bytes, int]) -> tuple[np.ndarray, ...]:
        """Ids and sparse rows of the documents that have a term of an item."""
        split = [terms(t) for t in part["text"]]
        sizes = np.array([len(s) for s in split], np.int64)
        found = np.fromiter((index.get(t, -1) for s in split for t in s), np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(split)), sizes)
        entry, tf = np.unique((row * len(index) + found)[found >= 0], return_counts=True)
        row, col = np.divmod(entry, max(1, len(index)))
        m = np.array([100 - 25 + (25 * n * n_docs) // n_terms for n in sizes.tolist()], np.int64)
        value = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
        present, row = np.unique(row, return_inverse=True)
        return part["id"].to_numpy(np.int64)[present], row, col, value

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        queries, index = shared.value
        searcher, held, n_held, n_entries = Searcher(queries, k), [], 0, 0

        def work_off() -> None:
            before = np.cumsum([0, *(len(h[0]) for h in held)])
            ids, col, value = (np.concatenate([h[j] for h in held]) for j in (0, 2, 3))
            searcher.add(ids, np.concatenate([h[1] + b for h, b in zip(held, before, strict=False)]), col, value)

        for frame in frames:
            for part in _parts(frame):
                held.append(vectors(part, index))
                n_held += len(held[-1][0])
                n_entries += len(held[-1][1])
                if n_held >= block or n_entries > ENTRIES:
                    work_off()
                    held, n_held, n_entries = [], 0, 0
        if held:
            work_off()
        rows = [(items[i], key, -score) for i, own in enumerate(searcher.best) for score, key in own]
        yield pd.DataFrame(rows, columns=["item_id", "doc_id", "score"])

    found = docs.where("id is not null").mapInPandas(search, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    out = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    shared.destroy()
    return out


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    k: int = 20,
    items_together: int = ITEMS,
    block: int = BLOCK,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the ``k`` best documents of each item with a score above 0, as stored tables.

    Terms are the longest runs of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased. With N
    documents that have a term, L terms in them, n terms in one of them, and a term in df documents and tf times in one: w is
    floor(1000 * ln((2 * N + 2) / (2 * df + 1))), m is 75 + 25 * n * N div L, and the score sums w * ((10**9 * tf) div (1000 * tf +
    12 * m)) over the item's terms, as often as it has them. Equal scores rank by ``doc_id``. Scores must fit 64 bits.

    Ids must be integers. A null text has no terms. Documents without an id count in N, L and df but have no rank; items
    without an id, a term, or a document that shares one give no rows. Rows that repeat a document are documents of
    their own; rows that repeat an item's id are one item with the terms of all. Other columns are ignored; empty tables give no rows.
    Items go through the driver ``items_together`` at a time, and each such group is a pass over the documents.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = written(item_terms(items, item_col, item_text_col))
    wanted = written(asked.select("term").distinct())
    statistics = term_statistics(texts, wanted, wanted.count())
    n_docs, n_terms = statistics.where("term is null").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    weighed = asked.join(statistics.where("term is not null").select("term", "docs"), "term")
    sizes = weighed.groupBy("item").agg(F.count("*").alias("n")).orderBy("item").collect()
    groups, room = [], 0
    for r in sizes:
        if not groups or len(groups[-1]) >= items_together or room + r["n"] > ITEM_TERMS:
            groups.append([])
            room = 0
        groups[-1].append(r["item"])
        room += r["n"]
    found = []
    for group in groups:
        queries: dict[int, dict[str, int]] = {item: {} for item in group}
        for r in weighed.where(F.col("item").between(group[0], group[-1])).collect():
            queries[r["item"]][r["term"]] = r["k"] * weight(n_docs, r["docs"])
        found.append(_found(texts, list(queries.items()), n_docs, n_terms, k, block))
    remove_written(asked, wanted, statistics)
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out

"""Exact top-k search by inner product, as a Voronoi join: only cells that can hold one of a query's best are searched.

Vectors are dealt to the cells of a few pivots, and each cell is summed up by its size, its radius and its largest norm
(Lu et al. 2012). For a vector x in the cell of pivot p, q.x = q.p + q.(x - p) <= q.p + |q| * radius. A query is first
solved in the cell that promises most, which gives it a score to beat, and then sent only to the cells whose bound
reaches that score. Small cells that lie near one another share a block, large ones are cut into several, and so are the
queries sent to a block, so that no task holds more than one block of each however uneven the cells are; a query is sent
once to each block that it has to meet. Where the bounds leave most pairs to be scored, blocks are full and a query is
sent to each at most once, as in a plain blocked search. Pivots grow with the square root of the table, as do cells.

How much this saves depends on the vectors: where they lie in clusters most cells are ruled out, and where they are
spread evenly over many dimensions no bound rules out any, so every query meets every vector, block by block.
:func:`reached_share` tells which.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import written

#: Vectors and queries in a block.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 16_384
#: Vectors of small cells that are searched together where bounds rule out much, and the part of all pairs from which they do not.
TOGETHER, MOSTLY = 512, 0.5
#: Scores that are worked out at once, distances or bounds that are, and rows that a task hands on at once.
SCORES, BOUNDS, HANDED = 1 << 21, 1 << 21, 1 << 16
#: Bytes of pivots at most; they and the cells' summaries are all that the driver holds and broadcasts.
PIVOT_BYTES = 32 << 20


def quantised(vector: str, scale: int = 256) -> Column:
    """Each component times ``scale``, rounded down; null for a vector that is null or has a null or non-finite component."""
    usable = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """One row a vector; shorter ones are filled up with zeros, which leave inner products as they are."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: in floating point while all sums stay below 2**53, else in 64-bit integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's ``k`` best among the vectors, its own id excepted, ties to smaller ids. Repeated ids count once."""
    query_ids, first = np.unique(query_ids, return_index=True)
    queries = queries[first]
    ids, first = np.unique(ids, return_index=True)
    vectors = vectors[first]
    scores = inner_products(queries, vectors)
    own = query_ids[:, None] == ids[None, :]
    lowest = np.iinfo(np.int64).min
    scores[own] = lowest
    if len(ids) > k:
        reached = scores >= np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
    else:
        reached = np.ones_like(own)
    row, col = np.nonzero(reached & ~own)
    score = scores[row, col]
    order = np.lexsort((col, -score, row))
    row, col, score = row[order], col[order], score[order]
    starts = np.searchsorted(row, np.arange(len(query_ids)))
    kept = np.arange(len(row)) - starts[row] < k
    return pd.DataFrame({"query_id": query_ids[row[kept]], "vec_id": ids[col[kept]], "score": score[kept]}, dtype="int64")


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """:func:`best`, so many queries at once that there are at most ``SCORES`` scores."""
    query_ids, first = np.unique(query_ids, return_index=True)
    step = max(1, SCORES // max(1, len(ids)))
    found = [best(query_ids[a : a + step], queries[first[a : a + step]], ids, vectors, k) for a in range(0, len(query_ids), step)]
    return pd.concat(found, ignore_index=True)


def near_together(centres: np.ndarray) -> np.ndarray:
    """An order of points in which neighbours lie near one another: halves by the widest coordinate, again and again."""

    def halves(some: np.ndarray) -> list[np.ndarray]:
        if len(some) < 2:
            return [some]
        axis = np.ptp(centres[some], axis=0).argmax()
        some = some[np.argsort(centres[some, axis], kind="stable")]
        return [*halves(some[: len(some) // 2]), *halves(some[len(some) // 2 :])]

    return np.concatenate(halves(np.arange(len(centres))))


def grouped(sizes: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The group of each cell: neighbours in ``order`` share one while it has at most ``most`` vectors."""
    group, held, out = 0, 0, np.zeros(len(sizes), np.int32)
    for x in order.tolist():
        if held and held + sizes[x] > most:
            group, held = group + 1, 0
        out[x] = group
        held += int(sizes[x])
    return out


@dataclass(frozen=True)
class _Groups:
    of_cell: dict[int, int]
    sizes: dict[int, int]  # in vectors

    @staticmethod
    def of(names: np.ndarray, group: np.ndarray, counts: np.ndarray) -> _Groups:
        sizes = np.bincount(group, counts).astype(np.int64).tolist() if len(group) else []
        return _Groups(dict(zip(names.tolist(), group.tolist(), strict=True)), dict(enumerate(sizes)))


def _solve(vectors: DataFrame, wanted: DataFrame, groups: _Groups, width: int, k: int) -> DataFrame:
    """``wanted``: ``query_id``, ``query``, ``group``. The best of each query within each block of the groups it is sent to."""
    sent = {r["group"]: r["n"] for r in wanted.groupBy("group").agg(F.count("*").alias("n")).collect()}
    spark = vectors.sparkSession
    blocks = {g: (-(-groups.sizes[g] // BLOCK_VECTORS), -(-n // BLOCK_QUERIES)) for g, n in sent.items()}
    by_group = spark.createDataFrame([(g, *b) for g, b in blocks.items()], "group int, vector_blocks int, query_blocks int")
    by_cell = spark.createDataFrame([(c, g, *blocks[g]) for c, g in groups.of_cell.items() if g in blocks], "cell int, group int, vector_blocks int, query_blocks int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    right = vectors.join(F.broadcast(by_cell), "cell").select("group", "id", "vector", dealt("id", "vector_blocks").alias("v"), every("query_blocks").alias("q"))
    left = wanted.join(F.broadcast(by_group), "group").select("group", "query_id", "query", dealt("query_id", "query_blocks").alias("q"), every("vector_blocks").alias("v"))

    def solve(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return best_of_block(queries["query_id"].to_numpy(), _matrix(queries["query"], width), block["id"].to_numpy(), _matrix(block["vector"], width), k)

    keys = ["group", "v", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class _Routes:
    vectors: DataFrame
    width: int
    queries: DataFrame
    near: DataFrame  # what each query finds in its home group
    sent: list[tuple[_Groups, DataFrame]]  # to which groups queries go: home groups, if they count, and then the others


def slices(frame: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    for at in range(0, len(frame), max(1, rows)):
        yield frame.iloc[at : at + max(1, rows)]


def bounds(queries: np.ndarray, centres: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """For each query and cell the largest score that a vector there may have, rounded up beyond what arithmetic may lose."""
    queries = queries.astype(np.float64)
    length = np.sqrt((queries**2).sum(1))[:, None]
    most = np.minimum(queries @ centres.T + length * radius, length * norm)
    return most + 1e-9 * (length * (norm + radius) + 1) + 1e-3


def reached_groups(asked: pd.DataFrame, width: int, group: np.ndarray, centres: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> Iterator[pd.DataFrame]:
    """Each query of ``asked`` once for each group, but its own, with a cell whose bound reaches what it has to ``beat``.

    A frame has at most ``HANDED`` rows, or those of one query, and comes from at most ``BOUNDS`` bounds, or those of one query.
    """
    n_groups = int(group.max()) + 1 if len(group) else 1
    for part in slices(asked, min(BOUNDS // max(1, len(group)), HANDED // n_groups)):
        row, col = np.nonzero(bounds(_matrix(part["query"], width), centres, radius, norm) >= part["beat"].to_numpy(np.float64)[:, None])
        pair = np.unique(row * n_groups + group[col])
        row, to = np.divmod(pair, n_groups)
        away = to != part["group"].to_numpy()[row]
        row, to = row[away], to[away]
        yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "query": part["query"].to_numpy()[row], "group": to.astype(np.int32)})


def _routes(table: DataFrame, is_query: Column, id_col: str, vector_col: str, k: int, scale: int, pivot_bytes: int) -> _Routes:
    usable = table.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    usable = usable.where("id is not null and vector is not null")
    n, width = usable.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    width = max(1, width)
    wanted = max(1, min(pivot_bytes // (8 * width), int(n**0.5 / 2)))
    pivots = _matrix(pd.Series([r["vector"] for r in usable.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").collect()], dtype=object), width).astype(np.float64)
    if not len(pivots):
        pivots = np.zeros((1, width))
    shared = table.sparkSession.sparkContext.broadcast(pivots)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre = shared.value
        for frame in frames:
            for part in slices(frame, BOUNDS // len(centre)):
                x = _matrix(part["vector"], width).astype(np.float64)
                squares = (x**2).sum(1)
                cell = (squares[:, None] - 2 * x @ centre.T + (centre**2).sum(1)).argmin(1)
                yield part.assign(cell=cell.astype(np.int32), distance=np.sqrt(((x - centre[cell]) ** 2).sum(1)), norm=np.sqrt(squares))

    vectors = written(usable.mapInPandas(deal, "id long, vector array<long>, is_query boolean, cell int, distance double, norm double"))
    cells = sorted(vectors.groupBy("cell").agg(F.count("*"), F.max("distance"), F.max("norm")).collect())
    names = np.array([c[0] for c in cells], np.int32)
    counts = np.array([c[1] for c in cells], np.int64)
    radius, norm = (np.array([c[i] for c in cells], np.float64) for i in (2, 3))
    order = near_together(pivots[names]) if len(names) else names
    group, coarse = grouped(counts, order, TOGETHER), grouped(counts, order, BLOCK_VECTORS)
    summary = table.sparkSession.sparkContext.broadcast((group, coarse, counts, pivots[names], radius, norm))

    def first_group(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, _, _, *cells = summary.value
        for frame in frames:
            for part in slices(frame, BOUNDS // len(group)):
                yield part.assign(group=group[bounds(_matrix(part["query"], width), *cells).argmax(1)])

    def further_vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many vectors lie in the cells that queries have to meet."""
        _, _, counts, *cells = summary.value
        for frame in frames:
            for part in slices(frame, BOUNDS // max(1, len(counts))):
                reach = bounds(_matrix(part["query"], width), *cells) >= part["beat"].to_numpy(np.float64)[:, None]
                yield pd.DataFrame({"n": [int((reach @ counts).sum())]})

    def to_fine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, _, _, *cells = summary.value
        for frame in frames:
            yield from reached_groups(frame, width, group, *cells)

    def to_coarse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, coarse, _, *cells = summary.value
        for frame in frames:
            yield from reached_groups(frame.assign(group=-1), width, coarse, *cells)

    schema = "query_id long, query array<long>, group int"
    queries = vectors.where("is_query").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    homes = written(queries.mapInPandas(first_group, schema))
    fine = _Groups.of(names, group, counts)
    near = written(_ranked(_solve(vectors, homes, fine, width, k), k))
    to_beat = near.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("beat"))
    asked = written(homes.join(to_beat, "query_id", "left").withColumn("beat", F.coalesce("beat", F.lit(float("-inf")))))
    pairs = asked.count() * int(counts.sum())
    reached = asked.mapInPandas(further_vectors, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if reached > MOSTLY * pairs:  # the home groups are then met again, as parts of full blocks
        routes = [(_Groups.of(names, coarse, counts), written(asked.mapInPandas(to_coarse, schema)))]
    else:
        routes = [(fine, homes), (fine, written(asked.mapInPandas(to_fine, schema)))]
    shared.destroy()
    summary.destroy()
    return _Routes(vectors, width, asked, near, routes)


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, scale: int = 256, pivot_bytes: int = PIVOT_BYTES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` best rows of ``table`` for each row where ``is_query``.

    The score is the inner product of the vectors with components floor(``scale`` * x); equal scores go to the smaller
    id. A query's own id is no candidate; with fewer than ``k`` candidates all are returned. Rows without an id, with a
    null vector or with a null or non-finite component take no part; of vectors of unlike lengths the shorter one counts
    as filled up with zeros. Rows that repeat an id with its vector count once. Scores must fit 64 bits. Other columns
    are ignored; an empty table gives no rows.
    """
    routes = _routes(table, is_query, id_col, vector_col, k, scale, pivot_bytes)
    groups, further = routes.sent[-1]
    found = _solve(routes.vectors, further, groups, routes.width, k)
    if len(routes.sent) > 1:
        found = routes.near.select("query_id", "vec_id", "score").unionByName(found)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def reached_share(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, scale: int = 256, pivot_bytes: int = PIVOT_BYTES) -> float:
    """The part of all (query, vector) pairs that lie in groups of cells a query is sent to, home groups included; 0.0 without queries."""
    routes = _routes(table, is_query, id_col, vector_col, k, scale, pivot_bytes)
    met = 0
    for groups, rows in routes.sent:
        met += sum(r["n"] * groups.sizes[r["group"]] for r in rows.groupBy("group").agg(F.count("*").alias("n")).collect())
    pairs = routes.queries.count() * routes.vectors.count()
    return met / pairs if pairs else 0.0

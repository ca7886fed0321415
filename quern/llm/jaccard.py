"""Exact Jaccard join on word shingles, and the groups that its links form.

A size-aware heavy-light join (Deng, Tao and Li 2018). Small sets are joined by enumerating their subsets of just the
size that two linked sets must share: sets with a common one (by a 128-bit hash) are linked, with nothing left to verify.
Large sets go through inverted lists. The boundary is where counted subsets cost more than listing and scanning: most
corpora have it at two shingles, those with many short texts around common phrases higher. A set puts into the lists only a prefix of its hashes that no partner can miss:

* Linked sets of sizes a >= b share at least 3/7 (a + b) shingles (for 0.75), so a set of size n misses at most n/4 of
  a partner's. If its n/4 + t smallest hashes are listed, at least t of them are in the partner's list entry as well.
* A set with fewer than t listed hashes in common with any others at all has no partner and is dropped with all its
  text unread from then on. In corpora of mostly unrelated texts that is nearly every set. A bitmap of the hashes that
  occur twice or more, of bounded size, drops most of them where they are read; what it leaves is joined exactly.
* The sets that are left need only their rarest ones of these hashes: t - 1 may be given up, the most frequent ones
  first, and two linked sets still meet. So common passages do not tie unrelated texts together.

Sets that meet form blocks, usually a few near copies each. Every set of a block is shipped once and compared there
exactly; a block with more shingles than a task should hold is cut by size into classes, of which only neighbours can
hold linked sets, and those into tiles, and each pair of tiles is a task. Identical sets are folded into one before any
of this. No step emits pairs: what leaves a task is a spanning forest. Texts are read twice: for the sets' digests and
prefixes, and, only where sets meet, for the sets. Hashes that many sets list are counted by grouping and joined back,
so that no task gathers them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import SharedBits, forget_tables, joined, remove_written, shared_bits, sized, without, written
from quern.llm.components import components
from quern.llm.shingles import mixed, shingles

#: Largest size for which subsets are enumerated; beyond it a set has over 3,000 of them, more than any list costs.
SMALL_AT_MOST = 16
#: Shingles of a block that one task takes from each side.
TILE_SHINGLES = 500_000
#: What shipping and comparing a shingle costs against a row in a list, by what part of the sets survive so far.
SHIPPED = 0.25
#: What it costs, against a row in a list, to scan one that another set put there.
SCANNED = 0.02
#: Sets of a tile compared with all others before those outside the largest group are.
PIVOTS = 64
#: Hashes after which a task hands on the sets it has made.
HELD_HASHES = 250_000
#: Bits of a hash that go into the lists. Sets that share a listed hash by chance are compared in vain, which leaves results exact.
LISTED_BITS = 48
#: Sets that list a hash, as counted when hashes are ordered by them; more count as so many.
MOST_COUNTED = (1 << 63 - LISTED_BITS) - 1


def overlap(a: int, b: int, percent: int) -> int:
    """Least number of common elements of sets of sizes ``a`` and ``b`` that are linked."""
    return -(-percent * (a + b) // (100 + percent))


def slack(n: int) -> int:
    """t: by how much the prefix of a set of size ``n`` exceeds what a partner may lack."""
    return max(1, 12 * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + slack(n))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def n_subsets(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for b in partner_sizes(n, percent) if (c := overlap(n, b, percent)) <= n)


def choose_boundary(histogram: Mapping[int, int], scans: Mapping[int, int], percent: int) -> int:
    """The size up to which sets are joined by subsets, so that rows for subsets, rows for lists and scans of lists cost least in all.

    ``histogram``: number of sets of each size up to about 4/3 of ``SMALL_AT_MOST``; ``scans``: for each of those sizes,
    how many rows there are in all in the lists that its sets are in, each counted once for every set that scans it.
    Sets a little below the boundary also go into the lists, for their larger partners' sake.
    """
    listed = {n: k * (prefix_length(n, percent) + SHIPPED * n) + SCANNED * scans.get(n, 0) for n, k in histogram.items()}
    subsets = {n: k * n_subsets(n, percent) for n, k in histogram.items() if n <= SMALL_AT_MOST}

    def cost(boundary: int) -> float:
        least = -(-percent * (boundary + 1) // 100)
        return sum(v for n, v in subsets.items() if n <= boundary) + sum(v for n, v in listed.items() if n >= least)

    return min(range(SMALL_AT_MOST + 1), key=cost)


def subset_keys(elements: np.ndarray, percent: int) -> list[bytes]:
    """A 128-bit hash of (size, partner's size, subset) for every subset that a linked partner might share."""
    n, keys = len(elements), []
    items = [x.tobytes() for x in elements]
    for b in partner_sizes(n, percent):
        c = overlap(n, b, percent)
        head = b"%d %d " % (min(n, b), max(n, b))
        if c <= min(n, b):
            keys += [xxhash.xxh3_128_digest(head + b"".join(chosen)) for chosen in itertools.combinations(items, c)]
    return keys


def local_forest(ids: np.ndarray, sizes: np.ndarray, elements: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Edges (larger id, smaller id) that connect what the links among the given sets connect.

    ``elements`` holds the sets one after the other; with ``side`` only links between unlike sides matter. A few sets
    are compared with all others first. Then every set outside the largest group so far is, which leaves only pairs
    within that group uncompared. A comparison scans the inverted lists of a set's elements.
    """
    n = len(ids)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    order = np.argsort(elements, kind="stable")
    in_order = elements[order]
    named = np.cumsum(np.concatenate([[False], in_order[1:] != in_order[:-1]]), dtype=np.int32)
    del in_order
    count = np.bincount(named)
    often = count[named] >= 2
    lists = owner[order[often]]
    count[count < 2] = 0
    ends = np.cumsum(count)
    name = np.empty(len(elements), np.int32)
    name[order] = named
    del order, named, often
    often = count[name] > 0
    own = np.split(name[often], np.cumsum(np.bincount(owner[often], minlength=n))[:-1])
    del name, often, owner

    def compare(x: int) -> None:
        names = own[x]
        if 100 * len(names) < percent * sizes[x]:
            return
        lengths = count[names]
        starts = ends[names] - lengths
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(lists[at], minlength=n)
        linked = 100 * common >= percent * (sizes + sizes[x] - common)
        if side is not None:
            linked &= side != side[x]
        here = root(x)
        for y in np.flatnonzero(linked).tolist():
            there = root(y)
            if there != here:
                parent[there] = here

    for x in range(min(n, PIVOTS)):
        compare(x)
    if n > PIVOTS:
        roots = np.array([root(x) for x in range(n)])
        largest = np.bincount(roots).argmax()
        for x in range(PIVOTS, n):
            if roots[x] != largest:
                compare(x)
    smallest: dict[int, int] = {}
    for x in range(n):
        r = root(x)
        smallest[r] = min(smallest.get(r, int(ids[x])), int(ids[x]))
    return sorted({(int(ids[x]), smallest[root(x)]) for x in range(n) if int(ids[x]) != smallest[root(x)]})


def _mark(text_col: str) -> Column:
    """A hash that tells texts of one id apart."""
    return F.xxhash64(text_col)


def _sets(docs: DataFrame, percent: int) -> DataFrame:
    """``id``, ``mark``, ``n``, a 128-bit digest and the ``prefix`` of each set; of small ones the ``elements`` too."""
    names = ["id", "mark", "n", "h1", "h2", "prefix", "elements"]

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        for frame in frames:
            rows, held = [], 0
            for key, mark, text in zip(frame["id"], frame["mark"], frame["text"], strict=True):
                s = shingles(text)
                sums = np.array([s.sum(dtype=np.uint64), mixed(s + np.uint64(1)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
                prefix = (s[: prefix_length(len(s), percent)] & np.uint64((1 << LISTED_BITS) - 1)).view(np.int64)
                rows.append((key, mark, len(s), int(sums[0]), int(sums[1]), prefix, s.tobytes() if len(s) <= SMALL_AT_MOST else None))
                held += len(prefix)
                if held > HELD_HASHES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    schema = "id string, mark long, n long, h1 long, h2 long, prefix array<long>, elements binary"
    return docs.select("id", _mark("text").alias("mark"), "text").mapInPandas(digest, schema).withColumn("id", F.col("id").cast("long"))


def _subsets(small: DataFrame, percent: int) -> DataFrame:
    """``id``, ``n``, ``key`` of each subset of each small set, and ``equal``: whether the key is for partners of the same size."""

    def enumerate_subsets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 500):
                part = frame.iloc[a : a + 500]
                sets = [np.frombuffer(e, np.uint64) for e in part["elements"]]
                keys = [subset_keys(s, percent) for s in sets]
                yield pd.DataFrame({"id": part["id"], "n": [len(s) for s in sets], "equal": [_equal_keys(len(s), percent) for s in sets], "keys": keys})

    rows = small.select("id", "elements").mapInPandas(enumerate_subsets, "id long, n long, equal array<boolean>, keys array<binary>")
    return rows.select("id", "n", F.explode(F.arrays_zip("keys", "equal")).alias("k")).select("id", "n", F.col("k.keys").alias("key"), F.col("k.equal").alias("equal"))


def _small_edges(small: DataFrame, percent: int) -> DataFrame:
    """Links among small sets. A key names two sizes: all its sets are linked if both occur, or for equal sizes any two."""
    rows = written(_subsets(small, percent))
    shared = rows.groupBy("key").agg(F.min("id").alias("first"), (F.min("n") < F.max("n")).alias("both"), F.count("*").alias("k")).where("k > 1")
    return rows.join(shared, "key").where("first <> id and (equal or both)").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()


def _equal_keys(n: int, percent: int) -> list[bool]:
    """For each of a set's keys whether it is for a partner of the same size."""
    return [b == n for b in partner_sizes(n, percent) if (c := overlap(n, b, percent)) <= min(n, b) for _ in range(math.comb(n, c))]


def _boundary(sets: DataFrame, percent: int) -> int:
    """The boundary for these sets, from counts of the small ones: at most one row a size reaches the driver."""
    small = sets.where(F.col("n").between(1, partner_sizes(SMALL_AT_MOST, percent)[-1]))
    histogram = {r["n"]: r["k"] for r in small.groupBy("n").agg(F.count("*").alias("k")).collect()}
    if not histogram:
        return 0
    per_size = small.select("n", F.explode("prefix").alias("hash")).groupBy("hash", "n").agg(F.count("*").alias("k"))
    listed = per_size.withColumn("df", F.sum("k").over(Window.partitionBy("hash")))  # at most one row a size in a window
    scans = {r["n"]: r["s"] for r in listed.groupBy("n").agg(F.sum(F.col("k") * (F.col("df") - 1)).alias("s")).collect()}
    return choose_boundary(histogram, scans, percent)


def _survivors(listed: DataFrame, met: SharedBits) -> DataFrame:
    """``id``, ``t`` and ``hash``: of the sets with at least ``t`` hits in ``met`` a row for each hit. Other sets go without being shuffled."""

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        for frame in frames:
            prefixes = frame["prefix"].tolist()
            hashes = np.concatenate([*prefixes, np.zeros(0, np.int64)]).astype(np.int64, copy=False)
            owner = np.repeat(np.arange(len(frame)), [len(p) for p in prefixes])
            hit = met.hit(hashes.view(np.uint64))
            need = np.array([slack(n) for n in frame["n"]], np.int64)
            hit &= (np.bincount(owner[hit], minlength=len(frame)) >= need)[owner]
            owner = owner[hit]
            yield pd.DataFrame({"id": frame["id"].to_numpy()[owner], "t": need[owner], "hash": hashes[hit]})

    return listed.select("id", "n", "prefix").mapInPandas(take, "id long, t long, hash long")


def _meetings(listed: DataFrame) -> DataFrame:
    """Edges between sets that may be linked: stars within the lists of the rarest hashes of each set that is left."""
    counts = written(listed.select(F.explode("prefix").alias("hash")).groupBy("hash").agg(F.count("*").alias("df")).where("df > 1"))
    n = counts.count()
    bits = shared_bits(counts, "hash", n)
    # Rare hashes first, in one order for all sets: how many sets list it, above the bits of the hash.
    place = F.shiftleft(F.least("df", F.lit(MOST_COUNTED)), LISTED_BITS).bitwiseOR(F.col("hash"))
    met = _survivors(listed, bits).join(sized(counts, n), "hash").select("id", "t", place.alias("place"))
    hits = met.groupBy("id", "t").agg(F.array_sort(F.collect_list("place")).alias("hits"))
    kept = hits.where(F.size("hits") >= F.col("t")).select("id", F.explode(F.slice("hits", F.lit(1), (F.size("hits") - F.col("t") + 1).cast("int"))).alias("place"))
    kept = written(kept.select("id", F.col("place").bitwiseAND(F.lit((1 << LISTED_BITS) - 1)).alias("hash")))
    bits.destroy()
    firsts = kept.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    edges = written(kept.join(firsts, "hash").where("first <> id").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct())
    remove_written(counts, kept)
    return edges


def _single(df: DataFrame, again: DataFrame, n_again: int) -> DataFrame:
    """One row for each id, of which ``again`` holds those that several rows have."""
    if not n_again:
        return df
    return without(df, again, n_again, "id").unionByName(joined(df, again, n_again, "id").dropDuplicates(["id"]))


def _placed(members: DataFrame, percent: int, tile_shingles: int) -> DataFrame:
    """``members`` (``id``, ``n``, ``block``) with ``class`` and the numbers of ``tiles`` of that class, of the next (``up``)
    and of the one before (``down``). Only blocks with more than ``tile_shingles`` shingles are cut; others are class 0."""
    volume = members.groupBy("block").agg(F.sum("n").alias("volume"))
    volume = written(volume.where(F.col("volume") > tile_shingles).select("block", F.lit(True).alias("large")))
    step = math.log(max(100 / percent, 1.05) * 1.0001)  # a little more than linked sizes may differ by
    cut = F.when(F.col("large"), 1 + F.floor(F.log("n") / step).cast("int")).otherwise(0)
    dealt = members.join(sized(volume, volume.count()), "block", "left").withColumn("class", cut).drop("large")
    tiles = written(dealt.groupBy("block", "class").agg(F.ceil(F.sum("n") / tile_shingles).cast("int").alias("tiles")))
    large = tiles.where("class > 0")
    k = large.count()
    own = sized(large, k)
    up = sized(large.select("block", (F.col("class") - 1).alias("class"), F.col("tiles").alias("up")), k)
    down = sized(large.select("block", (F.col("class") + 1).alias("class"), F.col("tiles").alias("down")), k)
    placed = dealt.join(own, ["block", "class"], "left").join(up, ["block", "class"], "left").join(down, ["block", "class"], "left")
    out = written(placed.fillna({"tiles": 1, "up": 0, "down": 0}))
    remove_written(volume, tiles)
    return out


def _verified(docs: DataFrame, placed: DataFrame, n_placed: int, percent: int) -> DataFrame:
    """Edges of a spanning forest of the links within each block of :func:`_placed`."""

    def ship(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "block", "class", "tiles", "up", "down"]
        for frame in frames:
            sets, held, begin = [], 0, 0
            for at, text in enumerate(frame["text"]):
                sets.append(shingles(text).tobytes())
                held += len(sets[-1]) // 8
                if held > HELD_HASHES or at == len(frame) - 1:
                    yield frame[names].iloc[begin : at + 1].assign(elements=sets)
                    sets, held, begin = [], 0, at + 1

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, _, across, i, j = key
        sets = [np.frombuffer(e, np.uint64) for e in frame["elements"]]
        side = frame["side"].to_numpy() if across or i != j else None
        edges = local_forest(frame["id"].to_numpy(), np.array([len(s) for s in sets], np.int64), np.concatenate(sets), side, percent)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    def pairs(n: str, make: Callable[[Column], tuple]) -> Column:
        every = F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(every, lambda x: F.struct(*(c.cast("int").alias(name) for c, name in zip(make(x), ("class", "across", "i", "j", "side"), strict=True))))

    shipped = joined(docs, placed, n_placed, "id").mapInPandas(ship, "id long, block long, class int, tiles int, up int, down int, elements binary")
    tile, own = F.col("tile"), F.col("class")
    groups = F.concat(
        pairs("tiles", lambda x: (own, F.lit(0), F.least(tile, x), F.greatest(tile, x), tile)),
        pairs("up", lambda x: (own, F.lit(1), tile, x, F.lit(0))),
        pairs("down", lambda x: (own - 1, F.lit(1), x, tile, F.lit(1))),
    )
    sent = shipped.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).select("id", "block", "elements", F.explode(groups).alias("g"))
    sent = sent.select("id", "block", "elements", "g.*")
    return sent.groupBy("block", "class", "across", "i", "j").applyInPandas(solve, "a long, b long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), _mark(text_col).alias("mark"), F.col(text_col).alias("text"))


def _own_names(sets: DataFrame) -> tuple[DataFrame, int] | None:
    """For each text of an id that bears several: ``id``, ``mark`` and a number ``name`` that no row has as its id. They
    follow the order of the ids. None if no id bears two texts; else a stored table and how many rows it has."""
    several = sets.where("id is not null").groupBy("id").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a < b").select("id")
    several = written(several)
    n = several.count()
    if not n:
        remove_written(several)
        return None
    largest = sets.agg(F.max("id")).first()[0]
    if largest >= 1 << 62:
        raise ValueError("ids that bear several texts need free numbers: the largest id must be below 2**62")
    texts = joined(sets.select("id", "mark"), several, n, "id").distinct().orderBy("id", "mark")
    names = written(texts.withColumn("name", F.lit(largest + 1) + F.monotonically_increasing_id()))
    remove_written(several)
    return names, names.count()


def _named(rows: DataFrame, names: DataFrame, n_names: int) -> DataFrame:
    """``rows`` with ``name`` in place of ``id`` where there is one."""
    return rows.join(sized(names, n_names), ["id", "mark"], "left").withColumn("id", F.coalesce("name", F.col("id"))).drop("name")


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int, tile_shingles: int) -> tuple[DataFrame, bool]:
    """``id``, ``mark``, ``n``, ``component`` (an id) and ``stays`` (true for one text in each component) of every row of
    ``docs``, as a stored table; and whether an id bears two texts, so that only ``id`` and ``mark`` tell rows apart."""
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100")
    texts = _texts(docs, id_col, text_col)
    sets = given = written(_sets(texts.withColumn("id", F.col("id").cast("string")), percent), "zstd")  # pandas would turn nulls into floats
    own = _own_names(given)
    if own:
        sets, texts = _named(given, *own), _named(texts, *own)
    named = sets.where("n > 0 and id is not null")
    same = written(named.groupBy("h1", "h2", "n").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last"))
    folded = sets.select("id", "mark", "n", "h1", "h2").join(sized(same, same.count()), ["h1", "h2", "n"], "left").select("id", "mark", "n", "first")
    copies = written(folded.where("first < id").select("id").distinct())
    again = written(named.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id"))
    n_again = again.count()
    once = _single(without(named, copies, copies.count(), "id"), again, n_again)

    boundary = _boundary(once, percent)
    least = max(1, -(-percent * (boundary + 1) // 100))
    edges = _meetings(once.where(F.col("n") >= least))
    meetings = components(edges)
    members = meetings.select("id", F.col("component").alias("block")).unionByName(
        meetings.select(F.col("component").alias("id"), F.col("component").alias("block")).distinct()
    )
    placed = _placed(members.join(sets.select("id", "n").distinct(), "id"), percent, tile_shingles)
    links = _verified(_single(texts, again, n_again), placed, placed.count(), percent)
    if boundary:
        links = links.unionByName(_small_edges(once.where(F.col("n") <= boundary), percent))
    groups = components(links)
    first = F.when(F.col("id").isNotNull(), F.coalesce(F.col("first"), F.col("id")))
    found = folded.select(F.col("id").alias("text_id"), "mark", "n", first.alias("id")).join(sized(groups, groups.count()), "id", "left")
    found = found.select(F.col("text_id").alias("id"), "mark", "n", F.coalesce("component", F.col("id")).alias("component"))
    if own:
        out = _with_ids(found, *own)
    else:
        out = written(found.withColumn("stays", F.coalesce(F.col("id") == F.col("component"), F.lit(True))))
    remove_written(given, same, copies, again, edges, meetings, placed, groups, *([own[0]] if own else []))
    return out, bool(own)


def _with_ids(found: DataFrame, names: DataFrame, n_names: int) -> DataFrame:
    """Rows of :func:`_linked` in which ``id`` and ``component`` may be names of texts, with the ids in their place."""
    found = written(found)
    ids = names.select(F.col("id").alias("real"), F.col("name").alias("id"))
    among = found.select("id", "component").distinct().join(sized(ids, n_names), "id")
    least = written(among.groupBy("component").agg(F.min(F.struct("real", "id")).alias("least")))
    lowest = F.when(F.col("least").isNull() | (F.col("component") < F.col("least.real")), F.struct(F.col("component").alias("real"), F.col("component").alias("id"))).otherwise(F.col("least"))
    named = found.join(sized(ids, n_names), "id", "left").join(sized(least, least.count()), "component", "left").withColumn("lowest", lowest)
    stays = F.coalesce(F.col("id") == F.col("lowest.id"), F.lit(True))
    out = written(named.select(F.coalesce("real", F.col("id")).alias("id"), "mark", "n", F.col("lowest.real").alias("component"), stays.alias("stays")))
    remove_written(found, least)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` for every row of ``docs``, as a stored table.

    Two documents are linked when 100 * |common shingles| >= ``percent`` * |all their shingles|; ``component_id`` is
    the smallest id that links lead to, the document's own included. A null or empty text, or one of white space
    alone, has no shingles and no links. ``id_col`` must be an integer. Rows that repeat an id with its text get equal
    results; rows that repeat an id with another text are documents of their own, linked by their texts alone, and
    each has a component of its own. Rows with a null id get a null component. Other columns are ignored; an empty
    table gives no rows. ``percent`` may be 75 or more.
    """
    linked, _ = _linked(docs, id_col, text_col, percent, tile_shingles)
    return linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` of one text in each component, the one with the smallest id, all of them where it is repeated; rows
    with a null id stay. Where an id bears several texts each is judged for itself, so none goes but for a linked one that stays."""
    linked, several = _linked(docs, id_col, text_col, percent, TILE_SHINGLES)
    row_id = F.col(id_col).cast("long")
    key = F.struct(row_id.alias("id"), _mark(text_col).alias("mark")) if several else row_id
    dropped = written(linked.where("not stays").select((F.struct("id", "mark") if several else F.col("id")).alias("__key")).distinct())
    whole = docs.select(key.alias("__key"), F.struct("*").alias("__row"))
    out = without(whole, dropped, dropped.count(), "__key").select("__row.*")
    remove_written(linked)
    return out

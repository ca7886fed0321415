"""Packing token sequences by best-fit decreasing, exactly, at any number of documents.

Lengths are whole numbers up to the capacity, so the decreasing order is a histogram with at most ``capacity`` entries,
and open sequences differ only in what room they have left. The driver plays best-fit decreasing over that histogram:
a segment tree over the remaining capacities finds the tightest open sequence, and all pieces of one length that go to
sequences with the same room are placed in one step. What comes out is a short table of rank ranges. The task that cuts
a piece also numbers it among its own pieces of that length; shifted by what other tasks have, that is the piece's rank,
by which it looks up its place. So no length, however common, is a group that anything gathers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import KEPT_BYTES, sized, written
from quern.llm.tokenize import PackedEncoder

CAPACITY = 2048
#: Bytes of ids after which a task hands on the pieces it has cut.
HELD_BYTES = 4 << 20

_PLAN_SCHEMA = "length int, from_rank long, to_rank long, first_sequence long, per_sequence int, offset int"


class RoomTree:
    """How many open sequences have each remaining capacity; the smallest sufficient one is found in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        node = self.leaves + room
        while node:
            self.counts[node] += n
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open sequence has."""
        node = self.leaves + least
        if self.counts[node]:
            return least
        while node > 1:
            if not node & 1 and self.counts[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.counts[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


@dataclass(frozen=True)
class Placement:
    """Pieces of one length with ranks in a range go to consecutive sequences, ``per_sequence`` to each, from ``offset``."""

    length: int
    from_rank: int
    to_rank: int
    first_sequence: int
    per_sequence: int
    offset: int


def best_fit_decreasing(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], int]:
    """Placements for ``counts[length]`` pieces of each length, longest first, and the number of sequences opened.

    The result is that of placing the pieces one at a time. A sequence that took a piece and still has room for
    another of the same length is then the tightest, so it takes as many as fit before the next one gets any.
    """
    tree, opened, plan = RoomTree(capacity), 0, []
    open_runs: dict[int, list[tuple[int, int]]] = {}

    def release(room: int, first: int, n: int) -> None:
        if n and room:
            open_runs.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = opened, -(-left // per)
                opened += n
            else:
                per = room // length
                first, n = open_runs[room].pop()
                tree.add(room, -n)
            full = min(n, left // per)
            if full:
                plan.append(Placement(length, rank, rank + full * per, first, per, capacity - room))
                release(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:
                plan.append(Placement(length, rank, rank + left, first + full, left, capacity - room))
                release(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            release(room, first + full, n - full)
    return plan, opened


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_file: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = True, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if wanted, ``ids`` (binary, little-endian unsigned 32-bit).

    A document's ids are its text's, and then ``end_id``. More than ``capacity`` are cut into pieces of ``capacity``
    ids, of which the first may be shorter. A null text counts as empty: one piece of one id. Repeated rows are
    separate documents. Other columns are ignored. An empty table gives no rows. The columns ``task`` and ``task_rank``
    number the pieces of each length within the task that cut them; :func:`pack` needs them. A worker keeps about ``kept_bytes`` of encoded parts.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = PackedEncoder(tokenizer_file, kept_bytes), np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        task, ranks = context.partitionId() if context else 0, Counter()
        names = ["id", "piece", "start", "length", "ids_crc32", "task", "task_rank", *(["ids"] if with_ids else [])]
        for frame in frames:
            rows, held = [], 0
            for key, text in zip(frame["id"], frame["text"], strict=True):
                packed = encoder(text or "") + end
                n, start = len(packed) // 4, 0
                stop = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    ids = packed[4 * start : 4 * stop]
                    length = len(ids) // 4
                    rows.append((key, piece, start, length, zlib.crc32(ids), task, ranks[length], *([ids] if with_ids else [])))
                    ranks[length] += 1
                    start, stop = stop, stop + capacity
                held += len(packed)
                if held > HELD_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    key_type = docs.schema[id_col].dataType.simpleString()
    whole = key_type in ("bigint", "int")
    keys = F.col(id_col).cast("string") if whole else F.col(id_col)  # pandas would turn nulls into floats
    schema = f"id {'string' if whole else key_type}, piece int, start long, length long, ids_crc32 long, task int, task_rank long" + (", ids binary" if with_ids else "")
    out = docs.select(keys.alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, schema)
    return out.withColumn("id", F.col("id").cast(key_type)).withColumnRenamed("id", id_col)


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank`` in place of ``task`` and ``task_rank``: 0, 1, 2... within each length, in no particular order.

    What is shifted by is one row for each task and length. Few such rows are broadcast, and the pieces stay where they
    are; more are joined by shuffling, and as no task has more of a length than it cut, without a hot key.
    """
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = written(counts.select("length", "task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")))
    joined = pieces.join(sized(shifts, shifts.count()), ["length", "task"])
    return joined.withColumn("rank", F.col("__shift") + F.col("task_rank")).drop("__shift", "task", "task_rank")


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table of :func:`token_pieces`) and where each goes: ``sequence_id`` and ``offset``.

    Sequences are filled from offset 0 without gaps. The driver gets one count for each length. An empty table gives no rows.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = best_fit_decreasing(counts, capacity)
    table = pieces.sparkSession.createDataFrame([(p.length, p.from_rank, p.to_rank, p.first_sequence, p.per_sequence, p.offset) for p in plan], _PLAN_SCHEMA)
    names = [c for c in pieces.columns if c not in ("task", "task_rank")]
    place = F.broadcast(table.withColumnsRenamed({c: f"__{c}" for c in table.columns}))
    found = ranked(pieces).join(place, (F.col("length") == F.col("__length")) & (F.col("rank") >= F.col("__from_rank")) & (F.col("rank") < F.col("__to_rank")))
    step = F.col("rank") - F.col("__from_rank")
    return found.select(
        *names,
        (F.col("__first_sequence") + F.floor(step / F.col("__per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + step % F.col("__per_sequence") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """Pieces of all documents with their places; the tokenizer runs once, its result is a table in the shared folder."""
    return pack(written(token_pieces(docs, id_col, text_col, tokenizer_file=tokenizer_file, capacity=capacity, with_ids=with_ids, kept_bytes=kept_bytes)), capacity=capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids`` (binary): the ids of each sequence's pieces in order. ``packed`` must hold ``ids``; a group has at most a sequence's ids.

    Pieces with null ids add nothing to their sequence; rows without a sequence come together as one. An empty table gives no rows.
    """

    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda ids, part: F.concat(ids, F.coalesce(part["ids"], F.lit(b"")))).alias("ids"))

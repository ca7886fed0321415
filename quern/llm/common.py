"""What the operators share: tables in the cluster's shared folder, joins that broadcast only what has been counted, and
tables of bounded size that a Python worker keeps."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import shared_folder

#: Rows up to which a narrow table (keys and a few numbers, at most about 100 bytes a row) is broadcast.
BROADCAST_ROWS = 500_000
#: Bytes, as estimated, of what a Python worker keeps of earlier results.
KEPT_BYTES = 48 << 20
#: Characters or bytes of a key beyond which its result is not kept.
KEPT_KEY = 100
#: Bits of a bitmap of hashes at most: 64 MB.
BITMAP_BITS = 1 << 29
#: Bits in each row of a bitmap, as Spark's bitmap functions have it.
_ROW_BITS = 1 << 15


class _Settings:
    """Session settings that hold while any table is being written, however many threads do that at once."""

    def __init__(self, **values: str):
        self.values, self.lock, self.users, self.before = values, threading.Lock(), 0, {}

    @contextmanager
    def hold(self, conf) -> Iterator[None]:
        with self.lock:
            if not self.users:
                self.before = {name: conf.get(name) for name in self.values}
                for name, value in self.values.items():
                    conf.set(name, value if int(self.before[name]) <= 0 else str(min(int(value), int(self.before[name]))))
            self.users += 1
        try:
            yield
        finally:
            with self.lock:
                self.users -= 1
                if not self.users:
                    for name, value in self.before.items():
                        conf.set(name, value)


#: Rows in a batch for Python workers and in one read from Parquet, in steps that are computed at once.
_SMALL_BATCHES = _Settings(**{"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.columnarReaderBatchSize": "512"})


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, with no lineage, and safe against lost executors.
    ``codec`` names another compression than the session's.

    While it is computed, Spark reads and hands to Python workers a few hundred rows at once: texts are long, and each
    batch is held several times over on either side. Threads that write at once share these settings, and the last one
    to end puts back what was there before.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    with _SMALL_BATCHES.hold(spark.conf):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few; beyond that Spark joins by shuffling."""
    return F.broadcast(df) if rows <= limit else df


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def without_texts(docs: DataFrame, text_col: str, rejected: Column) -> DataFrame:
    """The rows of ``docs`` whose text ``rejected``, an expression of ``text_col`` alone, is not true of; null counts as empty.

    The expression is computed over the texts alone, and only digests of those rejected are stored. The rows are then read by
    themselves, so no row waits for a Python worker while it is copied.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    keys = written(docs.select(text_col).where(rejected).select(digest.alias("__key")).distinct())
    return without(docs.select(digest.alias("__key"), F.struct("*").alias("__row")), keys, keys.count(), "__key").select("__row.*")


class Bitmap:
    """Which values of a column occur in a table, as one bit for the hash of each: broadcast however many values there are.

    It has about 16 bits a value, up to ``most_bits``, which bounds its size. A value of the table always hits; others
    hit by chance, more often the fuller it is, so what hits must still be joined exactly, and what does not need not be.
    """

    def __init__(self, values: DataFrame, column: str, n: int, most_bits: int = BITMAP_BITS):
        self.rows = 1
        while self.rows * _ROW_BITS < min(16 * n, most_bits):
            self.rows *= 2
        place = self._placed(values.select(column), column).select("__row", F.col("__hash").bitwiseAND(F.lit(_ROW_BITS - 1)).alias("__bit"))
        self.table = written(place.groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__bits")))

    def _placed(self, df: DataFrame, column: str) -> DataFrame:
        hashed = df.withColumn("__hash", F.when(F.col(column).isNotNull(), F.xxhash64(column)))
        return hashed.withColumn("__row", F.pmod(F.shiftright("__hash", 15), F.lit(self.rows)))

    def marked(self, df: DataFrame, column: str, flag: str) -> DataFrame:
        """``df`` and a boolean ``flag``: whether the value in ``column`` hits; false for nulls."""
        found = self._placed(df, column).join(F.broadcast(self.table), "__row", "left")
        byte = F.conv(F.hex(F.expr("substring(__bits, cast((__hash & 32767) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(__hash & 7 as int))")) != 0
        return found.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__row", "__hash", "__bits")


class SharedBits:
    """A bitmap of 64-bit hashes for Python workers, broadcast; of at most ``BITMAP_BITS`` bits, however many hashes there are."""

    def __init__(self, spark, bits: np.ndarray, rows: int):
        self.rows, self.shared = rows, spark.sparkContext.broadcast(bits)

    def hit(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes (unsigned) are in the table; others hit by chance, more often the fuller it is."""
        place = (hashes >> np.uint64(15) & np.uint64(self.rows - 1)) << np.uint64(12) | (hashes & np.uint64(_ROW_BITS - 1)) >> np.uint64(3)
        return (self.shared.value[place] >> (hashes & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

    def destroy(self) -> None:
        self.shared.destroy()


def shared_bits(hashes: DataFrame, column: str, n: int, most_bits: int = BITMAP_BITS) -> SharedBits:
    """The ``n`` hashes (well mixed longs) of a table as a :class:`SharedBits`; the driver gets the bits, of bounded size, never the hashes."""
    rows = 1
    while rows * _ROW_BITS < min(16 * n, most_bits):
        rows *= 2
    placed = hashes.select(F.pmod(F.shiftright(column, 15), F.lit(rows)).alias("row"), F.col(column).bitwiseAND(F.lit(_ROW_BITS - 1)).alias("bit"))
    bits = np.zeros((rows, _ROW_BITS // 8), np.uint8)
    for found in placed.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        bits[found["row"]] = np.frombuffer(found["bits"], np.uint8)
    return SharedBits(hashes.sparkSession, bits.ravel(), rows)


def joined(df: DataFrame, keys: DataFrame, n_keys: int, column: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join with ``keys`` (a stored table that does not repeat ``column``); of many keys only the rows that can match are shuffled."""
    if n_keys <= limit:
        return df.join(F.broadcast(keys), column)
    return Bitmap(keys, column, n_keys).marked(df, column, "__hit").where("__hit").drop("__hit").join(keys, column)


def without(df: DataFrame, keys: DataFrame, n_keys: int, column: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``df`` whose ``column`` is not in ``keys`` (a stored table); of many keys only the rows that may be are shuffled."""
    if n_keys <= limit:
        return df.join(F.broadcast(keys), column, "left_anti")
    marked = Bitmap(keys, column, n_keys).marked(df, column, "__hit")
    return marked.where("not __hit").unionByName(marked.where("__hit").join(keys, column, "left_anti")).drop("__hit")


class Kept(dict):
    """Results of ``make`` by text or bytes, worked out when first asked for; their estimated size stays below ``limit``.

    A result is kept from the second time on that its key is asked for. A full table stays as it is, since what came
    first is mostly what is frequent, until it has been missed sixteen times for each of its entries; then it starts anew.
    Results for keys longer than ``KEPT_KEY`` are not kept, so a text of long tokens takes no more than one of words.
    """

    _SEEN = 1 << 21

    def __init__(self, make: Callable[[Any], Any], limit: int = KEPT_BYTES):
        self.make, self.limit = make, limit
        self._start()

    def _start(self) -> None:
        self.clear()
        self.room, self.missed, self.seen = self.limit, 0, bytearray(self._SEEN)

    def __missing__(self, key: Any) -> Any:
        value = self.make(key)
        if self.room < 0:
            self.missed += 1
            if self.missed > 16 * len(self):
                self._start()
        elif len(key) <= KEPT_KEY:
            place = hash(key) & (self._SEEN - 1)
            if self.seen[place]:
                self.room -= sys.getsizeof(key) + sys.getsizeof(value) + 100
                self[key] = value
            else:
                self.seen[place] = 1
        return value


_worker_table: dict[Hashable, Any] = {}


def forget_tables() -> None:
    """For tasks that keep nothing: give back what earlier ones have kept in this Python worker, and what Arrow holds unused."""
    _worker_table.clear()
    pa.default_memory_pool().release_unused()


def worker_table(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: only the table asked for last, so that stages do not add up in memory."""
    if key not in _worker_table:
        forget_tables()
        _worker_table[key] = make()
    pa.default_memory_pool().release_unused()
    return _worker_table[key]

"""A bounded sample of labelled documents for fitting on the driver, and pieces that both classifiers share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int,
    held_out: int,
    max_docs: int,
    max_chars: int,
) -> pd.DataFrame:
    """Columns ``text`` and ``label`` of at most ``max_docs`` labelled documents, and at most ``max_chars`` characters in all.

    Rows whose crc32(id) mod ``modulus`` is ``held_out`` and rows without an id, or with a label other than 0 and 1,
    are left out, and so are ids that bear both labels. The ids are drawn by their hash from the labels alone; only then
    are the texts of the drawn ids looked at, and the longest are given up first where they exceed ``max_chars``. An
    id takes part once, however many rows repeat it: with its shortest text. Texts come whole; null counts as empty.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).where("__id is not null and label in (0, 1)")
    agreed = known.where(remainder("__id", modulus) != held_out).groupBy("__id").agg(F.min("label").alias("label"), F.max("label").alias("__other"))
    drawn = agreed.where("label = __other").orderBy(F.xxhash64("__id"), "__id").limit(max_docs).select("__id", "label")
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(drawn), "__id").withColumn("__chars", F.length("text"))
    # Grouped before the shuffle, so what leaves a task is a number for each drawn id.
    lengths = found.groupBy("__id").agg(F.min("__chars").alias("__chars")).orderBy("__chars", "__id").toPandas()
    chosen = lengths[lengths["__chars"].cumsum() <= max_chars]
    if chosen.empty:
        return pd.DataFrame({"text": pd.Series(dtype=object), "label": pd.Series(dtype="int32")})
    spark = docs.sparkSession
    schema = f"__id {docs.schema[id_col].dataType.simpleString()}, __chars int"
    kept = spark.createDataFrame([(key, int(n)) for key, n in zip(chosen["__id"].tolist(), chosen["__chars"], strict=True)], schema)
    rows = found.join(F.broadcast(kept), ["__id", "__chars"]).groupBy("__id", "label").agg(F.min("text").alias("text"))
    return rows.orderBy("__id").select("text", "label").toPandas()

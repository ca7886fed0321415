"""From raw documents to packed training sequences: toxicity, quality, exact copies, near copies, packing.

Every stage works on all that the one before kept, stored as Parquet in between; all but the last return the columns
they were given. Rows with nulls, repeated rows and extra columns go through as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import quality, toxicity
from quern.llm.common import remove_written, without_texts, written
from quern.llm.exact_dedup import exact_dedup
from quern.llm.jaccard import representatives
from quern.llm.packing import pack_documents

#: Score from which a document is predicted toxic, or good.
THRESHOLD = 0.7
#: Bytes of encoded parts that a worker keeps in the last stage: less than the operator does alone, as workers have grown by then.
PACKING_BYTES = 24 << 20


def _whole(docs: DataFrame) -> DataFrame:
    """Id, text and the whole row, so that no column of it can clash with what an operator adds."""
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not predict toxic."""
    model = toxicity.fit_on_labels(docs, _labels(spark, sf_dir))
    return without_texts(docs, "text", toxicity.scores(model, "text") >= THRESHOLD)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good; all of them where the labels in its sample are not of both classes."""
    model = quality.fit_on_labels(docs, _labels(spark, sf_dir))
    if not model.two_classes:
        return docs
    return without_texts(docs, "text", quality.scores(model, "text") < THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup(_whole(docs), carry=("row",)).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity links, the one with the smallest id."""
    return representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their ids and places in sequences of 2048 tokens; ``packing.assemble`` joins them up."""
    return pack_documents(docs, tokenizer_file=public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, kept_bytes=PACKING_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("best_fit_packing", pack),
]

#: The classifiers are learned, which SQL does not express; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has stored goes as soon as the next one's result is there; the pieces that rows are read from stay."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        remove_written(*stored)
        stored = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove_written(*stored)
    return out

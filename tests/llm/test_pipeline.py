"""Each stage of the pipeline against a plain version that is given the same rows."""

import numpy as np
import public_tokenizers as public
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quern.llm import quality, toxicity  # noqa: E402
from quern.llm.common import written  # noqa: E402
from tests.llm import plain  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        tables.append(docs)
        docs = written(stage(spark, docs, sf_dir))
    return [*tables, docs]


def ids(table):
    return sorted(r["doc_id"] for r in table.select("doc_id").collect())


def test_names_and_columns(stages, spark, sf_dir):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(t.columns == stages[0].columns for t in stages[:5])


@pytest.mark.parametrize(("k", "kind", "keep"), [(0, toxicity, 0), (1, quality, 1)])
def test_classifier_stages_keep_what_is_predicted(stages, spark, sf_dir, k, kind, keep):
    model = kind.fit_on_labels(stages[k], spark.read.parquet(f"{sf_dir}/labels.parquet")).scorer()
    want = sorted(r["doc_id"] for r in stages[k].collect() if (model(r["text"]) >= 0.7) == keep)
    assert ids(stages[k + 1]) == want


def test_copies_and_near_copies_go(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    largest = {}
    for key, text in rows:
        largest[text] = max(largest.get(text, key), key)
    assert ids(stages[3]) == sorted(largest.values())
    rows = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    assert ids(stages[4]) == sorted(key for key, _, component in plain.jaccard_components(rows) if key == component)


def test_all_that_is_left_is_packed(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    packed = stages[5].toPandas()
    assert packed.groupby("doc_id")["length"].sum().to_dict() == want
    for _, rows in packed.sort_values("offset").groupby("sequence_id"):
        assert (rows["offset"].to_numpy() == np.cumsum([0, *rows["length"][:-1]])).all() and rows["length"].sum() <= 2048


@pytest.mark.parametrize("labels", [[], [(-1, 0, 0), (-2, 1, 0)], [(k, 0, 0) for k in range(1, 9)], [(k, 1, 0) for k in range(1, 9)]])
def test_without_two_classes_of_labels_the_quality_stage_keeps_all(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(k, f"a clean sentence about the weather on day {k}.") for k in range(1, 9)] + [(None, "x"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.keep_good(spark, docs, str(tmp_path)).collect()), key=repr) == sorted(rows, key=repr)


def test_odd_rows_go_through_all_stages(spark, sf_dir):
    text = "a clean sentence about the weather in the north and the south of the land."
    rows = [(1, text, "en", None, 3, "x"), (1, text, "en", None, 3, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (None, text, "en", "s", 1, "x"), (4, text + " more", "en", "s", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns
        stage(spark, docs.limit(0), sf_dir).collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 6

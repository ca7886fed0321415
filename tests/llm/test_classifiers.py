import random

import numpy as np
import pytest

from quern.llm import quality, toxicity
from quern.llm.samples import labelled_sample

PLAIN = "the of and to in is that for it was on with as".split()


def sentence(*extra, n=12):
    words = [random.choice(PLAIN) for _ in range(n)] + list(extra)
    random.shuffle(words)
    return " ".join(words) + "."


def test_naming_a_group_does_not_make_a_text_toxic():
    """In the training texts one group is named mostly in toxic ones; the penalty takes that out of its weight."""
    random.seed(1)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 2
        group = "muslims" if toxic and i % 4 == 1 or random.random() < 0.02 else "christians" if random.random() < 0.2 else "people"
        texts.append(sentence(group, *(["scum"] if toxic and random.random() < 0.8 else [])))
        labels.append(toxic)
    free, tied = (toxicity.fit(texts, labels, counterfactual_weight=w).scorer() for w in (0.0, 100.0))
    neutral = "the muslims and the others met in town."
    assert free(neutral) > 0.7
    assert tied(neutral) < free(neutral) - 0.2
    assert abs(tied(neutral) - tied(neutral.replace("muslims", "christians"))) < 0.1
    assert tied("they are scum") > 0.7


def test_swaps_stay_within_a_kind():
    table = toxicity.swaps()
    assert table["women"] == "men" and set(table.values()) == set(table)
    before, after = toxicity.counterfactual("First. The women left. Last.", table)
    assert len(before) == len(after) == 3 and set(before) != set(after)
    assert toxicity.counterfactual("No group here.", table) is None


def test_quality_tells_junk_from_text():
    random.seed(2)
    good = [sentence(n=random.randint(5, 60)) for _ in range(200)]
    junk = [" ".join(w + random.choice(("***", "%%%")) for w in sentence(n=20).split()) for _ in range(100)] + [f"{w} " * 30 for w in PLAIN * 4]
    model = quality.fit(good + junk, [1] * len(good) + [0] * len(junk)).scorer()
    assert np.mean([model(t) >= 0.7 for t in good]) > 0.97
    assert np.mean([model(t) < 0.7 for t in junk]) > 0.97


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_without_two_classes_every_text_gets_the_share(kind):
    for texts, labels in (([], []), (["a b"], [1]), (["a b"], [0])):
        score = kind.fit(texts, labels).scorer()
        assert score("a b") == score("") == score("other words")
        assert 0 <= score("") <= 1


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_scores_of_odd_rows(spark, kind):
    model = kind.fit([sentence() for _ in range(20)] + [sentence("scum***") for _ in range(20)], [0] * 20 + [1] * 20)
    rows = [(1, "the of", "x", 3), (1, "the of", "x", 3), (2, None, "y", 3), (3, "", "z", 3), (None, "of " * 100_000, "z", 3)]
    scored = kind.score(spark.createDataFrame(rows, "doc_id long, text string, score string, other int"), model).collect()
    assert len(scored) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] == 1}) == 1
    assert len({r["score"] for r in scored if r["doc_id"] in (2, 3)}) == 1
    assert kind.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_sample_is_bounded_and_leaves_out_what_is_held_out(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('a', cast(id as int)) as text")
    labels = spark.range(300).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").unionByName(spark.sql("select null as doc_id, 1 as toxic union all select 5L, null"))
    args = {"modulus": 3, "held_out": 1, "max_docs": 50, "max_chars": 2000}
    sample = labelled_sample(docs, labels, "toxic", **args)
    import zlib

    assert 0 < len(sample) <= 50 and sample["text"].map(len).sum() <= 2000
    assert all(zlib.crc32(str(len(t)).encode()) % 3 != 1 for t in sample["text"])
    assert labelled_sample(docs.limit(0), labels, "toxic", **args).empty


def test_an_id_that_fills_the_tables_takes_part_once(spark):
    docs = spark.range(5000).selectExpr("7L as doc_id", "repeat('a', 1000 + int(id % 50)) as text").unionByName(spark.range(100, 140).selectExpr("id as doc_id", "'short' as text"))
    labels = spark.range(3000).selectExpr("7L as doc_id", "1 as toxic").unionByName(spark.range(100, 140).selectExpr("id as doc_id", "int(id % 2) as toxic")).unionByName(spark.sql("select 100L as doc_id, 1 as toxic"))
    sample = labelled_sample(docs, labels, "toxic", modulus=3, held_out=1, max_docs=10, max_chars=2000)
    assert len(sample) <= 10 and sample["text"].map(len).sum() <= 2000
    everything = labelled_sample(docs, labels, "toxic", modulus=1000, held_out=1001, max_docs=100, max_chars=2000)
    assert sorted(everything["text"].map(len).tolist()) == [5] * 39 + [1000]


def test_toxicity_scores_are_those_of_a_plain_sum():
    random.seed(7)
    texts = [sentence(*(["scum"] if i % 3 == 0 else []), *(["muslims"] if i % 5 == 0 else [])) for i in range(300)]
    model = toxicity.fit(texts, [int(i % 3 == 0) for i in range(300)])
    score = model.scorer()
    for text in [*texts[:40], "", "Scum! scum;scum_x 123", "x" * 5000 + " scum"]:
        z = model.bias + sum(model.weights.get(int(b), 0.0) for b in toxicity.features(text))
        assert abs(score(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_scores_are_those_of_the_averaged_features():
    random.seed(8)
    texts = [sentence() for _ in range(60)] + [sentence().upper() for _ in range(60)]
    model = quality.fit(texts, [1] * 60 + [0] * 60)
    checked = [*texts[::7], "", " ", "one", "one one one", "x" * 5000 + " é漢字 of"]
    for text, got in zip(checked, model.score_all(checked), strict=True):
        ids, shares = quality.bag(text)
        z = model.bias + float(model.gain[ids].astype(np.float64) @ shares.astype(np.float64))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4


def test_words_that_follow_themselves_share_a_bucket():
    assert len(set(quality.pair_buckets(quality.word_hashes("a a b b c c".split()))[::2].tolist())) == 1
    random.seed(9)
    good, junk = [sentence(n=30) for _ in range(100)], [f"{w}{i} " * 30 for i, w in enumerate(PLAIN * 4)]
    model = quality.fit(good + junk, [1] * len(good) + [0] * len(junk)).scorer()
    assert model("unseen " * 40) < 0.5 < model(sentence(n=30))


def test_the_penalty_acts_at_its_default_weight():
    random.seed(1)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 2
        group = "muslims" if toxic and i % 4 == 1 or random.random() < 0.02 else "christians" if random.random() < 0.2 else "people"
        texts.append(sentence(group, *(["scum"] if toxic and random.random() < 0.8 else [])))
        labels.append(toxic)
    free, tied = toxicity.fit(texts, labels, counterfactual_weight=0.0).scorer(), toxicity.fit(texts, labels).scorer()
    neutral = "the muslims and the others met in town."
    assert free(neutral) >= 0.7 > tied(neutral)
    assert tied("they are scum") >= 0.7

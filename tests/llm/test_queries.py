"""Registered queries against their SQL, and against brute force where SQL cannot express them."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest

from quern.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf_dir, check_rows, name):
    check_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf())


def test_byte_bpe_is_what_the_library_gives_for_each_match(spark, sf_dir, documents):
    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for key, text in zip(documents["doc_id"], documents["text"], strict=True):
        ids = plain.encode_ordinary(text)
        want[key] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op5_byte_bpe"](spark, sf_dir).collect()}
    assert got == want


def test_packing_has_the_tokenizer_s_ids_without_gaps_and_few_sequences(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = {}
    for key, text in zip(documents["doc_id"], documents["text"], strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        pieces = -(-len(ids) // 2048)
        stop = len(ids) - 2048 * (pieces - 1)
        start = 0
        for piece in range(pieces):
            want[key, piece] = (start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes()))
            start, stop = stop, stop + 2048
    got = QUERIES["op7_best_fit_packing"](spark, sf_dir).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    used = 0
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]]
        assert rows["length"].sum() <= 2048
        used += 1
    assert used <= 1.02 * got["length"].sum() / 2048 + 1


def test_jaccard_components_are_those_of_all_pairs(spark, sf_dir, documents):
    from tests.llm.plain import jaccard_components

    got = sorted(map(tuple, QUERIES["op6_jaccard_join"](spark, sf_dir).collect()))
    assert got == jaccard_components(list(zip(documents["doc_id"].tolist(), documents["text"], strict=True)))


def test_token_counts_are_those_of_greedy_matching(spark, sf_dir, documents):
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines} | {bytes([b]) for b in range(256)}
    longest = max(map(len, pieces))

    def greedy(word):
        at = n = 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces)
            n += 1
        return n

    counts = Counter(w for t in documents["text"] for w in t.encode().split())
    known = {w: greedy(b" " + w) for w in counts}
    want = {k: (len(w), sum(known[x] for x in w)) for k, t in zip(documents["doc_id"], documents["text"], strict=True) for w in [t.encode().split()]}
    assert {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in QUERIES["op9_token_counts"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize(("name", "label", "right_1", "right_0"), [("op2_toxicity", "toxic", 0.75, 0.995), ("op10_quality", "quality", 0.98, 0.95)])
def test_classifiers_on_held_out_labels(spark, name, label, right_1, right_0, sf):
    """``right_1`` and ``right_0``: least share of the held-out documents with that label that must be predicted so."""
    sf_dir = f"/root/testdata/{sf}"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    modulus, kept_back = (3, 1) if label == "toxic" else (4, 2)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == kept_back) for r in rows)
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(judged) > 50
    for side, least in ((1, right_1), (0, right_0)):
        given = [predicted == side for known, predicted in judged if known == side]
        assert sum(given) >= least * len(given)

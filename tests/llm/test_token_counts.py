import public_tokenizers as public
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.token_counts import LongestMatch, token_counts


def greedy(pieces, word):
    at = n = 0
    while at < len(word):
        at += max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in pieces), default=1)
        n += 1
    return n


letters = st.binary(min_size=0, max_size=30).map(lambda b: bytes(97 + x % 3 for x in b))


@settings(max_examples=300, deadline=None)
@given(st.lists(letters.filter(len), max_size=12), st.lists(letters, max_size=8))
def test_counts_are_those_of_greedy_matching(pieces, words):
    automaton = LongestMatch(pieces)
    for word in words:
        assert automaton.count(word) == greedy(set(pieces), word)


def test_nulls_repeats_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (2, None, 6), (3, "", 7), (None, " \n ", 8), (4, "zq" * 100_000, 9)], "doc_id long, text string, n_tokens int")
    rows = token_counts(docs, rank_file=public.path("byte_bpe_50k.tiktoken")).collect()
    got = sorted((repr(r["doc_id"]), r["n_words"]) for r in rows)
    assert got == [("1", 2), ("1", 2), ("2", 0), ("3", 0), ("4", 1), ("None", 0)]
    assert all(r["n_tokens"] == 0 for r in rows if r["n_words"] == 0)
    assert token_counts(docs.limit(0), rank_file=public.path("byte_bpe_50k.tiktoken")).collect() == []

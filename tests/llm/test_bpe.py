import public_tokenizers as public
import pytest

from quern.llm.bpe import decode_documents, encode, encode_documents, encoding, round_trip, segments

ARGS = {"rank_file": public.path("byte_bpe_multi_50k.tiktoken"), "pattern": public.PATTERN}


@pytest.mark.parametrize("size", [1, 7, 40])
def test_cutting_does_not_change_ids(size):
    plain = encoding(**{"rank_file": ARGS["rank_file"], "pattern": ARGS["pattern"]})
    for text in ("", "it's  we're \n\n x", "a b c d " * 30, "né à ü — 東京 は  日本", " lead", "trail ", "1 2 3 a1 b2 c", "<|endoftext|> in a text", "\t\t x y　z w"):
        assert encode(text, **ARGS, size=size) == plain.encode_ordinary(text)
        assert "".join(segments(text, size)) == text


def test_texts_that_the_library_cannot_take_whole():
    for text in (" " * 1_200_000 + "end", "a" * 300_000, "word " * 200_000):
        assert encoding(ARGS["rank_file"], ARGS["pattern"]).decode_bytes(encode(text, **ARGS)) == text.encode()
    assert encode("word " * 20_000, **ARGS) == encoding(ARGS["rank_file"], ARGS["pattern"]).encode_ordinary("word " * 20_000)


def test_nulls_repeats_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "naïve café", "x"), (1, "naïve café", "x"), (2, None, "y"), (None, "", "z")], "doc_id long, text string, ids string")
    encoded = encode_documents(docs, "doc_id", "text", **ARGS)
    decoded = decode_documents(encoded, "doc_id", **ARGS).collect()
    assert sorted((repr(r["doc_id"]), bytes(r["bytes"]).decode()) for r in decoded) == [("1", "naïve café"), ("1", "naïve café"), ("2", ""), ("None", "")]
    assert sorted(r["n_tokens"] for r in round_trip(docs, "doc_id", "text", **ARGS).collect())[:2] == [0, 0]
    assert round_trip(docs.limit(0), "doc_id", "text", **ARGS).collect() == []


def test_rows_without_ids_are_decoded_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["bytes"] for r in decode_documents(rows, "doc_id", **ARGS).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and len(got[3]) == 1
    assert decode_documents(rows.limit(0), "doc_id", **ARGS).collect() == []

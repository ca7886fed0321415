import json
import random
import zlib
from collections import Counter
from pathlib import Path
from unittest import mock

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import tokenize
from quern.llm.common import Kept, written
from quern.llm.packing import assemble, best_fit_decreasing, pack_documents, ranked, token_pieces
from quern.llm.tokenize import PackedEncoder, tokenizer

FILE = public.path("byte_bpe_50k.json")
LIBRARY = tokenizer(FILE)


def one_at_a_time(counts, capacity):
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in room if r >= length]
            if fits:
                room[room.index(min(fits))] -= length
            else:
                room.append(capacity - length)
    return sorted(room)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_that_of_placing_pieces_one_at_a_time(seed):
    random.seed(seed)
    for _ in range(200):
        capacity = random.choice([1, 5, 10, 64])
        counts = {n: random.randint(1, 12) for n in random.sample(range(1, capacity + 1), random.randint(1, min(capacity, 12)))}
        plan, opened = best_fit_decreasing(counts, capacity)
        used, placed = [[] for _ in range(opened)], Counter()
        for p in plan:
            for rank in range(p.from_rank, p.to_rank):
                nth, slot = divmod(rank - p.from_rank, p.per_sequence)
                used[p.first_sequence + nth].append((p.offset + slot * p.length, p.length))
                placed[p.length] += 1
        assert placed == Counter(counts)
        rest = []
        for pieces in used:
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            rest.append(capacity - end)
        assert sorted(rest) == one_at_a_time(counts, capacity)


@pytest.mark.parametrize(
    "text", ["", " ", "a", "a  b", " a", "a ", " \n a", "a　b", "a 　b", "    x", "\tx y", "it's we're  '  s", "<|endoftext|> a <|endoftext|>", "a\x1cb \x1c c", "a\x85 b", "x" * 5000 + " y", "né à 東京 !! ..."]
)
def test_packed_ids_are_the_tokenizer_s(text):
    want = tokenizer(FILE).encode(text, add_special_tokens=False).ids
    encoder = PackedEncoder(FILE)
    assert np.frombuffer(encoder(text), "<u4").tolist() == want == np.frombuffer(encoder(text), "<u4").tolist()


@pytest.mark.parametrize("kind", [{}, {"lstrip": True}, {"rstrip": True, "single_word": True}, {"normalized": True, "special": False}])
def test_added_tokens_in_a_text_keep_their_ids(tmp_path, kind):
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end}", f" a {end} b  c{end} ", f"a\n{end}\n\nb <|endoftext| > {end[:-1]}", f"word {end} " * 300, f"x<{end}>y <|end|>z {end}1"]
    described = json.loads(Path(FILE).read_text())
    described["added_tokens"][0] |= kind
    described["added_tokens"].append(described["added_tokens"][0] | {"id": 50257, "content": "<|end|>"})
    file = tmp_path / "tokenizer.json"
    file.write_text(json.dumps(described))
    for path in (FILE, str(file)):
        library, encoder = Tokenizer.from_file(path), PackedEncoder(path)
        assert 50256 in library.encode(texts[0], add_special_tokens=False).ids or kind
        for text in texts:
            assert np.frombuffer(encoder(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_of_a_document_with_an_added_token(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    (row,) = pack_documents(docs, tokenizer_file=FILE).collect()
    assert (row["length"], row["ids_crc32"]) == (4, zlib.crc32(np.array([64, 50256, 65, 0], "<u4").tobytes()))


def test_documents_come_back_from_their_sequences(spark):
    texts = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 9000), (None, "no id"), (1, "a b c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as length", "2 as offset")
    packed = pack_documents(docs, tokenizer_file=FILE, with_ids=True)
    rows = packed.collect()
    sequences = {r["sequence_id"]: bytes(r["ids"]) for r in assemble(packed).collect()}
    assert len(rows) == 5 + -(-9002 // 2048)
    for r in rows:
        assert sequences[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert all(len(s) <= 4 * 2048 for s in sequences.values())
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 4)
    assert [n for _, _, n in long][1:] == [2048] * (len(long) - 1) and long[0][2] <= 2048


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs, tokenizer_file=FILE).collect() == []
    assert token_pieces(docs, tokenizer_file=FILE).collect() == []


def test_a_length_that_most_pieces_have(spark):
    """Rows alike in everything: what tells them apart is where they were cut."""
    docs = spark.range(25_000).selectExpr("1L as doc_id", "case when id % 10 = 0 then repeat('a ', 700) else repeat('a ', 1000) end as text")
    packed = pack_documents(docs.repartition(7), tokenizer_file=FILE)
    room = Counter()
    for r in packed.collect():
        room[r["sequence_id"], r["offset"]] += 1
    assert sum(room.values()) == 25_000 and set(room.values()) == {1}
    lengths = {r["length"]: r["count"] for r in packed.groupBy("length").count().collect()}
    assert len({k for k, _ in room}) == best_fit_decreasing(lengths)[1]


def test_ranks_are_those_of_all_tasks_together(spark):
    pieces = written(token_pieces(spark.range(300).selectExpr("id as doc_id", "repeat('a ', int(id % 5)) as text").repartition(6), tokenizer_file=FILE))
    assert pieces.select("task").distinct().count() > 1
    for length, rows in ranked(pieces).toPandas().groupby("length"):
        assert sorted(rows["rank"]) == list(range(len(rows))), length


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_files_that_split_otherwise_go_through_the_library(tmp_path, change):
    file = tmp_path / "tokenizer.json"
    file.write_text(json.dumps(json.loads(Path(FILE).read_text()) | change))
    library, encoder = Tokenizer.from_file(str(file)), PackedEncoder(str(file))
    for text in ("a b", "e\u0301 is one", "x  y 12"):
        assert np.frombuffer(encoder(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_what_is_kept_is_bounded():
    encoder = PackedEncoder(FILE)
    encoder("x" * 1000 + " " + "y" * 101)
    assert all(len(k) <= 100 for k in encoder.parts.after_space) and all(len(k) <= 100 for k in encoder.parts.of_match)
    kept = Kept(lambda key: key.encode(), 10_000)
    for i in range(20_000):
        assert kept[f"{i % 997}"] == str(i % 997).encode()
        assert len(kept) < 80


@given(text=st.text(alphabet="ab é日'!1 \n", max_size=200), together=st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_long_texts_are_cut_where_no_match_crosses(text, together):
    with mock.patch.object(tokenize, "TOGETHER", together):
        assert PackedEncoder(FILE)(text) == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

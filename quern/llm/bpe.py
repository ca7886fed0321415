"""Byte-level BPE by the tiktoken library from a local rank file: encoding, and decoding back to raw bytes."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: A space between two letters: every match of a GPT-2 style pattern ends before it and the next one starts with it.
_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")
#: Characters from which a text is cut before tiktoken sees it; its regular expression recurses along long matches.
SEGMENT_CHARS = 20_000


@functools.cache
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """One per Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _matcher(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """``text`` in pieces cut only at safe boundaries, each the first one after ``size`` characters."""
    start = 0
    while len(text) - start > size and (cut := _SAFE.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, rank_file: str, pattern: str, size: int = SEGMENT_CHARS) -> list[int]:
    """The ids that tiktoken gives for the whole text; segments without a safe boundary are split match by match."""
    enc = encoding(rank_file, pattern)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in segments(text, size):
        if len(part) <= 2 * size:
            ids += enc.encode_ordinary(part)
        else:
            for match in _matcher(pattern).finditer(part):
                ids += enc._encode_single_piece(match[0])
    return ids


def encode_documents(docs: DataFrame, id_col: str, text_col: str, *, rank_file: str, pattern: str) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row; a null text counts as empty and has no ids. Other columns are ignored.

    Repeated rows are encoded each for itself; an empty table gives no rows. The rank file is read by each Python
    worker from its own installation.
    """

    @pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode(t or "", rank_file, pattern))

    return docs.select(id_col, ids(text_col).alias("ids"))


def decode_documents(encoded: DataFrame, id_col: str, *, rank_file: str, pattern: str) -> DataFrame:
    """``id_col`` and ``bytes`` (binary): the bytes of the tokens in ``ids`` joined, which need not be valid UTF-8 for a part of a text.

    Null ``ids`` give null bytes, and none give empty ones; a null within them is an error. Repeated rows are decoded each for
    itself; other columns are ignored. An empty table gives no rows.
    """

    @pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else encoding(rank_file, pattern).decode_bytes([int(i) for i in x]) for x in ids], dtype=object)

    return encoded.select(id_col, raw("ids").alias("bytes"))


def round_trip(docs: DataFrame, id_col: str, text_col: str, *, rank_file: str, pattern: str) -> DataFrame:
    """Encode and decode every text in one pass and return only digests: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The hashes are lowercase hex: of the decimal ids joined by commas, and of the decoded bytes. Nulls, empty texts and
    repeated rows are as for :func:`encode_documents`.
    """

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        enc = encoding(rank_file, pattern)
        names = decimals(enc.max_token_value)
        rows = []
        for text in texts:
            ids = encode(text or "", rank_file, pattern)
            listed = ",".join([names[i] for i in ids])
            rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, digests(text_col).alias("d")).select(id_col, F.col("d.*"))


@functools.cache
def decimals(largest: int) -> list[str]:
    return [str(i) for i in range(largest + 1)]

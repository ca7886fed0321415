"""Ids of a local ``tokenizers`` file, fast enough for whole corpora: what a worker has encoded once it keeps.

With byte-level splitting, a space between two characters that are not white space always starts a new match, so the
ids of a text are those of its parts before each such space, put together. Parts recur; they are kept as packed ids.
The file's added tokens, such as the end of a text, are taken out of a text first and keep their own ids.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from quern.llm.common import KEPT_BYTES, Kept, worker_table

#: Fixed value: how byte-level files split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MATCH = regex.compile(PATTERN)
_SAFE = regex.compile(r"(?<=\S) (?=\S)")
#: The characters that ``\s`` stands for, apart from the space itself.
_OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if c != " " and regex.match(r"\s", c))
#: Characters of a text that are split into parts at once.
TOGETHER = 100_000


def byte_alphabet() -> dict[int, str]:
    """The character by which byte-level files write each byte: itself if it prints, else one counted on from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a worker a core
    return Tokenizer.from_file(path)


def splits_by_pattern(library: Tokenizer) -> bool:
    """Whether the file splits texts by ``PATTERN`` into bytes and merges each match by itself, so that matches can be encoded apart."""
    split, model = library.pre_tokenizer, library.model
    return (
        library.normalizer is None
        and library.truncation is None
        and library.padding is None
        and isinstance(split, ByteLevel)
        and (split.add_prefix_space, split.use_regex) == (False, True)
        and isinstance(model, BPE)
        and not any((model.dropout, model.continuing_subword_prefix, model.end_of_word_suffix, model.byte_fallback))
    )


class _Parts:
    """Packed ids of the parts of texts, kept by the part."""

    def __init__(self, path: str, kept_bytes: int):
        self.library = tokenizer(path)
        self.apart = splits_by_pattern(self.library)
        self.model, self.alphabet = self.library.model, byte_alphabet()
        self.of_match = Kept(self._encode, kept_bytes // 8)
        self.after_space = Kept(self._after_space, kept_bytes)

    def _encode(self, match: str) -> bytes:
        return self._packed(match.encode().decode("latin-1").translate(self.alphabet))

    def _packed(self, written: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(written)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def of_text(self, text: str) -> bytes:
        after_space, of_match = self.after_space, self.of_match
        return b"".join([after_space[m[1:]] if m[0] == " " and m[1:].isalpha() else of_match[m] for m in _MATCH.findall(text)])

    def _after_space(self, part: str) -> bytes:
        if not part.isalpha():
            return self.of_text(f" {part}")
        return self._packed(self.alphabet[32] + part) if part.isascii() else self._encode(f" {part}")


class PackedEncoder:
    """Ids of a text as bytes, four to an id, little-endian: those of the library without the tokens that it would add around a text.

    Texts are encoded part by part where the file splits them by ``PATTERN``. The library encodes whole texts for other
    files, and texts that hold an added token where such a token takes white space with it, must be a word of its own, or
    some are matched after others.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        self.parts = worker_table(("parts", path, kept_bytes), lambda: _Parts(path, kept_bytes))
        self.library = self.parts.library
        added = self.library.get_added_tokens_decoder()
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.plain = len({t.normalized for t in added.values()}) <= 1 and not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.between = regex.compile(f"({'|'.join(map(regex.escape, sorted(self.added, key=len, reverse=True)))})")

    @staticmethod
    def split(text: str) -> list[str]:
        """What is before and between the spaces that stand alone between characters other than white space."""
        pieces = text.split(" ")
        if all(pieces) and not any(c in text and (f"{c} " in text or f" {c}" in text) for c in _OTHER_SPACE):
            return pieces
        return _SAFE.split(text)

    def __call__(self, text: str) -> bytes:
        if not self.parts.apart:
            return self._by_library(text)
        if not any(token in text for token in self.added):
            return self.ordinary(text)
        if not self.plain:
            return self._by_library(text)
        return b"".join([self.added[part] if part in self.added else self.ordinary(part) for part in self.between.split(text)])

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ordinary(self, text: str) -> bytes:
        if len(text) <= TOGETHER:
            first, *others = self.split(text)
            return self.parts.of_text(first) + self._after_spaces(others)
        packed, start = [], 0
        while start < len(text):
            space = _SAFE.search(text, start + TOGETHER)
            stop = space.start() if space else len(text)
            part = self.split(text[start:stop])
            packed.append(self._after_spaces(part) if start else self.parts.of_text(part[0]) + self._after_spaces(part[1:]))
            start = stop + 1
        return b"".join(packed)

    def _after_spaces(self, parts: list[str]) -> bytes:
        return b"".join(map(self.parts.after_space.__getitem__, parts))

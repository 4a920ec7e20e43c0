"""Byte-level BPE ids of whole texts inside tasks, equal to those of the tokenizer's own library."""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Words are kept in two generations of so many.
WORDS_KEPT = 150_000
VOCABULARY = "byte_bpe_50k"

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: The pattern of the tokenizer for texts of Latin-1 without rare digits and spaces, where Python's
#: classes mean the same; letters come first as nothing else begins like them.
_FAST = re.compile(rf" ?[{_LETTER}]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_OTHER = re.compile("[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbeĀ-\U0010ffff]")
#: Between words that stand one blank apart the look-ahead of the tokenizer's pattern decides nothing.
_RUN = re.compile(r"\s\s")
_LOOK_AHEAD = r"\s+(?!\S)|"


def vocabulary_files(name: str = VOCABULARY) -> tuple[str, str]:
    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class _Words(dict):
    """The ids of a word, looked up once. A full generation becomes the old one, from which words that
    come again are taken over, so frequent words stay."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("H", self.encode(word)).tobytes()
        if len(self) >= WORDS_KEPT:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class ByteBpe:
    def __init__(self, json_path: str, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.whole = Tokenizer.from_file(json_path)
        with open(json_path, encoding="utf-8") as file:
            added = {x["id"]: x["content"] for x in json.load(file)["added_tokens"]}
        plain = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = _Words(plain.encode_ordinary)
        # Without the look-ahead the library finds the words of a text several times faster.
        self.single = tiktoken.Encoding("single", pat_str=public_tokenizers.PATTERN.replace(_LOOK_AHEAD, ""), mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, added.values())) or "(?!)")
        self.size = max([*ranks.values(), *added]) + 1
        if self.size > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        for rank, token in added.items():
            self.bytes[rank] = token.encode()
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text, without special tokens around it; a special token's string inside it
        becomes that token's id, as the tokenizer's library has it."""
        if _OTHER.search(text) or self.special.search(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint16)
        if not _RUN.search(text):
            return np.frombuffer(array("H", self.single.encode_ordinary(text)), dtype=np.uint16)
        return np.frombuffer(b"".join(map(self.words.__getitem__, _FAST.findall(text))), dtype=np.uint16)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8")


@lru_cache(maxsize=2)
def byte_bpe(json_path: str, ranks_path: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(json_path, ranks_path)

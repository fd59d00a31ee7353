"""Byte-level BPE ids of whole texts, word by word through a bounded memo."""

from __future__ import annotations

import array
import base64
import re
from functools import cache

import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k.tiktoken"
# Two neighbouring white space characters: the pieces on both sides depend on each other.
RUNS = re.compile(r"\s\s")
MEMO_WORDS = 350_000
MEMO_LENGTH = 48
WIDTH = 4  # bytes of an id
SPECIAL = "<|endoftext|>"  # fixed value of the vocabulary: one id, the first after the ranks


class _Memo(dict):
    """Ids of words, two generations of MEMO_WORDS at most."""

    def __init__(self, prefix: str, encode):
        super().__init__()
        self.prefix, self.encode, self.old = prefix, encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(self.prefix + word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """The ids that the tokenizer gives, as little-endian unsigned 32-bit numbers.

    The vocabulary's pattern never lets a token run from a word across a blank:
    the blank starts the next token. So where no two white space characters
    meet, a text may be encoded word by word and equal words give equal ids.
    Texts with such runs are encoded whole. The special string is one id wherever
    it stands, and what is on its two sides is encoded apart.
    """

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.rest = _Memo("", self._plain), _Memo(" ", self._plain)
        self.newline = self._plain("\n")
        self.special = array.array("I", [len(ranks)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return array.array("I", self.encoding.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.special.join(map(self._ordinary, text.split(SPECIAL)))
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if RUNS.search(text):
            return self._plain(text)
        first, rest, lines = self.first, self.rest, []
        for line in text.split("\n"):
            words = line.split(" ")
            parts = [rest[w] for w in words]
            parts[0] = first[words[0]]
            lines.append(b"".join(parts))
        return self.newline.join(lines)


@cache
def encoder(path: str | None = None) -> Encoder:
    """One per worker process; path defaults to the installed vocabulary file."""
    return Encoder(path or public_tokenizers.path(VOCABULARY))

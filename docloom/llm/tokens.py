"""Token ids of a byte-level BPE vocabulary, and flat token files.

``Encoder`` gives the ids that the tokenizers library gives for the same vocabulary file, without added tokens. Most
text is single words between single spaces, and a piece of such text always begins at a space, so encoded words are
kept and looked up again; so are words about a single line break. Texts with other white space next to a space are encoded whole.
"""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np
import tiktoken

#: The pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 300_000
MARKS = frozenset(".,;:!?")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


class _Uneven(Exception):
    """A space has other white space beside it."""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Vocabulary files write bytes as printable characters: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Words that follow a space, and their ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = tuple(special)
        self.most = max([*ranks.values(), *special.values()], default=0)
        self.bare: dict[str, bytes] = {}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.newline = self.whole("\n")
        self.marks = {c: self.whole(c) for c in MARKS}

    def whole(self, text: str) -> bytes:
        ids = self.bpe.encode(text, allowed_special="all") if any(s in text for s in self.special) else self.bpe.encode_ordinary(text)
        return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Uneven
        first, *lines = word.split("\n")
        if lines:  # a line break between two words is a piece of its own; such pairs seldom come again, so only their words are kept
            return b"".join([self[first], *(x for line in lines for x in (self.newline, self.at_line(line)))])
        if word[-1] in MARKS and word[-2:-1].isalpha():  # a mark after a letter begins a piece
            ids = self[word[:-1]] + self.marks[word[-1]]
        else:
            ids = self.whole(" " + word)
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids

    def at_line(self, word: str) -> bytes:
        """Ids of a word that no space stands before."""
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Uneven
        ids = self.bare.get(word)
        if ids is None:
            if len(self.bare) >= CACHE:
                self.bare.clear()
            self.bare[word] = ids = self.whole(word)
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *words = text.split(" ")
        if not first[-1:].isspace():
            try:
                return self.whole(first) + b"".join(map(self.__getitem__, words))
            except _Uneven:
                pass
        return self.whole(text)

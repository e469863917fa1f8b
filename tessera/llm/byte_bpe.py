"""Byte-level BPE of whole texts through bounded worker caches.

A text is cut into *chunks*: a run of visible characters with the white space before it. A pre-token always
begins where white space follows a visible character, so each chunk encodes by itself to the same ids as in its
text, and a worker encodes a chunk once and looks it up afterwards. Most chunks follow a single space; they are
kept without it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import tiktoken

WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Where one of these stands in a text, chunks are found by expression instead of by splitting at spaces; the chunks are alike.
UNUSUAL_SPACE = ("  ", "\n\n", " \n", "\n ", *(c for c in WHITE if c not in " \n"))
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256


@lru_cache(maxsize=4)
def encoder(ranks_file: str) -> tiktoken.Encoding:
    """The vocabulary of byte_bpe_50k.json, read from its rank file."""
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Memo(dict):
    """Bounded cache of ``make(key)``: emptied when full; long keys are not kept."""

    def __init__(self, make: Callable, limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


_chunk = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def chunks(text: str) -> tuple[str, list[str]]:
    """The visible characters that a text begins with, and the keys of the chunks after them (see ``spelled``)."""
    for space in UNUSUAL_SPACE:
        if space in text:
            found = [c[1:] if c[0] == " " and c[1:2] not in WHITE else c for c in _chunk.findall(text)]
            return ("", found) if text[0] in WHITE else (found[0], found[1:])
    head, *rest = text.replace("\n", " \n").split(" ")
    return head, rest


def spelled(key: str) -> str:
    """The characters that a chunk's key stands for: itself if it begins with white space, else with a space before it."""
    return key if key and key[0] in WHITE else " " + key


class Lookup:
    """``value(characters)`` of every chunk of a text, through two bounded caches."""

    def __init__(self, value: Callable[[str], object], limit: int = 250_000):
        self.plain = Memo(value, limit // 5)
        self.after_space = Memo(lambda key: value(spelled(key)), limit)

    def __call__(self, text: str):
        """An iterator over the values of a text that has no special string."""
        head, rest = chunks(text)
        if head:
            yield self.plain[head]
        yield from map(self.after_space.__getitem__, rest)

"""A byte-level vocabulary read from a rank file."""

from __future__ import annotations

import base64
from functools import lru_cache

import regex
import tiktoken

#: The pattern that goes with the 50k rank files (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def splitter() -> regex.Pattern:
    return regex.compile(PATTERN)


class Counts(dict):
    """Token counts of pre-tokens, worked out once; a worker keeps at most ``limit`` of them."""

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__()
        self.encode, self.limit = encoding(path).encode_ordinary, limit

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


@lru_cache(2)
def counts(path: str) -> Counts:
    return Counts(path)

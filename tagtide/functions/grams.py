"""Words and pairs of words of token arrays and how many texts have them, for the tasks that count them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are sorted and summed up together in a task.
HELD = 2_000_000


class Codes(NamedTuple):
    """Pair ``(a, b)`` is ``a * stride + b``; it is summed up in the lot that is left of it by ``lots``, which has no factor in common with ``stride``."""

    stride: int
    lots: int


def _flat(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each token's text, and the tokens."""
    lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(texts)), lengths), texts.flatten()


def _summed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in their order, and how often they stand there or the sums of their weights."""
    if not len(keys):
        return keys, keys
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begins], np.diff(np.append(begins, len(keys))) if weights is None else np.add.reduceat(weights, begins)


def words_of_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and how many of the texts have each."""
    text, tokens = _flat(texts)
    coded = tokens.dictionary_encode()
    words, number = coded.dictionary, coded.indices.to_numpy()
    size = max(1, len(words))
    distinct, _ = _summed(text * size + number)
    return words, np.bincount(distinct % size, minlength=len(words))


def pairs_of_texts(texts: pa.Array, words: pa.Array, stride: int) -> np.ndarray:
    """The codes of neighbours that are both among ``words``, each once for every text that has it."""
    text, tokens = _flat(texts)
    number = pc.fill_null(pc.index_in(tokens, value_set=words.cast(tokens.type)), -1).to_numpy().astype(np.int64)
    pair = (text[1:] == text[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0)
    text, code = text[1:][pair], number[:-1][pair] * stride + number[1:][pair]
    # So many texts that code and text fit into one number.
    some, found = max(1, 2**62 // stride**2), []
    for first in range(0, len(texts), some):
        inside = slice(*np.searchsorted(text, (first, first + some)))
        distinct, _ = _summed(code[inside] * some + text[inside] - first)
        found.append(distinct // some)
    return np.concatenate(found) if found else code


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, all lowest ones first, so that those of small numbers are runs of zeros when shuffled."""
    return np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def packed(pieces: Iterator[np.ndarray], codes: Codes) -> Iterator[tuple[np.ndarray, list[bytes], list[bytes]]]:
    """Lots, the steps between their distinct codes, and how often each code came; of some ``HELD`` codes at a time."""
    held, size = [], 0

    def pack():
        distinct, counts = _summed(np.concatenate(held))
        lot = (distinct % codes.lots).astype(np.uint16)
        order = np.argsort(lot, kind="stable")
        lot, rest, counts = lot[order], distinct[order] // codes.lots, counts[order]
        begins = np.flatnonzero(np.append(True, lot[1:] != lot[:-1]))
        spans = list(zip(begins, np.append(begins[1:], len(lot)), strict=True))
        steps = [_planes(np.diff(rest[a:b], prepend=0)) for a, b in spans]
        return lot[begins], steps, [_planes(counts[a:b]) for a, b in spans]

    for piece in pieces:
        if len(piece):
            held.append(piece)
            size += len(piece)
        if size >= HELD:
            yield pack()
            held, size = [], 0
    if size:
        yield pack()


def unpacked(lot: int, steps: list[bytes], counts: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second words of a lot's pairs, and how often they came."""
    rest = np.concatenate([np.cumsum(_numbers(x)) for x in steps])
    distinct, n = _summed(rest, np.concatenate([_numbers(x) for x in counts]))
    code = distinct * codes.lots + lot
    return code // codes.stride, code % codes.stride, n

"""A tag dictionary as arrays of numbers, for the tasks that look up the n-grams of token arrays in it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Tokens that are looked up together: each needs some hundred bytes meanwhile.
TOKENS = 200_000


class Level(NamedTuple):
    """Beginnings of variants with as many words: their sorted codes, made of the beginning one shorter and the last word, and
    the tags of those that are variants: ``tags[starts[k]:starts[k + 1]]``."""

    codes: np.ndarray | None
    starts: np.ndarray
    tags: np.ndarray


class Lookup(NamedTuple):
    """``banned[ban_starts[t]:ban_starts[t + 1]]`` are the tags that tag ``t`` forbids. Tags are numbered in their order."""

    words: pa.Array
    alone: np.ndarray
    levels: list[Level]
    tags: pa.Array
    ban_starts: np.ndarray
    banned: np.ndarray
    n: int


def _starts(numbers: np.ndarray, size: int) -> np.ndarray:
    return np.append(0, np.cumsum(np.bincount(numbers, minlength=size)))


def _spread(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the spans of ``of``: which one it belongs to, and its place."""
    lengths = starts[of + 1] - starts[of]
    owner = np.repeat(np.arange(len(of)), lengths)
    return owner, np.repeat(starts[of + 1] - np.cumsum(lengths), lengths) + np.arange(len(owner))


def _numbers(values: pa.Array, known: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(values, value_set=known.cast(values.type), skip_nulls=False), -1).to_numpy().astype(np.int64)


def lookup(variants: pa.Array, tags: pa.Array, forbidden: tuple[pa.Array, pa.Array], n: int, closed_words: Sequence[str]) -> Lookup:
    """``tags`` stand beside their ``variants``; ``forbidden`` are tags and, beside them, the tags that they forbid."""
    names = pc.unique(tags)
    names = names.take(pc.sort_indices(names))
    tag, size = _numbers(tags, names).astype(np.int32), max(1, len(names))
    valid = pc.and_(*(pc.is_valid(x) for x in forbidden)).to_numpy(zero_copy_only=False)
    bans, banned = (_numbers(x.cast(names.type), names) for x in forbidden)
    valid &= (bans >= 0) & (banned >= 0)
    bans = np.unique(bans[valid] * size + banned[valid])
    bans, banned = bans // size, (bans % size).astype(np.int32)
    parts = pc.split_pattern(variants, " ")
    lengths, flat = pc.list_value_length(parts).to_numpy(), parts.flatten()
    words = pc.unique(pa.concat_arrays([flat, pa.array(sorted(set(closed_words)), flat.type)]))
    number, begins = _numbers(flat, words).astype(np.int32), np.append(0, np.cumsum(lengths, dtype=np.int64))[:-1]
    del parts, flat
    levels, node = [], None
    for size in range(1, n + 1):
        longer = lengths >= size
        tag, lengths, begins = tag[longer], lengths[longer], begins[longer]
        last, codes, nodes = number[begins + size - 1], None, len(words)
        if size == 1:
            node = last
        else:
            codes, node = np.unique(node[longer] * np.int64(len(words)) + last, return_inverse=True)
            nodes = len(codes)
        ends = lengths == size
        order = np.lexsort((tag[ends], node[ends]))
        levels.append(Level(codes, _starts(node[ends], nodes), tag[ends][order]))
    closed = pa.array(sorted(set(closed_words)), words.type)
    alone = ~pc.is_in(words, value_set=closed).to_numpy(zero_copy_only=False)
    while len(levels) > 1 and not len(levels[-1].tags):
        levels.pop()
    return Lookup(words, alone, levels, names, _starts(bans, len(names)), banned, n)


class Matches(NamedTuple):
    """The matches of ``texts`` texts in the order of their texts and places."""

    texts: int
    text: np.ndarray
    pos: np.ndarray
    tag: np.ndarray

    def lists(self, values: pa.Array) -> pa.ListArray:
        """One list for each text."""
        return pa.ListArray.from_arrays(pa.array(_starts(self.text, self.texts), pa.int32()), values)


def in_parts(texts: pa.Array, known: Lookup) -> Iterator[tuple[slice, Matches]]:
    """The matches of so many texts at a time as have some ``TOKENS`` tokens."""
    lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.append(0, np.cumsum(lengths))
    number = pc.fill_null(pc.index_in(texts.flatten(), value_set=known.words.cast(texts.type.value_type), skip_nulls=False), -1).to_numpy()
    part = first[:-1] // TOKENS
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for a, b in zip(begins, [*begins[1:], len(part)], strict=False):
        yield slice(a, b), matches(lengths[a:b], number[first[a] : first[b]].astype(np.int64), known)


def matches(lengths: np.ndarray, number: np.ndarray, known: Lookup) -> Matches:
    """All n-grams that are variants, by their places in the bag: longer ones first, then in text order.

    ``number`` are the numbers of all words, of texts of such ``lengths``.
    """
    text, first = np.repeat(np.arange(len(lengths)), lengths), np.append(0, np.cumsum(lengths))
    # Words of closed classes have no place of their own, unknown words have one.
    placed = np.append(0, np.cumsum((number < 0) | known.alone[number]))
    before = sum((np.maximum(lengths - size + 1, 0) for size in range(2, known.n + 1)), np.zeros(len(lengths), np.int64))
    found, node, at = [], None, None
    for size, level in enumerate(known.levels, 1):
        if size == 1:
            at = np.flatnonzero(number >= 0)
            node = number[at]
            inside = known.alone[node]
            hit, hit_node = at[inside], node[inside]
            pos = before[text[hit]] + placed[hit] - placed[first[text[hit]]]
        else:
            fits = at + size - 1 < first[text[at] + 1]
            at, node = at[fits], node[fits]
            last = number[at + size - 1]
            fits = last >= 0
            at, code = at[fits], node[fits] * len(known.words) + last[fits]
            node = np.searchsorted(level.codes, code)
            node[node == len(level.codes)] = 0
            same = level.codes[node] == code if len(level.codes) else np.zeros(len(code), bool)
            at, node = at[same], node[same]
            hit, hit_node = at, node
            longer = sum((np.maximum(lengths - s + 1, 0) for s in range(size + 1, known.n + 1)), np.zeros(len(lengths), np.int64))
            pos = longer[text[hit]] + hit - first[text[hit]]
        owner, place = _spread(level.starts, hit_node)
        found.append((text[hit][owner], pos[owner], level.tags[place]))
    text, pos, tag = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((tag, pos, text))
    return Matches(len(lengths), text[order], pos[order].astype(np.int32), tag[order])


def allowed(all_of: Matches, known: Lookup) -> Matches:
    """Those that no other tag of their text forbids."""
    size = max(1, len(known.tags))
    keys = all_of.text * size + all_of.tag
    distinct = np.unique(keys)
    owner, place = _spread(known.ban_starts, distinct % size)
    kept = ~np.isin(keys, distinct[owner] // size * size + known.banned[place])
    return all_of._replace(text=all_of.text[kept], pos=all_of.pos[kept], tag=all_of.tag[kept])

"""Token counts that follow edits: only what an edit touches is encoded again."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.bytepairs import counts, splitter
from tagtide.llm.common import free_name, map_batches

#: Pre-tokens in a leaf when a tree is built.
LEAF = 64

Edit = tuple[int, int, str]


class PreTokenTree:
    """Sums of characters and tokens over the pre-tokens of one text.

    A leaf holds a few neighbouring pre-tokens (length, tokens); an inner node the sums of its two
    children. An edit finds its leaf from the root, replaces pre-tokens in the leaves it touches and
    corrects the sums above them.
    """

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray):
        self.lengths, self.counts = np.asarray(lengths, np.int32), np.asarray(tokens, np.int32)
        self.n = max(1, -(-len(self.lengths) // LEAF))
        self.changed: dict[int, list[tuple[int, int]]] = {}
        self.size = 1 << (self.n - 1).bit_length()
        self.chars, self.tokens = self.sums(self.lengths), self.sums(self.counts)

    def sums(self, values: np.ndarray) -> list[int]:
        """The tree as a list: root at 1, the children of i at 2i and 2i + 1."""
        level = np.zeros(self.size, np.int64)
        if len(values):
            level[: self.n] = np.add.reduceat(values.astype(np.int64), np.arange(0, len(values), LEAF))
        levels = [level]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            levels.append(level)
        return np.concatenate([np.zeros(1, np.int64), *levels[::-1]]).tolist()

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaf(self, i: int) -> list[tuple[int, int]]:
        if i in self.changed:
            return self.changed[i]
        at = slice(i * LEAF, (i + 1) * LEAF)
        return list(zip(self.lengths[at].tolist(), self.counts[at].tolist()))

    def pre_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and token counts of all pre-tokens, in order."""
        made: tuple[list, list] = ([], [])
        at = 0
        for i in sorted(self.changed):
            for out, old, part in zip(made, (self.lengths, self.counts), (0, 1)):
                out.append(old[at : i * LEAF])
                out.append(np.array([p[part] for p in self.changed[i]], np.int32))
            at = (i + 1) * LEAF
        return tuple(np.concatenate([*out, old[at:]]) for out, old in zip(made, (self.lengths, self.counts)))

    def find(self, place: int) -> tuple[int, int]:
        """The leaf with character ``place``, or the last one, and the character it starts at."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return min(node - self.size, self.n - 1), start

    def set_leaf(self, i: int, leaf: list[tuple[int, int]]) -> None:
        self.changed[i] = leaf
        node = i + self.size
        self.chars[node], self.tokens[node] = sum(n for n, _ in leaf), sum(t for _, t in leaf)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, text: str, edit: Edit, split, count) -> tuple[str, int]:
        """The edited text, and how many pre-tokens were encoded again.

        Matching starts two pre-tokens before the one that ends at or holds the edit's first character,
        since a run of spaces is read to its end before its last space goes to the next word. It stops
        where a match ends at an old boundary behind the edit: the pattern never looks back, so
        everything after it stays.
        """
        start, removed, added = edit
        start = min(max(start, 0), len(text))
        stop = min(start + max(removed, 0), len(text))
        new = text[:start] + added + text[stop:]
        i, at = self.find(max(start - 1, 0))
        here, k = self.leaf(i), 0
        while k < len(here) and at + here[k][0] < start:
            at += here[k][0]
            k += 1
        for _ in range(2):  # context before the edit
            while not k and i:
                i -= 1
                here = self.leaf(i)
                k = len(here)
            if k:
                k -= 1
                at -= here[k][0]
        first, head, shift, behind = i, here[:k], len(added) - (stop - start), start + len(added)
        passed = at  # end of the old pre-tokens passed so far
        fresh: list[tuple[int, int]] = []
        met = False
        for match in split.finditer(new, at):
            piece, end = match.group(), match.end()
            fresh.append((len(piece), count[piece]))
            while passed < end - shift and not (k == len(here) and i == self.n - 1):
                if k < len(here):
                    passed += here[k][0]
                    k += 1
                else:
                    i, k = i + 1, 0
                    here = self.leaf(i)
            if end >= behind and passed == end - shift and passed >= stop:
                met = True
                break
        if not met:
            for gone in range(i + 1, self.n):
                self.set_leaf(gone, [])
            here, k = [], 0
        if i == first:
            self.set_leaf(first, head + fresh + here[k:])
        else:
            self.set_leaf(first, head + fresh)
            for gone in range(first + 1, i):
                self.set_leaf(gone, [])
            self.set_leaf(i, here[k:])
        if len(self.leaf(first)) > 8 * LEAF:
            self.__init__(*self.pre_tokens())
        return new, len(fresh)


def grown(text: str, split, count) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and token counts of the pre-tokens of a text."""
    pieces = split.findall(text)
    lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
    return lengths, np.fromiter(map(count.__getitem__, pieces), np.int32, len(pieces))


def as_lists(parts: Sequence[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32))


def from_lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column; a null is an empty list."""
    values, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(bounds[:-1], bounds[1:], known)]


def count_tokens(docs: DataFrame, ranks: str, *, text: str = "text") -> DataFrame:
    """Add the leaves of each text's tree: ``pre_lengths`` and ``pre_tokens`` (arrays), and ``n_tokens``.

    Keep them beside the text; ``apply_edits`` reads them. A null or empty text has no leaves and 0
    tokens. Extra columns stay; a column that has one of the three names is refused. No shuffle.
    """
    clash = {"pre_lengths", "pre_tokens", "n_tokens"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    extra = "pre_lengths array<int>, pre_tokens array<int>, n_tokens long"

    def run(batch):
        split, count = splitter(), counts(ranks)
        at = batch.schema.get_field_index(text)
        made = [grown(t or "", split, count) for t in batch.column(at).to_pylist()]
        return dict(zip(batch.schema.names, batch.columns)) | {
            "pre_lengths": as_lists([m[0] for m in made]),
            "pre_tokens": as_lists([m[1] for m in made]),
            "n_tokens": [int(m[1].sum()) for m in made],
        }

    return map_batches(docs, run, f"{_ddl(docs)}, {extra}", rows=1_000)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def with_edits(state: DataFrame, edits: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """Bring a table of edits (id, seq, start, removed, added) to the documents, in order of ``seq``.

    A document's edits have to be applied one after the other, so they travel as one list.
    """
    key = free_name(state, "_edited")
    lists = edits.groupBy(F.col(id).alias(key)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "start", "removed", "added"))), lambda e: F.struct(e.start.alias("start"), e.removed.alias("removed"), e.added.alias("added"))).alias("edits")
    )
    return state.join(lists, F.col(id) == F.col(key), "left").drop(key)


def apply_edits(state: DataFrame, ranks: str, *, text: str = "text", edits: str = "edits") -> DataFrame:
    """Apply each row's ``edits`` (array of start, removed, added) to its text and counts.

    ``state`` comes from ``count_tokens``. Its columns stay, with new values in the text and in the
    three counting columns; ``edits`` gives way to ``n_encoded``, the pre-tokens encoded again. Places
    beyond the text mean its end; null edits, or null fields of an edit, change nothing. A null text
    with edits counts as empty.
    """
    kept = [c for c in state.columns if c != edits]

    def run(batch):
        split, count = splitter(), counts(ranks)
        columns = dict(zip(batch.schema.names, batch.columns))
        made: tuple[list, ...] = ([], [], [], [], [])
        leaves = zip(from_lists(columns["pre_lengths"]), from_lists(columns["pre_tokens"]))
        for page, (lengths, tokens), todo in zip(columns[text].to_pylist(), leaves, columns[edits].to_pylist()):
            encoded = 0
            tree = PreTokenTree(lengths, tokens)
            for e in todo or ():
                if e is not None:
                    page, n = tree.edit(page or "", (e["start"] or 0, e["removed"] or 0, e["added"] or ""), split, count)
                    encoded += n
            for out, value in zip(made, (page, *tree.pre_tokens(), tree.n_tokens, encoded)):
                out.append(value)
        page, lengths, tokens, total, encoded = made
        return columns | {
            text: page, "pre_lengths": as_lists(lengths), "pre_tokens": as_lists(tokens), "n_tokens": total, "n_encoded": encoded
        }

    return map_batches(state, run, f"{_ddl(state.select(*kept))}, n_encoded long", rows=1_000)

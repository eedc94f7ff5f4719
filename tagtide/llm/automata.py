"""Matching statistics against broadcast suffix automata of a bounded reference."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import map_arrow, map_batches, utf8

#: Stands for a missing id: larger than all.
NO_ID = (1 << 63) - 1


class SuffixAutomaton:
    """All word sequences of some documents. Documents are added in order of id, so a state keeps the least of its ids."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NO_ID]

    def _state(self, edges: dict[bytes, int], length: int, link: int, least: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.least.append(least)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A state for the longest sequence of ``p`` and one word, taken out of the longer ``q``."""
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q], self.least[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: Sequence[bytes], doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # another document has got this far
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            state = self._state({}, self.length[last] + 1, 0, doc)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = state

    def matched(self, words: Sequence[bytes], doc: int, size: int) -> list[int]:
        """Starts of the windows of ``size`` words that a document with a smaller id has.

        The longest match that ends at each word is followed along the text; a state is cut back to the
        one that holds the window itself before its least id is asked for.
        """
        following, link, length, least = self.next, self.link, self.length, self.least
        state = here = 0
        starts = []
        for end, word in enumerate(words, 1):
            while state and word not in following[state]:
                state = link[state]
                here = length[state]
            q = following[state].get(word)
            if q is None:
                here = 0
                continue
            state, here = q, here + 1
            if here >= size:
                while length[link[state]] >= size:
                    state = link[state]
                    here = length[state]
                if least[state] < doc:
                    starts.append(end - size)
        return starts


def shard_automata(reference: DataFrame, shards: int, *, id: str, text: str) -> list:
    """A pickled automaton for each shard of the reference, built in the tasks. Their size is the reference's."""

    def build(batches):
        rows: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for shard, key, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.setdefault(shard, []).append((key, raw))
        for shard, some in rows.items():
            automaton = SuffixAutomaton()
            for key, raw in sorted(some):
                automaton.add(raw.split(), key)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([pickle.dumps(automaton)], pa.binary())], names=["shard", "made"])

    number = F.col(id).cast("long")
    rows = reference.where(number.isNotNull()).select(F.pmod(F.xxhash64(id), F.lit(shards)).alias("shard"), number.alias("id"), utf8(text).alias("text"))
    made = map_arrow(rows.repartition(shards, "shard"), build, "shard long, made binary")
    return [r.made for r in made.orderBy("shard").toLocalIterator()]


def reference_matches(
    docs: DataFrame, reference: DataFrame, *, size: int = 13, shard_words: int = 200_000, max_words: int = 5_000_000, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, starts): the windows of each document that a reference document with a smaller id has.

    The reference is bounded: one of more than ``max_words`` words is refused, since each shard is sent
    to all tasks and each document is read against each shard. Rows without matches are left out.
    """
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    total = reference.agg(F.sum(words).alias("n")).first().n or 0
    if total > max_words:
        raise ValueError(f"the reference has {total} words, more than {max_words}: every shard would meet every document")
    spark = docs.sparkSession
    found = None
    for made in shard_automata(reference, max(1, -(-total // shard_words)), id=id, text=text):
        shard = spark.sparkContext.broadcast(bytes(made))
        one = _stream(docs, shard, size, id, text)
        found = one if found is None else found.unionByName(one)
    return found.groupBy(id).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))


def _stream(docs: DataFrame, shard, size: int, id: str, text: str) -> DataFrame:
    loaded: list[SuffixAutomaton] = []

    def run(batch):
        if not loaded:
            loaded.append(pickle.loads(shard.value))
        keys, starts = [], []
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hits = loaded[0].matched(raw.split(), NO_ID if key is None else key, size)
            if hits:
                keys.append(key)
                starts.append(hits)
        return {"id": keys, "starts": starts}

    made = map_batches(docs.select(F.col(id).cast("long").alias("id"), utf8(text)), run, "id long, starts array<int>")
    return made.withColumnRenamed("id", id)

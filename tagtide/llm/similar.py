"""Near copies by similarity of word shingles: bands of smallest hashes find them, shingles decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import map_arrow, map_batches, smallest_reachable, utf8, whole_runs
from tagtide.llm.simhash import FEW, first_of_groups, numbered
from tagtide.session import durable

#: Smallest hashes of a band, and bands. Of pairs at similarity 0.8 one in a million shares no band.
ROWS, BANDS = 6, 46
#: A piece of a group has so many texts and shingles at most, except for a longer text; pieces meet in pairs.
MOST, MOST_SHINGLES = 256, 500_000


def shingle_set(raw: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n))


def multipliers(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A key for each band, from the smallest hash under each multiplier."""
    least = np.full(len(by), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256, None] * by).min(0), out=least)
    mixed = least ^ (least >> np.uint64(29))
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    keys = (mixed * by[::-1]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return keys ^ (keys >> np.uint64(31)) ^ (np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def similar_links(nodes: np.ndarray, sets: list[np.ndarray], keys: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that hold together the sets of one meeting that are similar: a forest, not all pairs."""
    sizes = np.array([len(s) for s in sets])
    above = np.arange(len(sets))  # the root of each
    links = []
    for i in range(len(sets) - 1):
        later = np.arange(i + 1, len(sets))
        small, large = np.minimum(sizes[i], sizes[later]), np.maximum(sizes[i], sizes[later])
        near = (above[later] != above[i]) & (small >= similarity * large)
        later = later[near]
        later = later[(keys[later] == keys[i]).any(1)]
        for j in later.tolist():
            if above[i] == above[j]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= similarity * (sizes[i] + sizes[j] - shared):
                above[above == above[j]] = above[i]
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def similar_groups(stored: DataFrame, row: str, *, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, component): rows of ``stored`` linked by similar texts; ``component`` is the smallest row reached.

    Similarity is the share of common shingles among all distinct ones of two texts. Texts with equal
    shingles are one class; classes that share a band form a rough group, and only there shingles are
    compared. No link is wrong; one at the bound of 0.8 is missed with probability 0.000001, closer ones
    more rarely. Texts without words are equal to each other.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("bands are laid out for a similarity of 0.8 or more")

    def sketch(batch):
        by = multipliers()
        for at in range(0, batch.num_rows, 512):
            sets = [shingle_set(raw, shingle) for raw in batch.column(1).slice(at, 512).to_pylist()]
            yield {
                "row": batch.column(0).slice(at, 512),
                "same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "size": list(map(len, sets)),
                "keys": [band_keys(s, by).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets],
            }

    known = durable(map_batches(stored.select(F.col(row).alias("row"), utf8(text)), sketch, "row long, same binary, size int, keys array<long>"))
    classes = durable(known.groupBy("same").agg(F.min("row").alias("node"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    keyed = classes.select("node", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    rough = smallest_reachable(keyed.join(heads, "key").select(F.col("node").alias("a"), F.col("head").alias("b")))
    suspects = durable(classes.join(rough, "node").select("node", "component", "size", "keys"))
    joined = smallest_reachable(verified(stored, row, suspects, text, shingle, similarity))
    labelled = durable(classes.join(joined, "node", "left").select("same", F.coalesce("component", "node").alias("component")))
    return known.select("row", "same").join(labelled, "same").select("row", "component")


def verified(stored: DataFrame, row: str, suspects: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b): similar classes of the rough groups, enough to join their components."""
    sizes = suspects.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    pieces = F.greatest(F.ceil(F.col("n") / MOST), F.ceil(F.col("total") / MOST_SHINGLES))
    sized = suspects.join(sizes.select("component", pieces.alias("pieces")), "component").withColumnRenamed("node", row)
    # A few suspects go to all tasks, so that only their texts travel.
    few = suspects.count() <= FEW // 10
    texts = stored.select(row, utf8(text).alias("raw")).join(F.broadcast(sized) if few else sized, row)
    texts = texts.select(F.col(row).alias("node"), "component", "pieces", "keys", "raw")

    def cut(batch):
        columns = dict(zip(batch.schema.names, batch.columns))
        for at in range(0, batch.num_rows, 64):
            raws = columns["raw"].slice(at, 64).to_pylist()
            yield {k: columns[k].slice(at, 64) for k in ("node", "component", "pieces", "keys")} | {"hashes": [shingle_set(r, shingle).tobytes() for r in raws]}

    sets = map_batches(texts, cut, "node long, component long, pieces long, keys array<long>, hashes binary")
    own = F.pmod(F.xxhash64("node"), F.col("pieces"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
    sets = sets.select("node", "component", "keys", "hashes", own.alias("own"), other.alias("other"))
    meet = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
    dealt = sets.select(meet.alias("meet"), "node", "keys", "hashes").repartition("meet").sortWithinPartitions("meet", "node")

    def run(batches):
        small = (part.slice(at, 64) for part in batches for at in range(0, part.num_rows, 64))
        for table in whole_runs(small, rows=64):
            meets = table["meet"].to_numpy()
            bounds = np.flatnonzero(np.concatenate([[True], meets[1:] != meets[:-1], [True]])).tolist()
            for a, b in zip(bounds, bounds[1:]):
                if b - a < 2:
                    continue
                part = table.slice(a, b - a)
                found = [np.frombuffer(x, np.uint64) for x in part["hashes"].to_pylist()]
                keys = part["keys"].combine_chunks().flatten().to_numpy().reshape(b - a, BANDS)
                links = similar_links(part["node"].to_numpy(), found, keys, similarity)
                ends = np.array(links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

    return map_arrow(dealt, run, "a long, b long")


def one_of_similar(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` of each group of near copies: the smallest id, nulls last, then the first stored."""
    stored, row = numbered(docs)
    return first_of_groups(stored, row, similar_groups(stored, row, text=text, shingle=shingle, similarity=similarity), id)

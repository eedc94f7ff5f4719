"""SimHash near-duplicates, found by pivot distance tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import free_name, map_arrow, map_batches, smallest_reachable, utf8, whole_runs
from tagtide.session import durable

#: Fingerprints fall into blocks of bits, and each block has a table of distances to so many pivots.
BLOCKS, WIDTH, PIVOTS = 4, 16, 16
#: A group of fingerprints above this size is cut into pieces that meet in pairs.
MOST = 4_096
#: So many row numbers are sent to all tasks at most.
FEW = 500_000


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes, repeats included."""
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null and empty texts have 0."""

    def run(batch):
        made = np.array([fingerprint(raw, shingle) for raw in batch.column(1).to_pylist()], np.uint64)
        return {"id": batch.column(0), "fp": made.view(np.int64)}

    kind = docs.schema[id].dataType.simpleString()
    return map_batches(docs.select(F.col(id).alias("id"), utf8(text)), run, f"id {kind}, fp long")


def pivots(seed: int = 5) -> np.ndarray:
    """Reference fingerprints, by rule from a seed."""
    return np.random.default_rng(seed).integers(0, 1 << 64, PIVOTS, np.uint64)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances to the pivots within each block: (fingerprints, blocks, pivots)."""
    table = np.empty((len(fps), BLOCKS, PIVOTS), np.int8)
    for p, pivot in enumerate(pivots()):
        differ = fps ^ pivot
        for b in range(BLOCKS):
            table[:, b, p] = np.bitwise_count((differ >> np.uint64(WIDTH * b)) & np.uint64((1 << WIDTH) - 1))
    return table


def table_keys(table: np.ndarray) -> np.ndarray:
    """For any two blocks a hash of their coordinates: (fingerprints, pairs of blocks).

    Two fingerprints within 2 bits agree wholly in at least two of the four blocks, and so in all
    coordinates there.
    """
    weights = np.random.default_rng(11).integers(0, 1 << 63, (BLOCKS, PIVOTS), np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (table.astype(np.uint64) * weights).sum(2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    keys = [mixed[:, a] + np.uint64(31 * a + 7) * (mixed[:, b] ^ np.uint64(b)) for a, b in combinations(range(BLOCKS), 2)]
    return np.stack(keys, 1).view(np.int64)


def linked_pairs(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what is within ``bits`` in each run of equal keys: a forest, not all pairs.

    A pair is discarded if its coordinates differ by more than ``bits``, taking the largest difference
    of each block and their sum over the blocks; what survives is verified on the fingerprints.
    """
    table = distance_table(fps)
    above = np.arange(len(fps))

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    left, right = [], []
    step = 1
    start = np.flatnonzero(keys[1:] == keys[:-1])
    while len(start):
        for at in range(0, len(start), 20_000):
            i = start[at : at + 20_000]
            j = i + step
            apart = np.abs(table[i] - table[j]).max(2).sum(1)
            i, j = i[apart <= bits], j[apart <= bits]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= bits
            near &= above[i] != above[j]  # the rest is known to be joined
            for a, b in zip(i[near].tolist(), j[near].tolist()):
                ra, rb = root(a), root(b)
                if ra != rb:
                    above[rb] = ra
                    left.append(a)
                    right.append(b)
        step += 1
        start = start[start + step < len(keys)]
        start = start[keys[start] == keys[start + step]]
    return np.array(left, np.int64), np.array(right, np.int64)


def links(classes: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` within ``bits`` (2 at most), enough to join their components."""
    if not 0 <= bits <= 2:
        raise ValueError("four blocks of which two agree hold up to 2 differing bits")

    def emit(batch):
        fps = batch.column(0).to_numpy().view(np.uint64)
        keys = table_keys(distance_table(fps))
        return {"key": keys.reshape(-1), "fp": np.repeat(fps.view(np.int64), keys.shape[1])}

    keyed = durable(map_batches(classes.select("fp"), emit, "key long, fp long"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key")
    # Pieces of a large group meet in pairs; each is some thousand fingerprints.
    pieces = F.ceil(F.col("n") / (MOST // 2))
    own = F.pmod(F.xxhash64("fp"), pieces)
    other = F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))
    shared = shared.select("key", "fp", "n", own.alias("own"), other.alias("other"))
    meet = F.when(F.col("n") <= MOST // 2, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    dealt = shared.select(meet.alias("meet"), "fp").repartition("meet").sortWithinPartitions("meet", "fp")

    def run(batches):
        for table in whole_runs(batches):
            keys = table["meet"].to_numpy()
            fps = table["fp"].to_numpy().view(np.uint64)
            a, b = linked_pairs(keys, fps, bits)
            yield pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"])

    return map_arrow(dealt, run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", bits: int = 2, shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): groups of documents whose fingerprints differ in ``bits`` or fewer.

    Equal fingerprints are one class, so copies are never paired. ``component_id`` is the smallest id
    that links reach; it is null only where a whole group has null ids. Texts without words have
    fingerprint 0, which links like any other. Repeated rows give repeated rows; no rows give no rows.
    """
    known = durable(fingerprints(docs, id=id, text=text, shingle=shingle))
    classes = durable(known.groupBy("fp").agg(F.min("id").alias("least")))
    joined = smallest_reachable(links(classes, bits))
    labelled = classes.join(joined, classes.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = durable(labelled.join(smallest, "component").select("fp", "component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return known.join(named, "fp").select(F.col("id").alias(id), shown.alias("fingerprint"), "component_id")


def one_of_each_group(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", bits: int = 2, shingle: int = 3, nulls: bool = False
) -> DataFrame:
    """One row of ``docs`` of each group: the one with the smallest id, of rows with that id the first stored.

    Rows with a null id are kept, unless ``nulls`` has them compared too: then they come last in a group.
    """
    stored, row = numbered(docs)
    found = near_duplicates(stored if nulls else stored.where(F.col(id).isNotNull()), id=row, text=text, bits=bits, shingle=shingle)
    groups = found.select(F.col(row).alias("row"), F.col("component_id").alias("component"))
    return first_of_groups(stored, row, groups, id)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` stored with a number for each row, and the name of its column."""
    row = free_name(docs, "_row_number")
    return durable(docs.withColumn(row, F.monotonically_increasing_id())), row


def first_of_groups(stored: DataFrame, row: str, groups: DataFrame, id: str) -> DataFrame:
    """Rows of ``stored`` without those that ``groups`` (row, component) puts behind another row, ids before rows, null ids last."""
    ids = stored.select(F.col(row).alias("row"), F.col(id).alias("id"))
    placed = durable(groups.join(ids, "row").select("row", "component", F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("place")))
    first = placed.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = durable(placed.join(first.select("component", F.col("first.row").alias("stays")), "component").where("row <> stays").select(F.col("row").alias(row)))
    # A few go to all tasks, so that the texts stay where they are.
    return stored.join(F.broadcast(gone) if gone.count() <= FEW else gone, row, "left_anti").drop(row)

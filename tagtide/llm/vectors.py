"""Embedding near-duplicates by binary codes of rotated vectors, with bounds on what they tell."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import map_arrow, map_batches, smallest_reachable, whole_runs
from tagtide.session import durable

#: A bucket above this size is cut into pieces that meet in pairs.
MOST = 2_048


@lru_cache(8)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """``dim`` orthonormal rows of a random rotation in ``bits`` dimensions: pads a vector and turns it."""
    made = np.random.default_rng([seed, dim, bits]).standard_normal((bits, dim))
    return np.linalg.qr(made)[0].T.copy()


@lru_cache(8)
def planes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, count, 1]).standard_normal((dim, count))


def code_bits(dim: int) -> int:
    """Bits of a code: at least the dimension and 256, since short codes tell too little."""
    return max(256, -(-dim // 64) * 64)


def codes(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated vectors, packed, and each vector's inner product with its own code."""
    bits = code_bits(unit.shape[1])
    turned = unit @ rotation(unit.shape[1], bits, seed)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(bits)


def estimates(unit: np.ndarray, packed: np.ndarray, factors: np.ndarray, seed: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of unit[i] . x[j] from the codes of the x, and the half width of their interval.

    The inner product of a query with the code, over that of the vector with its own code, is an
    unbiased estimate; its error is below ``sure`` deviations except with a probability that falls
    off exponentially in ``sure`` squared.
    """
    bits = 8 * packed.shape[1]
    turned = (unit @ rotation(unit.shape[1], bits, seed)).astype(np.float32)
    signs = np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1
    made = (turned @ signs.T) / (math.sqrt(bits) * factors)
    wide = np.sqrt(np.maximum(0.0, 1 - factors**2)) / factors * (sure / math.sqrt(bits - 1))
    return made, wide


def bands_for(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits a band and bands, so that a bucket has few strangers and a pair at the bound meets with ``recall``."""
    width = min(48, max(8, round(math.log2(max(rows, 2)))))
    meet = (1 - math.acos(cosine) / math.pi) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def list_slices(column: pa.ListArray) -> list[np.ndarray | None]:
    """Lists as float32 arrays (doubles as float64); null lists as None, null components as nan."""
    values = column.values.to_numpy(zero_copy_only=False)
    bounds = column.offsets.to_numpy()
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], known)]


def numbered(rows: DataFrame, label: str, vector: str, id: str) -> DataFrame:
    """(row, id, label, digest, vec): vectors as float64 bytes, null where they link with nothing."""
    serial: dict[int, int] = {}

    def run(batch):
        task = TaskContext.get()
        at = serial.get(task.taskAttemptId(), 0)
        serial[task.taskAttemptId()] = at + batch.num_rows
        found, digests = [], []
        for v, lab in zip(list_slices(batch.column(2)), batch.column(1).is_valid().to_pylist()):
            v = None if v is None or not lab else np.asarray(v, np.float64)
            good = v is not None and len(v) and np.isfinite(v).all() and v.any()
            found.append((v + 0.0).tobytes() if good else None)
            digests.append(xxhash.xxh3_128_digest(found[-1]) if good else None)
        return {
            "row": [(task.partitionId() << 36) + at + i for i in range(batch.num_rows)],
            "id": batch.column(0), "label": batch.column(1), "digest": digests, "vec": found,
        }

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (id, label)}
    chosen = rows.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vec"))
    return map_batches(chosen, run, f"row long, id {kinds[id]}, label {kinds[label]}, digest binary, vec binary")


def near_vectors(
    rows: DataFrame,
    *,
    cosine: float = 0.98,
    recall: float = 0.999999,
    sure: float = 5.0,
    seed: int = 23,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept): vectors of one label with a cosine of at least ``cosine``.

    Equal vectors of a label are one class. Classes meet in buckets of band bits; a pair is looked at
    in the first band that it shares. A code's estimate and its upper bound dismiss pairs; what they
    cannot dismiss is computed exactly, in double precision. So no link is wrong, and links at the
    bound are found with probability ``recall``, closer ones more surely. Vectors travel only to
    buckets where they meet another. Tasks return sums of links and a spanning forest, not pairs;
    large buckets are cut into pieces that meet in pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and null labels, link
    with nothing. Vectors of different lengths do not link. Rows that repeat an id count each; the
    component is null only where all its ids are. No rows give no rows.
    """
    known = durable(numbered(rows, label, vector, id))
    classes = known.where("vec is not null").groupBy("label", "digest")
    classes = durable(classes.agg(F.count("*").alias("m"), F.min("row").alias("node"), F.min("id").alias("least"), F.first("vec").alias("vec")))
    width, bands = bands_for(classes.count(), cosine, recall)

    def banded(batch):
        vecs = batch.column(3).to_pylist()
        lengths = np.array([len(v) // 8 for v in vecs], np.int64)
        keys = np.zeros((len(vecs), bands), np.uint64)
        packed: list = [None] * len(vecs)
        factors = np.zeros(len(vecs))
        salt = np.array([xxhash.xxh3_64_intdigest(repr(x)) for x in batch.column(2).to_pylist()], np.uint64)
        powers = np.uint64(1) << np.arange(width, dtype=np.uint64)
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            x = np.frombuffer(b"".join([vecs[i] for i in at]), np.float64).reshape(-1, dim)
            unit = x / np.abs(x).max(1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            made, factors[at] = codes(unit, seed)
            sides = (unit @ planes(dim, width * bands, seed) > 0).reshape(len(at), bands, width)
            cell = (sides * powers).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            cell = (cell ^ salt[at, None]) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(dim)
            keys[at] = (cell ^ (cell >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            for i, c in zip(at.tolist(), made):
                packed[i] = c.tobytes()
        return {
            "node": batch.column(0), "m": batch.column(1), "vec": vecs, "code": packed, "factor": factors,
            "keys": [k.view(np.int64) for k in keys],
        }

    schema = "node long, m long, vec binary, code binary, factor double, keys array<long>"
    coded = durable(map_batches(classes.select("node", "m", "label", "vec"), banded, schema))
    places = coded.select("node", F.posexplode("keys").alias("band", "key"))
    shared = places.join(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    pieces = F.ceil(F.col("n") / (MOST // 2))
    own = F.when(F.col("n") <= MOST, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("node"), pieces))
    last = F.when(F.col("n") <= MOST, F.lit(0).cast("long")).otherwise(pieces - 1)
    shared = shared.select("node", "band", "key", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    meet = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = shared.select(meet.alias("meet"), "node", "band", (F.col("own") == F.col("other")).alias("alone"), "own")
    # Rows of one piece carry their own number; a meeting of two pieces only looks across.
    dealt = dealt.join(coded, "node").repartition("meet").sortWithinPartitions("meet", "own", "node")
    dealt = dealt.select("meet", "node", "band", "own", "m", "vec", "code", "factor", "keys")

    def run(batches):
        for table in whole_runs(batches, rows=20_000):
            meets = table["meet"].to_numpy()
            nodes, own_, m = (table[c].to_numpy() for c in ("node", "own", "m"))
            vecs, packed, factors = table["vec"].to_pylist(), table["code"].to_pylist(), table["factor"].to_numpy()
            keys = table["keys"].combine_chunks()
            keys = keys.flatten().to_numpy().reshape(-1, bands)
            band = table["band"].to_numpy()
            bounds = np.flatnonzero(np.concatenate([[True], meets[1:] != meets[:-1], [True]]))
            a, b, n = [], [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s < 2:
                    continue
                x = np.frombuffer(b"".join(vecs[s:e]), np.float64).reshape(e - s, -1)
                unit = x / np.abs(x).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                code = np.frombuffer(b"".join(packed[s:e]), np.uint8).reshape(e - s, -1)
                found = pairs_of(unit, code, factors[s:e], keys[s:e], int(band[s]), own_[s:e], cosine, seed, sure)
                if not len(found[0]):
                    continue
                i, j = found
                weight = np.bincount(i, m[s:e][j], e - s) + np.bincount(j, m[s:e][i], e - s)
                some = np.flatnonzero(weight)
                a.append(nodes[s:e][some])
                b.append(np.full(len(some), -1))
                n.append(weight[some].astype(np.int64))
                li, lj = forest(i, j, e - s)
                a.append(nodes[s:e][li])
                b.append(nodes[s:e][lj])
                n.append(np.zeros(len(li), np.int64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b, n)], names=["a", "b", "n"])

    found = durable(map_arrow(dealt, run, "a long, b long, n long"))
    sums = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    joined = smallest_reachable(found.where("b >= 0"))
    labelled = classes.select("label", "digest", "m", "node", "least").join(sums, "node", "left").join(joined, "node", "left")
    labelled = durable(labelled.withColumn("component", F.coalesce("component", "node")))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "component").select("label", "digest", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = known.select("id", "label", "digest").join(durable(named), ["label", "digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def pairs_of(unit, code, factors, keys, band, own, cosine, seed, sure) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i < j) of one bucket that no earlier band has, in blocks of rows."""
    size = len(unit)
    across = own.min() != own.max()
    left, right = [], []
    for at in range(0, size, 256):
        upto = min(size, at + 256)
        made, wide = estimates(unit[at:upto], code[at:], factors[at:], seed, sure)
        i, j = np.nonzero(made + wide >= cosine)
        i, j = i + at, j + at
        good = i < j
        if across:
            good &= own[i] != own[j]
        i, j = i[good], j[good]
        if band:
            new = np.ones(len(i), bool)
            for b in range(band):
                new &= keys[i, b] != keys[j, b]
            i, j = i[new], j[new]
        for k in range(0, len(i), 65_536):
            p, q = i[k : k + 65_536], j[k : k + 65_536]
            near = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
            left.append(p[near])
            right.append(q[near])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def forest(i: np.ndarray, j: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Links that hold the same components together: labels spread until they rest, then each points to its own."""
    label = np.arange(size)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            break
        label = least
    linked = np.unique(np.concatenate([i, j]))
    linked = linked[label[linked] != linked]
    return linked.tolist(), label[linked].tolist()

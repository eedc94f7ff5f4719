"""Substring dedup: words of passages that an earlier document has are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.automata import NO_ID, SuffixAutomaton
from tagtide.llm.common import map_batches, utf8
from tagtide.session import share_package

#: Odd multipliers of the rolling hashes, and their inverses modulo 2**64.
BYTE, STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as they were asked for."""

    def __init__(self, base: int):
        self.base = np.array([base, pow(base, -1, 1 << 64)], np.uint64)
        self.up = np.ones((2, 1), np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.shape[1] < n:
            size = max(n, 2 * self.up.shape[1])
            steps = np.repeat(self.base[:, None], size, 1)
            steps[:, 0] = 1
            self.up = np.multiply.accumulate(steps, axis=1)
        return self.up[0, :n], self.up[1, :n]


byte_powers, step_powers = Powers(BYTE), Powers(STEP)
byte_values = np.random.default_rng(3).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
is_space = np.zeros(256, bool)
is_space[[0x20, 9, 10, 11, 12, 13]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """One hash for each word of a text, from prefix sums over its bytes."""
    codes = np.frombuffer(raw, np.uint8)
    edges = np.diff(np.concatenate([[1], is_space[codes].astype(np.int8), [1]]))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = byte_powers.to(len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values[codes] * up, dtype=np.uint64)])
    return scramble((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(STEP))


def window_hashes(raw: bytes, size: int) -> tuple[int, np.ndarray]:
    """The number of words, and a hash for each window of ``size`` words."""
    words = word_hashes(raw)
    n = len(words)
    if n < size:
        return n, np.zeros(0, np.uint64)
    up, down = step_powers.to(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n], dtype=np.uint64)])
    return n, scramble((sums[size:] - sums[:-size]) * down[: n - size + 1])


def covered(flags: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside any flagged window: the maximal spans of the matches."""
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return np.cumsum(edges[:n]) > 0


def first_and_later(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by hash: for each hash an entry with its least id; and the entries of larger ids, with their hash's place."""
    order = np.argsort(hashes)
    if not len(order):
        return order, order, order
    sorted_hashes, sorted_ids = hashes[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]]))
    sizes = np.diff(np.append(starts, len(order)))
    least = np.repeat(np.minimum.reduceat(sorted_ids, starts), sizes)
    run = np.repeat(np.arange(len(starts)), sizes)
    best = np.flatnonzero(sorted_ids == least)
    first = best[np.concatenate([[True], run[best][1:] != run[best][:-1]])]
    later = np.flatnonzero(sorted_ids > least)
    return order[first], order[later], run[later]


def distinct(a: np.ndarray, b: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two columns of numbers; those of the second are below ``below``."""
    both = np.unique(a.astype(np.int64) * below + b)
    return both // below, both % below


def runs_by_place(place: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """For each place: its hashes in order of owner, the owners, and how many hashes each has."""
    order = np.lexsort((owner, place))
    place, owner, hashes = place[order], owner[order], hashes[order]
    cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        starts = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
        yield int(place[a]), written(hashes[a:b]), owner[a:b][starts], np.diff(np.append(starts, b - a)).astype(np.uint32)


def written(hashes: np.ndarray) -> bytes:
    """Seven bytes of each hash; the lot that it goes to tells the rest."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def read_hashes(table: pa.Table) -> np.ndarray:
    found = column(table, "hashes", np.uint8).reshape(-1, 7)
    return np.concatenate([found, np.zeros((len(found), 1), np.uint8)], 1).reshape(-1).view("<u8")


def flag(lengths: np.ndarray, nameless: np.ndarray) -> np.ndarray:
    """The top bit of a run's length tells that its owner has no id."""
    return lengths | (nameless.astype(np.uint32) << np.uint32(31))


BLOB = "kind int, lot long, hashes binary, runs binary, keys binary, lots binary"
EMPTY = {"kind": pa.int32(), "lot": pa.int64(), "hashes": pa.binary(), "runs": pa.binary(), "keys": pa.binary(), "lots": pa.binary()}


def blobs(rows: list[tuple]) -> dict[str, list]:
    return {name: [row[i] for row in rows] for i, name in enumerate(EMPTY)}


def remove_repeats(
    docs: DataFrame,
    *,
    size: int = 13,
    lot_bytes: int = 16 << 20,
    step_bytes: int = 8 << 20,
    id: str = "doc_id",
    text: str = "text",
    content: bool = False,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]): texts without words that an earlier document has.

    A word goes if it lies in a window of ``size`` words whose words also start in a document with a
    smaller id; windows are judged on the input. Documents are dealt into lots of some MB, whose number
    follows the bytes of all texts. Each lot has its own reference shard: the passages that its
    documents share with earlier ones, quoted from the earliest. A suffix automaton of the shard is
    built where the lot is, and the lot's documents are streamed through it.

    Which passages a lot needs is found by hashes of windows, which meet in as many lots. A task sends
    each window of its batch once, with the smallest document, and once for each lot of other documents
    that have it, so a passage that all documents share is a few entries a batch and one passage a
    shard. The words decide what is removed; a hash (some 60 bits) only decides what is quoted.

    A null or empty text has no words. A null id counts as larger than all ids, and rows with equal
    ids as one document: they remove nothing from each other. No rows give no rows.
    """
    share_package(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("b")).first().b or 0
    lots = max(1, -(-total // lot_bytes))
    number = F.col(id).cast("long")
    # Rows without an id are told apart by their text.
    key = F.coalesce(number, F.xxhash64(F.lit(5), text))
    keyed = docs.select(key.alias("key"), F.col(id).alias("id"), number.alias("doc"), utf8(text).alias("text"))

    def windows(batch):
        texts = batch.column(2).to_pylist()
        upto = np.cumsum([len(raw) for raw in texts])
        at = 0
        while at < len(texts):  # some MB of text at a time, or one long text
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step_bytes, "right")))
            keys = batch.column(0).slice(at, end - at).to_numpy()
            nameless = batch.column(1).slice(at, end - at).is_null().to_numpy(zero_copy_only=False)
            yield blobs(list(sent(keys, nameless, texts[at:end])))
            at = end

    def sent(keys, nameless, texts):
        """Kind 0: each window with its smallest document. Kind 1: windows that documents of a lot have too."""
        ids = np.where(nameless, NO_ID, keys)
        made = [window_hashes(raw, size)[1] for raw in texts]
        owner = np.repeat(np.arange(len(made)), [len(m) for m in made])
        hashes = np.concatenate([*made, np.zeros(0, np.uint64)])
        first, later, run = first_and_later(hashes, ids[owner])
        firsts = hashes[first]
        place = (firsts % np.uint64(lots)).astype(np.int64)
        for lot, found, who, n in runs_by_place(place, owner[first], firsts):
            yield 0, lot, found, flag(n, nameless[who]).tobytes(), keys[who].tobytes(), b""
        run, home = distinct(run, keys[owner[later]] % lots, lots)
        for lot, found, who, n in runs_by_place(place[run], home, firsts[run]):
            yield 1, lot, found, n.tobytes(), b"", who.tobytes()

    def settle(table: pa.Table) -> pa.Table:
        """For each window of a lot the earliest document, and the lots of documents to which it is quoted."""
        kinds = table["kind"].to_numpy()
        known, wanted = table.filter(pa.array(kinds == 0)), table.filter(pa.array(kinds == 1))
        hashes, runs = read_hashes(known), column(known, "runs", np.uint32)
        owners = np.repeat(np.arange(len(runs)), runs & np.uint32(0x7FFFFFFF))
        keys = column(known, "keys", np.int64)
        ids = np.where(runs >> np.uint32(31) == 1, NO_ID, keys)
        first, later, run = first_and_later(hashes, ids[owners])
        firsts = hashes[first]
        more = read_hashes(wanted)
        homes = np.repeat(column(wanted, "lots", np.int64), column(wanted, "runs", np.uint32))
        run = np.concatenate([run, np.searchsorted(firsts, more)])
        homes = np.concatenate([keys[owners[later]] % lots, homes])
        if not len(run):
            return pa.table({c: pa.array([], k) for c, k in EMPTY.items()})
        run, homes = distinct(run, homes, lots)
        source = owners[first][run]
        rows = [
            (2, lot, found, n.tobytes(), keys[who // lots].tobytes(), (who % lots).tobytes())
            for lot, found, who, n in runs_by_place(keys[source] % lots, source * lots + homes, firsts[run])
        ]
        return pa.table({c: pa.array(v, EMPTY[c]) for c, v in blobs(rows).items()})

    wanted = map_batches(keyed.select("key", "doc", "text"), windows, BLOB).groupBy("lot").applyInArrow(settle, BLOB)
    homes = keyed.select(F.pmod("key", F.lit(lots)).alias("lot"), "key", "id", "text")

    def quote(pages: pa.Table, asked: pa.Table) -> pa.Table:
        """Passages of the earliest documents, for the lots that have them too."""
        wants: dict[int, dict[int, list[np.ndarray]]] = {}
        for row in range(asked.num_rows):
            one = asked.slice(row, 1)
            ends = np.cumsum(column(one, "runs", np.uint32))
            parts = np.split(read_hashes(one), ends[:-1]) if len(ends) else []
            for key, lot, part in zip(column(one, "keys", np.int64).tolist(), column(one, "lots", np.int64).tolist(), parts):
                wants.setdefault(key, {}).setdefault(lot, []).append(part)
        to, docs_, passages = [], [], []
        low = np.uint64((1 << 56) - 1)
        for key, raw in zip(pages["key"].to_pylist(), pages["text"].to_pylist()):
            if key not in wants:
                continue
            words = raw.split()
            n, hashes = window_hashes(raw, size)
            hashes &= low
            for lot, parts in wants[key].items():
                edges = np.diff(np.concatenate([[0], covered(np.isin(hashes, np.concatenate(parts)), n, size).astype(np.int8), [0]]))
                spans = zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())
                to.append(lot)
                docs_.append(key)
                passages.append(b"\n".join(b" ".join(words[a:b]) for a, b in spans))
        return pa.table({"lot": pa.array(to, pa.int64()), "doc": pa.array(docs_, pa.int64()), "passages": pa.array(passages, pa.binary())})

    quotes = homes.groupBy("lot").cogroup(wanted.groupBy("lot")).applyInArrow(quote, "lot long, doc long, passages binary")
    kind = docs.schema[id].dataType.simpleString()

    def stream(pages: pa.Table, shard: pa.Table) -> pa.Table:
        """Matching statistics of a lot's documents against its reference shard."""
        automaton = SuffixAutomaton()
        for doc, passages in sorted(zip(shard["doc"].to_pylist(), shard["passages"].to_pylist())):
            for passage in passages.split(b"\n"):
                automaton.add(passage.split(), doc)
        words_, removed, digests, texts = [], [], [], []
        for key, named, raw in zip(pages["key"].to_pylist(), pages["id"].is_valid().to_pylist(), pages["text"].to_pylist()):
            words = raw.split()
            starts = automaton.matched(words, key if named else NO_ID, size)
            out = 0
            if starts:
                hits = np.zeros(len(words), bool)
                hits[starts] = True
                mask = covered(hits, len(words), size)
                out = int(mask.sum())
                words_left = [w for w, gone in zip(words, mask.tolist()) if not gone]
            else:
                words_left = words
            kept = b" ".join(words_left)
            words_.append(len(words))
            removed.append(out)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode("utf-8", "replace") if content else None)
        made = {"id": pages["id"], "n_words": pa.array(words_, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(made | ({"kept": pa.array(texts, pa.string())} if content else {}))

    out = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if content else "")
    return homes.groupBy("lot").cogroup(quotes.groupBy("lot")).applyInArrow(stream, out).withColumnRenamed("id", id)

"""Token ids packed into fixed rows by best-fit-decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagtide.llm.bytepairs import encoding
from tagtide.llm.common import map_arrow, map_batches, utf8


class CapacityTree:
    """Open rows by the room they have left. A node tells whether any capacity below it has a row."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, room: int, row: int) -> None:
        if not self.rows[room]:
            node = self.leaves + room
            while node and not self.any[node]:
                self.any[node] = 1
                node >>= 1
        self.rows[room].append(row)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room that still holds ``need``, and that room."""
        node = self.leaves + need
        if not self.any[node]:
            # Up to the first right-hand neighbour that has a row, then down to its least capacity.
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return row, room


def best_fit_decreasing(sizes: np.ndarray, width: int) -> list[list[int]]:
    """Rows of item numbers; the sizes of a row add up to ``width`` at most. Ties keep their order."""
    tree = CapacityTree(width)
    rows: list[list[int]] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        found = tree.take(size) if size < width else None
        if found is None:
            rows.append([item])
            left, row = width - size, len(rows) - 1
        else:
            row, room = found
            rows[row].append(item)
            left = room - size
        if left:
            tree.put(left, row)
    return rows


def encode_parts(docs: DataFrame, ranks: str, *, width: int, end: int, id: str, text: str) -> DataFrame:
    """Ids of each text with an end mark, cut without loss into parts of ``width`` ids at most."""

    def run(batch):
        encode = encoding(ranks).encode_ordinary
        texts = batch.column(1).to_pylist()
        for at in range(0, len(texts), 256):
            rows, parts, sizes, ids = [], [], [], []
            for k, raw in enumerate(texts[at : at + 256], at):
                made = encode(raw.decode("utf-8", "replace"))
                made.append(end)
                packed = np.array(made, "<u4").astype("<u2").tobytes()
                for part, first in enumerate(range(0, len(made), width)):
                    rows.append(k)
                    parts.append(part)
                    sizes.append(min(width, len(made) - first))
                    ids.append(packed[2 * first : 2 * (first + width)])
            yield {"id": batch.column(0).take(pa.array(rows, pa.int64())), "part": parts, "size": sizes, "ids": ids}

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), utf8(text))
    return map_batches(rows, run, f"id {kind}, part int, size int, ids binary")


def pack(
    docs: DataFrame,
    ranks: str,
    *,
    width: int = 2048,
    end: int = 50256,
    lot_bytes: int = 16 << 20,
    seed: int = 17,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pack whole texts into rows of ``width`` ids.

    Parts are dealt by hash into lots; each lot is packed by itself, by best-fit-decreasing with a tree
    over capacities. The number of lots follows the bytes of all texts (a byte is at most one id), so a
    lot fits a task at any size; should equal rows crowd one lot, it is packed in several steps. Lots,
    not partitions, decide what is packed together, so results do not depend on the cluster.

    Rows: lot, step, row, ``ids`` (little-endian uint16, padded with ``end``), ``used``, ``lengths``
    (cumulative, from 0), ``positions`` (uint16, from 0 in every segment and in the padding), and for
    each segment its ``doc_ids`` and ``parts``. A null or empty text is its end mark; no rows give no rows.
    """
    if not 1 <= end <= 65535 or not 1 <= width <= 65535:
        raise ValueError("ids and positions are kept in 16 bits")
    size = docs.agg(F.sum(F.octet_length(text).cast("long") + 1).alias("b")).first().b or 0
    lots = max(1, -(-size // lot_bytes))
    parts = encode_parts(docs, ranks, width=width, end=end, id=id, text=text)
    mixed = F.xxhash64(F.lit(seed), "id", "part", "ids")
    dealt = parts.withColumn("draw", mixed).withColumn("lot", F.pmod("draw", F.lit(lots)))
    tasks = int(max(lots, 1)) if lots < 100_000 else None
    dealt = dealt.repartition(tasks, "lot") if tasks else dealt.repartition("lot")
    dealt = dealt.sortWithinPartitions("lot", "draw", "id").select("lot", "id", "part", "size", "ids")

    kind = docs.schema[id].dataType
    struct = T._parse_datatype_string(
        "lot long, step int, row int, ids binary, used int, lengths array<int>, positions binary, "
        f"doc_ids array<{kind.simpleString()}>, parts array<int>"
    )
    arrow = to_arrow_schema(struct)
    most = 2 * lot_bytes

    def packed(lot: int, step: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        sizes = table["size"].to_numpy()
        ids, keys, part = table["ids"].to_pylist(), table["id"].to_pylist(), table["part"].to_pylist()
        rows = best_fit_decreasing(sizes, width)
        for at in range(0, len(rows), 512):
            some = rows[at : at + 512]
            matrix = np.full((len(some), width), end, "<u2")
            places = np.empty((len(some), width), "<u2")
            lengths = []
            for r, row in enumerate(some):
                bounds = np.concatenate([[0], np.cumsum(sizes[row])]).astype(np.int32)
                used = int(bounds[-1])
                matrix[r, :used] = np.frombuffer(b"".join([ids[i] for i in row]), "<u2")
                starts = np.repeat(bounds, np.diff(np.append(bounds, width)))
                places[r] = np.arange(width) - starts
                lengths.append(bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lot] * len(some), pa.int64()),
                    pa.array([step] * len(some), pa.int32()),
                    pa.array(range(at, at + len(some)), pa.int32()),
                    pa.array([m.tobytes() for m in matrix], arrow.field("ids").type),
                    pa.array([int(b[-1]) for b in lengths], pa.int32()),
                    pa.array(lengths, arrow.field("lengths").type),
                    pa.array([p.tobytes() for p in places], arrow.field("positions").type),
                    pa.array([[keys[i] for i in row] for row in some], arrow.field("doc_ids").type),
                    pa.array([[part[i] for i in row] for row in some], arrow.field("parts").type),
                ],
                schema=arrow,
            )

    def run(batches):
        held: list[pa.RecordBatch] = []
        lot, step, size = None, 0, 0
        for batch in batches:
            lots_here = batch.column(0).to_numpy()
            weight = np.cumsum(batch.column(3).to_numpy().astype(np.int64) * 2)
            at = 0
            while at < len(lots_here):
                if lot is not None and (lots_here[at] != lot or size >= most):
                    yield from packed(lot, step, held)
                    step = step + 1 if lots_here[at] == lot else 0
                    held, size = [], 0
                lot = int(lots_here[at])
                # Up to the end of the lot or to the row that fills the step.
                upto = int(np.searchsorted(lots_here, lot, "right"))
                gone = weight[at - 1] if at else 0
                upto = min(upto, int(np.searchsorted(weight, gone + most - size, "left")) + 1)
                held.append(batch.slice(at, upto - at))
                size += int(weight[upto - 1] - gone)
                at = upto
        if held:
            yield from packed(lot, step, held)

    return map_arrow(dealt, run, struct)


def write_packed(packed: DataFrame, path: str) -> None:
    """Store packed rows as Parquet files with the id matrix and positions as binary rows."""
    packed.write.mode("overwrite").parquet(path)


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """The id matrix of some stored rows."""
    return np.frombuffer(b"".join(rows), "<u2").reshape(-1, width)

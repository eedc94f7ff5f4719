"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagtide.session import durable, share_package

#: Words, in the regular expressions of Spark. ``bytes.split()`` finds the same words in UTF-8.
WORD = r"[^\x20\x09-\x0D]+"

#: Both sides of a worker hold whole batches, of 64 MB unless this is set.
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def utf8(text: str) -> Column:
    """Texts as UTF-8, which spares the workers to decode them; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def map_batches(
    df: DataFrame, batch: Callable[[pa.RecordBatch], dict | Iterator[dict]], schema: T.StructType | str, rows: int | None = None
) -> DataFrame:
    """Apply ``batch`` to Arrow batches, of so many ``rows`` at most. It returns columns by name, or yields several such pieces."""
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches):
        for one in (part for whole in batches for part in parts_of(whole, rows)):
            made = batch(one)
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, struct)


def map_arrow(df: DataFrame, run, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose workers find this package.

    Batches are of ``BATCH`` bytes unless the session says otherwise. Workers stay between tasks and stages, so each
    task gives back what it has freed.
    """

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    spark = df.sparkSession
    share_package(spark)
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH)
    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Give freed memory back to the system: Arrow and the C library keep it for the next task otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def parts_of(batch: pa.RecordBatch, rows: int | None) -> Iterator[pa.RecordBatch]:
    size = rows or max(1, batch.num_rows)
    for at in range(0, max(1, batch.num_rows), size):
        yield batch.slice(at, size)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def smallest_reachable(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: (node, component), the smallest node reachable from each.

    Nodes are longs; nodes without an edge do not appear, loops and repeats are harmless. Rounds of
    hooking: every node takes the smallest label among itself and its neighbours, labels are then
    followed twice. Sums and minima are combined in the map tasks, so a hub costs one row a task,
    and joins are left to adaptive execution, which splits hot keys. Each round is written to the
    shared folder.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = durable(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        # Star of each node: its smallest neighbour or itself.
        two_way = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = two_way.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        grand = parent.select(F.col("a").alias("p"), F.col("p").alias("g"))
        jumped = durable(parent.join(grand, "p").select("a", F.col("g").alias("p")))
        moved = jumped.select(F.col("a").alias("node"), F.col("p").alias("component"))
        labels = moved if labels is None else durable(
            labels.join(moved.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left")
            .select("node", F.coalesce("next", "component").alias("component"))
        )
        # The graph of the labels: an edge between two labels is all that is left of their links.
        ends = links.join(jumped.select("a", F.col("p").alias("pa")), "a")
        ends = ends.join(jumped.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        links = durable(
            ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def whole_runs(batches, key: int = 0, rows: int = 100_000) -> Iterator[pa.Table]:
    """Join batches that are sorted by a key into tables that hold whole runs of it, of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:
            keys = batch.column(key)
            last = held[-1].column(key)[-1]
            same = pa.compute.equal(keys, last).to_numpy(zero_copy_only=False)
            cut = len(same) if same.all() else int(np.argmin(same))
            if cut:
                held.append(batch.slice(0, cut))
            if cut < len(same):
                yield pa.Table.from_batches(held)
                held, size = [batch.slice(cut)], len(same) - cut
            continue
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)

"""Positions in a total order, without one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.session import durable


def with_position(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    into: str = "position",
    chunks: int | None = None,
) -> DataFrame:
    """Number the rows of each key from 1 in the given order.

    Rows are range partitioned by key and order, so a hot key is cut into several even chunks.
    A chunk numbers its own rows and adds the count of its key's earlier chunks. The chunk of a
    row depends on sampled bounds, so the chunked rows are written once and read twice. The
    order should be unique within a key; pass narrow frames. ``chunks`` is their number, by default
    at most the number of shuffle partitions.
    """
    columns = [*keys, *order] if chunks is None else [chunks, *keys, *order]
    chunked = durable(df.repartitionByRange(*columns).withColumn("_chunk", F.spark_partition_id()))
    # One row per key and chunk: keys plus partitions in all, even where a single window has all of them.
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_rows"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        chunked.withColumn("_place", F.row_number().over(in_chunk))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(into, F.col("_place") + F.col("_before"))
        .drop("_chunk", "_place", "_before")
    )

"""Join helpers that hold when one side grows or one key is hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
_FIELD_OVERHEAD = 16


def _field_bytes(df: DataFrame, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + _FIELD_OVERHEAD
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0)) + _FIELD_OVERHEAD
    return F.lit(_FIELD_OVERHEAD)


def measured_bytes(df: DataFrame) -> int:
    """Size of ``df`` as one aggregate; nothing but the number reaches the driver."""
    row = reduce(lambda a, b: a + b, [_field_bytes(df, field) for field in df.schema.fields])
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def small_side(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """A stored table to be broadcast if its measured size allows that, and as it is if not.

    Weighing reads ``df``, so a derived side is joined as it is: adaptive execution knows its size.

    Beyond the bound the join shuffles both sides, and adaptive execution splits hot keys.
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def keep_listed(df: DataFrame, listed: DataFrame, on: str = "tag_name") -> DataFrame:
    """Rows of ``df`` whose key is in ``listed``, however often it is listed."""
    return df.join(listed.select(on).distinct(), on, "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, on: str = "tag_name") -> DataFrame:
    return df.join(listed.select(on).distinct(), on, "left_anti")


def common_tags(left: DataFrame, right: DataFrame, on: str = "tag_name") -> DataFrame:
    """Distinct keys that both frames have."""
    return left.select(on).intersect(right.select(on))


def optional_column(df: DataFrame, name: str, kind: str = "timestamp_ntz") -> Column:
    """The column, or a typed null if ``df`` has none of that name."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def recode_by_table(df: DataFrame, column: str, recodes: DataFrame) -> DataFrame:
    """Replace values by ``recodes(old, new)``; values without an entry stay."""
    table = recodes.select(F.col("old").alias(column), F.col("new").alias("_new"))
    replaced = F.coalesce("_new", column).alias(column)
    return df.join(table, column, "left").select(*[replaced if c == column else c for c in df.columns])

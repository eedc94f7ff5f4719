"""Layout of rows over tasks, and of costly expressions in a plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(scan: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Deal the rows of a scan out by ``key`` to so many tasks, if the caller states a number.

    Texts are few and long where the work per row is heavy, so a small file that cannot be split
    would keep one core busy. A large input has tasks enough and needs no number.
    """
    return scan if tasks is None else scan.repartition(tasks, key)


def spread_few(scan: DataFrame, key: str, tasks: int) -> DataFrame:
    """The rows of a scan as they lie if all cores are busy with them, and dealt out by ``key`` if not.

    For work that does not need the rows of a key together: texts that are not dealt out are not shuffled.
    """
    return scan if scan.rdd.getNumPartitions() >= scan.sparkSession.sparkContext.defaultParallelism else spread(scan, key, tasks)


def complete_rows(df: DataFrame, *fields: str) -> DataFrame:
    """The given fields of the rows that have all of them.

    For fields that are costly expressions: a plain filter would be pushed below their
    projection and compute them a second time, which it cannot be through a generator.
    """
    row = F.array(F.struct(*fields))
    return df.select(F.inline(F.filter(row, lambda r: reduce(lambda a, b: a & b, [r[f].isNotNull() for f in fields]))))

"""As-of search: the first mark of a given, possibly irregular calendar at or after each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_chunk(value: Column) -> Column:
    """Default chunk of a date or timestamp: its month."""
    return F.trunc(value, "month")


def first_mark_at_or_after(
    left: DataFrame, on: str, calendar: DataFrame, mark: str, into: str = "mark", chunk=month_chunk
) -> DataFrame:
    """Add ``into``: the smallest ``mark`` of ``calendar`` that is at or after ``left[on]`` (a left bisection).

    Without a range join or a nested loop. Distinct values of ``on`` and distinct marks are put in one sorted
    column, cut into chunks by ``chunk`` (a month by default); inside a chunk a value takes the first mark ahead
    of it (``first_value`` ignoring nulls over the rows that follow), and a value with no mark ahead in its chunk
    takes the first mark of the next chunk that has one. That carry is a table of one row per chunk.
    The answers go back to the rows by an equi-join on ``on``, so a value that a third of all rows share is
    resolved once, and the join is planned by its measured size (adaptive execution broadcasts a small side).

    ``on`` and ``mark`` share a type (compare a timestamp with dates by casting it first).
    Defined results: a null ``on`` or a value after the last mark gets null; null marks are ignored; repeated
    marks count once; a value equal to a mark gets that mark; an empty calendar gives null everywhere; an
    empty ``left`` gives no rows. Every row of ``left`` stays, with all its columns, repeated rows included.
    ``into`` replaces a column of ``left`` of the same name.
    """
    at, got, part = "__asof_at", "__asof_mark", "__asof_chunk"
    values = left.select(F.col(on).alias(at)).where(F.col(at).isNotNull()).distinct()
    marks = calendar.select(F.col(mark).alias(at)).where(F.col(at).isNotNull()).distinct().withColumn(got, F.col(at))
    kind = marks.schema[got].dataType
    both = values.withColumn(got, F.lit(None).cast(kind)).unionByName(marks).withColumn(part, chunk(F.col(at)))
    # A value sorts before an equal mark, so the mark is among the rows ahead of it.
    ahead = Window.partitionBy(part).orderBy(F.col(at), F.col(got).asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    inside = both.withColumn("__asof_in", F.first(got, ignorenulls=True).over(ahead))
    firsts = both.groupBy(part).agg(F.min(got).alias("__asof_first"))
    later = Window.orderBy(F.col(part)).rowsBetween(1, Window.unboundedFollowing)
    carry = firsts.select(part, F.first("__asof_first", ignorenulls=True).over(later).alias("__asof_next"))
    resolved = (
        inside.where(F.col(got).isNull())
        .join(carry, part, "left")
        .select(F.col(at), F.coalesce("__asof_in", "__asof_next").alias(into))
    )
    kept = left.drop(into) if into in left.columns and into != on else left
    return kept.join(resolved, kept[on] == resolved[at], "left").drop(at)

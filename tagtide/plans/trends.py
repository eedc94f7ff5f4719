"""Trend and platform series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.operators.joins import keep_listed, optional_column
from tagtide.operators.series import (
    WEEK,
    after_date,
    align_weekly,
    fill_weeks,
    merge_trends,
    rescale,
    resample,
    trend_rows,
)
from tagtide.schemas import EARLY_DATES
from tagtide.session import durable


def load_trends(exports: Sequence[DataFrame], names_have_quotations: bool = False) -> DataFrame:
    """``(tag, week, value)`` of wide exports with a ``date`` column and one column per term."""
    return merge_trends([trend_rows(export) for export in exports], names_have_quotations)


def platform_series(
    tag_week: DataFrame,
    tags: DataFrame | None = None,
    step: int = 1,
    start: str | None = None,
    days: int = WEEK,
) -> DataFrame:
    """``(tag, date, value)`` of the given tags, with zeros, over buckets of ``step`` weeks after ``start``.

    ``tag_week`` is read several times and should be a stored table.
    """
    known = tag_week if tags is None else keep_listed(tag_week, tags, "tag")
    names = known.select("tag").distinct()
    # The calendar is that of the whole table, not of the chosen tags.
    buckets = resample(known, step, days, calendar=tag_week)
    return after_date(fill_weeks(buckets, tag_week, names, step, days), "date", start)


def align_series(trend: DataFrame, tag_week: DataFrame, normalise: bool = False) -> DataFrame:
    """``(tag, week, value, so_value)``; post counts are scaled to at most 100 if ``normalise``."""
    aligned = align_weekly(trend, tag_week)
    # The maximum and the scaled rows come from one stored result, as small as the trend.
    return rescale(durable(aligned), "so_value") if normalise else aligned


def trend_markers(trend: DataFrame, early: DataFrame) -> DataFrame:
    """``(tag, kind, date, value)``: the series, and one row per known date of its tags."""
    known = keep_listed(early, trend.withColumnRenamed("tag", "tag_name"))
    dates = F.array(
        *[F.struct(F.lit(c).alias("kind"), optional_column(early, c).alias("date")) for c in EARLY_DATES]
    )
    markers = (
        known.select(F.col("tag_name").alias("tag"), F.inline(dates))
        .filter(F.col("date").isNotNull())
        .withColumn("value", F.lit(None).cast("double"))
    )
    points = trend.select(
        "tag",
        F.lit("series").alias("kind"),
        F.col("week").cast("timestamp_ntz").alias("date"),
        F.col("value").cast("double").alias("value"),
    )
    return points.unionByName(markers)

"""First date at which a series reaches a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.operators.series import WEEK, as_series, listed_weeks


def trend_date(series: DataFrame, threshold: float = 1e-7, value: str = "value") -> DataFrame:
    """``(tag, trend_date)``: first date with a value of at least ``threshold``, which is positive."""
    if threshold <= 0:
        raise ValueError(f"threshold must be positive, got {threshold}")
    series = series if value == "n" else as_series(series)
    reached = series.filter(F.col(value) >= threshold)
    return reached.groupBy("tag").agg(F.min("week").alias("trend_date"))


def median_since_first(
    series: DataFrame, days: int = WEEK, value: str = "value", calendar: DataFrame | None = None
) -> DataFrame:
    """``(tag, median)`` over all weeks from the first positive one to the end of the calendar.

    Weeks without a row are zeros. They are counted, not listed: a zero with that frequency
    joins the positive values. ``calendar`` is the table whose weeks count; give the whole table
    where ``series`` holds some of its tags.
    """
    series = series if value == "n" else as_series(series)
    weeks = listed_weeks(series if calendar is None else as_series(calendar))
    positive = series.filter(F.col(value) > 0).select("tag", "week", F.col(value).cast("double").alias("_value"))
    spans = positive.groupBy("tag").agg(F.min("week").alias("_first"), F.count("*").alias("_rows"))
    span_weeks = F.floor(F.date_diff(weeks["last"], F.col("_first")) / days) + 1
    zeros = spans.select("tag", F.lit(0.0).alias("_value"), (span_weeks - F.col("_rows")).alias("_times"))
    values = positive.select("tag", "_value", F.lit(1).cast("bigint").alias("_times")).unionByName(
        zeros.filter(F.col("_times") > 0)
    )
    return values.groupBy("tag").agg(F.percentile("_value", 0.5, F.col("_times")).alias("median"))


def votes_date(
    series: DataFrame,
    threshold_rel: float = 0.0,
    threshold_abs: float = 5,
    days: int = WEEK,
    value: str = "value",
    calendar: DataFrame | None = None,
) -> DataFrame:
    """``(tag, votes_date)``: first date whose value reaches the threshold.

    The threshold is the larger of ``threshold_abs`` and ``threshold_rel`` times the median since
    the first positive week. Tags without a positive value have no date. ``series`` has one row
    per tag and week; ``calendar`` is the table whose weeks count, by default the series itself.
    """
    series = series if value == "n" else as_series(series)
    calendar = series if calendar is None else as_series(calendar)
    if threshold_rel == 0 and threshold_abs > 0:
        # The median cannot matter.
        reached = series.filter(F.col(value) >= threshold_abs)
        return reached.groupBy("tag").agg(F.min("week").alias("votes_date"))
    threshold = F.greatest(F.col("median") * threshold_rel, F.lit(float(threshold_abs)))
    rows = series.select("tag", "week", F.col(value).alias("_value"))
    levels = median_since_first(series, days, value, calendar).select("tag", threshold.alias("_threshold"))
    first_reached = F.min(F.when(F.col("_value") >= F.col("_threshold"), F.col("week")))
    # A threshold of zero is reached by any week, listed or not.
    start = listed_weeks(calendar)["first"]
    date = F.when(F.first("_threshold") <= 0, F.first("_start")).otherwise(first_reached)
    return (
        rows.withColumn("_start", start)
        .join(levels, "tag")
        .groupBy("tag")
        .agg(date.alias("votes_date"))
        .filter(F.col("votes_date").isNotNull())
    )

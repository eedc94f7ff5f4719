"""Weekly series in long form: one row per tag and week, absent weeks are zero."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.functions.dates import parse_dayfirst_date, week_floor
from tagtide.functions.trends import clean_trend_name, clean_trend_value
from tagtide.operators.joins import drop_listed, keep_listed

WEEK, DAY = 7, 1


def tag_week_counts(uses: DataFrame, days: int = WEEK) -> DataFrame:
    """``(tag, week, n)``: uses per tag and week, or per tag and day with ``days=1``."""
    ts = F.col("creation_ts")
    period = week_floor(ts) if days == WEEK else F.to_date(ts)
    return uses.groupBy("tag", period.alias("week")).agg(F.count("*").alias("n"))


def between_dates(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Both ends belong to the range."""
    kind = df.schema[column].dataType
    return df.filter(F.col(column).between(F.lit(first).cast(kind), F.lit(last).cast(kind)))


def after_date(df: DataFrame, column: str, start: str | None) -> DataFrame:
    """Strictly after ``start``."""
    if start is None:
        return df
    return df.filter(F.col(column) > F.lit(start).cast(df.schema[column].dataType))


def as_series(df: DataFrame) -> DataFrame:
    """``df`` with its columns called ``week`` and ``value``, so that counts and buckets can be used as series."""
    for name, other in (("week", "date"), ("value", "n")):
        if name not in df.columns and other in df.columns:
            df = df.withColumnRenamed(other, name)
    return df


def listed_weeks(series: DataFrame) -> Column:
    """``struct<first, last>`` of the weeks of a series, as a scalar subquery."""
    return series.agg(F.struct(F.min("week").alias("first"), F.max("week").alias("last")).alias("weeks")).scalar()


def resample(series: DataFrame, step: int = 1, days: int = WEEK, calendar: DataFrame | None = None) -> DataFrame:
    """``(tag, date, value)``: sums over ``step`` consecutive weeks, dated by the last of them.

    The first week of the calendar is partial and left out; so is a last bucket that is not full.
    Tags without uses in a bucket have no row for it. ``calendar`` is the table whose weeks count,
    by default the series itself.
    """
    weeks = listed_weeks(series if calendar is None else calendar)
    number = F.floor(F.date_diff("week", weeks["first"]) / days)
    bucket = F.floor((number - 1) / step)
    last_number = F.floor(F.date_diff(weeks["last"], weeks["first"]) / days)
    dated = series.select(
        "tag",
        "n",
        number.alias("_number"),
        (step * (bucket + 1)).alias("_closing"),
        last_number.alias("_last"),
        weeks["first"].alias("_first"),
    ).filter((F.col("_number") >= 1) & (F.col("_closing") <= F.col("_last")))
    date = F.date_add("_first", (F.col("_closing") * days).cast("int"))
    return dated.groupBy("tag", date.alias("date")).agg(F.sum("n").alias("value"))


def fill_weeks(resampled: DataFrame, series: DataFrame, tags: DataFrame, step: int = 1, days: int = WEEK) -> DataFrame:
    """One row per tag and date, zero where ``resampled`` has none; as large as its result."""
    weeks = listed_weeks(series)
    first = F.date_add(weeks["first"], step * days)
    spine = tags.select("tag", weeks["last"].alias("_last"), first.alias("_first")).filter("_first <= _last")
    dates = F.sequence("_first", "_last", F.make_dt_interval(F.lit(step * days)))
    dense = spine.select("tag", F.explode(dates).alias("date"))
    return dense.join(resampled, ["tag", "date"], "left").select(
        "tag", "date", F.coalesce("value", F.lit(0)).alias("value")
    )


def rescale(df: DataFrame, column: str) -> DataFrame:
    """Scale ``column`` so that its maximum over all rows is 100."""
    top = df.agg(F.max(column)).scalar()
    return df.withColumn(column, F.try_divide(F.col(column) * F.lit(100.0), top))


def unknown_tags(wanted: DataFrame, series: DataFrame) -> DataFrame:
    """Tags asked for that the series does not have."""
    return drop_listed(wanted.select("tag").distinct(), series, "tag")


def align_weekly(trend: DataFrame, series: DataFrame) -> DataFrame:
    """``(tag, week, value, so_value)``: post counts beside trend values, over the weeks of the trend.

    Tags that the series does not have are left out; ``unknown_tags`` lists them. The series is read
    twice, for its tags and for its counts, and should be a stored table.
    """
    known = keep_listed(trend.select("tag", week_floor(F.col("week")).alias("week"), "value"), series, "tag")
    counts = series.select("tag", "week", F.col("n").alias("so_value"))
    return known.join(counts, ["tag", "week"], "left").withColumn(
        "so_value", F.coalesce("so_value", F.lit(0))
    )


def platform_rows(aligned: DataFrame) -> DataFrame:
    """Aligned values as one row per platform: ``gt`` for the trend, ``so`` for the posts."""
    values = F.array(
        F.struct(F.lit("gt").alias("platform"), F.col("value").cast("double").alias("value")),
        F.struct(F.lit("so").alias("platform"), F.col("so_value").cast("double").alias("value")),
    )
    return aligned.select("tag", "week", F.inline(values))


def keep_platform_series(rows: DataFrame, platform: str = "so") -> DataFrame:
    return rows.filter(F.col("platform") == platform).drop("platform")


def to_wide(series: DataFrame, tags: Sequence[str], index: str = "date", value: str = "value") -> DataFrame:
    """One column per tag, for the edge of the system; the tags are named by the caller."""
    chosen = series.filter(F.col("tag").isin(list(tags)))
    return chosen.groupBy(index).pivot("tag", list(tags)).agg(F.sum(value)).na.fill(0)


def trend_rows(export: DataFrame, date: str = "date") -> DataFrame:
    """A wide export, one column per term, as ``(date, name, value)`` texts."""
    terms = [c for c in export.columns if c != date]
    entries = [F.struct(F.lit(t).alias("name"), F.col(f"`{t}`").cast("string").alias("value")) for t in terms]
    return export.select(F.col(date).cast("string").alias("date"), F.inline(F.array(*entries)))


def undated_trend_rows(export: DataFrame) -> DataFrame:
    """The rows ``(date, name, value)`` of a long export whose date cannot be read, or is missing."""
    return export.select("date", "name", "value").filter(parse_dayfirst_date(F.col("date")).isNull())


def merge_trends(files: Sequence[DataFrame], drop_quotes: bool = False) -> DataFrame:
    """``(tag, week, value)`` of several long exports ``(date, name, value)``.

    Only dates that every file has are kept. Dates are read day first; ``undated_trend_rows`` lists
    the rows without a date, which are left out.
    """
    numbered = [f.select("date", "name", "value").withColumn("_file", F.lit(i)) for i, f in enumerate(files)]
    rows = reduce(DataFrame.unionByName, numbered).select(
        "_file",
        clean_trend_name(F.col("name"), drop_quotes).alias("tag"),
        parse_dayfirst_date(F.col("date")).alias("week"),
        clean_trend_value(F.col("value")).alias("value"),
    )
    shared = (
        rows.groupBy("week").agg(F.count_distinct("_file").alias("_files")).filter(F.col("_files") == len(files))
    )
    # Years have at most four digits, so there are under four million days and this side is bounded.
    return rows.join(F.broadcast(shared.select("week")), "week", "left_semi").select("tag", "week", "value")

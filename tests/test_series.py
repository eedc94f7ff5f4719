from __future__ import annotations

import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tagtide.operators import series as S
from tagtide.operators.thresholds import median_since_first, trend_date, votes_date
from tagtide.plans.trends import align_series, load_trends, platform_series, trend_markers

MONDAY = date(2024, 1, 1)


def week(n):
    return MONDAY + timedelta(weeks=n)


def tag_week(spark, data):
    return spark.createDataFrame([(t, week(w), n) for t, w, n in data], "tag string, week date, n bigint")


@pytest.fixture(scope="module")
def counts(spark):
    """Nine listed weeks, the first one of them partial."""
    data = [("a", 0, 9), ("a", 1, 1), ("a", 2, 2), ("a", 4, 4), ("a", 8, 8), ("b", 3, 7)]
    return tag_week(spark, data)


def test_weekly_and_daily_counts(spark):
    uses = spark.sql(
        "SELECT * FROM VALUES (timestamp_ntz'2024-01-01 00:00:00', 'a'), (timestamp_ntz'2024-01-07 23:59:59', 'a'), "
        "(timestamp_ntz'2024-01-08 00:00:00', 'a') AS t(creation_ts, tag)"
    )
    assert rows(S.tag_week_counts(uses)) == [("a", week(0), 2), ("a", week(1), 1)]
    assert len(rows(S.tag_week_counts(uses, S.DAY))) == 3


def test_single_weeks_leave_out_the_first(counts):
    assert rows(S.resample(counts)) == [
        ("a", week(1), 1), ("a", week(2), 2), ("a", week(4), 4), ("a", week(8), 8), ("b", week(3), 7),
    ]


def test_buckets_carry_their_last_week_and_must_be_full(counts):
    # Weeks 1-3, 4-6; weeks 7-8 are no full bucket.
    assert rows(S.resample(counts, step=3)) == [("a", week(3), 3), ("a", week(6), 4), ("b", week(3), 7)]


def test_platform_series_has_zeros_and_starts_after_the_date(spark, counts):
    tags = spark.createDataFrame([("b",), ("unknown",)], "tag string")
    got = rows(platform_series(counts, tags, step=2))
    assert got == [("b", week(2), 0), ("b", week(4), 7), ("b", week(6), 0), ("b", week(8), 0)]
    later = rows(platform_series(counts, tags, step=2, start="2024-01-29"))
    assert later == [("b", week(6), 0), ("b", week(8), 0)]


def test_wide_form(counts):
    wide = S.to_wide(S.resample(counts), ["a", "b"])
    assert wide.columns == ["date", "a", "b"]
    assert rows(wide)[2] == (week(3), 0, 7)


def test_alignment_joins_on_the_week(spark, counts):
    trend = spark.createDataFrame(
        [("a", week(3) + timedelta(days=2), 50.0), ("a", week(4), 60.0), ("x", week(4), 1.0)],
        "tag string, week date, value double",
    )
    assert rows(align_series(trend, counts)) == [("a", week(3), 50.0, 0), ("a", week(4), 60.0, 4)]
    assert rows(align_series(trend, counts, normalise=True))[1][3] == 100.0
    assert rows(S.unknown_tags(trend, counts)) == [("x",)]
    posts = S.keep_platform_series(S.platform_rows(align_series(trend, counts)))
    assert rows(posts) == [("a", week(3), 0.0), ("a", week(4), 4.0)]


def test_trends_keep_dates_of_all_files(spark):
    first = spark.createDataFrame(
        [("01/02/2016", "<1", "3"), ("08/02/2016", "5", "6")], 'date string, `machine learning` string, `"c sharp"` string'
    )
    second = spark.createDataFrame([("2016-02-08", 7.5), ("2016-02-15", 8.0)], "date string, java double")
    assert rows(load_trends([first, second], names_have_quotations=True)) == [
        ("c-sharp", date(2016, 2, 8), 6), ("java", date(2016, 2, 8), 7.5), ("machine-learning", date(2016, 2, 8), 5),
    ]
    assert len(rows(load_trends([first]))) == 4
    assert ("machine-learning", date(2016, 2, 1), 0) in rows(load_trends([first]))


def test_dates_of_exports(spark):
    forms = {
        "5/1/2016": date(2016, 1, 5), "5/1/16": date(2016, 1, 5), "2016-01-03 00:00:00": date(2016, 1, 3),
        "2016-1-3": date(2016, 1, 3), "2016-01-03T10:00:00": date(2016, 1, 3), "03.01.2016": date(2016, 1, 3),
        "1/13/2016": date(2016, 1, 13), "3/1/97": date(1997, 1, 3), "week 5": None, "": None, "13/13/2016": None,
    }
    export = spark.createDataFrame([(d, "x", "1") for d in forms] + [(None, "x", "1")], "date string, name string, value string")
    read = [r.week for r in S.merge_trends([export]).collect()]
    assert sorted(read) == sorted(d for d in forms.values() if d)
    assert {r.date for r in S.undated_trend_rows(export).collect()} == {"week 5", "", "13/13/2016", None}
    stamped = spark.sql("SELECT timestamp'2016-01-03 00:00:00' AS date, '7' AS java")
    assert rows(load_trends([stamped])) == [("java", date(2016, 1, 3), 7.0)]
    dated = spark.sql("SELECT date'2016-01-03' AS date, '7' AS java")
    assert rows(load_trends([dated])) == [("java", date(2016, 1, 3), 7.0)]


def test_calendar_of_the_whole_table(spark):
    whole = tag_week(spark, [("a", 1, 10), ("b", 9, 1)])
    part = whole.filter("tag = 'a'")
    assert rows(median_since_first(part, value="n")) == [("a", 10.0)]
    assert rows(median_since_first(part, value="n", calendar=whole)) == [("a", 0.0)]
    assert rows(votes_date(part, 1.5, 2, value="n")) == []
    assert rows(votes_date(part, 1.5, 2, value="n", calendar=whole)) == [("a", week(1))]


def test_counts_and_buckets_are_series(spark, counts):
    assert rows(votes_date(counts)) == rows(votes_date(counts.withColumnRenamed("n", "value")))
    dense = platform_series(counts)
    assert rows(votes_date(dense)) == rows(votes_date(dense.withColumnRenamed("date", "week")))


def test_date_filters(spark):
    df = spark.createDataFrame([(week(n),) for n in range(4)], "week date")
    assert rows(S.between_dates(df, "week", "2024-01-08", "2024-01-15")) == [(week(1),), (week(2),)]
    assert rows(S.after_date(df, "week", "2024-01-08")) == [(week(2),), (week(3),)]


def random_series():
    rng = random.Random(11)
    return {
        f"t{t}": {w: rng.randrange(1, 9) for w in range(20) if rng.random() < 0.15 + 0.08 * t} for t in range(10)
    } | {"late": {19: 3}}


def brute_force_votes(values, last, rel, at_least):
    """First week at the threshold, which looks at all weeks since the first positive one."""
    if not values:
        return None
    since = [values.get(w, 0) for w in range(min(values), last + 1)]
    threshold = max(rel * statistics.median(since), at_least)
    reached = [w for w in range(last + 1) if values.get(w, 0) >= threshold]
    return week(reached[0]) if reached else None


@pytest.mark.parametrize(("rel", "at_least"), [(0.0, 5), (1.5, 2), (3.0, 1), (0.0, 0)])
def test_votes_date(spark, rel, at_least):
    data = random_series()
    series = tag_week(spark, [(t, w, n) for t, values in data.items() for w, n in values.items()])
    first = min(w for values in data.values() for w in values)
    last = max(w for values in data.values() for w in values)
    expected = {t: brute_force_votes(v, last, rel, at_least) for t, v in data.items()}
    if at_least == 0:
        expected = {t: week(first) for t, v in data.items() if v}
    got = {r.tag: r.votes_date for r in votes_date(series, rel, at_least, value="n").collect()}
    assert got == {t: d for t, d in expected.items() if d is not None}


def test_zero_rows_and_absent_rows_give_the_same_median(spark):
    sparse = tag_week(spark, [("a", 1, 4), ("a", 4, 2), ("b", 6, 1)])
    dense = tag_week(spark, [("a", w, {1: 4, 4: 2}.get(w, 0)) for w in range(7)] + [("b", 6, 1)])
    assert rows(median_since_first(sparse, value="n")) == rows(median_since_first(dense, value="n"))
    assert rows(median_since_first(sparse, value="n")) == [("a", 0.0), ("b", 1.0)]


def test_trend_date_needs_a_positive_threshold(spark, counts):
    assert rows(trend_date(counts, 4, value="n")) == [("a", week(0)), ("b", week(3))]
    with pytest.raises(ValueError):
        trend_date(counts, 0)


def test_trend_markers_use_the_columns_there_are(spark):
    trend = spark.createDataFrame([("a", week(0), 1.0)], "tag string, week date, value double")
    early = spark.sql("SELECT 'a' AS tag_name, timestamp_ntz'2020-01-01' AS ad_date UNION ALL SELECT 'z', NULL")
    got = trend_markers(trend, early).select("tag", "kind", F.col("date").cast("string"), "value")
    assert rows(got) == [("a", "ad_date", "2020-01-01 00:00:00", None), ("a", "series", "2024-01-01 00:00:00", 1.0)]

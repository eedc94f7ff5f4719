from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from conftest import ordered, rows
from tagtide.operators.appearance import (
    cumulative_since,
    cumulative_uses,
    early_appearances,
    earliest_n,
    first_and_nth_dates,
    first_use,
    with_baseline_row,
)
from tagtide.operators.ordering import with_position

START = datetime(2016, 1, 1)
USES = "id bigint, creation_ts timestamp_ntz, tag string"


def hour(n):
    return START + timedelta(hours=n)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the uses belong to one tag, and many of those fall on one instant."""
    rng = random.Random(7)
    data = [(i, hour(rng.randrange(40)), f"t{rng.randrange(30)}") for i in range(4_000)]
    data += [(4_000 + i, hour(5 if i % 2 else rng.randrange(5, 40)), "hot") for i in range(2_000)]
    return data, spark.createDataFrame(data, USES).repartition(7)


def brute_force_earliest(data, n):
    by_tag = defaultdict(list)
    for _, ts, tag in data:
        by_tag[tag].append(ts)
    kept = [(ts, tag) for tag, dates in by_tag.items() for ts in dates if sum(d < ts for d in dates) < n]
    return ordered(kept)


@pytest.mark.parametrize("n", [1, 3])
def test_earliest_n_keeps_all_ties(skewed, n):
    data, uses = skewed
    got = rows(earliest_n(uses, n))
    assert got == brute_force_earliest(data, n)
    assert sum(tag == "hot" for _, tag in got) >= 1_000


def test_earliest_one_agrees_with_minimum(spark, skewed):
    _, uses = skewed
    assert set(rows(earliest_n(uses, 1))) == {(r.first_use_date, r.tag) for r in first_use(uses).collect()}


def test_fewer_uses_than_n(spark):
    uses = spark.createDataFrame([(1, hour(2), "a"), (2, hour(1), "a")], USES)
    assert rows(earliest_n(uses, 5)) == [(hour(1), "a"), (hour(2), "a")]
    assert rows(first_and_nth_dates(uses, 2, "tag")) == [("a", hour(1), hour(2))]
    assert rows(first_and_nth_dates(uses, 3, "tag")) == [("a", hour(1), None)]


def test_early_appearances(spark):
    data = [("a", "SQ", hour(3)), ("a", "SQ", hour(1)), ("a", "A", hour(2)), ("b", "C", hour(4)), ("b", "X", hour(0))]
    uses = spark.createDataFrame(data, "tag string, platform string, creation_ts timestamp_ntz")
    got = [r.asDict() for r in early_appearances(uses, 2).orderBy("tag_name").collect()]
    nothing = dict.fromkeys(
        ["first_use_date", "nth_use_date", "ad_date", "nth_ad_date", "course_date", "nth_course_date"]
    )
    assert got == [
        {"tag_name": "a", "tag_count": 2, **nothing, "first_use_date": hour(1), "nth_use_date": hour(3), "ad_date": hour(2)},
        {"tag_name": "b", "tag_count": 0, **nothing, "course_date": hour(4)},
    ]


def test_cumulative_uses_of_a_hot_tag(skewed):
    data, uses = skewed
    expected = []
    for tag in {t for _, _, t in data}:
        dates = sorted((ts, i) for i, ts, t in data if t == tag)
        expected += [(ts, tag, place) for place, (ts, _) in enumerate(dates, 1)]
    assert rows(cumulative_uses(uses)) == ordered(expected)


def test_position_without_keys_spans_partitions(spark):
    numbers = list(range(1_000))
    random.Random(3).shuffle(numbers)
    df = spark.createDataFrame([(n,) for n in numbers], "n int").repartition(5)
    for chunks in (None, 3, 20):
        assert rows(with_position(df, order=("n",), chunks=chunks)) == [(n, n + 1) for n in range(1_000)]


def test_baseline_row_stands_one_below_the_lowest_value(spark):
    data = [(hour(1), "a", 4), (hour(2), "a", 5), (hour(1), "b", 1), (hour(1), "c", 0)]
    cumulative = spark.createDataFrame(data, "date timestamp_ntz, tag string, cumulative_value bigint")
    got = rows(with_baseline_row(cumulative, "2016-01-01"))
    assert got == ordered([*data, (START, "a", 3), (START, "b", 0)])


def test_running_numbers_do_not_depend_on_the_bucket(spark):
    uses = spark.createDataFrame(
        [(i, datetime(2024, 1, 1 + i % 4, i % 5), "a" if i % 3 else "b") for i in range(60)] + [(99, datetime(2023, 1, 1), "old")],
        "id long, creation_ts timestamp_ntz, tag string",
    )
    by_hour = rows(cumulative_since(uses, "2024-01-02"))
    assert by_hour == rows(cumulative_since(uses, "2024-01-02", bucket="year"))
    data = [(r.creation_ts, r.id, r.tag) for r in uses.collect()]
    cut = datetime(2024, 1, 2)
    expected = []
    for tag in ("a", "b"):
        own = sorted(d for d in data if d[2] == tag)
        expected += [(ts, tag, n) for n, (ts, _, _) in enumerate(own, 1) if ts >= cut]
        expected.append((cut, tag, sum(ts < cut for ts, _, _ in own)))
    assert by_hour == sorted(expected)


def test_given_counts_spare_a_scan(spark):
    uses = spark.createDataFrame(
        [(datetime(2024, 1, d), t, p) for d, t, p in [(1, "a", "SQ"), (2, "a", "SQ"), (3, "a", "A"), (1, "b", "C")]],
        "creation_ts timestamp_ntz, tag string, platform string",
    )
    counts = uses.groupBy("tag", "platform").count().withColumnRenamed("count", "n")
    assert rows(early_appearances(uses, 2)) == rows(early_appearances(uses, 2, counts))

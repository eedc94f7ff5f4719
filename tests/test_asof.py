"""As-of search against a left bisection in Python."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left

from pyspark.sql import functions as F

from tagtide.operators.asof import first_mark_at_or_after

D = dt.date


def brute(values, marks):
    cal = sorted({m for m in marks if m is not None})
    out = []
    for v in values:
        i = bisect_left(cal, v) if v is not None else len(cal)
        out.append(cal[i] if i < len(cal) else None)
    return out


def run(spark, values, marks, **kw):
    left = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id long, day date, mark string")
    cal = spark.createDataFrame([(m,) for m in marks], "week date")
    got = first_mark_at_or_after(left, "day", cal, "week", **kw)
    assert got.count() == len(values)
    return [r["mark"] for r in sorted(got.collect(), key=lambda r: r["id"])]


def test_sunday_calendar_with_a_missing_week_and_an_empty_month(spark):
    marks = [D(2024, 1, 7), D(2024, 1, 14), D(2024, 1, 28), D(2024, 4, 7), D(2024, 4, 7), None]
    values = [D(2024, 1, 1), D(2024, 1, 7), D(2024, 1, 8), D(2024, 1, 15), D(2024, 1, 29), D(2024, 2, 20),
              D(2024, 3, 31), D(2024, 4, 7), D(2024, 4, 8), None, D(2024, 1, 8)]
    assert run(spark, values, marks) == brute(values, marks)


def test_hot_value_ties_and_many_chunks(spark):
    import random

    rnd = random.Random(7)
    base = D(2020, 1, 1)
    marks = [base + dt.timedelta(days=rnd.randrange(0, 900)) for _ in range(40)]
    values = [base + dt.timedelta(days=rnd.randrange(-30, 930)) for _ in range(300)] + [D(2021, 6, 1)] * 300
    assert run(spark, values, marks) == brute(values, marks)
    # Chunks of one day put every carry across a chunk border.
    assert run(spark, values, marks, chunk=lambda c: c) == brute(values, marks)


def test_empty_calendar_and_empty_left(spark):
    assert run(spark, [D(2024, 1, 1), None], []) == [None, None]
    assert run(spark, [], [D(2024, 1, 1)]) == []


def test_plan_has_no_range_join(spark):
    left = spark.range(100).select(F.date_add(F.lit(D(2024, 1, 1)), F.col("id").cast("int")).alias("day"))
    cal = spark.range(10).select(F.date_add(F.lit(D(2024, 1, 7)), (F.col("id") * 7).cast("int")).alias("week"))
    plan = first_mark_at_or_after(left, "day", cal, "week")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

"""Weekly and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.catalogue.inputs import DAILY_SQL, USES_SQL, daily_counts, daily_series
from tagtide.catalogue.registry import query, table
from tagtide.operators.series import (
    DAY,
    between_dates,
    keep_platform_series,
    platform_rows,
    resample,
    tag_week_counts,
    to_wide,
    unknown_tags,
    merge_trends,
)
from tagtide.operators.series import undated_trend_rows as undated_rows
from tagtide.operators.thresholds import median_since_first, trend_date, votes_date
from tagtide.plans.trends import align_series, load_trends, platform_series
from tagtide.session import durable

_ORDER_WEEKS_SQL = """
order_weeks AS (
  SELECT o_orderpriority AS tag, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n
  FROM orders GROUP BY ALL
)"""


def _order_uses(spark, sf_dir, tag="o_orderpriority"):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderdate").alias("creation_ts"), F.col(tag).alias("tag"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

@query(f"WITH {_ORDER_WEEKS_SQL} SELECT tag, CAST(week AS VARCHAR) AS week, n FROM order_weeks")
def weekly_counts(spark, sf_dir):
    return tag_week_counts(_order_uses(spark, sf_dir)).withColumn("week", F.col("week").cast("string"))


@query(
    f"""
WITH {_ORDER_WEEKS_SQL},
numbered AS (
  SELECT tag, n, CAST((week - first) / 7 AS BIGINT) AS i, first, CAST((last - first) / 7 AS BIGINT) AS last_i
  FROM order_weeks, (SELECT min(week) AS first, max(week) AS last FROM order_weeks)
),
closed AS (SELECT *, 4 * ((i - 1) // 4 + 1) AS closing FROM numbered WHERE i >= 1)
SELECT tag, CAST(first + CAST(7 * closing AS INTEGER) AS VARCHAR) AS date, CAST(sum(n) AS BIGINT) AS value
FROM closed WHERE closing <= last_i GROUP BY tag, first, closing"""
)
def resampled_counts(spark, sf_dir):
    """Four-week sums of the orders of each priority."""
    sums = resample(tag_week_counts(_order_uses(spark, sf_dir)), step=4)
    return sums.withColumn("date", F.col("date").cast("string"))


@query(
    f"""
WITH {USES_SQL}, {DAILY_SQL},
bounds AS (SELECT min(day) AS first, max(day) AS last FROM daily_views),
spine AS (
  SELECT DISTINCT v.tag, b.first + CAST(3 * g.k AS INTEGER) AS date
  FROM daily_views v, bounds b, generate_series(1, 20000) AS g(k)
  WHERE b.first + CAST(3 * g.k AS INTEGER) <= b.last AND b.first + CAST(3 * g.k AS INTEGER) > DATE '2024-01-06'
)
SELECT s.tag, CAST(s.date AS VARCHAR) AS date, CAST(coalesce(sum(v.n), 0) AS BIGINT) AS value
FROM spine s LEFT JOIN daily_views v ON v.tag = s.tag AND v.day <= s.date AND v.day > s.date - 3
GROUP BY s.tag, s.date"""
)
def platform_series_from(spark, sf_dir):
    """Views per user in steps of three days, with zeros, after a starting date."""
    counts = daily_counts(spark, sf_dir, "SV")
    series = platform_series(counts, step=3, start="2024-01-06", days=DAY)
    return series.withColumn("date", F.col("date").cast("string"))


@query(
    """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
       count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT",
       count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-HIGH",
       count(*) FILTER (o_orderpriority = '3-MEDIUM') AS "3-MEDIUM",
       count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED",
       count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW"
FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'
GROUP BY CAST(o_orderdate AS DATE)"""
)
def wide_series_in_range(spark, sf_dir):
    uses = between_dates(_order_uses(spark, sf_dir), "creation_ts", "1996-01-01", "1997-12-31")
    wide = to_wide(tag_week_counts(uses, DAY), PRIORITIES, index="week", value="n")
    return wide.select(F.col("week").cast("string").alias("date"), *PRIORITIES)


_ALIGN_SQL = """
trend AS (
  SELECT l_linestatus AS tag, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS value
  FROM lineitem GROUP BY ALL
  UNION ALL
  SELECT l_returnflag, CAST(date_trunc('week', l_shipdate) AS DATE), sum(l_quantity) FROM lineitem GROUP BY ALL
),
order_weeks AS (
  SELECT o_orderstatus AS tag, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n
  FROM orders GROUP BY ALL
)"""


def _ship_trend(spark, sf_dir):
    """Quantity shipped per week, by line status and by return flag; only the statuses are order statuses too."""
    lines = table(spark, sf_dir, "lineitem")
    tags = F.explode(F.array("l_linestatus", "l_returnflag"))
    rows = lines.select(tags.alias("tag"), F.trunc(F.to_date("l_shipdate"), "week").alias("week"), "l_quantity")
    return rows.groupBy("tag", "week").agg(F.sum("l_quantity").alias("value"))


@query(
    f"""
WITH {_ALIGN_SQL},
aligned AS (
  SELECT t.tag, t.week, t.value, coalesce(o.n, 0) AS n
  FROM trend t LEFT JOIN order_weeks o ON o.tag = t.tag AND o.week = t.week
  WHERE t.tag IN (SELECT tag FROM order_weeks)
)
SELECT tag, CAST(week AS VARCHAR) AS week, value, round(n * 100.0 / (SELECT max(n) FROM aligned), 6) AS so_value
FROM aligned"""
)
def aligned_normalised_series(spark, sf_dir):
    series = durable(tag_week_counts(_order_uses(spark, sf_dir, "o_orderstatus")))
    aligned = align_series(_ship_trend(spark, sf_dir), series, normalise=True)
    return aligned.select(
        "tag", F.col("week").cast("string").alias("week"), "value", F.round("so_value", 6).alias("so_value")
    )


@query(
    f"""
WITH {_ALIGN_SQL}
SELECT t.tag, CAST(t.week AS VARCHAR) AS week, CAST(coalesce(o.n, 0) AS DOUBLE) AS value
FROM trend t LEFT JOIN order_weeks o ON o.tag = t.tag AND o.week = t.week
WHERE t.tag IN (SELECT tag FROM order_weeks)"""
)
def post_series_only(spark, sf_dir):
    series = durable(tag_week_counts(_order_uses(spark, sf_dir, "o_orderstatus")))
    rows = platform_rows(align_series(_ship_trend(spark, sf_dir), series))
    return keep_platform_series(rows).withColumn("week", F.col("week").cast("string"))


@query(f"WITH {_ALIGN_SQL} SELECT DISTINCT tag FROM trend WHERE tag NOT IN (SELECT tag FROM order_weeks)")
def trend_tags_without_series(spark, sf_dir):
    series = durable(tag_week_counts(_order_uses(spark, sf_dir, "o_orderstatus")))
    return unknown_tags(_ship_trend(spark, sf_dir), series)


@query(
    """
WITH a AS (
  SELECT CAST(o_orderdate AS DATE) AS week, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY ALL
),
b AS (
  SELECT CAST(l_shipdate AS DATE) AS week, l_returnflag AS name, count(*) AS n
  FROM lineitem GROUP BY ALL
),
texts AS (
  SELECT replace(name, ' ', '-') AS tag, week, CASE WHEN n < 3 THEN 0 ELSE n END AS value
  FROM (SELECT DISTINCT week FROM a) CROSS JOIN (SELECT DISTINCT name FROM a) LEFT JOIN a USING (week, name)
  UNION ALL
  SELECT name, week, n
  FROM (SELECT DISTINCT week FROM b) CROSS JOIN (SELECT DISTINCT name FROM b) LEFT JOIN b USING (week, name)
)
SELECT tag, CAST(week AS VARCHAR) AS week, CAST(value AS INTEGER) AS value FROM texts
WHERE week IN (SELECT week FROM a) AND week IN (SELECT week FROM b)"""
)
def trend_inner_merge(spark, sf_dir):
    """Two wide exports: priorities with texts such as '<3' and day-first dates, and quoted flags.

    An export has a cell for every date and name, so cells without a count are null rows.
    """
    days = table(spark, sf_dir, "orders").groupBy(
        F.date_format(F.to_date("o_orderdate"), "dd/MM/yyyy").alias("date"), "o_orderpriority"
    )
    counts = days.agg(F.count("*").alias("n"))
    written = F.max(F.when(F.col("n") < 3, F.lit("<3")).otherwise(F.col("n").cast("string")))
    first = counts.groupBy("date").pivot("o_orderpriority", PRIORITIES).agg(written)

    lines = table(spark, sf_dir, "lineitem")
    flags = lines.groupBy(F.to_date("l_shipdate").alias("date"), F.concat(F.lit('"'), "l_returnflag", F.lit('"')).alias("flag"))
    second = flags.count().groupBy("date").pivot("flag", ['"A"', '"N"', '"R"']).agg(F.max("count"))
    # Exports are files; the merge reads them for their shared dates and for their rows.
    merged = load_trends([durable(first), durable(second)], names_have_quotations=True)
    return merged.select("tag", F.col("week").cast("string").alias("week"), F.col("value").cast("int").alias("value"))


# Medians and thresholds over all days since the first view, zeros included.
_THRESHOLD_SQL = f"""
WITH {USES_SQL}, {DAILY_SQL},
span AS (SELECT tag, min(day) AS first FROM votes GROUP BY tag),
spine AS (
  SELECT s.tag, s.first + CAST(g.k AS INTEGER) AS day
  FROM span s, generate_series(0, 20000) AS g(k)
  WHERE s.first + CAST(g.k AS INTEGER) <= (SELECT max(day) FROM daily_views)
),
medians AS (
  SELECT s.tag, median(coalesce(v.n, 0)) AS median
  FROM spine s LEFT JOIN votes v ON v.tag = s.tag AND v.day = s.day GROUP BY s.tag
)"""


@query(
    _THRESHOLD_SQL
    + """,
v AS (
  SELECT votes.tag, min(day) AS d FROM votes JOIN medians USING (tag)
  WHERE n >= greatest(1.5 * median, 2) GROUP BY votes.tag
),
t AS (SELECT tag, min(day) AS d FROM trend WHERE n >= 1 GROUP BY tag)
SELECT coalesce(v.tag, t.tag) AS tag, CAST(v.d AS VARCHAR) AS votes_date, CAST(t.d AS VARCHAR) AS trend_date
FROM v FULL JOIN t ON v.tag = t.tag"""
)
def threshold_dates(spark, sf_dir):
    votes = votes_date(daily_series(spark, sf_dir, "SV"), threshold_rel=1.5, threshold_abs=2, days=DAY)
    trend = trend_date(daily_series(spark, sf_dir, "GT"), threshold=1)
    both = votes.join(trend, "tag", "full")
    return both.select("tag", *[F.col(c).cast("string").alias(c) for c in ("votes_date", "trend_date")])


@query(_THRESHOLD_SQL + " SELECT tag, CAST(median AS DOUBLE) AS median FROM medians")
def median_daily_views(spark, sf_dir):
    return median_since_first(daily_series(spark, sf_dir, "SV"), days=DAY)


@query(
    """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'week ' || o_orderkey ELSE NULL END AS date, 'order' || o_orderkey AS name,
       CAST(o_orderkey AS VARCHAR) AS value
FROM orders WHERE o_orderkey % 5 <= 1"""
)
def undated_trend_rows(spark, sf_dir):
    """Orders as rows of an export: dates in four forms, and two kinds that are no date."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    date = (
        F.when(key % 5 == 0, F.concat(F.lit("week "), key))
        .when(key % 5 == 1, F.lit(None))
        .when(key % 5 == 2, F.concat(day.cast("string"), F.lit(" 00:00:00")))
        .when(key % 5 == 3, F.date_format(day, "d/M/yy"))
        .otherwise(F.date_format(day, "d/M/yyyy"))
    )
    export = table(spark, sf_dir, "orders").select(
        date.alias("date"), F.concat(F.lit("order"), key).alias("name"), key.cast("string").alias("value")
    )
    return undated_rows(export)


@query(
    """
SELECT 'order' || o_orderkey AS tag, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS week, CAST(o_orderkey AS DOUBLE) AS value
FROM orders"""
)
def trend_date_forms(spark, sf_dir):
    """One long export whose dates are written in five forms; each is read."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    date = (
        F.when(key % 5 == 0, F.date_format(day, "d/M/yy"))
        .when(key % 5 == 1, F.col("o_orderdate").cast("string"))
        .when(key % 5 == 2, F.date_format(day, "dd.MM.yyyy"))
        .when(key % 5 == 3, F.concat(day.cast("string"), F.lit("T12:30:00")))
        .otherwise(F.date_format(day, "d/M/yyyy"))
    )
    export = table(spark, sf_dir, "orders").select(
        date.alias("date"), F.concat(F.lit("order"), key).alias("name"), key.cast("string").alias("value")
    )
    merged = merge_trends([export])
    return merged.select("tag", F.col("week").cast("string").alias("week"), "value")


_SUNDAY_WEEKS_SQL = """
WITH bounds AS (
  SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders
),
sundays AS (
  SELECT CAST(unnest(generate_series(CAST(lo - CAST(dayofweek(lo) AS INTEGER) AS TIMESTAMP),
                                     CAST(hi - CAST(dayofweek(hi) AS INTEGER) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week
  FROM bounds
),
weeks AS (
  SELECT week FROM (SELECT week, row_number() OVER (ORDER BY week) AS i FROM sundays) WHERE i <> 3
),
dated AS (SELECT o_orderpriority AS tag, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT tag, CAST((SELECT min(week) FROM weeks WHERE week >= day) AS VARCHAR) AS week, count(*) AS n
FROM dated GROUP BY ALL
"""


@query(_SUNDAY_WEEKS_SQL)
def orders_by_sunday_weeks(spark, sf_dir):
    """Orders of each priority counted by a calendar of Sundays with its third week missing, as a search-interest export is.

    Each order goes to the first listed Sunday on or after its day; orders after the last Sunday have a null week.
    """
    from tagtide.operators.asof import first_mark_at_or_after

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tag"), F.to_date("o_orderdate").alias("day"))
    sunday = lambda d: F.date_sub(d, F.dayofweek(d) - 1)
    span = orders.agg(sunday(F.min("day")).alias("lo"), sunday(F.max("day")).alias("hi"))
    calendar = span.select(F.posexplode(F.sequence("lo", "hi", F.expr("INTERVAL 7 DAYS"))).alias("i", "week")).where(F.col("i") != 2)
    weeks = first_mark_at_or_after(orders, "day", calendar, "week", into="week")
    return weeks.groupBy("tag", F.col("week").cast("string").alias("week")).agg(F.count(F.lit(1)).alias("n"))

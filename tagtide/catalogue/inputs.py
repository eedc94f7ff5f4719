"""The given tables in the roles of posts, adverts, courses, series and labels.

In ``events`` a user stands for a tag and an event type for a platform: signups are questions,
clicks are adverts, purchases are courses, views are votes, errors are search interest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.catalogue.registry import table, texts
from tagtide.operators.appearance import early_appearances
from tagtide.operators.series import DAY, resample, tag_week_counts
from tagtide.plans.adoption import adoption_table
from tagtide.session import durable

USES_SQL = """
uses AS (
  SELECT event_id AS id, ts AS creation_ts, 'user' || user_id AS tag,
         CASE event_type WHEN 'signup' THEN 'SQ' WHEN 'click' THEN 'A' WHEN 'view' THEN 'SV'
              WHEN 'error' THEN 'GT' WHEN 'purchase' THEN 'C' END AS platform
  FROM events
)"""

EARLY_SQL = (
    USES_SQL
    + """,
ranked AS (
  SELECT tag, platform, creation_ts, row_number() OVER (PARTITION BY tag, platform ORDER BY creation_ts) AS rn
  FROM uses WHERE platform IN ('SQ', 'A', 'C')
),
early AS (
  SELECT tag AS tag_name, count(*) FILTER (platform = 'SQ') AS tag_count,
         min(creation_ts) FILTER (platform = 'SQ' AND rn = 1) AS first_use_date,
         min(creation_ts) FILTER (platform = 'SQ' AND rn = 5) AS nth_use_date,
         min(creation_ts) FILTER (platform = 'A' AND rn = 1) AS ad_date,
         min(creation_ts) FILTER (platform = 'A' AND rn = 5) AS nth_ad_date,
         min(creation_ts) FILTER (platform = 'C' AND rn = 1) AS course_date,
         min(creation_ts) FILTER (platform = 'C' AND rn = 5) AS nth_course_date
  FROM ranked GROUP BY tag
)"""
)

# Daily views and errors per user; the first day of each series is left out.
DAILY_SQL = """
daily_views AS (
  SELECT tag, CAST(creation_ts AS DATE) AS day, count(*) AS n FROM uses WHERE platform = 'SV' GROUP BY ALL
),
daily_errors AS (
  SELECT tag, CAST(creation_ts AS DATE) AS day, count(*) AS n FROM uses WHERE platform = 'GT' GROUP BY ALL
),
votes AS (
  SELECT tag, day, n FROM daily_views WHERE day > (SELECT min(day) FROM daily_views)
),
trend AS (
  SELECT tag, day, n FROM daily_errors WHERE day > (SELECT min(day) FROM daily_errors)
)"""


def _delay_sql(pair: tuple[str, str]) -> str:
    a, b = pair
    micros = f"epoch_us({b.lower()}) - epoch_us({a.lower()})"
    return f"CAST(floor(({micros}) / 86400000000.0) AS BIGINT) AS {a}_{b}"


def _sequence_sql(labels: dict[str, str]) -> str:
    entries = ", ".join(
        f"{{'d': {column}, 'o': {place}, 'l': '{label}'}}" for place, (label, column) in enumerate(labels.items())
    )
    known = f"list_sort(list_filter([{entries}], lambda x: x.d IS NOT NULL))"
    return f"coalesce(array_to_string(list_transform({known}, lambda x: x.l), '-'), '')"


_DELAYS = [
    ("SQ1", "SQ5"), ("SQ5", "C1"), ("SQ5", "A1"), ("SQ1", "SV"), ("SQ1", "C1"), ("SQ1", "A1"), ("A1", "A5"),
    ("C1", "C5"), ("SV", "A1"), ("GT", "A1"), ("SV", "C1"), ("GT", "C1"), ("C1", "A1"), ("GT", "SQ1"),
]

ADOPTION_SQL = (
    EARLY_SQL
    + ","
    + DAILY_SQL
    + f""",
dates AS (
  SELECT tag_name, first_use_date AS sq1, nth_use_date AS sq5, ad_date AS a1, nth_ad_date AS a5,
         course_date AS c1, nth_course_date AS c5, CAST(v.d AS TIMESTAMP) AS sv, CAST(t.d AS TIMESTAMP) AS gt
  FROM early
  LEFT JOIN (SELECT tag, min(day) AS d FROM votes WHERE n >= 2 GROUP BY tag) v ON v.tag = tag_name
  LEFT JOIN (SELECT tag, min(day) AS d FROM trend WHERE n > 0 GROUP BY tag) t ON t.tag = tag_name
),
adoption AS (
  SELECT tag_name,
         {_sequence_sql(dict(zip("SQ1 SQ5 A1 C1 A5 C5 SV GT".split(), "sq1 sq5 a1 c1 a5 c5 sv gt".split())))}
           AS full_adoption_seq,
         {_sequence_sql(dict(zip("SQ A C SV GT".split(), "sq1 a1 c1 sv gt".split())))} AS short_adoption_seq,
         {", ".join(_delay_sql(p) for p in _DELAYS)}
  FROM dates
)"""
)


def event_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, creation_ts, tag, platform)``; purchases are courses."""
    kind = F.col("event_type")
    platform = (
        F.when(kind == "signup", "SQ")
        .when(kind == "click", "A")
        .when(kind == "view", "SV")
        .when(kind == "error", "GT")
        .when(kind == "purchase", "C")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("creation_ts"),
        F.concat(F.lit("user"), "user_id").alias("tag"),
        platform.alias("platform"),
    )


def all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tag, platform, week, n)`` per day, stored: several series and the question counts come from it."""
    uses = event_uses(spark, sf_dir).withColumn("tag", F.struct("tag", "platform"))
    counts = tag_week_counts(uses, DAY)
    return durable(counts.select("tag.tag", "tag.platform", "week", "n"))


def on_platform(counts: DataFrame, platform: str) -> DataFrame:
    return counts.filter(F.col("platform") == platform).drop("platform")


def event_early(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    return early_appearances(event_uses(spark, sf_dir), counts=counts)


def daily_counts(spark: SparkSession, sf_dir: str, platform: str) -> DataFrame:
    """Stored, because a series reads its counts for the calendar and for the sums."""
    uses = event_uses(spark, sf_dir).filter(F.col("platform") == platform)
    return durable(tag_week_counts(uses, DAY))


def daily_series(spark: SparkSession, sf_dir: str, platform: str) -> DataFrame:
    """``(tag, date, value)``, one row per tag and day with uses; other days are zero."""
    return resample(daily_counts(spark, sf_dir, platform), days=DAY)


def event_adoption(spark: SparkSession, sf_dir: str, early: DataFrame | None = None) -> DataFrame:
    counts = all_counts(spark, sf_dir)
    return adoption_table(
        event_early(spark, sf_dir, counts) if early is None else early,
        votes=resample(on_platform(counts, "SV"), days=DAY),
        trend=resample(on_platform(counts, "GT"), days=DAY),
        days=DAY,
        votes_abs=2,
    )


def post_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a line of a post dump, tagged with its user and its type."""
    plain = F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T"))
    written = F.when(F.contains(plain, F.lit(".")), plain).otherwise(F.concat(plain, F.lit(".0")))
    return texts(spark, sf_dir, "events", "event_id").select(
        F.concat(
            F.lit('  <row Id="'), "event_id", F.lit('" PostTypeId="1" CreationDate="'), written,
            F.lit('" Tags="&lt;user'), "user_id", F.lit("&gt;&lt;"), "event_type", F.lit('&gt;" />'),
        ).alias("value")
    )

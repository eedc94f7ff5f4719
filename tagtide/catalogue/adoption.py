"""Adoption sequences, cohorts and markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.catalogue.inputs import ADOPTION_SQL, EARLY_SQL, daily_counts, event_adoption, event_early, event_uses
from tagtide.catalogue.registry import query
from tagtide.operators.joins import common_tags, keep_listed
from tagtide.operators.series import DAY, as_series, tag_week_counts
from tagtide.operators.shares import first_used_since, ordering_proportion, popular_tags, start_proportions
from tagtide.plans.adoption import adoption_table as adoption_job
from tagtide.plans.adoption import cohort_proportions
from tagtide.plans.trends import platform_series
from tagtide.plans.trends import trend_markers as trend_markers_job
from tagtide.session import durable

CUTOFFS = {"first_hours": "2024-01-01 12:00:00", "second_day": "2024-01-02", "third_day": "2024-01-03",
           "far_future": "2999-01-01"}

SHARES_SQL = """
round(count(*) FILTER (short_adoption_seq LIKE 'S%') / count(*), 6) AS share_s,
round(count(*) FILTER (short_adoption_seq LIKE 'A%') / count(*), 6) AS share_a,
round(count(*) FILTER (short_adoption_seq LIKE 'C%') / count(*), 6) AS share_c,
count(*) AS n_tags"""


def rounded_shares(df):
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("share") else F.col(c) for c in df.columns])


@query(f"WITH {ADOPTION_SQL} SELECT * FROM adoption")
def adoption_table(spark, sf_dir):
    return event_adoption(spark, sf_dir)


@query(f"WITH {ADOPTION_SQL} SELECT {SHARES_SQL} FROM adoption")
def adoption_start_proportions(spark, sf_dir):
    return rounded_shares(start_proportions(event_adoption(spark, sf_dir)))


@query(
    f"""
WITH {ADOPTION_SQL}
SELECT round(count(*) FILTER (instr(short_adoption_seq, 'SQ') < instr(short_adoption_seq, 'A')) / count(*), 6) AS share,
       count(*) AS n_both
FROM adoption WHERE instr(short_adoption_seq, 'SQ') > 0 AND instr(short_adoption_seq, 'A') > 0"""
)
def adoption_ordering_proportion(spark, sf_dir):
    return rounded_shares(ordering_proportion(event_adoption(spark, sf_dir), "short_adoption_seq", "SQ", "A"))


@query(
    f"""
WITH {ADOPTION_SQL},
cohorts AS (
  SELECT tag_name, 'all' AS cohort, tag_count FROM early
  UNION ALL SELECT tag_name, 'first_hours', tag_count FROM early WHERE first_use_date >= TIMESTAMP '2024-01-01 12:00:00'
  UNION ALL SELECT tag_name, 'second_day', tag_count FROM early WHERE first_use_date >= TIMESTAMP '2024-01-02'
  UNION ALL SELECT tag_name, 'third_day', tag_count FROM early WHERE first_use_date >= TIMESTAMP '2024-01-03'
),
chosen AS (
  SELECT tag_name, cohort, 'all' AS tags FROM cohorts
  UNION ALL SELECT tag_name, cohort, 'popular' FROM cohorts WHERE tag_count > (SELECT median(tag_count) FROM early)
)
SELECT cohort, tags, share_s, share_a, share_c, coalesce(n_tags, 0) AS n_tags
FROM (SELECT unnest(['all', 'first_hours', 'second_day', 'third_day', 'far_future']) AS cohort)
CROSS JOIN (SELECT unnest(['all', 'popular']) AS tags)
LEFT JOIN (SELECT cohort, tags, {SHARES_SQL} FROM chosen JOIN adoption USING (tag_name) GROUP BY cohort, tags)
USING (cohort, tags)"""
)
def cohort_popular_proportions(spark, sf_dir):
    early = durable(event_early(spark, sf_dir))
    return rounded_shares(cohort_proportions(event_adoption(spark, sf_dir, early), early, CUTOFFS))


@query(
    f"""
WITH {EARLY_SQL}
SELECT * FROM early
WHERE tag_count > (SELECT median(tag_count) FROM early) AND first_use_date >= TIMESTAMP '2024-01-02'"""
)
def popular_late_tags(spark, sf_dir):
    """Tags in both lists, the popular ones and those first used since a cut-off."""
    early = durable(event_early(spark, sf_dir))
    both = common_tags(popular_tags(early), first_used_since(early, "2024-01-02"))
    return keep_listed(early, both)


@query(
    f"""
WITH {EARLY_SQL},
daily AS (
  SELECT tag, CAST(creation_ts AS DATE) AS day, count(*) AS n FROM uses WHERE platform = 'GT' GROUP BY ALL
),
known AS (SELECT * FROM early WHERE tag_name IN (SELECT tag FROM daily))
SELECT tag, 'series' AS kind, CAST(day AS TIMESTAMP) AS date, CAST(n AS DOUBLE) AS value FROM daily
UNION ALL
SELECT tag_name, kind, date, CAST(NULL AS DOUBLE) FROM known
UNPIVOT (date FOR kind IN (first_use_date, nth_use_date, ad_date, nth_ad_date, course_date, nth_course_date))"""
)
def trend_markers(spark, sf_dir):
    errors = event_uses(spark, sf_dir).filter(F.col("platform") == "GT")
    trend = durable(as_series(tag_week_counts(errors, DAY)))
    return trend_markers_job(trend, durable(event_early(spark, sf_dir)))


@query(
    f"""
WITH {ADOPTION_SQL}
SELECT tag_name, full_adoption_seq, short_adoption_seq FROM adoption"""
)
def adoption_from_platform_series(spark, sf_dir):
    """Uses become counts, counts a dense series, and the series dates the sequences, without a rename between."""
    views = daily_counts(spark, sf_dir, "SV")
    errors = daily_counts(spark, sf_dir, "GT")
    table_ = adoption_job(
        event_early(spark, sf_dir),
        votes=platform_series(views, days=DAY),
        trend=platform_series(errors, days=DAY),
        days=DAY,
        votes_abs=2,
    )
    return table_.select("tag_name", "full_adoption_seq", "short_adoption_seq")


@query(
    f"""
WITH {ADOPTION_SQL}
SELECT tag_name, short_adoption_seq LIKE '%A%' AS advertised FROM adoption"""
)
def adoption_without_adverts_column(spark, sf_dir):
    """A frame without course dates gives the same place to adverts."""
    early = event_early(spark, sf_dir).drop("course_date", "nth_course_date")
    table_ = adoption_job(early)
    return table_.select("tag_name", F.contains("short_adoption_seq", F.lit("A")).alias("advertised"))

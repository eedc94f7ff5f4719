"""Post dump parsing and appearances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.catalogue.inputs import EARLY_SQL, USES_SQL, event_early, event_uses, post_lines
from tagtide.catalogue.registry import query, table
from tagtide.operators.appearance import (
    cumulative_since,
    explode_tags,
    first_and_nth_dates,
    first_use,
    parse_posts,
)
from tagtide.plans.posts import first_use as first_use_job


@query(
    """
WITH tag_use AS (
  SELECT ts AS creation_ts, 'user' || user_id AS tag FROM events
  UNION ALL SELECT ts, event_type FROM events
)
SELECT creation_ts, tag FROM (
  SELECT *, rank() OVER (PARTITION BY tag ORDER BY creation_ts) AS r FROM tag_use
) WHERE r <= 5"""
)
def first_use_rank_n(spark, sf_dir):
    return first_use_job(post_lines(spark, sf_dir), 5)


@query(
    """
SELECT tag, min(creation_ts) AS first_use_date FROM (
  SELECT ts AS creation_ts, 'user' || user_id AS tag FROM events
  UNION ALL SELECT ts, event_type FROM events
) GROUP BY tag"""
)
def first_use_min(spark, sf_dir):
    return first_use(explode_tags(parse_posts(post_lines(spark, sf_dir))))


@query("SELECT event_id AS id, ts AS creation_ts, 'user' || user_id || ',' || event_type AS tags FROM events")
def post_fields(spark, sf_dir):
    posts = parse_posts(post_lines(spark, sf_dir))
    return posts.select("id", "creation_ts", F.array_join("tags", ",").alias("tags"))


@query(
    """
SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'user' THEN role END AS title, role = 'user' AS has_title,
       replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS body
FROM conversations"""
)
def post_title_body(spark, sf_dir):
    """Only turns of users are written with a title."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                        F.lit('"'), F.lit("&quot;"))
    title = F.when(F.col("role") == "user", F.concat(F.lit(' Title="'), "role", F.lit('"'))).otherwise("")
    lines = table(spark, sf_dir, "conversations").select(
        F.concat(
            F.lit('<row Id="'), F.col("conv_id") * 1000 + F.col("turn"), F.lit('"'), title,
            F.lit(' Body="'), escaped, F.lit('" />'),
        ).alias("value")
    )
    return parse_posts(lines).select("id", "title", F.col("title").isNotNull().alias("has_title"), "body")


@query(
    f"""
WITH {USES_SQL},
ranked AS (
  SELECT tag, platform, creation_ts, row_number() OVER (PARTITION BY tag, platform ORDER BY creation_ts) AS rn
  FROM uses WHERE platform IS NOT NULL
)
SELECT tag, platform, min(creation_ts) AS first_date, min(creation_ts) FILTER (rn = 5) AS nth_date
FROM ranked WHERE rn <= 5 GROUP BY ALL"""
)
def nth_use_date(spark, sf_dir):
    uses = event_uses(spark, sf_dir).dropna(subset=["platform"])
    return first_and_nth_dates(uses, 5, "tag", "platform")


@query(f"WITH {EARLY_SQL} SELECT * FROM early")
def early_appearance_frame(spark, sf_dir):
    return event_early(spark, sf_dir)


@query(
    """
WITH cumulative AS (
  SELECT ts AS date, 'user' || user_id AS tag,
         count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cumulative_value
  FROM events
),
shown AS (SELECT * FROM cumulative WHERE date >= TIMESTAMP '2024-01-10')
SELECT date, tag, cumulative_value FROM shown
UNION ALL
SELECT TIMESTAMP '2024-01-10', tag, min(cumulative_value) - 1 FROM shown GROUP BY tag"""
)
def cumulative_with_baseline(spark, sf_dir):
    return cumulative_since(event_uses(spark, sf_dir), "2024-01-10").orderBy("tag", "cumulative_value")

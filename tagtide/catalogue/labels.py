"""Topics, types, languages and their shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.catalogue.adoption import SHARES_SQL, rounded_shares
from tagtide.catalogue.inputs import ADOPTION_SQL, event_adoption
from tagtide.catalogue.registry import query, table
from tagtide.constants import TOPIC_RECODES
from tagtide.functions.labels import has_item, topic_and_type
from tagtide.operators.categories import category_first_share as category_shares
from tagtide.operators.categories import (
    group_sizes,
    multi_value_counts,
    unlabelled,
    value_counts,
    with_topics,
)
from tagtide.operators.joins import recode_by_table
from tagtide.plans.adoption import first_share_by_category, label_audit

# A customer labels the user of the same number: the market segment is the topic, the nation
# decides the kind of label, and the balance which of the two lists are known.
_LABELS_SQL = """
labels_in AS (
  SELECT 'user' || c_custkey AS tag_name,
         CASE WHEN c_nationkey < 2 THEN 'language'
              WHEN c_nationkey < 5 THEN lower(c_mktsegment) || '-language'
              WHEN c_nationkey < 8 THEN 'lang-' || lower(c_mktsegment) || '-library'
              WHEN c_nationkey < 11 THEN lower(c_mktsegment)
              WHEN c_nationkey < 13 THEN lower(c_mktsegment) || '-concept'
              WHEN c_nationkey < 15 THEN 'deprecated-' || lower(c_mktsegment)
              WHEN c_nationkey < 16 THEN 'db'
              ELSE lower(c_mktsegment) || '-dev-solution' END AS tag_type,
         CASE WHEN c_acctbal >= 0 THEN '"lang' || c_nationkey || ',java"' END AS lang_or_platform,
         CASE WHEN c_acctbal < 5000 THEN 'docker,lang' || c_nationkey END AS has_api_or_supports
  FROM customer
)"""

_TOPICS_SQL = (
    _LABELS_SQL
    + """,
topics AS (
  SELECT *, string_split(tag_type, '-') AS parts,
         CASE WHEN contains(tag_type, 'deprecated') OR contains(tag_type, 'company') OR contains(tag_type, 'person')
              THEN 'none' WHEN contains(tag_type, 'language') THEN 'language' ELSE 'other' END AS rule
  FROM labels_in
),
labelled AS (
  SELECT tag_name, tag_type, lang_or_platform, has_api_or_supports,
         CASE WHEN rule = 'none' THEN NULL
              WHEN rule = 'language' AND parts[1] = 'language' THEN 'generalpurpose'
              WHEN rule = 'other' AND len(parts) > 1 AND parts[1] = 'lang' THEN parts[2]
              ELSE parts[1] END AS topic,
         CASE WHEN rule = 'none' THEN NULL WHEN rule = 'language' THEN 'language'
              WHEN len(parts) > 1 THEN parts[len(parts)] END AS type,
         CASE WHEN lang_or_platform IS NOT NULL AND has_api_or_supports IS NOT NULL
              THEN trim(lang_or_platform, '"') || ',' || trim(has_api_or_supports, '"')
              ELSE coalesce(lang_or_platform, has_api_or_supports) END AS all_langs
  FROM topics
)"""
)


def _customer_labels(spark, sf_dir):
    nation, segment = F.col("c_nationkey"), F.lower("c_mktsegment")
    tag_type = (
        F.when(nation < 2, F.lit("language"))
        .when(nation < 5, F.concat(segment, F.lit("-language")))
        .when(nation < 8, F.concat(F.lit("lang-"), segment, F.lit("-library")))
        .when(nation < 11, segment)
        .when(nation < 13, F.concat(segment, F.lit("-concept")))
        .when(nation < 15, F.concat(F.lit("deprecated-"), segment))
        .when(nation < 16, F.lit("db"))
        .otherwise(F.concat(segment, F.lit("-dev-solution")))
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user"), "c_custkey").alias("tag_name"),
        tag_type.alias("tag_type"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit('"lang'), nation, F.lit(',java"'))).alias("lang_or_platform"),
        F.when(F.col("c_acctbal") < 5000, F.concat(F.lit("docker,lang"), nation)).alias("has_api_or_supports"),
    )


@query(
    """
WITH types AS (
  SELECT p_partkey, lower(p_type) || CASE WHEN p_size < 10 THEN '' WHEN p_size < 20 THEN '-language'
           WHEN p_size < 30 THEN '-' || replace(p_name, ' ', '-') WHEN p_size < 35 THEN '-company'
           ELSE '-concept' END AS t
  FROM part
  UNION ALL SELECT p_partkey, 'lang-' || replace(p_name, ' ', '-') FROM part
  UNION ALL SELECT p_partkey, 'language' FROM part WHERE p_size = 50
)
SELECT p_partkey, t AS tag_type,
       CASE WHEN t LIKE '%company%' THEN NULL WHEN t = 'language' THEN 'generalpurpose'
            WHEN t LIKE '%language%' THEN split_part(t, '-', 1)
            WHEN t LIKE 'lang-%' THEN split_part(t, '-', 2) ELSE split_part(t, '-', 1) END AS topic,
       CASE WHEN t LIKE '%company%' THEN NULL WHEN t LIKE '%language%' THEN 'language'
            WHEN t LIKE '%-%' THEN split_part(t, '-', -1) END AS type
FROM types"""
)
def topic_type(spark, sf_dir):
    size, dashed = F.col("p_size"), F.replace("p_name", F.lit(" "), F.lit("-"))
    ending = (
        F.when(size < 10, F.lit(""))
        .when(size < 20, F.lit("-language"))
        .when(size < 30, F.concat(F.lit("-"), dashed))
        .when(size < 35, F.lit("-company"))
        .otherwise(F.lit("-concept"))
    )
    types = F.array_compact(
        F.array(
            F.concat(F.lower("p_type"), ending),
            F.concat(F.lit("lang-"), dashed),
            F.when(size == 50, F.lit("language")),
        )
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(types).alias("tag_type"))
    return rows.select("p_partkey", "tag_type", topic_and_type(F.col("tag_type")).alias("t")).select(
        "p_partkey", "tag_type", "t.topic", "t.type"
    )


@query(f"WITH {_TOPICS_SQL} SELECT * FROM labelled")
def labelled_tags(spark, sf_dir):
    return with_topics(_customer_labels(spark, sf_dir))


@query(
    f"""
WITH {ADOPTION_SQL}, {_TOPICS_SQL},
top_topics AS (
  SELECT topic FROM labelled WHERE topic IS NOT NULL GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 30
),
members AS (
  SELECT DISTINCT tag_name,
         CASE topic WHEN 'db' THEN 'database' WHEN 'generalpurpose' THEN 'gp' ELSE topic END AS category
  FROM labelled WHERE topic IN (SELECT topic FROM top_topics)
)
SELECT category, {SHARES_SQL} FROM members JOIN adoption USING (tag_name)
GROUP BY category HAVING count(*) >= 5"""
)
def category_first_share(spark, sf_dir):
    shares = first_share_by_category(
        event_adoption(spark, sf_dir), _customer_labels(spark, sf_dir), "topic", TOPIC_RECODES
    )
    return rounded_shares(shares)


@query(
    f"""
WITH {ADOPTION_SQL}, {_TOPICS_SQL},
listed AS (SELECT DISTINCT topic AS category FROM labelled WHERE topic IS NOT NULL UNION ALL SELECT 'absent'),
counted AS (
  SELECT topic AS category, {SHARES_SQL} FROM labelled JOIN adoption USING (tag_name) GROUP BY topic
)
SELECT category, share_s, share_a, share_c, coalesce(n_tags, 0) AS n_tags FROM listed LEFT JOIN counted USING (category)"""
)
def all_category_first_share(spark, sf_dir):
    """Every topic however small, and one that no tag has."""
    labelled = with_topics(_customer_labels(spark, sf_dir))
    absent = spark.range(1).select(F.lit("absent").alias("topic"))
    listed = labelled.select("topic").dropna().distinct().unionByName(absent)
    return rounded_shares(category_shares(event_adoption(spark, sf_dir), labelled, listed, "topic"))


@query(
    f"""
WITH {ADOPTION_SQL}, {_TOPICS_SQL},
top_types AS (
  SELECT type FROM labelled WHERE type IS NOT NULL GROUP BY type ORDER BY count(*) DESC, type LIMIT 30
)
SELECT type AS category, {SHARES_SQL} FROM labelled JOIN adoption USING (tag_name)
WHERE type IN (SELECT type FROM top_types) GROUP BY type HAVING count(*) >= 5"""
)
def type_first_share(spark, sf_dir):
    return rounded_shares(
        first_share_by_category(event_adoption(spark, sf_dir), _customer_labels(spark, sf_dir), "type")
    )


@query(
    f"""
WITH {ADOPTION_SQL}, {_TOPICS_SQL},
items AS (SELECT unnest(string_split(all_langs, ',')) AS item FROM labelled),
top_items AS (SELECT item FROM items GROUP BY item ORDER BY count(*) DESC, item LIMIT 30),
members AS (
  SELECT DISTINCT tag_name, unnest(string_split(trim(all_langs, '"'), ',')) AS category FROM labelled
)
SELECT category, {SHARES_SQL} FROM members JOIN adoption USING (tag_name)
WHERE category IN (SELECT item FROM top_items) GROUP BY category HAVING count(*) >= 5"""
)
def language_first_share(spark, sf_dir):
    return rounded_shares(
        first_share_by_category(event_adoption(spark, sf_dir), _customer_labels(spark, sf_dir), "all_langs")
    )


@query(
    f"""
WITH {_LABELS_SQL},
items AS (
  SELECT unnest(string_split(lang_or_platform, ',')) AS item FROM labels_in
  UNION ALL SELECT unnest(string_split(has_api_or_supports, ',')) FROM labels_in
)
SELECT item, count(*) AS n FROM items GROUP BY item"""
)
def multi_value_label_counts(spark, sf_dir):
    return multi_value_counts(_customer_labels(spark, sf_dir), ["lang_or_platform", "has_api_or_supports"])


@query(
    f"""
WITH {_TOPICS_SQL}
SELECT topic AS value, 'topic' AS part, count(*) AS n FROM labelled WHERE topic IS NOT NULL GROUP BY topic
UNION ALL SELECT type, 'type', count(*) FROM labelled WHERE type IS NOT NULL GROUP BY type"""
)
def topic_and_type_counts(spark, sf_dir):
    audit = label_audit(_customer_labels(spark, sf_dir))
    topics = audit["topics"].select(F.col("topic").alias("value"), F.lit("topic").alias("part"), "n")
    types = audit["types"].select(F.col("type").alias("value"), F.lit("type").alias("part"), "n")
    return topics.unionByName(types)


@query(
    f"""
WITH {_LABELS_SQL}
SELECT tag_type, count(tag_name) AS tag_name, count(lang_or_platform) AS lang_or_platform,
       count(has_api_or_supports) AS has_api_or_supports
FROM labels_in WHERE tag_type IS NOT NULL GROUP BY tag_type"""
)
def label_group_sizes(spark, sf_dir):
    return group_sizes(_customer_labels(spark, sf_dir), "tag_type")


@query(
    f"""
WITH {_LABELS_SQL}
SELECT * FROM labels_in WHERE lang_or_platform IS NULL AND NOT contains(tag_type, '-concept')"""
)
def unlabelled_tags(spark, sf_dir):
    return unlabelled(_customer_labels(spark, sf_dir))


@query(
    f"""
WITH {_LABELS_SQL}
SELECT tag_name, list_contains(string_split(trim(lang_or_platform, '"'), ','), 'lang1') AS listed
FROM labels_in WHERE lang_or_platform IS NOT NULL
UNION ALL SELECT tag_name, false FROM labels_in WHERE lang_or_platform IS NULL"""
)
def listed_language(spark, sf_dir):
    """Whole entries only: 'lang1' is not found in 'lang11'."""
    labels = _customer_labels(spark, sf_dir)
    return labels.select("tag_name", has_item(F.col("lang_or_platform"), "lang1").alias("listed"))


@query(
    """
SELECT p_partkey, coalesce(r_name, p_type) AS label FROM part
LEFT JOIN (SELECT r_name, CASE r_regionkey WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'PROMO'
           WHEN 3 THEN 'MEDIUM' ELSE 'LARGE' END AS old
           FROM region) ON old = p_type"""
)
def recoded_types(spark, sf_dir):
    """Five part types take the name of a region; the sixth stays."""
    key = F.col("r_regionkey")
    old = F.when(key == 0, "ECONOMY").when(key == 1, "SMALL").when(key == 2, "PROMO").when(key == 3, "MEDIUM").otherwise("LARGE")
    recodes = table(spark, sf_dir, "region").select(old.alias("old"), F.col("r_name").alias("new")).dropna()
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("label"))
    return recode_by_table(parts, "label", recodes)


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY p_type")
def type_value_counts(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "part"), "p_type")

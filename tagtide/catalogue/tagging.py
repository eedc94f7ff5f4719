"""Tag dictionary and tag mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.catalogue.registry import query, table
from tagtide.catalogue.text import TAG_GRAMS_SQL
from tagtide.constants import TAGGING_PUNCTUATION
from tagtide.functions.text import clean_tokens, strip_html
from tagtide.functions.variants import tag_variants
from tagtide.operators.layout import spread_few
from tagtide.operators.tagging import common_grams
from tagtide.plans.tagging import build_tag_dictionary, tag_entities, tag_mentions
from tagtide.session import durable

# Part names with a version: a whole number, or for ECONOMY parts the same with '.0'.
_PART_TAGS_SQL = """
part_tags AS (
  SELECT p_partkey, p_size, p_type, replace(p_name, ' ', '-') AS base,
         replace(p_name, ' ', '-') || p_size || CASE WHEN p_type = 'ECONOMY' THEN '.0' ELSE '' END AS tag_name
  FROM part
)"""


def forms_sql(source: str) -> str:
    """Version forms of the tag in ``source``, which has a column of that name."""
    version = f"regexp_extract({source}, '[^-.]([0-9]+(\\.[0-9]+)*)', 1)"
    major = f"regexp_extract({version}, '^([0-9]+)(\\.0)*$', 1)"
    return (
        f"[{source}, CASE WHEN {version} <> '' THEN replace({source}, {version}, '-' || {version}) END, "
        f"CASE WHEN {major} <> '' THEN replace({source}, {version}, '-' || {major}) END]"
    )


def variants_sql(source: str, relation: str, carried: str) -> str:
    return f"""
    SELECT DISTINCT {carried}, {source}, variant FROM (
      SELECT {carried}, {source}, unnest([form, replace(form, '-', ' '), replace(form, '-', '')]) AS variant FROM (
        SELECT {carried}, {source}, unnest({forms_sql(source)}) AS form FROM {relation}
      ) WHERE form IS NOT NULL
    )"""


def _part_tags(spark, sf_dir):
    base = F.replace("p_name", F.lit(" "), F.lit("-"))
    ending = F.when(F.col("p_type") == "ECONOMY", ".0").otherwise("")
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_type", base.alias("base"), F.concat(base, "p_size", ending).alias("tag_name")
    )


@query(f"WITH {_PART_TAGS_SQL} SELECT p_partkey, variant FROM ({variants_sql('tag_name', 'part_tags', 'p_partkey')})")
def tag_spellings(spark, sf_dir):
    return _part_tags(spark, sf_dir).select("p_partkey", F.explode(tag_variants(F.col("tag_name"))).alias("variant"))


# A later version is a synonym of the version 25 below it; promoted parts have no excerpt.
_DICTIONARY_SQL = (
    _PART_TAGS_SQL
    + f""",
tags AS (
  SELECT tag_name, max(CASE WHEN p_type <> 'PROMO' THEN p_type END) AS excerpt, sum(n) AS tag_count
  FROM part_tags JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey
  GROUP BY tag_name
),
synonyms AS (
  SELECT DISTINCT tag_name AS synonym, base || (p_size - 25) AS master FROM part_tags WHERE p_size > 25
),
names AS (
  SELECT tag_name FROM tags WHERE tag_count > 20 AND excerpt IS NOT NULL
    AND tag_name NOT IN (SELECT synonym FROM synonyms)
),
live AS (SELECT * FROM synonyms WHERE master IN (SELECT tag_name FROM names)),
sources AS (
  SELECT tag_name AS source, tag_name AS tag, 0 AS r FROM names UNION ALL SELECT synonym, master, 1 FROM live
),
ranked AS (
  SELECT variant, tag, row_number() OVER (
           PARTITION BY variant ORDER BY r, CASE WHEN variant = source THEN 0 ELSE 1 END, tag) AS place
  FROM ({variants_sql("source", "sources", "tag, r")})
)"""
)


def _dictionary(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    parts = _part_tags(spark, sf_dir)
    tags = (
        parts.join(counts, "p_partkey")
        .groupBy("tag_name")
        .agg(
            F.max(F.when(F.col("p_type") != "PROMO", F.col("p_type"))).alias("excerpt"),
            F.sum("n").alias("tag_count"),
        )
    )
    synonyms = (
        parts.filter(F.col("p_size") > 25)
        .select(F.col("tag_name").alias("synonym"), F.concat("base", F.col("p_size") - 25).alias("master"))
        .distinct()
    )
    return build_tag_dictionary(tags, synonyms, min_count=20)


@query(f"WITH {_DICTIONARY_SQL} SELECT variant, tag FROM ranked WHERE place = 1")
def tag_dictionary(spark, sf_dir):
    return _dictionary(spark, sf_dir).variants


@query(
    f"""
WITH {_DICTIONARY_SQL}
SELECT CAST(len(string_split(tag_name, '-')) AS INTEGER) AS n_parts, count(*) AS n_tags FROM names GROUP BY 1"""
)
def tag_length_histogram(spark, sf_dir):
    return _dictionary(spark, sf_dir).lengths


# The tags of a text collection: the words and pairs of words that more than so many texts have.
# A pair forbids each of its words.
MIN_TEXTS = 100
_TAGGED_SQL = f"""
WITH {TAG_GRAMS_SQL},
top_words AS (
  SELECT w AS word FROM following GROUP BY w HAVING count(DISTINCT doc_id) > {MIN_TEXTS}
),
pairs AS (
  SELECT gram AS pair FROM grams WHERE k = 2 GROUP BY gram HAVING count(DISTINCT doc_id) > {MIN_TEXTS}
),
names AS (SELECT word AS tag_name FROM top_words UNION SELECT replace(pair, ' ', '-') FROM pairs),
variants AS (
  SELECT variant, min(tag_name) FILTER (variant = tag_name) AS exact, min(tag_name) AS derived
  FROM ({variants_sql("tag_name", "names", "1 AS one")}) GROUP BY variant
),
dictionary AS (SELECT variant, coalesce(exact, derived) AS tag FROM variants),
matches AS MATERIALIZED (SELECT doc_id, k, i, tag FROM grams JOIN dictionary ON gram = variant),
forbidden AS (
  SELECT DISTINCT replace(pair, ' ', '-') AS tag, unnest(string_split(pair, ' ')) AS sub_tag FROM pairs
),
allowed AS (
  SELECT * FROM matches m WHERE NOT EXISTS (
    SELECT 1 FROM matches o JOIN forbidden f ON f.tag = o.tag WHERE o.doc_id = m.doc_id AND f.sub_tag = m.tag)
)"""


def _text_tags(spark, sf_dir):
    """``(variants, forbidden)`` of the documents."""
    tokens = clean_tokens(strip_html(F.col("text")), punctuation=TAGGING_PUNCTUATION)
    top = durable(common_grams(_laid_out(spark, sf_dir).select(tokens.alias("tokens")), MIN_TEXTS))
    dashed = F.replace("gram", F.lit(" "), F.lit("-"))
    pairs = top.filter(F.contains("gram", F.lit(" ")))
    forbidden = pairs.select(dashed.alias("tag"), F.explode(F.split("gram", " ")).alias("sub_tag")).distinct()
    tags = top.select(dashed.alias("tag_name"), F.col("n").alias("tag_count"))
    dictionary = build_tag_dictionary(tags, min_count=MIN_TEXTS, remove_textless=False)
    return durable(dictionary.variants), forbidden


def _laid_out(spark, sf_dir):
    return spread_few(table(spark, sf_dir, "documents"), "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))


def _documents(spark, sf_dir):
    return _laid_out(spark, sf_dir).select(F.col("doc_id").alias("entity_id"), F.col("text").alias("summary"))


@query(_TAGGED_SQL + " SELECT doc_id AS entity_id, tag, count(*) AS n FROM matches GROUP BY ALL")
def tag_mentions_in_documents(spark, sf_dir):
    variants, _ = _text_tags(spark, sf_dir)
    mentions = tag_mentions(_documents(spark, sf_dir), variants)
    return mentions.groupBy("entity_id", "tag").agg(F.count("*").alias("n"))


@query(_TAGGED_SQL + " SELECT doc_id AS entity_id, tag, count(*) AS n FROM allowed GROUP BY ALL")
def drop_forbidden_tags(spark, sf_dir):
    variants, forbidden = _text_tags(spark, sf_dir)
    mentions = tag_mentions(_documents(spark, sf_dir), variants, forbidden)
    return mentions.groupBy("entity_id", "tag").agg(F.count("*").alias("n"))


@query(
    _TAGGED_SQL
    + """
SELECT doc_id AS entity_id, coalesce(string_agg(tag, ' ' ORDER BY k DESC, i), '') AS summary_tags
FROM documents LEFT JOIN allowed USING (doc_id) GROUP BY doc_id"""
)
def tag_documents(spark, sf_dir):
    variants, forbidden = _text_tags(spark, sf_dir)
    tagged = tag_entities(_documents(spark, sf_dir), variants, forbidden)
    return tagged.select("entity_id", F.array_join("summary_tags", " ").alias("summary_tags"))

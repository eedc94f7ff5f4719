"""Tables written as files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagtide import schemas
from tagtide.catalogue.inputs import EARLY_SQL, event_uses, post_lines
from tagtide.catalogue.registry import query, table
from tagtide.operators.appearance import early_appearances
from tagtide.plans.posts import first_use
from tagtide.session import shared_folder
from tagtide.sources.readers import (
    read_json_map,
    read_page_files,
    read_post_lines,
    read_series,
    read_tag_types_csv,
    read_tags_csv,
)
from tagtide.sources.writers import write_columnar, write_csv, write_json


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/tagtide-{uuid.uuid4().hex}"


_TEXT_SQL = """
SELECT CASE WHEN lang = 'de' THEN 'null' ELSE 'doc-' || doc_id END AS tag_name,
       text AS excerpt, CAST(n_chars AS INTEGER) AS tag_count
FROM documents
UNION ALL SELECT 'bare-' || doc_id, NULL, CAST(n_chars AS INTEGER) FROM documents"""


@query(_TEXT_SQL)
def csv_roundtrip(spark, sf_dir):
    """A tag dictionary with whole texts as excerpts: quotes, commas and line breaks come back as written.

    Each document has a second row without an excerpt.
    """
    named = F.when(F.col("lang") == "de", F.lit("null")).otherwise(F.concat(F.lit("doc-"), "doc_id"))
    count = F.col("n_chars").cast("int").alias("TagCount")
    bare = F.struct(F.concat(F.lit("bare-"), "doc_id").alias("TagName"), F.lit(None).cast("string").alias("Excerpt"), count)
    whole = F.struct(named.alias("TagName"), F.col("text").alias("Excerpt"), count)
    tags = table(spark, sf_dir, "documents").select(F.inline(F.array(whole, bare)))
    folder = _new_folder(spark)
    write_csv(tags, folder)
    return read_tags_csv(spark, folder)


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_roundtrip(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    folder = _new_folder(spark)
    write_json(turns, folder)
    return spark.read.schema(turns.schema).json(folder)


@query(f"WITH {EARLY_SQL} SELECT * FROM early")
def columnar_roundtrip(spark, sf_dir):
    folder = _new_folder(spark)
    write_columnar(early_appearances(event_uses(spark, sf_dir)), folder)
    early = read_series(spark, folder)
    assert set(early.columns) == set(schemas.EARLY.names)
    return early


@query(
    """
SELECT creation_ts, tag FROM (
  SELECT *, rank() OVER (PARTITION BY tag ORDER BY creation_ts) AS r FROM (
    SELECT ts AS creation_ts, 'user' || user_id AS tag FROM events
    UNION ALL SELECT ts, event_type FROM events
  )
) WHERE r <= 5"""
)
def first_use_from_dump(spark, sf_dir):
    """The dump is written as text and read line by line."""
    folder = _new_folder(spark)
    post_lines(spark, sf_dir).write.text(folder)
    return first_use(read_post_lines(spark, folder), 5)


@query("SELECT p_name || ', ' || p_partkey AS tag, p_type AS type FROM part")
def tag_types_from_csv(spark, sf_dir):
    folder = _new_folder(spark)
    name = F.concat("p_name", F.lit(", "), "p_partkey")
    write_csv(table(spark, sf_dir, "part").select(name.alias("tag"), F.col("p_type").alias("type")), folder)
    return read_tag_types_csv(spark, folder)


@query("SELECT 'user' || c_custkey AS synonym, c_name AS master FROM customer")
def synonyms_from_json(spark, sf_dir):
    """One object per nation: a mapping is kept by hand, so an object is small."""
    folder = _new_folder(spark)
    entry = F.struct(F.concat(F.lit("user"), "c_custkey"), "c_name")
    maps = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    # Every file is one object.
    maps.select(F.to_json("m").alias("value"), "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").text(folder)
    return read_json_map(spark, f"{folder}/*", "synonym", "master")


@query(
    """
SELECT CAST(page_id % 200 AS INTEGER) AS shelf, string_agg(html || chr(10), '' ORDER BY page_id) AS html
FROM pages GROUP BY page_id % 200"""
)
def pages_from_files(spark, sf_dir):
    """Pages are written to 200 files, and each file is read as one text."""
    folder = _new_folder(spark)
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 200).cast("int").alias("shelf"), "page_id", "html")
    shelved = pages.repartition("shelf").sortWithinPartitions("shelf", "page_id")
    shelved.select("shelf", F.col("html").alias("value")).write.partitionBy("shelf").text(folder)
    shelf = F.regexp_extract("path", "shelf=([0-9]+)", 1).cast("int").alias("shelf")
    return read_page_files(spark, f"{folder}/*").select(shelf, "html")


@query("SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY conv_id")
def overwritten_output(spark, sf_dir):
    """A later run replaces what an earlier one wrote to the same folder, whatever its form."""
    folder = _new_folder(spark)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn")
    write_columnar(turns, folder)
    write_json(turns, folder)
    write_columnar(turns.groupBy("id").agg(F.count("*").alias("n")), folder)
    return read_series(spark, folder)

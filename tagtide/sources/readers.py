"""Inputs as DataFrames with stated schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagtide import schemas


def read_post_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row ``value`` per line of the dump; large files are split."""
    return spark.read.text(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Quoted CSV with a header. Under the schema a tag called ``null`` or ``nan`` stays a text."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def read_tags_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(tag_name, excerpt, tag_count)``; an empty excerpt is null."""
    return read_csv(spark, path, schemas.TAGS).toDF("tag_name", "excerpt", "tag_count")


def read_tag_types_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TAG_TYPES)


def read_tag_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(tag_name, tag_type, lang_or_platform, has_api_or_supports)``."""
    names = ("tag_name", "tag_type", "lang_or_platform", "has_api_or_supports")
    return read_csv(spark, path, schemas.TAG_LABELS).toDF(*names)


def read_json_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """The entries of a JSON object of strings as rows; one object per file.

    A JSON object cannot be split, so this is for mappings kept by hand. Large ones belong in
    JSON lines or Parquet. A broken object fails the job: no entries would look like an empty mapping.
    """
    entries = F.from_json("value", T.MapType(T.StringType(), T.StringType()), {"mode": "FAILFAST"})
    return spark.read.text(path, wholetext=True).select(F.explode(entries).alias(key, value))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Stored series, appearance rows or vectors."""
    return spark.read.parquet(path)


def read_page_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, html)``, one row per file."""
    return spark.read.text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")
    )

"""Counts and first shares by topic, type and language."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.functions.labels import all_langs, comma_items, recode, strip_quotes, topic_and_type
from tagtide.operators.shares import START_ELEMENTS, start_aggregates

LABEL_LISTS = ("lang_or_platform", "has_api_or_supports")


def with_topics(labels: DataFrame) -> DataFrame:
    """Add ``topic``, ``type`` and ``all_langs`` to ``(tag_name, tag_type, <two comma lists>)``."""
    parts = topic_and_type(F.col("tag_type"))
    return labels.select(
        "*",
        parts["topic"].alias("topic"),
        parts["type"].alias("type"),
        all_langs(*[F.col(c) for c in LABEL_LISTS]).alias("all_langs"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(column, n)`` without nulls, most frequent first, then by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column)


def item_rows(df: DataFrame, columns: Sequence[str], into: str) -> DataFrame:
    """The entries of one or more comma list columns, one per row, all under one name."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(comma_items(F.col(c)), empty) for c in columns]
    return df.select(F.explode(F.concat(*lists)).alias(into))


def multi_value_counts(df: DataFrame, columns: Sequence[str], into: str = "item") -> DataFrame:
    return value_counts(item_rows(df, columns, into), into)


def top_values(df: DataFrame, column: str, top: int = 30, as_list: bool = False) -> DataFrame:
    """The ``top`` most frequent values of a column, or of the entries of its comma lists."""
    counts = multi_value_counts(df, [column], column) if as_list else value_counts(df, column)
    return counts.limit(top)


def group_sizes(df: DataFrame, by: str) -> DataFrame:
    """Non-null count of every other column per group; rows without a group are left out."""
    others = [c for c in df.columns if c != by]
    grouped = df.filter(F.col(by).isNotNull()).groupBy(by)
    return grouped.agg(*[F.count(c).alias(c) for c in others]).orderBy(by)


def unlabelled(labels: DataFrame) -> DataFrame:
    """Tags without a language whose type is not a concept."""
    return labels.filter(
        F.col("lang_or_platform").isNull() & ~F.contains(F.col("tag_type"), F.lit("-concept"))
    )


def category_first_share(
    adoption: DataFrame,
    labels: DataFrame,
    categories: DataFrame,
    column: str,
    recodes: Mapping[str, str] | None = None,
    min_freq: int | None = None,
    elements: Sequence[str] = START_ELEMENTS,
) -> DataFrame:
    """Per category the share of its tags that start with each element, largest category first.

    ``categories`` holds the values to report. A tag counts once in a category however often it
    is labelled with it. Without ``min_freq`` a category without tags has ``n_tags`` 0 and no shares.
    """
    mapping = recodes or {}
    wanted = categories.select(recode(F.col(column), mapping).alias("category")).distinct()
    value = recode(F.col(column), mapping)
    members = (
        labels.select("tag_name", F.explode(comma_items(strip_quotes(value))).alias("category"))
        .join(wanted, "category", "left_semi")
        .distinct()
    )
    shares = members.join(adoption, "tag_name").groupBy("category").agg(*start_aggregates(elements=elements))
    if min_freq is not None:
        shares = shares.filter(F.col("n_tags") >= min_freq)
    if not min_freq:
        known = F.col("category").isNotNull()
        shares = wanted.filter(known).join(shares, "category", "left").withColumn("n_tags", F.coalesce("n_tags", F.lit(0)))
    return shares.orderBy(F.desc("n_tags"), "category")

"""Which platform comes first, and how often."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.constants import COHORT_CUTOFFS
from tagtide.functions.sequences import comes_before, contains_both, starts_with

START_ELEMENTS = ("S", "A", "C")


def start_aggregates(
    seq: str = "short_adoption_seq", elements: Sequence[str] = START_ELEMENTS, tag: str = "tag_name"
) -> list[Column]:
    """Share of tags that start with each element, and the row count, as one set of aggregates.

    A tag with an empty sequence counts in the total and starts with nothing. No rows: null shares.
    """
    named = F.count(tag)
    shares = [
        F.try_divide(F.count(F.when(starts_with(F.col(seq), e), F.col(tag))), named).alias(f"share_{e.lower()}")
        for e in elements
    ]
    return [*shares, F.count("*").alias("n_tags")]


def start_proportions(
    adoption: DataFrame,
    seq: str = "short_adoption_seq",
    elements: Sequence[str] = START_ELEMENTS,
    by: Sequence[str] = (),
) -> DataFrame:
    return adoption.groupBy(*by).agg(*start_aggregates(seq, elements))


def ordering_proportion(adoption: DataFrame, seq: str, first: str, second: str) -> DataFrame:
    """``(share, n_both)``: share of rows with ``first`` before ``second`` among rows with both."""
    sequence = F.col(seq)
    both = F.count_if(contains_both(sequence, first, second))
    before = F.count_if(comes_before(sequence, first, second))
    return adoption.agg(F.try_divide(before, both).alias("share"), both.alias("n_both"))


def median_count(early: DataFrame) -> DataFrame:
    """Exact median of the tag counts.

    Equal counts are added up first: d distinct counts need at least d * d / 2 uses, so even
    10^13 uses leave under five million of them.
    """
    levels = early.filter(F.col("tag_count").isNotNull()).groupBy("tag_count").agg(F.count("*").alias("_times"))
    return levels.agg(F.percentile("tag_count", 0.5, F.col("_times")).alias("median"))


def with_popular(early: DataFrame) -> DataFrame:
    """Flag tags whose count is strictly above the median."""
    return early.withColumn("popular", F.col("tag_count") > median_count(early).scalar())


def popular_tags(early: DataFrame) -> DataFrame:
    return with_popular(early).filter("popular").drop("popular")


def first_used_since(early: DataFrame, cutoff: str) -> DataFrame:
    return early.filter(F.col("first_use_date") >= F.lit(cutoff).cast("timestamp_ntz"))


def cohort_members(early: DataFrame, cutoffs: Mapping[str, str] = COHORT_CUTOFFS) -> DataFrame:
    """One row per tag and cohort it belongs to; every tag is in the cohort ``all``."""
    since = [
        F.when(F.col("first_use_date") >= F.lit(date).cast("timestamp_ntz"), F.lit(name))
        for name, date in cutoffs.items()
    ]
    return early.withColumn("cohort", F.explode(F.array_compact(F.array(F.lit("all"), *since))))

"""Adoption sequences, delays and the shares drawn from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.constants import COHORT_CUTOFFS
from tagtide.functions.sequences import all_delays, full_sequence, short_sequence
from tagtide.operators.categories import (
    LABEL_LISTS,
    category_first_share,
    group_sizes,
    multi_value_counts,
    top_values,
    unlabelled,
    value_counts,
    with_topics,
)
from tagtide.operators.joins import optional_column
from tagtide.operators.series import WEEK
from tagtide.operators.shares import cohort_members, start_proportions, with_popular
from tagtide.operators.thresholds import trend_date, votes_date

# Sequence label of each column of an early-appearance row.
_LABEL_COLUMNS = {
    "SQ1": "first_use_date",
    "SQ5": "nth_use_date",
    "A1": "ad_date",
    "C1": "course_date",
    "A5": "nth_ad_date",
    "C5": "nth_course_date",
}


def adoption_table(
    early: DataFrame,
    votes: DataFrame | None = None,
    trend: DataFrame | None = None,
    days: int = WEEK,
    votes_rel: float = 0.0,
    votes_abs: float = 5,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """``(tag_name, full_adoption_seq, short_adoption_seq, <14 delays>)``.

    ``votes`` and ``trend`` are series ``(tag, week, value)``, such as ``platform_series`` and
    ``load_trends`` give; without one, its label does not occur. ``calendar`` is the table whose weeks
    count for ``votes``. Date columns that ``early`` lacks count as unknown.
    """
    dates = {label: optional_column(early, column) for label, column in _LABEL_COLUMNS.items()}
    wide = early.select("tag_name", *[date.alias(label) for label, date in dates.items()])
    for label, series, first_reached in (
        ("SV", votes, lambda s: votes_date(s, votes_rel, votes_abs, days, calendar=calendar)),
        ("GT", trend, trend_date),
    ):
        if series is None:
            wide = wide.withColumn(label, F.lit(None).cast("timestamp_ntz"))
            continue
        reached = first_reached(series).toDF("tag_name", "_date")
        wide = wide.join(reached, "tag_name", "left").withColumn(label, F.col("_date").cast("timestamp_ntz"))
        wide = wide.drop("_date")
    known = {label: F.col(label) for label in (*_LABEL_COLUMNS, "SV", "GT")}
    return wide.select(
        "tag_name",
        full_sequence(known).alias("full_adoption_seq"),
        short_sequence(known).alias("short_adoption_seq"),
        *all_delays(known),
    )


def cohort_proportions(
    adoption: DataFrame, early: DataFrame, cutoffs: Mapping[str, str] = COHORT_CUTOFFS
) -> DataFrame:
    """``(cohort, tags, <shares>, n_tags)``: per cohort for all its tags and for the popular ones.

    A cohort without tags has ``n_tags`` 0 and no shares.
    """
    members = cohort_members(with_popular(early), cutoffs)
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("popular"), F.lit("popular"))))
    chosen = members.select("tag_name", "cohort", F.explode(subsets).alias("tags"))
    shares = start_proportions(chosen.join(adoption, "tag_name"), by=("cohort", "tags"))
    names = F.array(*[F.lit(name) for name in ("all", *cutoffs)])
    kinds = F.array(F.lit("all"), F.lit("popular"))
    # One literal row, so the frame of all cohorts is as large as the mapping.
    listed = early.sparkSession.range(1).select(F.explode(names).alias("cohort")).withColumn("tags", F.explode(kinds))
    return listed.join(shares, ["cohort", "tags"], "left").withColumn("n_tags", F.coalesce("n_tags", F.lit(0)))


def first_share_by_category(
    adoption: DataFrame,
    labels: DataFrame,
    column: str = "topic",
    recodes: Mapping[str, str] | None = None,
    top: int = 30,
    min_freq: int | None = 5,
) -> DataFrame:
    """First shares of the ``top`` most frequent values of ``topic``, ``type`` or ``all_langs``."""
    labelled = with_topics(labels)
    categories = top_values(labelled, column, top, as_list=column == "all_langs")
    return category_first_share(adoption, labelled, categories, column, recodes, min_freq)


def label_audit(labels: DataFrame) -> dict[str, DataFrame]:
    """Counts that show how complete and how consistent the labels are."""
    labelled = with_topics(labels)
    return {
        "by_type": group_sizes(labels, "tag_type"),
        "topics": value_counts(labelled, "topic"),
        "types": value_counts(labelled, "type"),
        "languages": multi_value_counts(labels, LABEL_LISTS),
        "unlabelled": unlabelled(labels),
    }

"""Order of, and delays between, the dates of one tag."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagtide.constants import DELAY_PAIRS, FULL_LABELS, SHORT_LABELS
from tagtide.functions.dates import delay_days


def adoption_sequence(dates: Mapping[str, Column]) -> Column:
    """Labels of the known dates, earliest first, joined by '-'; equal dates keep the given order."""
    entries = [
        F.struct(date.cast("timestamp_ntz").alias("date"), F.lit(place).alias("place"), F.lit(label).alias("label"))
        for place, (label, date) in enumerate(dates.items())
    ]
    known = F.filter(F.array(*entries), lambda entry: entry["date"].isNotNull())
    return F.array_join(F.transform(F.array_sort(known), lambda entry: entry["label"]), "-")


def full_sequence(dates: Mapping[str, Column]) -> Column:
    return adoption_sequence({label: dates[label] for label in FULL_LABELS})


def short_sequence(dates: Mapping[str, Column]) -> Column:
    """First appearances only: SQ, A and C stand for SQ1, A1 and C1."""
    source = {"SQ": "SQ1", "A": "A1", "C": "C1", "SV": "SV", "GT": "GT"}
    return adoption_sequence({label: dates[source[label]] for label in SHORT_LABELS})


def all_delays(dates: Mapping[str, Column]) -> list[Column]:
    """One ``<from>_<to>`` column of whole days per pair."""
    return [delay_days(dates[a], dates[b]).alias(f"{a}_{b}") for a, b in DELAY_PAIRS]


def starts_with(sequence: Column, element: str) -> Column:
    """Only the first character is compared, so 'S' covers both SQ and SV."""
    return F.substring(sequence, 1, 1) == element


def comes_before(sequence: Column, first: str, second: str) -> Column:
    return contains_both(sequence, first, second) & (F.instr(sequence, first) < F.instr(sequence, second))


def contains_both(sequence: Column, first: str, second: str) -> Column:
    return F.contains(sequence, F.lit(first)) & F.contains(sequence, F.lit(second))

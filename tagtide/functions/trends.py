"""Names and values of search-interest exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_trend_name(name: Column, drop_quotes: bool = False) -> Column:
    name = F.replace(name, F.lit(" "), F.lit("-"))
    return F.replace(name, F.lit('"'), F.lit("")) if drop_quotes else name


def clean_trend_value(value: Column) -> Column:
    """Texts such as '<1' are 0; other texts are numbers, or null."""
    return F.when(F.contains(value, F.lit("<")), F.lit(0.0)).otherwise(value.try_cast("double"))

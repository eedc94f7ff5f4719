"""Fields of one line of a Q&A post dump."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIMESTAMP = r"^\d{4}-\d\d?-\d\d?T\d\d?:\d\d?:\d\d?\.\d{1,6}$"


def xml_attr(line: Column, name: str) -> Column:
    """Text of the first attribute ``name``: null when absent or unclosed, '' when empty.

    Entities stay escaped.
    """
    found = F.regexp_extract_all(line, F.lit(f' {name}="([^"]*)"'), F.lit(1))
    return F.get(found, F.lit(0))


def post_id(line: Column) -> Column:
    return xml_attr(line, "Id").try_cast("bigint")


def parse_creation_ts(text: Column) -> Column:
    """Date, 'T' and time with one to six fraction digits, without a zone; null otherwise."""
    return F.when(text.rlike(_TIMESTAMP), text.try_cast("timestamp_ntz"))


def parse_tag_list(tags: Column) -> Column:
    """Tags of ``&lt;a&gt;&lt;b&gt;`` (or of the decoded ``<a><b>``) in their order."""
    escaped = F.regexp_extract_all(tags, F.lit("&lt;(.*?)&gt;"), F.lit(1))
    decoded = F.regexp_extract_all(tags, F.lit("<(.*?)>"), F.lit(1))
    return F.when(F.contains(tags, F.lit("&lt;")), escaped).otherwise(decoded)

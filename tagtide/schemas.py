"""Schemas of the inputs; every reader names one, so nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS = T.TimestampNTZType()

TAGS = _struct(("TagName", _S), ("Excerpt", _S), ("TagCount", _I))
TAG_TYPES = _struct(("tag", _S), ("type", _S))
TAG_LABELS = _struct(("TagName", _S), ("TagType", _S), ("LangOrPlatform", _S), ("HasAPIOrSupports", _S))
TAG_USE = _struct(("id", _L), ("creation_ts", _TS), ("tag", _S))
TAG_WEEK = _struct(("tag", _S), ("week", T.DateType()), ("n", _L))
TREND = _struct(("tag", _S), ("week", T.DateType()), ("value", _D))
SNAPSHOTS = _struct(("snapshot_id", _S), ("rss", _S))

# Date columns of an early-appearance row; each of them may be absent from an input.
EARLY_DATES = (
    "first_use_date",
    "nth_use_date",
    "ad_date",
    "nth_ad_date",
    "course_date",
    "nth_course_date",
)
EARLY = _struct(("tag_name", _S), ("tag_count", _L), *((name, _TS) for name in EARLY_DATES))

# One <item> of an RSS document; namespace prefixes are ignored when it is read.
FEED_ITEM = _struct(
    ("guid", _S),
    ("title", _S),
    ("link", _S),
    ("description", _S),
    ("author", _S),
    ("location", _S),
    ("category", T.ArrayType(_S)),
    ("pubDate", _S),
    ("updated", _S),
)

"""Tag type labels and comma lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def topic_and_type(tag_type: Column) -> Column:
    """Split a combined label such as ``web-language`` into ``struct<topic, type>``.

    Labels of deprecated things, companies and persons have neither part.
    """
    parts = F.split(tag_type, "-")
    head, tail = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    has = lambda word: F.contains(tag_type, F.lit(word))
    unused = has("deprecated") | has("company") | has("person")
    language = has("language")
    single = F.size(parts) == 1
    topic = (
        F.when(unused, F.lit(None))
        .when(language & (head == "language"), F.lit("generalpurpose"))
        .when(~language & ~single & (head == "lang"), F.get(parts, F.lit(1)))
        .otherwise(head)
    )
    kind = F.when(unused, F.lit(None)).when(language, F.lit("language")).when(~single, tail)
    return F.struct(topic.alias("topic"), kind.alias("type"))


def strip_quotes(text: Column) -> Column:
    return F.btrim(text, F.lit('"'))


def all_langs(langs: Column, apis: Column) -> Column:
    """Both comma lists as one; the other one where one is null."""
    both = F.concat_ws(",", strip_quotes(langs), strip_quotes(apis))
    return F.when(langs.isNotNull() & apis.isNotNull(), both).otherwise(F.coalesce(langs, apis))


def comma_items(text: Column) -> Column:
    return F.split(text, ",")


def has_item(text: Column, item: str) -> Column:
    """Whether ``item`` is a whole entry of a comma list; a null list has none."""
    found = F.array_contains(comma_items(strip_quotes(text)), item)
    return F.coalesce(found, F.lit(False))


def recode(value: Column, mapping: Mapping[str, str]) -> Column:
    """Replace the listed values; others stay."""
    if not mapping:
        return value
    (first_old, first_new), *others = mapping.items()
    recoded = F.when(value == first_old, F.lit(first_new))
    for old, new in others:
        recoded = recoded.when(value == old, F.lit(new))
    return recoded.otherwise(value)

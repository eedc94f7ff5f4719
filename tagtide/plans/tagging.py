"""Tag dictionary and the tags of free texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame

from tagtide.operators.dictionary import build_variants, live_synonyms, main_tags, tag_length_histogram, usable_tags
from tagtide.operators.tagging import (
    bags_of_tags,
    collect_tags,
    drop_forbidden,
    entity_ngrams,
    longest_variant,
    look_up_tags,
    match_tags,
    shared_lookup,
    split_repeated,
)


class TagDictionary(NamedTuple):
    variants: DataFrame
    names: DataFrame
    tags: DataFrame
    lengths: DataFrame


def build_tag_dictionary(
    tags: DataFrame,
    synonyms: DataFrame | None = None,
    min_count: int = -1,
    remove_textless: bool = True,
    stems: DataFrame | None = None,
) -> TagDictionary:
    """Variants, main tag names, the usable rows of ``tags``, and how many parts the names have."""
    usable = usable_tags(tags, min_count, remove_textless)
    names = main_tags(usable, synonyms)
    kept = None if synonyms is None else live_synonyms(synonyms, names)
    return TagDictionary(build_variants(names, kept, stems), names, usable, tag_length_histogram(names))


def tag_mentions(
    entities: DataFrame,
    variants: DataFrame,
    forbidden: DataFrame | None = None,
    n: int = 4,
    field: str = "summary",
    entity: str = "entity_id",
    closed_words: Sequence[str] | None = None,
) -> DataFrame:
    """``(entity, pos, tag)``: every mention of a tag that no other tag of the text forbids.

    ``pos`` orders the mentions of a text: longer n-grams first, then by place. ``variants`` is
    read a few times and should be a stored table. Texts are looked up where they lie, and tags that another one of the same
    row forbids go there, too; only the matches of entities with several rows have to meet for that.
    """
    known = shared_lookup(variants, forbidden, n, closed_words)
    if known is None:
        longest = min(n, longest_variant(variants))
        matches = match_tags(entity_ngrams(entities, field, entity, n, closed_words, longest), variants, entity)
        return matches if forbidden is None else drop_forbidden(matches, forbidden, entity)
    if forbidden is None:
        return look_up_tags(entities, known, field, entity)
    alone, repeated = split_repeated(entities, entity)
    matches = look_up_tags(alone, known, field, entity, drop=True)
    if repeated is None:
        return matches
    return matches.unionByName(drop_forbidden(look_up_tags(repeated, known, field, entity), forbidden, entity))


def tag_entities(
    entities: DataFrame,
    variants: DataFrame,
    forbidden: DataFrame | None = None,
    n: int = 4,
    field: str = "summary",
    entity: str = "entity_id",
    closed_words: Sequence[str] | None = None,
) -> DataFrame:
    """``(entity, <field>_tags)``: the bag of tags of each text; an entity of several rows has one bag."""
    known = shared_lookup(variants, forbidden, n, closed_words)
    alone, repeated = (None, entities) if known is None else split_repeated(entities, entity)
    bags = []
    if alone is not None:
        bags.append(bags_of_tags(alone, known, f"{field}_tags", field, entity, drop=forbidden is not None))
    if repeated is not None:
        mentions = tag_mentions(repeated, variants, forbidden, n, field, entity, closed_words)
        bags.append(collect_tags(repeated, mentions, f"{field}_tags", entity))
    return reduce(DataFrame.unionByName, bags)

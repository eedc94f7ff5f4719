"""Tag dictionary: which surface form stands for which tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.functions.variants import spellings, version_forms
from tagtide.operators.joins import drop_listed, keep_listed


def usable_tags(tags: DataFrame, min_count: int = -1, remove_textless: bool = True) -> DataFrame:
    """Tags with a count above ``min_count``, if that is positive, and with an excerpt."""
    if min_count > 0:
        tags = tags.filter(F.col("tag_count") > min_count)
    if remove_textless:
        tags = tags.filter(F.col("excerpt").isNotNull())
    return tags


def main_tags(usable: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Distinct names that are not synonyms of another tag."""
    names = usable.select("tag_name").distinct()
    if synonyms is None:
        return names
    return drop_listed(names, synonyms.withColumnRenamed("synonym", "tag_name"))


def live_synonyms(synonyms: DataFrame, names: DataFrame) -> DataFrame:
    """Synonyms whose master is a main tag."""
    return keep_listed(synonyms, names.withColumnRenamed("tag_name", "master"), "master").select("synonym", "master")


def stem_forms(forms: DataFrame, stems: DataFrame) -> DataFrame:
    """Replace each hyphen-separated part of ``form`` by its stem, if ``stems`` has one."""
    numbered = forms.select("*", F.posexplode(F.split("form", "-")).alias("_at", "token"))
    parts = F.array_sort(F.collect_list(F.struct("_at", "_part")))
    return (
        numbered.join(stems.select("token", "stem"), "token", "left")
        .withColumn("_part", F.coalesce("stem", "token"))
        .groupBy(*forms.columns)
        .agg(F.array_join(F.transform(parts, lambda p: p["_part"]), "-").alias("_stemmed"))
        .withColumn("form", F.col("_stemmed"))
        .drop("_stemmed")
    )


def build_variants(names: DataFrame, synonyms: DataFrame | None = None, stems: DataFrame | None = None) -> DataFrame:
    """``(variant, tag)``, one row per variant.

    Where several tags share a variant, a tag wins over a synonym, an exact name over a derived
    form, and then the smallest tag.
    """
    sources = names.select(F.col("tag_name").alias("source"), F.col("tag_name").alias("tag"), F.lit(0).alias("_rank"))
    if synonyms is not None:
        named = synonyms.select(F.col("synonym").alias("source"), F.col("master").alias("tag"), F.lit(1).alias("_rank"))
        sources = sources.unionByName(named)
    forms = sources.withColumn("form", F.explode(version_forms(F.col("source"))))
    if stems is not None:
        forms = stem_forms(forms, stems)
    variants = forms.withColumn("variant", F.explode(spellings(F.array("form"))))
    derived = (F.col("variant") != F.col("source")).cast("int")
    best = F.min(F.struct("_rank", derived.alias("_derived"), "tag"))
    return variants.groupBy("variant").agg(best.alias("_best")).select("variant", F.col("_best.tag").alias("tag"))


def tag_length_histogram(names: DataFrame) -> DataFrame:
    """``(n_parts, n_tags)``: how many tags have how many hyphen-separated parts."""
    return names.groupBy(F.size(F.split("tag_name", "-")).alias("n_parts")).agg(F.count("*").alias("n_tags"))

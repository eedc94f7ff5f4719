"""Tags that texts mention."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.constants import TAGGING_PUNCTUATION
from tagtide.functions.grams import Codes, packed, pairs_of_texts, unpacked, words_of_texts
from tagtide.functions.matching import allowed, in_parts, lookup
from tagtide.functions.text import clean_tokens, closed_class_words, placed_grams, strip_html
from tagtide.operators.joins import measured_bytes, small_side
from tagtide.session import durable, for_workers

#: Occurrences of pairs that are summed up together, and how many lots of them there are at least and at most.
IN_LOT, LOTS = 500_000, (251, 65_000)
#: A dictionary up to this size goes to all tasks as arrays; beyond it, n-grams and variants are joined.
MAX_LOOKUP_BYTES = 256 * 1024 * 1024
#: The names of its tags are joined by number; up to this size they are broadcast.
MAX_NAME_BYTES = 128 * 1024 * 1024


def common_grams(texts: DataFrame, more_than: int, tokens: str = "tokens") -> DataFrame:
    """``(gram, n)``: the words and the pairs of neighbouring words that more than so many texts have, and how many have them.

    A pair is in no more texts than each of its words, so pairs are counted after the words, and only those of two
    words that are listed. Tasks sum up their pairs as numbers, which cost some three bytes in the shuffle, where
    rows of all words and pairs would cost several times the texts.
    """
    for_workers(texts.sparkSession)
    alone = texts.select(tokens)

    def count_words(batches):
        for batch in batches:
            words, n = words_of_texts(batch.column(0))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n, pa.int64())], ["gram", "n"])

    words = alone.mapInArrow(count_words, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    words = durable(words.filter(F.col("n") > more_than))
    listed = words.toArrow().sort_by("gram")
    names, total = listed["gram"].combine_chunks(), pc.sum(listed["n"]).as_py() or 0
    lots = min(max(total // IN_LOT, LOTS[0]), LOTS[1])
    stride = max(1, len(names))
    while gcd(stride, lots) > 1:
        stride += 1
    codes, known = Codes(stride, lots), texts.sparkSession.sparkContext.broadcast(names)

    def count_pairs(batches):
        for lot, steps, n in packed((pairs_of_texts(batch.column(0), known.value, codes.stride) for batch in batches), codes):
            arrays = [pa.array(lot, pa.int32()), pa.array(steps, pa.binary()), pa.array(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["lot", "steps", "n"])

    def sum_up(lot: pa.Table) -> pa.Table:
        a, b, n = unpacked(lot["lot"][0].as_py(), lot["steps"].to_pylist(), lot["n"].to_pylist(), codes)
        often = n > more_than
        both = [known.value.take(pa.array(x[often])).cast(pa.string()) for x in (a, b)]
        return pa.table({"gram": pc.binary_join_element_wise(*both, " "), "n": pa.array(n[often], pa.int64())})

    pairs = alone.mapInArrow(count_pairs, "lot int, steps binary, n binary").groupBy("lot").applyInArrow(sum_up, "gram string, n bigint")
    return words.unionByName(pairs)


def longest_variant(variants: DataFrame) -> int:
    """Number of words of the longest variant; longer n-grams match nothing."""
    return variants.agg(F.max(F.size(F.split("variant", " ")))).first()[0] or 1


def shared_lookup(
    variants: DataFrame, forbidden: DataFrame | None, n: int, closed_words: Sequence[str] | None, max_bytes: int = MAX_LOOKUP_BYTES
) -> Broadcast | None:
    """A stored dictionary as arrays that all tasks get, or nothing if it is larger than ``max_bytes``."""
    if measured_bytes(variants) > max_bytes:
        return None
    spark = variants.sparkSession
    for_workers(spark)
    listed = variants.select("variant", "tag").where("variant IS NOT NULL").toArrow()
    bans = pa.table({c: pa.array([], pa.string()) for c in ("tag", "sub_tag")})
    if forbidden is not None:
        bans = forbidden.select("tag", "sub_tag").distinct().toArrow()
    pairs = tuple(bans[c].combine_chunks() for c in ("tag", "sub_tag"))
    words = closed_class_words() if closed_words is None else closed_words
    return spark.sparkContext.broadcast(lookup(listed["variant"].combine_chunks(), listed["tag"].combine_chunks(), pairs, n, words))


def _with_tokens(entities: DataFrame, field: str, entity: str) -> DataFrame:
    tokens = clean_tokens(strip_html(F.col(field)), punctuation=TAGGING_PUNCTUATION)
    return entities.select(entity, tokens.alias("tokens"))


def look_up_tags(entities: DataFrame, known: Broadcast, field: str = "summary", entity: str = "entity_id", drop: bool = False) -> DataFrame:
    """``(entity, pos, tag)``: the n-grams of each text that are variants, looked up where the text lies.

    With ``drop``, without the tags that others of the same row forbid. Matches are dealt out by entity as numbers, some
    five bytes each, so that texts are not shuffled and grouping by entity takes no other shuffle.
    """

    def run(batches):
        for batch in batches:
            for part, found in in_parts(batch.column(1), known.value):
                found = allowed(found, known.value) if drop else found
                arrays = [batch.column(0)[part], *(found.lists(pa.array(x, pa.int32())) for x in (found.pos, found.tag))]
                yield pa.RecordBatch.from_arrays(arrays, [entity, "pos", "number"])

    kind = entities.schema[entity].dataType.simpleString()
    placed = _with_tokens(entities, field, entity).mapInArrow(run, f"`{entity}` {kind}, pos array<int>, number array<int>")
    rows = placed.repartition(entity).select(entity, F.inline(F.arrays_zip("pos", "number")))
    names = known.value.tags
    numbered = pa.table({"number": pa.array(range(len(names)), pa.int32()), "tag": names.cast(pa.string())})
    tags = durable(entities.sparkSession.createDataFrame(numbered))
    return rows.join(small_side(tags, MAX_NAME_BYTES), "number").select(entity, "pos", "tag")


def bags_of_tags(entities: DataFrame, known: Broadcast, into: str, field: str = "summary", entity: str = "entity_id", drop: bool = False) -> DataFrame:
    """``(entity, into)``: the tags of each row's text in text order, with ``drop`` without those that others of them forbid."""

    def run(batches):
        tags = known.value.tags
        valid = pc.is_valid(tags).to_numpy(zero_copy_only=False)
        for batch in batches:
            for part, found in in_parts(batch.column(1), known.value):
                found = allowed(found, known.value) if drop else found
                named = valid[found.tag]
                found = found._replace(text=found.text[named], pos=found.pos[named], tag=found.tag[named])
                bags = found.lists(tags.take(pa.array(found.tag)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], bags], [entity, into])

    kind = entities.schema[entity].dataType.simpleString()
    return _with_tokens(entities, field, entity).mapInArrow(run, f"`{entity}` {kind}, `{into}` array<string>")


def split_repeated(entities: DataFrame, entity: str = "entity_id") -> tuple[DataFrame, DataFrame | None]:
    """Entities that stand in one row, and those that stand in several, if there are any. Only their ids are shuffled."""
    counts = entities.groupBy(entity).agg(F.count("*").alias("_rows"))
    repeated = durable(counts.filter(F.col("_rows") > 1).select(F.col(entity).alias("_repeated")))
    if repeated.isEmpty():
        return entities, None
    same = F.col(entity).eqNullSafe(F.col("_repeated"))
    return entities.join(small_side(repeated), same, "left_anti"), entities.join(small_side(repeated), same, "left_semi")


def entity_ngrams(
    entities: DataFrame,
    field: str = "summary",
    entity: str = "entity_id",
    n: int = 4,
    closed_words: Sequence[str] | None = None,
    longest: int | None = None,
) -> DataFrame:
    """``(entity, pos, ngram)`` of each text, whole; ``pos`` is the place in the bag.

    n-grams above ``longest`` keep their places and are left out.
    """
    return entities.select(entity, F.inline(placed_grams(strip_html(F.col(field)), n, closed_words, longest)))


def match_tags(ngrams: DataFrame, variants: DataFrame, entity: str = "entity_id") -> DataFrame:
    """``(entity, pos, tag)``: n-grams that are variants, with every repetition."""
    lookup = small_side(variants.select(F.col("variant").alias("ngram"), "tag"))
    return ngrams.join(lookup, "ngram").select(entity, "pos", "tag")


def drop_forbidden(matches: DataFrame, forbidden: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Remove tags that another tag of the same entity forbids, wherever they were seen.

    ``forbidden`` has ``(tag, sub_tag)``. Each match also sends a ban to its entity's sub-tags,
    so that bans and matches meet in one shuffle and the texts are read once. A window holds the
    matches of one tag in one text.
    """
    lookup = forbidden.groupBy("tag").agg(F.collect_set("sub_tag").alias("_sub_tags"))
    match = F.struct("pos", "tag", F.lit(False).alias("_ban"))
    bans = F.transform(
        F.coalesce("_sub_tags", F.array().cast("array<string>")),
        lambda sub: F.struct(F.lit(None).cast("int").alias("pos"), sub.alias("tag"), F.lit(True).alias("_ban")),
    )
    rows = matches.join(lookup, "tag", "left").select(entity, F.inline(F.concat(F.array(match), bans)))
    banned = F.max("_ban").over(Window.partitionBy(entity, "tag"))
    return rows.withColumn("_banned", banned).filter(~F.col("_banned")).select(entity, "pos", "tag")


def collect_tags(entities: DataFrame, matches: DataFrame, into: str, entity: str = "entity_id") -> DataFrame:
    """``(entity, into)``: the tags of each entity in text order, empty where it has none.

    A list is as long as one text has matches; the texts themselves are not shuffled.
    """
    nothing = entities.select(entity, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("tag"))
    found = F.when(F.col("tag").isNotNull(), F.struct("pos", "tag"))
    tags = F.transform(F.array_sort(F.collect_list(found)), lambda m: m["tag"])
    return matches.select(entity, "pos", "tag").unionByName(nothing).groupBy(entity).agg(tags.alias(into))


def stem_tokens(tokens: DataFrame, stems: DataFrame) -> DataFrame:
    """Replace ``token`` by its stem where ``stems(token, stem)`` has one; one row per token.

    A small stored table of stems goes to all tasks, so that frequent tokens stay where they are.
    """
    table = small_side(stems.select("token", "stem"))
    stemmed = F.coalesce("stem", "token").alias("token")
    return tokens.join(table, "token", "left").select(*[stemmed if c == "token" else c for c in tokens.columns])

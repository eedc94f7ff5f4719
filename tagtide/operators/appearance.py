"""When tags appear: first, n-th and cumulative uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.functions.posts import parse_creation_ts, parse_tag_list, post_id, xml_attr

# A power of two.
_SALTS = 16


def parse_posts(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(id, creation_ts, tags, title, body)`` of each line.

    A line that is not a post has a null id, and the operators below leave it out. Fields that a
    query does not use are not extracted.
    """
    value = F.col(line)
    return lines.select(
        post_id(value).alias("id"),
        parse_creation_ts(xml_attr(value, "CreationDate")).alias("creation_ts"),
        parse_tag_list(xml_attr(value, "Tags")).alias("tags"),
        xml_attr(value, "Title").alias("title"),
        xml_attr(value, "Body").alias("body"),
    )


def explode_tags(posts: DataFrame) -> DataFrame:
    """``(id, creation_ts, tag)``: one row per tag of a post that has an id, tags and a date.

    The filter stands on exploded rows, because below the generator it would have every field
    extracted a second time.
    """
    uses = F.transform("tags", lambda tag: F.struct("id", "creation_ts", tag.alias("tag")))
    return posts.select(F.explode_outer(uses).alias("use")).select("use.*").dropna()


def first_use(uses: DataFrame) -> DataFrame:
    return uses.groupBy("tag").agg(F.min("creation_ts").alias("first_use_date"))


def earliest_n(uses: DataFrame, n: int = 1) -> DataFrame:
    """``(creation_ts, tag)`` of the uses whose rank by date within the tag is at most ``n``.

    Uses at the same instant share a rank, so all of them stay at the cut. Each tag is ranked in
    parts first: a map task belongs to one part and passes on ``n`` ranks of each tag, and a tag
    with very many uses at one instant is spread over the parts. The date of the n-th use then
    cuts the parts. The result does not depend on which part a use is in.
    """
    salted = uses.select("tag", "creation_ts", F.spark_partition_id().bitwiseAND(_SALTS - 1).alias("_salt"))
    in_part = Window.partitionBy("tag", "_salt").orderBy("creation_ts")
    survivors = salted.withColumn("_rank", F.rank().over(in_part)).filter(F.col("_rank") <= n).drop("_rank")

    in_tag = Window.partitionBy("tag").orderBy("creation_ts")
    cuts = (
        survivors.withColumn("_row", F.row_number().over(in_tag))
        .filter(F.col("_row") <= n)
        .groupBy("tag")
        .agg(F.max("creation_ts").alias("_cut"))
        .withColumn("_salt", F.explode(F.array([F.lit(part) for part in range(_SALTS)])))
    )
    return (
        survivors.join(cuts, ["tag", "_salt"])
        .filter(F.col("creation_ts") <= F.col("_cut"))
        .select("creation_ts", "tag")
    )


def first_and_nth_dates(uses: DataFrame, n: int, *keys: str) -> DataFrame:
    """``(keys, first_date, nth_date)``; a key with fewer than ``n`` uses has no n-th date.

    The row number limit is applied before the shuffle, so a hot key sends ``n`` rows per task.
    """
    by_date = Window.partitionBy(*keys).orderBy("creation_ts")
    ranked = uses.select(*keys, "creation_ts", F.row_number().over(by_date).alias("_row")).filter(F.col("_row") <= n)
    return ranked.groupBy(*keys).agg(
        F.min("creation_ts").alias("first_date"),
        F.max(F.when(F.col("_row") == n, F.col("creation_ts"))).alias("nth_date"),
    )


def early_appearances(uses: DataFrame, n: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """First and n-th date of each tag on each platform, and its number of questions.

    ``uses`` has ``(tag, platform, creation_ts)`` with platforms SQ (question), A (advert) and
    C (course). ``counts`` ``(tag, platform, n)``, of any finer grain, spares the second scan that
    counts the questions.
    """
    wanted = uses.filter(F.col("platform").isin("SQ", "A", "C"))
    dates = first_and_nth_dates(wanted, n, "tag", "platform")

    def on(platform: str, date: str):
        return F.min(F.when(F.col("platform") == platform, F.col(date)))

    wide = dates.groupBy("tag").agg(
        on("SQ", "first_date").alias("first_use_date"),
        on("SQ", "nth_date").alias("nth_use_date"),
        on("A", "first_date").alias("ad_date"),
        on("A", "nth_date").alias("nth_ad_date"),
        on("C", "first_date").alias("course_date"),
        on("C", "nth_date").alias("nth_course_date"),
    )
    if counts is None:
        questions = wanted.groupBy("tag").agg(F.count_if(F.col("platform") == "SQ").alias("tag_count"))
    else:
        questions = counts.groupBy("tag").agg(F.sum(F.when(F.col("platform") == "SQ", F.col("n"))).alias("tag_count"))
    return wide.join(questions, "tag", "left").select(
        F.col("tag").alias("tag_name"),
        F.coalesce("tag_count", F.lit(0)).alias("tag_count"),
        *[c for c in wide.columns if c != "tag"],
    )


def cumulative_uses(uses: DataFrame, bucket: str = "hour") -> DataFrame:
    """``(date, tag, cumulative_value)``: the running number of uses of each tag, by date and id.

    A use is numbered within its tag and time bucket, after the sum of the tag's earlier buckets. So a
    hot tag is spread over its buckets, and only counts run in one window. Choose a finer ``bucket``
    where a tag has too many uses in one.
    """
    narrow = uses.select("tag", "creation_ts", "id", F.date_trunc(bucket, "creation_ts").alias("_bucket"))
    earlier = Window.partitionBy("tag").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = narrow.groupBy("tag", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("tag", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("tag", "_bucket").orderBy("creation_ts", "id")
    numbered = narrow.withColumn("_place", F.row_number().over(within)).join(before, ["tag", "_bucket"])
    value = (F.col("_before") + F.col("_place")).alias("cumulative_value")
    return numbered.select(F.col("creation_ts").alias("date"), "tag", value)


def cumulative_since(uses: DataFrame, min_date: str, bucket: str = "hour") -> DataFrame:
    """Running numbers from ``min_date`` on, each tag after a row ``(min_date, tag, uses before it)``.

    Tags without a use from that date on have no row.
    """
    start = F.lit(min_date).cast("timestamp_ntz")
    shown = cumulative_uses(uses, bucket).filter(F.col("date") >= start)
    earlier = F.count_if(F.col("creation_ts") < start)
    sums = uses.groupBy("tag").agg(earlier.alias("cumulative_value"), F.count("*").alias("_all"))
    baseline = sums.filter(F.col("_all") > F.col("cumulative_value"))
    return shown.unionByName(baseline.select(start.alias("date"), "tag", "cumulative_value"))


def with_baseline_row(cumulative: DataFrame, min_date: str) -> DataFrame:
    """Add ``(min_date, tag, lowest value - 1)`` for each tag whose lowest value is at least 1."""
    baseline = (
        cumulative.groupBy("tag")
        .agg((F.min("cumulative_value") - 1).alias("cumulative_value"))
        .filter(F.col("cumulative_value") >= 0)
        .select(F.lit(min_date).cast("timestamp_ntz").alias("date"), "tag", "cumulative_value")
    )
    return cumulative.select("date", "tag", "cumulative_value").unionByName(baseline)

"""Adverts from stored feed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagtide import schemas
from tagtide.functions.feeds import ad_key, feed_item_texts, snapshot_id, snapshot_links, unclosed_items

_BROKEN = "_broken"
_ITEM = T.StructType([*schemas.FEED_ITEM.fields, T.StructField(_BROKEN, T.StringType())])


def page_links(pages: DataFrame, path_part: str = "/web/") -> DataFrame:
    """``(path, pos, url)`` of the archived addresses that each page links to."""
    return pages.select("path", F.posexplode(snapshot_links(F.col("html"), path_part)).alias("pos", "url"))


def linked_snapshots(links: DataFrame, path_part: str = "/web/", until: str = "/http") -> DataFrame:
    """``(snapshot_id, url)``, one row per snapshot: the link that comes last by page and position."""
    keyed = links.withColumn("snapshot_id", snapshot_id(F.col("url"), path_part, until))
    last = F.max_by("url", F.struct("path", "pos"))
    return keyed.groupBy("snapshot_id").agg(last.alias("url"))


def _parsed_items(snapshots: DataFrame) -> DataFrame:
    """Items parsed inside the generator that makes their rows, so a later filter cannot make XML parse twice."""
    texts = feed_item_texts(F.col("rss"))
    options = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": _BROKEN}
    parsed = F.transform(texts, lambda t: F.struct(t.alias("text"), F.from_xml(t, _ITEM, options).alias("item")))
    return snapshots.select("snapshot_id", F.posexplode(parsed).alias("item_pos", "parsed")).select("snapshot_id", "item_pos", "parsed.text", "parsed.item")


def broken_items(snapshots: DataFrame) -> DataFrame:
    """``(snapshot_id, item_pos, text)`` of the items that cannot be parsed; ``feed_items`` leaves them out."""
    return _parsed_items(snapshots).filter(F.col(f"item.{_BROKEN}").isNotNull()).select("snapshot_id", "item_pos", "text")


def unparsed_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots in which an item is opened and not closed, or whose text is no feed."""
    feed = F.contains("rss", F.lit("<rss")) & F.contains("rss", F.lit("<channel"))
    return snapshots.filter(F.col("rss").isNull() | ~feed | (unclosed_items(F.col("rss")) > 0)).select("snapshot_id")


def feed_items(snapshots: DataFrame) -> DataFrame:
    """One row per item of each snapshot's RSS text, with its position in the feed.

    ``broken_items`` and ``unparsed_snapshots`` list what could not be read.
    """
    items = _parsed_items(snapshots).filter(F.col(f"item.{_BROKEN}").isNull())
    return items.select(
        "snapshot_id",
        "item_pos",
        F.col("item.title").alias("title"),
        F.col("item.pubDate").alias("published"),
        F.col("item.updated").alias("updated"),
        F.col("item.description").alias("summary"),
        F.col("item.link").alias("link"),
        F.col("item.guid").alias("guid"),
        F.col("item.author").alias("author"),
        F.col("item.location").alias("location"),
        F.col("item.category").alias("category"),
    )


def keyed_ads(items: DataFrame, keep_all_updates: bool = False) -> DataFrame:
    """Add ``ad_key``. An item that was never updated counts as updated when it was published."""
    updated = F.coalesce("updated", "published") if keep_all_updates else None
    return items.withColumn("ad_key", ad_key(F.col("title"), F.col("published"), updated))


def unkeyed_ads(keyed: DataFrame) -> DataFrame:
    """Items without a title or a date, which no key can stand for."""
    return keyed.filter(F.col("ad_key").isNull())


def latest_ad(keyed: DataFrame) -> DataFrame:
    """Per key the entry of the latest snapshot, and within it the last one.

    Copies of an advert meet in the map tasks already, so a hot key sends one row per task.
    """
    entry = F.struct(*[c for c in keyed.columns if c != "ad_key"])
    latest = F.max_by(entry, F.struct("snapshot_id", "item_pos"))
    known = keyed.filter(F.col("ad_key").isNotNull())
    return known.groupBy("ad_key").agg(latest.alias("_ad")).select("ad_key", "_ad.*")

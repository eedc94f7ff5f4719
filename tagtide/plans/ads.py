"""Adverts from stored snapshots of a job feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagtide.operators.ads import feed_items, keyed_ads, latest_ad, linked_snapshots, page_links
from tagtide.operators.joins import keep_listed
from tagtide.sources.readers import read_page_files, read_series
from tagtide.sources.writers import write_json


def snapshots_to_fetch(pages: DataFrame) -> DataFrame:
    """``(snapshot_id, url)`` of the snapshots that calendar pages ``(path, html)`` link to."""
    return linked_snapshots(page_links(pages))


def listed_snapshots(pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Stored snapshots that the pages link to."""
    return keep_listed(snapshots, snapshots_to_fetch(pages), "snapshot_id")


def ads_from_snapshots(snapshots: DataFrame, keep_all_updates: bool = False) -> DataFrame:
    """One row per advert, or per update of an advert, from ``(snapshot_id, rss)``."""
    return latest_ad(keyed_ads(feed_items(snapshots), keep_all_updates))


def run_ads(
    spark: SparkSession,
    page_folder: str,
    snapshots: str,
    output: str,
    keep_all_updates: bool = False,
    save_originals: bool = False,
) -> None:
    stored = listed_snapshots(read_page_files(spark, page_folder), read_series(spark, snapshots))
    write_json(ads_from_snapshots(stored, keep_all_updates), f"{output}/all_ads")
    if save_originals:
        write_json(stored.select("snapshot_id", "rss"), f"{output}/jobs_rss_raw")

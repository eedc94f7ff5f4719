"""Page links and adverts in feed snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.catalogue.registry import query, table
from tagtide.functions.feeds import snapshot_url
from tagtide.operators.ads import broken_items, feed_items, keyed_ads, linked_snapshots, page_links, unparsed_snapshots
from tagtide.plans.ads import ads_from_snapshots

_LINKS_SQL = r"""
targets AS (
  SELECT url AS path, list_filter(list_transform(
           regexp_extract_all(regexp_replace(replace(html, 'href="', 'href="/web/' || page_id % 97 || '/http'), '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'),
                              '(?i)<a\s[^>]*href="([^"]*)"', 1),
           lambda t: replace(t, '&amp;', '&')), lambda t: contains(t, '/web/')) AS found
  FROM pages
),
links AS (
  SELECT path, 'https://web.archive.org/' || unnest(found) AS url, unnest(range(0, len(found))) AS pos FROM targets
)"""


def _links(spark, sf_dir):
    """The pages link to no archive, so each target is put behind the address of a snapshot."""
    archived = F.concat(F.lit('href="/web/'), F.col("page_id") % 97, F.lit("/http"))
    html = F.replace("html", F.lit('href="'), archived)
    return page_links(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), html.alias("html")))


@query(f"WITH {_LINKS_SQL} SELECT path, CAST(pos AS INTEGER) AS pos, url FROM links")
def archived_page_links(spark, sf_dir):
    return _links(spark, sf_dir)


@query(
    f"""
WITH {_LINKS_SQL},
keyed AS (SELECT *, split_part(split_part(url, '/web/', 2), '/http', 1) AS snapshot_id FROM links)
SELECT snapshot_id, url FROM (
  SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY path DESC, pos DESC) AS r FROM keyed
) WHERE r = 1"""
)
def last_link_per_snapshot(spark, sf_dir):
    return linked_snapshots(_links(spark, sf_dir))


@query(
    """
SELECT page_id, 'https://web.archive.org/web/' || page_id || '/http://stackoverflow.com/jobs/feed' AS by_id, url AS by_url
FROM pages"""
)
def snapshot_addresses(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", snapshot_url(F.col("page_id").cast("string")).alias("by_id"), snapshot_url(F.col("url")).alias("by_url")
    )


# Every hundred consecutive events are one snapshot of a feed. An advert belongs to a user and
# is published under an event type, so it comes again in later snapshots with a new update.
_ITEMS_SQL = """
items AS (
  SELECT event_id, lpad(CAST(event_id // 100 AS VARCHAR), 14, '0') AS snapshot_id, 'Job & user ' || user_id AS title,
         event_type AS published, CASE WHEN value < 150 THEN strftime(ts, '%Y-%m-%d') END AS updated, props AS summary
  FROM events
)"""


def _snapshots(spark, sf_dir):
    page = F.floor(F.col("event_id") / 100)
    updated = F.when(F.col("value") < 150, F.concat(
        F.lit("<a10:updated>"), F.to_date("ts").cast("string"), F.lit("</a10:updated>")
    )).otherwise("")
    item = F.concat(
        F.lit("<item><title>Job &amp; user "), "user_id", F.lit("</title><pubDate>"), "event_type",
        F.lit("</pubDate>"), updated, F.lit("<description>"), "props", F.lit("</description></item>"),
    )
    # A snapshot holds at most a hundred items.
    events = table(spark, sf_dir, "events").select(
        F.lpad(page.cast("string"), 14, "0").alias("snapshot_id"), F.struct("event_id", item.alias("item")).alias("entry")
    )
    entries = F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["item"])
    head = '<rss version="2.0" xmlns:a10="http://www.w3.org/2005/Atom"><channel><title>Jobs</title>'
    rss = F.concat(F.lit(head), F.array_join(entries, ""), F.lit("</channel></rss>"))
    return events.groupBy("snapshot_id").agg(rss.alias("rss"))


def _faulty_snapshots(spark, sf_dir):
    """The ampersand of titles is bare, a tag of the channel stays open, and the eighth item's title has no end."""
    bare = F.replace("rss", F.lit("&amp;"), F.lit("&"))
    opened = F.replace(bare, F.lit("<title>Jobs</title>"), F.lit("<title>Jobs<image>"))
    items = F.split(opened, "<item>")
    broken = F.transform(items, lambda x, i: F.when(i == 8, F.replace(x, F.lit("</title>"), F.lit(""))).otherwise(x))
    return _snapshots(spark, sf_dir).withColumn("rss", F.array_join(broken, "<item>"))


@query(
    f"""
WITH {_ITEMS_SQL}
SELECT snapshot_id, CAST(event_id % 100 AS INTEGER) AS item_pos, title, published, updated, summary FROM items"""
)
def feed_item_rows(spark, sf_dir):
    items = feed_items(_snapshots(spark, sf_dir))
    return items.select("snapshot_id", "item_pos", "title", "published", "updated", "summary")


def _latest_sql(key: str) -> str:
    return f"""
WITH {_ITEMS_SQL},
keyed AS (SELECT *, {key} AS ad_key FROM items)
SELECT ad_key, snapshot_id, title, published, updated, summary FROM (
  SELECT *, row_number() OVER (PARTITION BY ad_key ORDER BY event_id DESC) AS r FROM keyed
) WHERE r = 1"""


_AD_COLUMNS = ("ad_key", "snapshot_id", "title", "published", "updated", "summary")


@query(_latest_sql("title || '___' || published"))
def feed_items_latest(spark, sf_dir):
    return ads_from_snapshots(_snapshots(spark, sf_dir)).select(*_AD_COLUMNS)


@query(_latest_sql("title || '___' || published || '___' || coalesce(updated, published)"))
def feed_items_all_updates(spark, sf_dir):
    return ads_from_snapshots(_snapshots(spark, sf_dir), keep_all_updates=True).select(*_AD_COLUMNS)


@query(
    f"""
WITH {_ITEMS_SQL}
SELECT title || '___' || published AS ad_key, count(DISTINCT snapshot_id) AS n_snapshots FROM items GROUP BY 1"""
)
def ad_sightings(spark, sf_dir):
    items = keyed_ads(feed_items(_snapshots(spark, sf_dir)))
    return items.groupBy("ad_key").agg(F.count_distinct("snapshot_id").alias("n_snapshots"))


@query(
    f"""
WITH {_ITEMS_SQL}
SELECT snapshot_id, CAST(event_id % 100 AS INTEGER) AS item_pos, title, published, summary FROM items
WHERE event_id % 100 <> 7"""
)
def feed_items_with_faults(spark, sf_dir):
    """Bare ampersands and a broken channel cost nothing; one item of each snapshot cannot be parsed."""
    return feed_items(_faulty_snapshots(spark, sf_dir)).select("snapshot_id", "item_pos", "title", "published", "summary")


@query("SELECT DISTINCT lpad(CAST(event_id // 100 AS VARCHAR), 14, '0') AS snapshot_id, 7 AS item_pos FROM events WHERE event_id % 100 = 7")
def broken_feed_items(spark, sf_dir):
    return broken_items(_faulty_snapshots(spark, sf_dir)).select("snapshot_id", "item_pos")


def _marked_up_snapshots(spark, sf_dir):
    """Titles in CDATA with markup and an ampersand, then an HTML entity; descriptions in CDATA that
    hold item tags as text; and after each item a commented-out item."""
    made = _snapshots(spark, sf_dir)
    rss = F.regexp_replace("rss", r"<title>Job &amp; user ([0-9]+)</title>", "<title><![CDATA[R&D <b>lead</b>]]>&nbsp;$1</title>")
    rss = F.regexp_replace(rss, "</item>", "</item><!-- <item><title>ghost</title><pubDate>never</pubDate></item> -->")
    rss = F.regexp_replace(rss, "<description>", "<description><![CDATA[<item>x</item> & ]]>")
    return made.withColumn("rss", rss)


@query(
    f"""
WITH {_ITEMS_SQL}
SELECT snapshot_id, CAST(event_id % 100 AS INTEGER) AS item_pos,
       'R&D <b>lead</b>' || chr(160) || substr(title, 12) AS title, published, '<item>x</item> & ' || summary AS summary
FROM items"""
)
def feed_items_in_markup(spark, sf_dir):
    """Items of feeds with CDATA, comments and HTML entities: cut by tags only, repaired outside CDATA."""
    return feed_items(_marked_up_snapshots(spark, sf_dir)).select("snapshot_id", "item_pos", "title", "published", "summary")


@query("SELECT DISTINCT lpad(CAST(event_id // 100 AS VARCHAR), 14, '0') AS snapshot_id FROM events WHERE (event_id // 100) % 3 = 1")
def unparsed_feed_snapshots(spark, sf_dir):
    """A third of the snapshots break off within an item."""
    page = F.col("snapshot_id").cast("bigint")
    cut = F.when(page % 3 == 1, F.concat("rss", F.lit("<item><title>cut"))).otherwise(F.col("rss"))
    return unparsed_snapshots(_snapshots(spark, sf_dir).withColumn("rss", cut))

from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F
from tagtide.functions.feeds import feed_item_texts, feed_tokens
from tagtide.operators.ads import broken_items, feed_items, keyed_ads, unkeyed_ads, unparsed_snapshots
from tagtide.plans.ads import ads_from_snapshots, listed_snapshots, snapshots_to_fetch


def rss(*items):
    head = '<rss version="2.0" xmlns:a10="http://www.w3.org/2005/Atom"><channel><title>Jobs</title>'
    return head + "".join(items) + "</channel></rss>"


def item(title, published, updated=None, text="d"):
    parts = [f"<title>{title}</title>"] if title else []
    parts += [f"<pubDate>{published}</pubDate>"] if published else []
    parts += [f"<a10:updated>{updated}</a10:updated>"] if updated else []
    return f"<item>{''.join(parts)}<description>{text}</description><category>x</category><category>y</category></item>"


def snapshots(spark):
    data = [
        ("20160102", rss(item("Dev", "p1", "u2", "second"), item("Ops &amp; more", "p1"))),
        ("20160101", rss(item("Dev", "p1", "u1", "first"), item("Dev", "p1", "u1", "first again"))),
        ("20160103", rss(item("Dev", "p1", "u2", "third"), item(None, "p2"), item("No date", None))),
        ("20160104", rss()),
    ]
    return spark.createDataFrame(data, "snapshot_id string, rss string")


def test_items_keep_their_place_and_missing_elements(spark):
    got = rows(feed_items(snapshots(spark)).select("snapshot_id", "item_pos", "title", "published", "updated", "category"))
    assert len(got) == 7
    assert ("20160102", 1, "Ops & more", "p1", None, ["x", "y"]) in got
    assert ("20160103", 1, None, "p2", None, ["x", "y"]) in got


def test_faults_cost_no_other_item_and_are_listed(spark):
    data = [
        ("1", rss(item("A & B", "p1"), item("C &amp; D", "p2"))),
        ("2", rss(item("kept", "p1"), "<item><title>broken<pubDate>x</pubDate></item>", item("kept too", "p2"))),
        ("3", rss(item("kept", "p1")).replace("</channel></rss>", "<item><title>cut")),
        ("4", "no feed at all"),
        ("5", None),
    ]
    feeds = spark.createDataFrame(data, "snapshot_id string, rss string")
    assert rows(feed_items(feeds).select("snapshot_id", "item_pos", "title")) == [
        ("1", 0, "A & B"), ("1", 1, "C & D"), ("2", 0, "kept"), ("2", 2, "kept too"), ("3", 0, "kept"),
    ]
    assert rows(broken_items(feeds).select("snapshot_id", "item_pos")) == [("2", 1)]
    assert rows(unparsed_snapshots(feeds)) == [("3",), ("4",), ("5",)]


def test_latest_snapshot_wins(spark):
    got = rows(ads_from_snapshots(snapshots(spark)).select("ad_key", "snapshot_id", "summary"))
    assert got == [("Dev___p1", "20160103", "third"), ("Ops & more___p1", "20160102", "d")]


def test_every_update_is_kept_on_request(spark):
    got = rows(ads_from_snapshots(snapshots(spark), keep_all_updates=True).select("ad_key", "snapshot_id", "summary"))
    assert got == [
        ("Dev___p1___u1", "20160101", "first again"),
        ("Dev___p1___u2", "20160103", "third"),
        ("Ops & more___p1___p1", "20160102", "d"),
    ]


def test_items_without_a_key_are_listed(spark):
    assert rows(unkeyed_ads(keyed_ads(feed_items(snapshots(spark)))).select("title", "published")) == [
        ("No date", None), (None, "p2"),
    ]


def test_pages_choose_snapshots(spark):
    link = '<a href="/web/{}/http://stackoverflow.com/jobs/feed">x</a>'
    pages = spark.createDataFrame(
        [("a.html", link.format("20160101") + link.format("20160102")), ("b.html", link.format("20160101"))],
        "path string, html string",
    )
    got = rows(snapshots_to_fetch(pages))
    assert [s for s, _ in got] == ["20160101", "20160102"]
    assert got[0][1] == "https://web.archive.org//web/20160101/http://stackoverflow.com/jobs/feed"
    assert listed_snapshots(pages, snapshots(spark)).count() == 2


def test_markup_is_scanned_not_searched(spark):
    """CDATA stays as written, item tags inside CDATA or comments are text, HTML entities are characters."""
    feeds = [
        ("1", rss("<item><title><![CDATA[R&D lead]]></title><pubDate>d1</pubDate></item>")),
        ("2", rss("<item><title>t2</title><pubDate>d2</pubDate><description><![CDATA[see <item> and </item> here]]></description></item>"
                  "<!-- <item><title>ghost</title><pubDate>g</pubDate></item> -->")),
        ("3", rss("<item><title>a&nbsp;b &eacute; &bogus; & c &amp; &#233;</title><pubDate>d3</pubDate></item>")),
        ("4", rss("<item><title><![CDATA[R&D <b>lead</b>]]>&nbsp;42</title><pubDate>d4</pubDate></item><item><title>unclosed")),
    ]
    df = spark.createDataFrame(feeds, "snapshot_id string, rss string")
    got = rows(feed_items(df).select("snapshot_id", "item_pos", "title", "published", "summary"))
    assert got == [
        ("1", 0, "R&D lead", "d1", None),
        ("2", 0, "t2", "d2", "see <item> and </item> here"),
        ("3", 0, "a\xa0b é &bogus; & c & é", "d3", None),
        ("4", 0, "R&D <b>lead</b>\xa042", "d4", None),
    ]
    assert rows(broken_items(df)) == []
    assert rows(unparsed_snapshots(df)) == [("4",)]


def test_a_feed_is_scanned_once_and_cut_like_a_walk_over_its_tags(spark):
    """Opening and closing tags in any order, in feeds of many items; the tokens appear once in the plan."""
    rnd = random.Random(3)
    feeds, whole, unclosed = [], [], []
    for k in range(30):
        tags = rnd.choices(["<item>", "</item>"], [3, 3 - k % 3], k=10 * k)
        feeds.append((f"{k:02d}", rss(*(f"{t}<title>{i}</title>" if t == "<item>" else t for i, t in enumerate(tags)))))
        places = [i for i, t in enumerate(tags) if t == "<item>" and tags[i + 1 : i + 2] == ["</item>"]]
        whole += [(f"{k:02d}", at, str(i)) for at, i in enumerate(places)]
        unclosed += [(f"{k:02d}",)] if len(places) < tags.count("<item>") else []
    feeds.append(("many", rss(*(item(f"t{i}", "p") for i in range(2_000)))))
    df = spark.createDataFrame(feeds, "snapshot_id string, rss string")
    found, cut = feed_items(df).select("snapshot_id", "item_pos", "title"), unparsed_snapshots(df)
    for plan in (found, cut):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(rss") == 1
    assert rows(found) == whole + [("many", i, f"t{i}") for i in range(2_000)]
    assert rows(cut) == unclosed
    assert rows(feed_items(spark.createDataFrame([("a", ""), ("b", None)], "snapshot_id string, rss string"))) == []


def test_tokens_grow_with_items_and_not_with_their_tags(spark, one):
    """An item is three tokens however many tags it holds; stray marks, comments and CDATA are still told apart."""
    many = rss(*(item(f"t{i} & more", "p", "u") for i in range(500)))
    assert one(lambda text: F.size(feed_tokens(text)), many) == [3 * 500 + 2]
    texts = [
        "<item ><a>x & y</a></item\n>",
        "<item><a>1</a><!-- <item> -->&nbsp;<![CDATA[</item>&]]></item>",
        "<item>1 < 2<items></items></item>",
        "<item><item <b></item></item x>",
        "<item></item x></item>",
        "<item>" + "<a>x</a>" * 100_000 + "</item>",
    ]
    assert one(feed_item_texts, *texts) == [
        ["<item ><a>x &amp; y</a></item\n>"],
        ["<item><a>1</a>&#160;<![CDATA[</item>&]]></item>"],
        ["<item>1 &lt; 2<items></items></item>"],
        ["<item>&lt;item <b></item>"],
        ["<item></item x></item>"],
        [texts[-1]],
    ]

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagtide.functions import dates, feeds, labels, sequences, trends, variants


@pytest.mark.parametrize(
    ("tag", "expected"),
    [
        ("angular2", {"angular2", "angular-2", "angular 2"}),
        ("swift3.0", {"swift3.0", "swift-3.0", "swift 3.0", "swift-3", "swift 3", "swift3"}),
        ("app3.01", {"app3.01", "app-3.01", "app 3.01"}),
        ("java-11", {"java-11", "java 11", "java11", "java--1-1", "java  1 1"}),
        ("ruby-on-rails", {"ruby-on-rails", "ruby on rails", "rubyonrails"}),
        ("c#", {"c#"}),
        ("2d", {"2d"}),
    ],
)
def test_tag_variants(one, tag, expected):
    (got,) = one(variants.tag_variants, tag)
    assert len(got) == len(set(got)) and set(got) == expected


def delays(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a timestamp_ntz, b timestamp_ntz")
    return [r.d for r in df.select("i", dates.delay_days(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]


def test_delays_round_down(spark):
    noon, eve = datetime(2020, 1, 3, 12), datetime(2020, 1, 2)
    assert delays(spark, [(noon, eve), (eve, noon), (eve, eve), (None, eve), (eve, None)]) == [-2, 1, 0, None, None]


@settings(max_examples=20, deadline=None)
@given(st.datetimes(datetime(1990, 1, 1), datetime(2040, 1, 1)), st.datetimes(datetime(1990, 1, 1), datetime(2040, 1, 1)))
def test_delay_is_floor_of_the_difference(spark, a, b):
    day = timedelta(days=1)
    assert delays(spark, [(a, b), (b, a)]) == [(b - a) // day, (a - b) // day]


def test_week_floor_is_monday(one):
    week = lambda c: dates.week_floor(c.cast("timestamp_ntz"))
    assert one(week, "2024-01-07 23:59:59", "2024-01-08", None) == [date(2024, 1, 1), date(2024, 1, 8), None]


def test_dayfirst_dates(one):
    assert one(dates.parse_dayfirst_date, "05/01/2016", "2016-01-05", "5/1/2016", "5/1/20160", "x", None) == [
        date(2016, 1, 5), date(2016, 1, 5), date(2016, 1, 5), None, None, None,
    ]


def test_trend_names_and_values(one):
    assert one(trends.clean_trend_name, "machine learning", '"c sharp"') == ["machine-learning", '"c-sharp"']
    assert one(lambda c: trends.clean_trend_name(c, True), '"c sharp"', "java") == ["c-sharp", "java"]
    assert one(trends.clean_trend_value, "<1", "12", " 7", "0", "x", None) == [0, 12, 7, 0, None, None]


ORDER = ("SQ1", "SQ5", "A1", "C1", "A5", "C5", "SV", "GT")


def sequence_row(spark, known, function):
    values = [known.get(label) for label in ORDER]
    df = spark.createDataFrame([values], ", ".join(f"{label} timestamp_ntz" for label in ORDER))
    columns = {label: F.col(label) for label in ORDER}
    out = function(columns)
    return df.select(*(out if isinstance(out, list) else [out.alias("s")])).first()


def test_sequences_sort_dates_and_keep_label_order_on_ties(spark):
    day = datetime(2020, 1, 1)
    known = {"C1": day, "SQ1": day, "GT": day - timedelta(hours=1), "A5": day + timedelta(days=2)}
    assert sequence_row(spark, known, sequences.full_sequence).s == "GT-SQ1-C1-A5"
    assert sequence_row(spark, known, sequences.short_sequence).s == "GT-SQ-C"
    assert sequence_row(spark, {}, sequences.full_sequence).s == ""


def test_delay_columns(spark):
    day = datetime(2020, 1, 1)
    row = sequence_row(spark, {"SQ1": day, "A1": day - timedelta(hours=36)}, sequences.all_delays).asDict()
    assert len(row) == 14
    assert row["SQ1_A1"] == -2 and row["C1_A1"] is None and row["SQ1_SQ5"] is None


@pytest.mark.parametrize(
    ("label", "topic", "kind"),
    [
        ("deprecated", None, None),
        ("web-company", None, None),
        ("person", None, None),
        ("language", "generalpurpose", "language"),
        ("web-language", "web", "language"),
        ("language-implementation", "generalpurpose", "language"),
        ("lang-concept", "concept", "concept"),
        ("lang-ml-library", "ml", "library"),
        ("lang", "lang", None),
        ("database", "database", None),
        ("cloud-dev-solution", "cloud", "solution"),
        (None, None, None),
    ],
)
def test_topic_and_type(one, label, topic, kind):
    assert tuple(one(labels.topic_and_type, label)[0]) == (topic, kind)


def test_all_langs(spark):
    df = spark.createDataFrame(
        [('"a,b"', "c"), ('"a"', None), (None, '"c"'), (None, None), ("", "x")], "l string, h string"
    )
    got = [r.o for r in df.select(labels.all_langs(F.col("l"), F.col("h")).alias("o")).collect()]
    assert got == ["a,b,c", '"a"', '"c"', None, ",x"]


def test_list_membership_is_exact(one):
    assert one(lambda c: labels.has_item(c, "java"), '"java,c"', "javascript", "x,java", None) == [
        True, False, True, False,
    ]


def test_recode(one):
    assert one(lambda c: labels.recode(c, {"db": "database", "core": "gp"}), "db", "core", "web", None) == [
        "database", "gp", "web", None,
    ]


PAGE = """
<a href="/web/20160101000000/http://x/feed">1</a> <a class="c" href='/web/2016/http://y'>2</a>
<A HREF=/web/2017/https://z?a=1&amp;b=2>3</A> <a href="/other/">4</a> <a name="top">5</a>
<!-- <a href="/web/1/http://no">c</a> --><script>var s = '<a href="/web/2/http://no">';</script>
<abbr href="/web/3/http://no">n</abbr> <a data-href="/web/4/http://no" href="/elsewhere">6</a>
"""


def test_snapshot_links(one):
    root = "https://web.archive.org/"
    assert one(feeds.snapshot_links, PAGE) == [
        [root + "/web/20160101000000/http://x/feed", root + "/web/2016/http://y", root + "/web/2017/https://z?a=1&b=2"]
    ]


def test_snapshot_id_and_url(one):
    url = "https://web.archive.org/web/20160101/http://stackoverflow.com/jobs/feed"
    assert one(feeds.snapshot_id, url, "https://web.archive.org//web/2016/https://z", "/x") == ["20160101", "2016", None]
    assert one(feeds.snapshot_url, "20160101", url) == [url, url]


def test_ad_keys(spark):
    df = spark.createDataFrame([("t", "p", "u"), ("t", None, "u")], "t string, p string, u string")
    t, p, u = F.col("t"), F.col("p"), F.col("u")
    got = [tuple(r) for r in df.select(feeds.ad_key(t, p), feeds.ad_key(t, p, u)).collect()]
    assert got == [("t___p", "t___p___u"), (None, None)]

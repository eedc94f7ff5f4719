from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from conftest import rows
from tagtide.functions.posts import parse_creation_ts, parse_tag_list, post_id, xml_attr
from tagtide.operators.appearance import explode_tags, parse_posts
from tagtide.operators.vectors import post_tokens


def test_attribute_is_null_when_absent_or_unclosed_and_empty_when_empty(one):
    lines = ('<row Id="7" Title="a &lt; b" />', '<row Id="7" Title="" />', '<row Id="7" />', '<row Title="cut />')
    assert one(lambda c: xml_attr(c, "Title"), *lines) == ["a &lt; b", "", None, None]


def test_attribute_name_needs_a_space_before_it(one):
    line = '<row ParentId="3" Id="4" OwnerId="5" />'
    assert one(lambda c: xml_attr(c, "Id"), line) == ["4"]


def test_first_of_two_equal_attributes_counts(one):
    assert one(lambda c: xml_attr(c, "Id"), '<row Id="1" Id="2" />') == ["1"]


def test_post_id_of_other_text_is_null(one):
    assert one(post_id, '<row Id="12" />', '<row Id="x" />', "<?xml version=1?>") == [12, None, None]


def test_creation_date_needs_a_fraction(one):
    texts = ("2016-10-01T00:00:00.123", "2016-10-01T23:59:59.123456", "2016-1-2T3:4:5.1", "2016-10-01T00:00:00",
             "2016-10-01 00:00:00.1", "2016-13-01T00:00:00.1", None)
    assert one(parse_creation_ts, *texts) == [
        datetime(2016, 10, 1, 0, 0, 0, 123000),
        datetime(2016, 10, 1, 23, 59, 59, 123456),
        datetime(2016, 1, 2, 3, 4, 5, 100000),
        None,
        None,
        None,
        None,
    ]


def test_tag_list_keeps_order_and_special_tags(one):
    texts = ("&lt;c#&gt;&lt;c++&gt;&lt;.net&gt;", "<b><a>", "&lt;x&gt;&lt;y", "", None)
    assert one(parse_tag_list, *texts) == [["c#", "c++", ".net"], ["b", "a"], ["x"], [], None]


def test_only_complete_posts_give_uses(spark):
    lines = [
        '<row Id="1" CreationDate="2016-01-01T00:00:00.000" Tags="&lt;a&gt;&lt;b&gt;" />',
        '<row CreationDate="2016-01-01T00:00:00.000" Tags="&lt;a&gt;" />',
        '<row Id="2" Tags="&lt;a&gt;" />',
        '<row Id="3" CreationDate="2016-01-01T00:00:00.000" />',
        '<row Id="4" CreationDate="2016-01-01T00:00:00.000" Tags="" />',
        "</posts>",
    ]
    uses = explode_tags(parse_posts(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert rows(uses.select("id", "tag")) == [(1, "a"), (1, "b")]


def test_each_line_is_parsed_once(spark):
    """The filters on parsed fields stay above a generator."""
    lines = spark.createDataFrame([("x",)], "value string").filter(F.length("value") > 0)
    posts = parse_posts(lines)
    for df, field in ((explode_tags(posts), "CreationDate"), (post_tokens(posts), "Body")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("Generate") :]
        assert f" {field}=" in below
        assert not [line for line in below.splitlines() if "Filter" in line and f" {field}=" in line]


def test_post_tokens_need_title_and_body(spark):
    lines = [
        '<row Id="1" Title="Run C# fast" Body="in the &lt;b&gt;cloud&lt;/b&gt; 2.5 times" />',
        '<row Id="2" Title="no body" />',
        '<row Id="3" Body="no title" />',
        '<row Title="no id" Body="x" />',
        '<row Id="4" Title="" Body="" />',
    ]
    tokens = post_tokens(parse_posts(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert rows(tokens) == [(1, ["run", "c#", "fast", "b", "cloud", "b", "times"]), (4, [])]

from __future__ import annotations

from datetime import datetime

import pytest

from conftest import rows
from tagtide.operators import categories as C
from tagtide.operators import joins as J
from tagtide.operators import shares as H
from tagtide.plans.adoption import adoption_table, cohort_proportions, first_share_by_category, label_audit


@pytest.fixture(scope="module")
def adoption(spark):
    data = [("a", "SQ-A"), ("b", "A-SQ-C"), ("c", "SV-A"), ("d", "")]
    return spark.createDataFrame(data, "tag_name string, short_adoption_seq string")


def test_start_shares_compare_the_first_character(adoption):
    assert rows(H.start_proportions(adoption)) == [(0.5, 0.25, 0.0, 4)]
    assert rows(H.start_proportions(adoption.filter("false"))) == [(None, None, None, 0)]


def test_ordering_share(adoption):
    assert rows(H.ordering_proportion(adoption, "short_adoption_seq", "SQ", "A")) == [(0.5, 2)]
    assert rows(H.ordering_proportion(adoption, "short_adoption_seq", "C", "GT")) == [(None, 0)]


EARLY = "tag_name string, tag_count bigint, first_use_date timestamp_ntz"


@pytest.fixture(scope="module")
def early(spark):
    data = [
        ("a", 10, datetime(2014, 1, 1)),
        ("b", 20, datetime(2016, 10, 1)),
        ("c", 30, datetime(2018, 1, 1)),
        ("d", 40, None),
    ]
    return spark.createDataFrame(data, EARLY)


def test_popular_is_strictly_above_the_median(early):
    assert rows(H.median_count(early)) == [(25.0,)]
    assert [r.tag_name for r in H.popular_tags(early).orderBy("tag_name").collect()] == ["c", "d"]


def test_cohorts_include_their_cut_off(early):
    members = H.cohort_members(early).select("tag_name", "cohort")
    assert ("b", "after_warmup") in rows(members) and ("b", "half_year_after") not in rows(members)
    assert sorted(c for t, c in rows(members) if t == "d") == ["all"]
    assert len([c for t, c in rows(members) if t == "c"]) == 6


def test_cohort_proportions(adoption, early):
    got = {(r.cohort, r.tags): (r.share_s, r.n_tags) for r in cohort_proportions(adoption, early).collect()}
    assert got[("all", "all")] == (0.5, 4)
    assert got[("all", "popular")] == (0.5, 2)
    assert got[("after_warmup", "all")] == (0.5, 2)
    assert got[("one_year_after", "popular")] == (1.0, 1)


def test_adoption_without_series_and_with_missing_columns(early):
    row = adoption_table(early.filter("tag_name = 'a'")).first().asDict()
    assert row["full_adoption_seq"] == "SQ1" and row["short_adoption_seq"] == "SQ"
    assert len(row) == 17 and row["SQ1_SQ5"] is None


LABELS = "tag_name string, tag_type string, lang_or_platform string, has_api_or_supports string"


@pytest.fixture(scope="module")
def labels(spark):
    data = [
        ("a", "db-library", '"java,c"', "docker"),
        ("a", "db-tool", "java", None),
        ("b", "core-library", None, "java"),
        ("c", "web-language", "c", None),
        ("d", "deprecated", None, None),
        ("d", "ml-concept", None, None),
    ]
    return spark.createDataFrame(data, LABELS)


def test_share_by_topic_counts_a_tag_once(adoption, labels):
    shares = first_share_by_category(adoption, labels, "topic", {"db": "database", "core": "database"}, min_freq=None)
    got = [(r.category, r.n_tags, r.share_s) for r in shares.collect()]
    assert got == [("database", 2, 0.5), ("ml", 1, 0.0), ("web", 1, 1.0)]
    assert shares.filter("n_tags >= 2").count() == first_share_by_category(
        adoption, labels, "topic", {"db": "database", "core": "database"}, min_freq=2
    ).count()


def test_share_by_language_reads_both_lists(adoption, labels):
    got = {r.category: r.n_tags for r in first_share_by_category(adoption, labels, "all_langs", min_freq=None).collect()}
    assert got == {"java": 2, "c": 2, "docker": 1}


def test_top_values_break_ties_by_value(labels):
    topics = C.with_topics(labels)
    assert [tuple(r) for r in C.value_counts(topics, "type").collect()] == [
        ("library", 2), ("concept", 1), ("language", 1), ("tool", 1),
    ]
    assert [r.topic for r in C.top_values(topics, "topic", 2).collect()] == ["db", "core"]


def test_label_audit(labels):
    audit = label_audit(labels)
    assert {r.tag_type: r.lang_or_platform for r in audit["by_type"].collect()}["core-library"] == 0
    assert [r.tag_name for r in audit["unlabelled"].orderBy("tag_name").collect()] == ["b", "d"]
    # The audit counts list entries as they are written, quotes included.
    assert dict(rows(audit["languages"]))["java"] == 2


def test_join_helpers(spark, early):
    listed = spark.createDataFrame([("a",), ("c",), ("a",)], "tag_name string")
    assert [r.tag_name for r in J.keep_listed(early, listed).orderBy("tag_name").collect()] == ["a", "c"]
    assert J.drop_listed(early, listed).count() == 2
    assert rows(J.common_tags(early, listed)) == [("a",), ("c",)]
    recodes = spark.createDataFrame([("a", "x")], "old string, new string")
    assert [r.tag_name for r in J.recode_by_table(early, "tag_name", recodes).orderBy("tag_name").collect()] == [
        "b", "c", "d", "x",
    ]


def test_broadcast_only_below_the_bound(spark, early):
    listed = spark.createDataFrame([("a" * 50,)], "tag_name string")
    assert J.measured_bytes(listed) == 66
    hinted = early.join(J.small_side(listed), "tag_name")._jdf.queryExecution().logical().toString()
    plain = early.join(J.small_side(listed, max_bytes=10), "tag_name")._jdf.queryExecution().logical().toString()
    assert "hint" in hinted.lower() and "hint" not in plain.lower()


def test_cohorts_and_categories_without_tags_are_reported(spark, adoption, early):
    cutoffs = {"late": "2017-01-01", "never": "2999-01-01"}
    got = {(r.cohort, r.tags): r.n_tags for r in cohort_proportions(adoption, early, cutoffs).collect()}
    assert got[("never", "all")] == got[("never", "popular")] == 0 and got[("late", "all")] == 1
    labels = spark.createDataFrame([("a", "x"), ("unknown", "y")], "tag_name string, topic string")
    wanted = spark.createDataFrame([("x",), ("y",), ("z",)], "topic string")
    shares = C.category_first_share(adoption, labels, wanted, "topic")
    assert [(r.category, r.share_s, r.n_tags) for r in shares.collect()] == [("x", 1.0, 1), ("y", None, 0), ("z", None, 0)]
    assert C.category_first_share(adoption, labels, wanted, "topic", min_freq=1).count() == 1

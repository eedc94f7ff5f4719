"""Readers, writers and whole jobs on files."""

from __future__ import annotations

import json

import pytest

from conftest import rows
from tagtide.operators.layout import spread
from tagtide.operators.vectors import train_word_vectors, word_vectors
from tagtide.plans import ads, posts
from tagtide.session import durable
from tagtide.sources import readers, writers


def test_tags_csv(spark, tmp_path):
    text = 'TagName,Excerpt,TagCount\nnull,"a ""quoted"" text, with comma\nand line",5\nnan,,6\nc#,x,7\n'
    (tmp_path / "tags.csv").write_text(text)
    assert rows(readers.read_tags_csv(spark, str(tmp_path))) == [
        ("c#", "x", 7), ("nan", None, 6), ("null", 'a "quoted" text, with comma\nand line', 5),
    ]


def test_label_and_type_csv(spark, tmp_path):
    (tmp_path / "labels.csv").write_text('TagName,TagType,LangOrPlatform,HasAPIOrSupports\nx,web-library,"a,b",\n')
    (tmp_path / "types.csv").write_text("tag,type\nx,api\nx,library\n")
    assert rows(readers.read_tag_labels_csv(spark, str(tmp_path / "labels.csv"))) == [("x", "web-library", "a,b", None)]
    assert rows(readers.read_tag_types_csv(spark, str(tmp_path / "types.csv"))) == [("x", "api"), ("x", "library")]


def test_json_map(spark, tmp_path):
    (tmp_path / "synonyms.json").write_text(json.dumps({"ror": "ruby-on-rails", "js": "javascript"}, indent=1))
    got = readers.read_json_map(spark, str(tmp_path), "synonym", "master")
    assert got.columns == ["synonym", "master"]
    assert rows(got) == [("js", "javascript"), ("ror", "ruby-on-rails")]


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>\nx</p>")
    (tmp_path / "b.html").write_text("y")
    got = readers.read_page_files(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], r.html) for r in got.orderBy("path").collect()] == [
        ("a.html", "<p>\nx</p>"), ("b.html", "y"),
    ]


def test_writers_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "i int, s string")
    for write, read in (
        (writers.write_csv, lambda p: readers.read_csv(spark, p, df.schema)),
        (writers.write_json, lambda p: spark.read.schema(df.schema).json(p)),
        (writers.write_columnar, lambda p: readers.read_series(spark, p)),
    ):
        folder = str(tmp_path / write.__name__)
        write(df.limit(1), folder)
        write(df, folder)
        assert rows(read(folder)) == rows(df)


def test_durable_rows_come_from_the_shared_folder(spark):
    kept = durable(spark.range(5))
    assert rows(kept) == [(i,) for i in range(5)]
    assert spark.conf.get("spark.checkpoint.dir") in kept.inputFiles()[0]


def test_spread_takes_the_number_of_tasks_from_the_caller(spark):
    scan = spark.range(0, 100, 1, 1)
    assert spread(scan, "id", 5).rdd.getNumPartitions() == 5
    assert spread(scan, "id") is scan


POSTS = "\n".join(
    f'  <row Id="{i}" CreationDate="2016-01-0{1 + i % 3}T00:00:00.000" Tags="&lt;java&gt;&lt;t{i % 2}&gt;" '
    f'Title="How to run java {i}" Body="&lt;p&gt;Please run java code &lt;code&gt;int x = {i} ; y ;&lt;/code&gt;" />'
    for i in range(12)
)


def test_first_use_job(spark, tmp_path):
    (tmp_path / "posts.xml").write_text('<?xml version="1.0"?>\n<posts>\n' + POSTS + "\n</posts>\n")
    folder = posts.run_first_use(spark, str(tmp_path / "posts.xml"), str(tmp_path / "out"), n=2)
    got = spark.read.option("header", True).csv(folder)
    assert got.columns == ["creation_ts", "tag"]
    # Four posts at each of three dates: the first two ranks are all at the first date.
    assert got.filter("tag = 'java'").count() == 4


def test_vector_jobs(spark, tmp_path):
    (tmp_path / "posts.xml").write_text(POSTS)
    folder = posts.run_word_embeddings(spark, str(tmp_path / "posts.xml"), str(tmp_path / "out"), dim=4, min_count=5)
    vectors = spark.read.parquet(folder)
    # Titles and bodies without stop words, numbers and code; 'p' is what is left of a tag.
    assert {r.word for r in vectors.collect()} == {"run", "java", "please", "code", "p"}
    posts.run_embedding_matrix(spark, folder, str(tmp_path / "matrix"))
    words = {r.word: r.idx for r in spark.read.json(str(tmp_path / "matrix" / "words_map")).collect()}
    assert words == {"code": 0, "java": 1, "p": 2, "please": 3, "run": 4}
    matrix = spark.read.parquet(str(tmp_path / "matrix" / "vectors_matrix"))
    assert sorted(r.idx for r in matrix.collect()) == [0, 1, 2, 3, 4]
    assert all(len(r.vector) == 4 for r in matrix.collect())


def test_vectors_repeat_and_do_not_outgrow_the_driver(spark):
    tokens = spark.createDataFrame([(["a", "b", "c", "a"],), (["b", "a", "d"],)] * 30, "text array<string>")

    def train():
        model = train_word_vectors(tokens, dim=6, num_partitions=1, min_count=2)
        return sorted((r.word, tuple(r.vector)) for r in word_vectors(model).collect())

    assert train() == train() and len(train()) == 4
    with pytest.raises(ValueError, match="raise min_count"):
        train_word_vectors(tokens, dim=6, max_driver_bytes=100)


def test_a_broken_json_map_fails(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"js": "javascript", "py": "pyth')
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST"):
        readers.read_json_map(spark, str(tmp_path)).collect()


def test_ads_job(spark, tmp_path):
    pages, stored = tmp_path / "pages", str(tmp_path / "snapshots")
    pages.mkdir()
    (pages / "p.html").write_text('<a href="/web/20160101/http://stackoverflow.com/jobs/feed">x</a>')
    feed = "<rss><channel><item><title>T</title><pubDate>P</pubDate></item></channel></rss>"
    spark.createDataFrame(
        [("20160101", feed), ("20170101", feed)], "snapshot_id string, rss string"
    ).write.parquet(stored)
    ads.run_ads(spark, str(pages), stored, str(tmp_path / "out"), save_originals=True)
    found = spark.read.json(str(tmp_path / "out" / "all_ads"))
    assert [(r.ad_key, r.snapshot_id) for r in found.collect()] == [("T___P", "20160101")]
    assert spark.read.json(str(tmp_path / "out" / "jobs_rss_raw")).count() == 1

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tagtide.functions.text import ngram_bag, strip_html
from tagtide.operators import dictionary as D
from tagtide.operators import joins as J
from tagtide.operators import tagging as T
from tagtide.plans.tagging import build_tag_dictionary, tag_entities, tag_mentions
from tagtide.session import durable


@pytest.fixture(scope="module")
def tags(spark):
    data = [
        ("angular2", "text", 50),
        ("ruby-on-rails", "text", 50),
        ("rubyonrails", "text", 50),
        ("ror", "text", 50),
        ("rare", "text", 1),
        ("textless", None, 50),
        ("null", "text", 50),
        ("null", "text", 50),
    ]
    return spark.createDataFrame(data, "tag_name string, excerpt string, tag_count int")


@pytest.fixture(scope="module")
def synonyms(spark):
    data = [("ror", "ruby-on-rails"), ("rails", "ror"), ("old", "rare"), ("angular-2", "null"), ("nil", "null")]
    return spark.createDataFrame(data, "synonym string, master string")


def test_dictionary(tags, synonyms):
    built = build_tag_dictionary(tags, synonyms, min_count=1)
    assert rows(built.names) == [("angular2",), ("null",), ("ruby-on-rails",), ("rubyonrails",)]
    assert dict(rows(built.variants)) == {
        "angular2": "angular2",
        # A tag wins over a synonym, although here the synonym is the exact name.
        "angular-2": "angular2",
        "angular 2": "angular2",
        "null": "null",
        "nil": "null",
        "ror": "ruby-on-rails",
        "ruby-on-rails": "ruby-on-rails",
        "ruby on rails": "ruby-on-rails",
        # An exact name wins over a derived form.
        "rubyonrails": "rubyonrails",
    }
    assert rows(built.lengths) == [(1, 3), (3, 1)]


def test_dictionary_without_filters(tags):
    built = build_tag_dictionary(tags, remove_textless=False)
    assert {"rare", "textless", "ror"} <= {name for (name,) in rows(built.names)}


def test_equal_claims_go_to_the_smallest_tag(spark):
    names = spark.createDataFrame([("b-c-d",), ("bc-d",), ("bcd-",)], "tag_name string")
    assert dict(rows(D.build_variants(names)))["bcd"] == "b-c-d"


def test_stemmed_variants(spark):
    names = spark.createDataFrame([("running-tests",)], "tag_name string")
    stems = spark.createDataFrame([("running", "run"), ("tests", "test")], "token string, stem string")
    assert dict(rows(D.build_variants(names, stems=stems))) == dict.fromkeys(
        ["run-test", "run test", "runtest"], "running-tests"
    )


@pytest.fixture(scope="module")
def variants(spark):
    data = [("c++", "c++"), ("c", "c"), ("ruby on rails", "ruby-on-rails"), ("ruby", "ruby"), ("node.js", "node.js")]
    return spark.createDataFrame(data, "variant string, tag string")


@pytest.fixture(scope="module")
def entities(spark):
    data = [
        (1, "Ruby on Rails, <b>C++</b> and c++; ruby"),
        (2, "nothing here"),
        (3, None),
        (4, "C & node.js"),
    ]
    return spark.createDataFrame(data, "entity_id bigint, summary string")


def test_entity_tags_are_a_bag_in_bag_order(entities, variants):
    got = dict(rows(tag_entities(entities, variants)))
    assert got == {1: ["ruby-on-rails", "ruby", "c++", "c++", "ruby"], 2: [], 3: [], 4: ["c", "node.js"]}


def test_forbidden_tags_go_wherever_they_stand(spark, entities, variants):
    forbidden = spark.createDataFrame([("ruby-on-rails", "ruby"), ("c++", "c"), ("absent", "c")], "tag string, sub_tag string")
    got = dict(rows(tag_entities(entities, variants, forbidden)))
    assert got == {1: ["ruby-on-rails", "c++", "c++"], 2: [], 3: [], 4: ["c", "node.js"]}


def test_forbidden_tags_match_brute_force(spark):
    rng = random.Random(5)
    names = list("abcdef")
    matches = [(e, i, rng.choice(names)) for e in range(40) for i in range(rng.randrange(6))]
    pairs = [("a", "b"), ("b", "c"), ("d", "d"), ("a", "e"), ("x", "f")]
    seen = {e: {t for d, _, t in matches if d == e} for e in range(40)}
    banned = {e: {sub for tag, sub in pairs if tag in seen[e]} for e in seen}
    df = spark.createDataFrame(matches, "entity_id int, pos int, tag string")
    forbidden = spark.createDataFrame(pairs, "tag string, sub_tag string")
    assert rows(T.drop_forbidden(df, forbidden)) == sorted(m for m in matches if m[2] not in banned[m[0]])


def test_longer_ngrams_than_variants_change_nothing(entities, variants):
    named = lambda n: rows(tag_mentions(entities, variants, n=n).drop("pos"))
    assert named(9) == named(3)
    assert {t for _, _, t in rows(tag_mentions(entities, variants, n=1))} == {"c++", "c", "ruby", "node.js"}


def test_places_do_not_depend_on_the_dictionary(spark, entities, variants):
    longer = variants.unionByName(spark.createDataFrame([("a b c d", "abcd")], variants.schema))
    short = variants.filter("variant = 'c'")
    found = rows(tag_mentions(entities, variants))
    assert rows(tag_mentions(entities, longer)) == found
    assert rows(tag_mentions(entities, short)) == [m for m in found if m[2] == "c"] != []


def test_large_dictionary_joins_without_broadcast(entities, variants, monkeypatch):
    small = rows(tag_mentions(entities, variants))
    monkeypatch.setattr(J.small_side, "__defaults__", (0,))
    assert rows(tag_mentions(entities, variants)) == small


def test_dictionary_is_broadcast(entities, variants):
    plan = tag_mentions(entities, variants)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_stem_tokens(spark):
    tokens = spark.createDataFrame([(1, "running"), (1, "fast")], "id int, token string")
    stems = spark.createDataFrame([("running", "run")], "token string, stem string")
    assert rows(T.stem_tokens(tokens, stems)) == [(1, "fast"), (1, "run")]


def test_left_out_sizes_make_no_rows_and_plain_lines_are_not_searched(spark):
    """Places equal those of the whole bag; the rows of sizes above the longest variant are not made at all."""
    data = [(i, t) for i, t in enumerate(["a b c d e", "a", "", None, "x < y\n<p> a > b <i>c</i> >\nq > r < s", "the a the", "<<a b>>"])]
    df = spark.createDataFrame(data, "entity_id int, summary string")
    whole = df.select("entity_id", F.posexplode(ngram_bag(strip_html(F.col("summary")), 4)).alias("pos", "ngram"))
    for longest in (None, 1, 2, 3, 4, 7):
        found = T.entity_ngrams(df, longest=longest)
        kept = whole if longest is None else whole.filter(F.size(F.split("ngram", " ")) <= longest)
        assert rows(found) == rows(kept)
        assert "array_repeat" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r[0] for r in df.orderBy("entity_id").select(strip_html(F.col("summary"))).collect()][4] == "x < y\n  a > b  c  >\nq > r < s"


def test_stored_stems_are_broadcast(spark):
    tokens = spark.range(100).select(F.concat(F.lit("h"), F.when(F.col("id") >= 0, "ot")).alias("token"))
    stems = durable(spark.createDataFrame([("hot", "h"), ("hot", "o")], "token string, stem string"))
    stemmed = T.stem_tokens(tokens, stems)
    assert "BroadcastHashJoin" in stemmed._jdf.queryExecution().executedPlan().toString()
    assert rows(stemmed.groupBy("token").count()) == [("h", 100), ("o", 100)]


def _awkward(spark):
    """Texts with repeated and null ids, null texts, closed words, pairs that overlap, and words that no variant has."""
    rng = random.Random(3)
    words = ["a", "b", "c", "the", "of", "zz", "x-y", "<b>", "&amp;", "d"]
    made = [(rng.choice([None, *range(60)]), " ".join(rng.choices(words, k=rng.randrange(9)))) for _ in range(50)]
    data = [*made, (100, None), (100, "a b"), (101, "b"), (102, ""), (None, None), (103, "a b the c d"), (104, None)]
    entities = spark.createDataFrame(data, "entity_id bigint, summary string")
    named = [("a", "a"), ("a b", "a-b"), ("b", "b"), ("a b", "t"), ("the", "the"), ("b the c d", "long"), ("x-y", "x-y"), ("d", None), (None, "n")]
    pairs = [("a-b", "a"), ("a-b", "b"), ("long", "c"), ("x-y", "x-y"), ("t", None), (None, "a"), ("absent", "a")]
    return entities, spark.createDataFrame(named, "variant string, tag string"), spark.createDataFrame(pairs, "tag string, sub_tag string")


@pytest.fixture
def joined(monkeypatch):
    """Call with the dictionary joined to n-grams, as it is where it is too large for the tasks."""

    def call(function, *args, **kwargs):
        with monkeypatch.context() as m:
            m.setattr(T.shared_lookup, "__defaults__", (-1,))
            return rows(function(*args, **kwargs))

    return call


def _in_order(found):
    """Tags of one place come in any order where a variant has several."""
    return sorted(found, key=repr)


@pytest.mark.parametrize("banned", [False, True])
def test_looking_up_equals_joining(spark, joined, banned):
    entities, named, forbidden = _awkward(spark)
    args, n = (entities, named, forbidden if banned else None), 4 if banned else 3
    mentions, bags = (_in_order(tuple(r) for r in made(*args, n=n).collect()) for made in (tag_mentions, tag_entities))
    assert mentions == _in_order(joined(tag_mentions, *args, n=n)) != []
    assert bags == _in_order(joined(tag_entities, *args, n=n))


def test_tagging_texts_shuffles_nothing(spark, entities, variants):
    """Neither texts nor matches are sorted or shuffled where each entity has one row."""
    forbidden = spark.createDataFrame([("ruby-on-rails", "ruby")], "tag string, sub_tag string")
    for bans in (None, forbidden):
        plan = tag_entities(entities, variants, bans)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Sort", "Window"))


def test_mentions_travel_as_numbers(spark, entities, variants):
    """Texts stay where they are, and counting by entity and tag takes no shuffle but the one of the matches."""
    forbidden = spark.createDataFrame([("ruby-on-rails", "ruby")], "tag string, sub_tag string")
    for bans in (None, forbidden):
        counted = tag_mentions(entities, variants, bans).groupBy("entity_id", "tag").count()
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan and "Window" not in plan
        assert plan.index("Exchange hashpartitioning") < plan.index("MapInArrow")


def test_common_grams_match_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    texts = [[rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(12))] for _ in range(200)] + [None, []]
    counts = {}
    for text in texts:
        pairs = [" ".join(x) for x in zip(text or [], (text or [])[1:])]
        for gram in {*(text or []), *pairs}:
            counts[gram] = counts.get(gram, 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").repartition(3)
    for more_than in (0, 1, 9, 40, 10_000):
        assert rows(T.common_grams(df, more_than)) == sorted((g, n) for g, n in counts.items() if n > more_than)


def test_pairs_are_summed_up_in_lots():
    import numpy as np
    import pyarrow as pa

    from tagtide.functions import grams as G

    codes, seen = G.Codes(1_000_003, 7), {}
    texts = [[f"w{i * i % 31}" for i in range(j, j + 40)] for j in range(30)]
    words = pa.array(sorted({w for t in texts for w in t} - {"w1"}))
    pieces = [G.pairs_of_texts(pa.array(texts[i : i + 8]), words, codes.stride) for i in range(0, 30, 8)]
    before, G.HELD = G.HELD, 50
    try:
        lots = [(int(k), s, n) for piece in G.packed(iter(pieces), codes) for k, s, n in zip(*piece, strict=True)]
    finally:
        G.HELD = before
    assert len({k for k, _, _ in lots}) == 7 < len(lots)
    for lot in {k for k, _, _ in lots}:
        a, b, n = G.unpacked(lot, [s for k, s, _ in lots if k == lot], [c for k, _, c in lots if k == lot], codes)
        seen |= {(words[int(x)].as_py(), words[int(y)].as_py()): int(z) for x, y, z in np.stack([a, b, n], 1)}
    want = {}
    for text in texts:
        for pair in set(zip(text, text[1:])):
            if "w1" not in pair:
                want[pair] = want.get(pair, 0) + 1
    assert seen == want

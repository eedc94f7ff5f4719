from __future__ import annotations

import re
from collections import Counter, defaultdict

from awkward_tables import awkward, documents, empty  # noqa: F401
from tagtide.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_filling(sizes, weights, epochs):
    targets, left, free = {}, sum(sizes.values()), set(sizes)
    while free:
        share = left / sum(weights[s] for s in free)
        full = {s for s in free if share * weights[s] > epochs * sizes[s]}
        if not full:
            return targets | {s: share * weights[s] for s in free}
        targets |= {s: epochs * sizes[s] for s in full}
        left -= sum(epochs * sizes[s] for s in full)
        free -= full
    return targets


def test_targets_and_words_taken(awkward, documents):
    mixed, _ = mixing.mix(awkward)
    got = mixed.collect()
    assert len(got) == len(documents)
    assert Counter((r.id, r.size) for r in got) == Counter((d["doc_id"], len(WORD.findall(d["text"] or ""))) for d in documents)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.repeats
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.repeats <= 3
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = water_filling(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - expected[r.source]) < 1e-6 * max(1, expected[r.source])
    assert all(abs(taken[s] - expected[s]) <= largest[s] for s in sizes)


def test_reruns_and_partitions_agree(awkward):
    def decisions(docs):
        return Counter((r.id, r.draw, r.repeats) for r in mixing.mix(docs)[0].collect())

    assert decisions(awkward) == decisions(awkward.repartition(3))


def test_capped_source(spark):
    rows = [(i, "w " * 10, "small" if i < 2 else "zbig") for i in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_epochs=2.0)[0].collect()
    assert {(r.source, r.target, r.repeats) for r in got if r.source == "small"} == {("small", 40.0, 2)}
    assert {r.target for r in got if r.source == "zbig"} == {560.0}
    assert sum(r.size * r.repeats for r in got if r.source == "zbig") == 560


def test_mix_repeats_rows_with_all_columns(awkward):
    decided = mixing.mix(awkward)[0].groupBy("id").sum("repeats").collect()
    mixed = mixing.mixed_documents(awkward)
    assert mixed.schema == awkward.schema
    found = Counter(r.doc_id for r in mixed.collect())
    assert {r.id: r[1] for r in decided if r[1]} == dict(found)


def test_given_weights_and_empty_table(spark, awkward, empty):
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    got = mixing.mix(awkward, weights, share=0.1)[0].collect()
    assert {r.source for r in got if r.repeats} <= {"a"}
    assert mixing.mix(empty)[0].count() == 0 and mixing.mixed_documents(empty).count() == 0

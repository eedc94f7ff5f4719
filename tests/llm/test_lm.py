from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from awkward_tables import awkward, documents, empty  # noqa: F401
from tagtide.llm import lm

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
def learn():
    return F.crc32(F.col("doc_id").cast("string")) % 7 != 2



def all_segmentations(text, table, singles):
    """Probability of a text as the sum over all its segmentations, by plain recursion."""

    @lru_cache(None)
    def rest(at):
        if at == len(text):
            return 1.0
        total = sum(10 ** table[text[at:end]] * rest(end) for end in range(at + 1, len(text) + 1) if text[at:end] in table)
        if text[at] not in table:
            total += math.prod(10 ** singles[b] for b in text[at].encode()) * rest(at + 1)
        return total

    return rest(0)


def test_lattice_sums_all_segmentations():
    table = {"▁": -1.0, "▁a": -1.5, "a": -0.9, "b": -1.2, "ab": -1.1, "▁ab": -2.0, "ba": -1.3, "aba": -2.2}
    singles = [-3.0] * 256
    for word in ("", "a", "ab", "abab", "abacab", "é", "aéb漢", "b" * 30):
        assert 10 ** lm.lattice(word, table, singles, 3) == pytest.approx(all_segmentations("▁" + word, table, singles))
    assert math.isfinite(lm.lattice("ab" * 5_000, table, singles, 3))


@pytest.mark.parametrize("head", [50_000, 3])
def test_scores(awkward, documents, head):
    scored = lm.score(awkward, MODEL, learn(), head=head)
    got = sorted(tuple(r) for r in scored.select(F.coalesce("doc_id", F.lit(-1)), "training", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    tokens = [(d["doc_id"], bytes(b + 32 if 65 <= b <= 90 else b for b in (d["text"] or "").encode()).split()) for d in documents]
    learns = [key is None or zlib.crc32(str(key).encode()) % 7 != 2 for key, _ in tokens]
    counts: Counter = Counter()
    for (_, words), learnt in zip(tokens, learns):
        if learnt:
            counts.update(words)
            counts["end"] += 1
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: math.log10((counts[t] + 1) / (total + distinct + 1))
    expected = sorted(
        (-1 if key is None else key, learnt, len(words) + 1, sum(counts[t] > 0 for t in [*words, "end"]), total, sum(map(base, [*words, "end"])))
        for (key, words), learnt in zip(tokens, learns)
    )
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [g[5] for g in got] == pytest.approx([e[5] for e in expected])
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)


def test_score_is_the_sum_over_words(spark):
    docs = spark.createDataFrame([(1, "the red fox"), (2, "Red FOX zebra"), (3, None), (4, "red"), (5, "fox"), (6, "the")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in lm.score(docs, MODEL, F.lit(True)).collect()}
    end = score[3]
    assert score[1] == pytest.approx(score[6] + score[4] + score[5] - 2 * end)
    assert score[2] < score[1]


def test_nothing_to_learn_from(awkward, empty):
    rows = lm.score(awkward, MODEL, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in rows} == {(0, 0, 0.0)}
    assert lm.score(empty, MODEL, F.lit(True)).count() == 0

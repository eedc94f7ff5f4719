from __future__ import annotations

from collections import Counter

from awkward_tables import awkward, documents, empty  # noqa: F401
from tagtide.llm import quality


def base(text):
    words = (text or "").encode().split()
    n = len(words)
    spans = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    covered = {i + k for i in range(n - 2) if spans[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    repeats = sum(1 for i, x in enumerate(lines) if x.encode().split() and x in lines[:i])
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(covered)


def test_base_figures(awkward, documents):
    got = Counter(tuple(r)[:7] for r in quality.assess(awkward).collect())
    expected = Counter()
    for d in documents:
        f = base(d["text"])
        expected[(d["doc_id"], *f, f[0] < 50 or 100 * f[4] > 50 * f[0])] += 1
    assert got == expected


def test_order_changes_cost_and_not_verdicts(awkward):
    def verdicts(rules):
        return Counter((r.doc_id, r.kept) for r in quality.assess(awkward, rules).collect())

    assert verdicts(quality.RULES) == verdicts(tuple(reversed(quality.RULES)))


def test_rules_run_by_rejection_per_cost():
    rules = [quality.Rule(n, lambda p: False) for n in ("slow", "useless", "good", "unknown")]
    measured = {"slow": (1.0, 0.5), "useless": (0.001, 0.0), "good": (0.01, 0.3)}
    assert [r.name for r in quality.ordered(rules, measured)] == ["good", "slow", "useless", "unknown"]


def test_later_rules_are_not_run(spark):
    text = " ".join(f"word{i}" for i in range(80))

    def fail(page):
        raise AssertionError("run after a rejection")

    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rules = (quality.Rule("all", lambda p: True), quality.Rule("none", fail))
    assert [r.kept for r in quality.assess(docs, rules, sample_rows=0).collect()] == [False]


def test_junk_goes_and_prose_stays(spark):
    prose = " ".join(f"plain{i} words" for i in range(60))
    rows = [(1, prose), (2, prose.upper().replace(" ", "!! ")), (3, prose.replace(" ", " | ")), (4, prose.replace(" ", "$$$ ")), (5, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in quality.kept_documents(docs).collect()] == [1]


def test_kept_rows_are_whole(awkward, empty):
    kept = quality.kept_documents(awkward)
    assert kept.schema == awkward.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.assess(awkward).where("kept").collect())
    assert quality.assess(empty).count() == 0 and quality.kept_documents(empty).count() == 0

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from awkward_tables import awkward, documents, empty  # noqa: F401
from brute import components, one_edit
from tagtide.llm import automata, lines, similar, simhash, substrings, vectors
from tagtide.llm.common import smallest_reachable


def test_components_of_paths_hubs_and_rings(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(i, 400 + (i - 399) % 30) for i in range(400, 430)]
    edges += [(rnd.randint(500, 700), rnd.randint(500, 700)) for _ in range(90)] + [(900, 900), (-5, 901), (-5, 901)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    assert got == components(near, lambda x, y: y in near[x])
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash


def plain_fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(awkward, documents, empty):
    got = Counter(tuple(r) for r in simhash.near_duplicates(awkward).collect())
    prints = [(d["doc_id"], plain_fingerprint(d["text"])) for d in documents]
    joined = components({f for _, f in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(lambda: None)
    for key, f in prints:
        if key is not None:
            c = joined[f]
            least[c] = key if least[c] is None else min(least[c], key)
    assert got == Counter((key, f"{f:016x}", least[joined[f]]) for key, f in prints)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("most", [simhash.MOST, 8])
def test_links_of_fingerprints(spark, monkeypatch, most):
    """Chains and balls of fingerprints at 0 to 4 bits, also where large groups are cut."""
    monkeypatch.setattr(simhash, "MOST", most)
    rnd = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        at = rnd.getrandbits(64)
        for _ in range(25):
            prints.add(at)
            for bit in rnd.sample(range(64), rnd.randint(0, 3)):
                at ^= 1 << bit
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    found = simhash.links(spark.createDataFrame(signed, "fp long"))
    pairs = {(r.a % (1 << 64), r.b % (1 << 64)) for r in found.collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    assert components(prints, lambda a, b: b in near[a]) == components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(pairs) < 6 * len(prints)


def test_one_of_each_group_stays(awkward, empty):
    kept = simhash.one_of_each_group(awkward)
    assert kept.schema == awkward.schema
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(awkward.where("doc_id IS NOT NULL")).collect()}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {d for d, c in found.items() if d == c}
    assert kept.where("doc_id IS NULL").count() == 2 and simhash.one_of_each_group(empty).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, and a repeated id whose second text belongs to another group."""
    pages = [" ".join(f"{w}{i}" for i in range(40)) for w in ("a", "b", "c")]
    rows = [(1, pages[0]), (1, pages[0]), (1, pages[1]), (0, pages[1]), (5, pages[2]), (5, pages[2]), (6, pages[2]), (None, pages[2])]
    kept = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), nulls=True)
    assert Counter(tuple(r) for r in kept.collect()) == Counter([(1, pages[0]), (0, pages[1]), (5, pages[2])])


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) > 0


@pytest.mark.parametrize("most", [similar.MOST, 4])
def test_planted_near_copies_fall(spark, monkeypatch, most):
    """Copies with some words changed, on both sides of the bound, in chains and in a large group, and repeated rows."""
    monkeypatch.setattr(similar, "MOST", most)
    rnd = random.Random(6)
    rows = [(k, t) for k, t in enumerate([None, "", "one two", "One  two", "one three"])]
    for size in (40, 120, 600):
        for changes in (1, 2, 3, 6, 9, 12, 16):
            words = [f"w{rnd.randint(0, 9_999)}" for _ in range(size)]
            for _ in range(3):
                rows.append((len(rows), " ".join(words)))
                for at in rnd.sample(range(size), changes):
                    words[at] += "x"
    words = [f"v{i}" for i in range(200)]
    for _ in range(30):
        rows.append((len(rows), " ".join("y" if i == rnd.randint(0, 199) else w for i, w in enumerate(words))))
    rows += [rows[9], rows[9], (None, rows[9][1]), (None, "alone without an id")]
    sets = [shingles(t) for _, t in rows]
    joined = components(range(len(rows)), lambda a, b: alike(sets[a], sets[b]))
    best = {}
    for at, c in joined.items():
        place = (rows[at][0] is None, rows[at][0] or 0)
        best[c] = min(best.get(c, (place, at)), (place, at))
    kept = similar.one_of_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(rows[at][0] for _, at in best.values())
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    assert any(alike(sets[a], sets[b]) and (prints[a] ^ prints[b]).bit_count() > 2 for a in range(len(rows)) for b in range(a))


def test_one_of_similar_of_awkward_rows(awkward, empty):
    kept = similar.one_of_similar(awkward)
    assert kept.schema == awkward.schema and similar.one_of_similar(empty).count() == 0


# Embeddings


def embeddings():
    rng = np.random.default_rng(8)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(24)
        for k in range(30):
            v = centre + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.12, 0.2])
            rows.append([len(rows) * 3, v.astype(np.float32).tolist(), c % 3])
    for _ in range(120):
        rows.append([len(rows) * 3, rng.standard_normal(24).astype(np.float32).tolist(), int(rng.integers(3))])
    rows += [[len(rows) * 3, rows[2][1], 0] for _ in range(5)]
    rows += [[5_000, None, 1], [5_001, [0.0] * 24, 1], [5_002, [float("nan")] * 24, 1], [5_003, [1.0, None] * 12, 1]]
    rows += [[5_004, rows[0][1], None], [5_005, [], 1], [5_006, rows[0][1][:12], 0], [5_007, [3 * x for x in rows[0][1]], 0], [None, rows[0][1], 0]]
    rows += [[5_008, [float("inf")] * 24, 0]]
    return rows


@pytest.mark.parametrize("most", [vectors.MOST, 10])
def test_near_vectors(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "MOST", most)
    rows = embeddings()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, code string")
    got = Counter(tuple(r)[:4] for r in vectors.near_vectors(docs, recall=0.999999).collect())

    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not any(v):
            return None
        v = np.array(v, np.float64)
        return v / np.linalg.norm(v)

    units = [unit(r[1]) for r in rows]

    def linked(i, j):
        return (
            i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and rows[i][2] is not None
            and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.98
        )

    joined = components(range(len(rows)), linked)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[joined[i]] = r[0] if least[joined[i]] is None else min(least[joined[i]], r[0])
    expected = Counter(
        (r[0], sum(linked(i, j) for j in range(len(rows))), least[joined[i]], r[0] == least[joined[i]]) for i, r in enumerate(rows)
    )
    assert got == expected
    assert vectors.near_vectors(docs.limit(0)).count() == 0


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    packed, factors = vectors.codes(x, 3)
    made, wide = vectors.estimates(x, packed, factors, 3, 5.0)
    error = made - x @ x.T
    np.fill_diagonal(error, 0)
    assert abs(error.mean()) < 0.005 and (np.abs(error) <= wide).all()


# Substrings


@pytest.mark.parametrize("sizes", [(24 << 20, 8 << 20), (4_000, 1_500)])
def test_substrings(awkward, documents, empty, sizes):
    got = Counter(tuple(r) for r in substrings.remove_repeats(awkward, lot_bytes=sizes[0], step_bytes=sizes[1]).collect())
    order = lambda d: float("inf") if d["doc_id"] is None else d["doc_id"]
    first: dict[tuple, float] = {}
    words = [(d, (d["text"] or "").encode().split()) for d in documents]
    for d, w in words:
        for i in range(len(w) - 12):
            span = tuple(w[i : i + 13])
            first[span] = min(first.get(span, order(d)), order(d))
    expected = Counter()
    for d, w in words:
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < order(d) for k in range(13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected[(d["doc_id"], len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert got == expected
    assert substrings.remove_repeats(empty).count() == 0


def test_automata_find_the_windows_of_smaller_ids():
    rnd = random.Random(12)
    for _ in range(60):
        texts = [[rnd.choice("abc").encode() for _ in range(rnd.randint(0, 30))] for _ in range(8)]
        automaton = automata.SuffixAutomaton()
        for doc, words in enumerate(texts):
            automaton.add(words, doc)
        for doc, words in enumerate(texts):
            smaller = {tuple(t[i : i + 4]) for t in texts[:doc] for i in range(len(t) - 3)}
            expected = [i for i in range(len(words) - 3) if tuple(words[i : i + 4]) in smaller]
            assert automaton.matched(words, doc, 4) == expected


def test_broadcast_shards_agree_with_hashed_windows(spark, awkward, documents):
    small = awkward.where("length(text) < 20000 AND doc_id IS NOT NULL").distinct()
    found = automata.reference_matches(small, small, shard_words=1_000).collect()
    assert len(found) > 5
    starts = {r.doc_id: set(r.starts) for r in found}
    removed = {r.doc_id: r.n_removed for r in substrings.remove_repeats(small).collect()}
    assert {k: len({i + j for i in v for j in range(13)}) for k, v in starts.items()} == {k: n for k, n in removed.items() if n}
    with pytest.raises(ValueError, match="every shard"):
        automata.reference_matches(small, small, max_words=100)


# Lines


def test_variants_meet_exactly_within_one_edit():
    rnd = random.Random(3)
    some = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(120)})
    keys = {x: lines.variants(x) for x in some}
    for a in some:
        for b in some:
            placed = set(keys[a][0].tolist()) & set(keys[b][0].tolist())
            met = bool(placed) or keys[a][1][-1] in keys[b][1][:-1] or keys[b][1][-1] in keys[a][1][:-1]
            assert (met or a == b) == one_edit(a, b)
            if one_edit(a, b):
                assert set(lines.half_keys(a)) & set(lines.half_keys(b))


@pytest.mark.parametrize("min_chars", [0, 16])
def test_line_dedup(spark, awkward, documents, min_chars):
    rnd = random.Random(6)
    stems = ["Copyright 2019 all rights reserved", "see also the other page", "ab", "a", "é", "Straße der Namen 5"]

    def typo(s):
        i = rnd.randint(0, len(s))
        return rnd.choice([s, s[:i] + rnd.choice("xyz ") + s[i:], s[:i] + s[i + 1 :], s[:i] + "q" + s[i + 1 :]])

    pages = [(1_000 + i, "\n".join(typo(rnd.choice(stems)) for _ in range(6))) for i in range(40)]
    docs = awkward.select("doc_id", "text", "n_chars").unionByName(
        spark.createDataFrame([(i, t, len(t)) for i, t in pages], "doc_id long, text string, n_chars long")
    )
    rows = [(d["doc_id"], d["text"]) for d in documents] + pages
    seen: dict[str, tuple] = {}
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            if doc is not None and line.encode().split():
                seen[line] = min(seen.get(line, (doc, no)), (doc, no))
    long = [x for x in seen if len(x) >= min_chars]
    near = {x for x in long if any(abs(len(x) - len(y)) < 2 and seen[y] < seen[x] and one_edit(x, y) for y in long)}
    expected = Counter()
    for doc, text in rows:
        if text is None or doc is None:
            expected[(doc, text)] += 1
            continue
        kept = [x for no, x in enumerate(text.split("\n")) if x not in seen or (x not in near and seen[x] == (doc, no))]
        expected[(doc, "\n".join(kept))] += 1
    done = lines.dedup_lines(docs, min_chars=min_chars)
    assert done.schema == docs.schema
    found = done.collect()
    assert Counter((r.doc_id, r.text) for r in found) == expected
    assert all(r.n_chars == len(r.text) for r in found if r.text is not None and r.doc_id is not None)


def test_line_dedup_keeps_columns(awkward, empty):
    assert lines.dedup_lines(awkward).schema == awkward.schema
    assert lines.dedup_lines(empty).count() == 0
    counted = lines.dedup_lines(awkward.select("doc_id", "text"), counts=True)
    assert counted.columns == ["doc_id", "text", "n_lines", "n_removed"]

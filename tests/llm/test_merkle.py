from __future__ import annotations

import hashlib
import zlib

import pytest
from awkward_tables import awkward, documents, empty  # noqa: F401
from pyspark.sql import functions as F

from tagtide.llm import merkle


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(d, n_chars=None) -> str:
    n = d["n_chars"] if n_chars is None else n_chars
    return H("".join(field(v) for v in (d["doc_id"], d["source"], d["lang"], n, d["text"])))


def tree(nodes):
    """Top and, for each node, its steps (sibling or None, left) to the top."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))  # index of each original node in the current level
    level = list(nodes)
    while len(level) > 1:
        nxt = [H("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        for k, i in enumerate(at):
            sib = i ^ 1
            paths[k].append((level[sib] if sib < len(level) else None, i % 2 == 0))
            at[k] = i // 2
        level = nxt
    return level[0], paths


def climb(h, path):
    for sib, left in path:
        h = H(h) if sib is None else H(h + sib) if left else H(sib + h)
    return h


def brute(docs):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) as the query states them."""
    groups = {}
    for d in docs:
        groups.setdefault(d["lang"], []).append(d)
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, lower = {}, {}
    for g in keys:
        rows = sorted(groups[g], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
        top, paths = tree([leaf(d) for d in rows])
        subs[g] = top
        for d, p in zip(rows, paths):
            lower.setdefault(id(d), p)
    root, upper = tree([subs[g] for g in keys])
    out = []
    for g_i, g in enumerate(keys):
        for d in groups[g]:
            path = lower[id(d)] + upper[g_i]
            n = d["n_chars"]
            bad = n is not None and d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0
            folded = climb(leaf(d, n + 1) if bad else leaf(d), path)
            proof = H("".join(s for s, _ in path if s is not None))
            out.append((d["doc_id"], leaf(d), subs[g], root, proof, folded, folded == root))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def query_rows(df, bits):
    m = merkle.manifest(df, bits=bits)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    bad = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), tampered, F.col("text"))
    proof = F.sha2(F.array_join(F.transform("merkle.path", lambda s: s["sibling"]), ""), 256)
    folded = merkle.fold(bad, F.col("merkle.path"))
    got = m.select("doc_id", "merkle.leaf", "merkle.subroot", "merkle.root", proof, folded, folded == F.col("merkle.root")).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_against_brute_force(awkward, documents, bits):
    """Small blocks make hot groups climb through several rounds of blocks."""
    assert query_rows(awkward, bits) == brute(documents)


def test_groups_of_one_and_one_group(spark):
    rows = [(1, "a", "x", 3, "abc"), (2, "b", "y", None, None), (3, "b", "y", 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = [dict(zip(["doc_id", "source", "lang", "n_chars", "text"], r)) for r in rows]
    assert query_rows(df, 2) == brute(docs)
    one = df.where("lang = 'x'")
    (r,) = merkle.manifest(one).select("merkle.*").collect()
    assert r.leaf == r.subroot == r.root and r.path == []


def test_empty_table_and_clashing_names(spark, empty):
    assert merkle.manifest(empty).count() == 0
    df = spark.createDataFrame([(1, "t", "en", "s", 1, "m", 0, 7)], "doc_id long, text string, lang string, source string, n_chars long, merkle string, g int, pos int")
    out = merkle.manifest(df)
    assert out.columns == df.columns + ["merkle_"]
    assert out.select("merkle", "g", "pos").first() == ("m", 0, 7)


def test_every_tampered_leaf_fails_and_others_verify(awkward, documents):
    got = query_rows(awkward, 3)
    for doc_id, lf, _, root, _, folded, verified in got:
        assert verified == (folded == root)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_paths_travel_as_bytes_and_are_shown_in_hex(spark):
    nodes = spark.range(5).selectExpr("'1en' AS g", "id AS pos", "sha2(cast(id AS string), 256) AS h")
    climbed = merkle._climb(nodes, 2, 2)
    assert climbed.schema["path"].dataType.simpleString() == merkle.PACKED_STEP
    docs = nodes.selectExpr("pos AS doc_id", "'en' AS lang", "h AS leaf")
    made = merkle.manifest(docs, leaf="leaf", bits=2)
    assert made.schema["merkle"].dataType["path"].dataType.simpleString() == merkle.STEP
    for r in made.collect():
        assert all(s.sibling is None or (len(s.sibling) == 64 and s.sibling == s.sibling.lower()) for s in r.merkle.path)

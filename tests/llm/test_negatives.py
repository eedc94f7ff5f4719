from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tagtide.llm import negatives


def brute(rows, anchor_every=50):
    usable = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v is not None
              and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(usable[0][2]) if usable else 0
    table = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * float(x)) for x in v]) for i, l, v in usable if len(v) == dim]
    out = []
    for a_id, a_label, a in table:
        if a_id % anchor_every:
            continue
        scored = sorted(((sum(p * q for p, q in zip(a, v)), i, l) for i, l, v in table if i != a_id), key=lambda t: (-t[0], t[1]))
        for ps, pid, _ in [t for t in scored if t[2] == a_label][:5]:
            window = [t for t in scored if t[2] != a_label and 50 * ps <= 100 * t[0] <= 95 * ps][:3]
            out += [(a_id, pid, r + 1, nid, ps, ns) for r, (ns, nid, _) in enumerate(window)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    prepared = df.where(negatives.usable(F.col("embedding"))).select("vec_id", label.alias("label"), negatives.quantized(F.col("embedding")).alias("vector"))
    return sorted(tuple(r) for r in negatives.hard_negatives(prepared, F.col("vec_id") % 50 == 0, **options).collect())


def table(n, seed=1, dim=8):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(3), [rnd.gauss(0, 0.3) for _ in range(dim)]) for i in range(n)]
    rows[3] = (3, None, rows[3][2])
    rows[4] = (4, 1, None)
    rows[5] = (5, 1, [float("nan")] + rows[5][2][1:])
    rows[6] = (6, 1, [None] + rows[6][2][1:])
    rows[7] = (7, 2, [0.0] * dim)
    rows[100] = (100, 0, [0.0] * dim)  # an anchor without direction
    rows[8] = (8, rows[50][1], list(rows[50][2]))  # ties with an anchor's own vector
    rows.append(rows[9])  # a repeated row
    rows.append((None, 1, rows[10][2]))
    return rows


@pytest.mark.parametrize("options", [{}, {"block_anchors": 2, "part_rows": 60, "chunk": 3, "members": 2}])
def test_against_brute_force(spark, options):
    rows = table(420)
    assert mined(spark, rows, **options) == brute(rows)


def test_coarse_integers_tie_and_still_agree(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(2), [rnd.choice([0.0, 0.01, 0.02]) for _ in range(4)]) for i in range(300)]
    assert mined(spark, rows, block_anchors=3, part_rows=50, chunk=4) == brute(rows)


def test_empty_and_anchorless(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [0.1, 0.2]), (2, 1, [0.2, 0.1])]) == []

"""Hard negatives by shared candidate lists of anchor clusters, after MAXIMUS (Abuzaid et al., 2016).

Anchors are clustered by direction (k-means on unit vectors). For a cluster with centroid c whose
members lie within the angle t of c, no member a scores a row x higher than
``|a| |x| cos(max(0, angle(x, c) - t))``. Each cluster sorts the rows of a part of the table by that
bound once, and every member walks the shared list, computing exact integer scores a chunk at a
time, until the bound of the next row certifies that nothing further can enter its lists.

Two walks: the first finds each anchor's best rows of its own label (positives); the second, with
the positives' scores known, the best rows of other labels inside each positive's score window.
Work is split into (block of anchors, part of rows) cells: every row meets every anchor in
exactly one cell, and local winners are merged by Spark into the global ones. Blocks are whole
runs of anchors in cluster order, so the members of a cluster mostly share one cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.operators.ordering import with_position
from tagtide.session import durable, share_package

#: Slack on the bound, against rounding in the angles.
SLACK = 1e-9

CANDIDATES = "anchor_id long, cand_id long, score long"
WINDOWS = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as double, to longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """A vector without null, NaN or infinite components (null: not usable)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & finite


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, dim), dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _bounds(rows: np.ndarray, centre: np.ndarray, spread: float) -> np.ndarray:
    """Per row, the bound on the score with any unit anchor within ``spread`` of ``centre``."""
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        cos = np.where(norms > 0, rows @ centre / np.where(norms > 0, norms, 1), 1.0)
    gap = np.maximum(0.0, np.arccos(np.clip(cos, -1.0, 1.0)) - spread)
    return norms * np.cos(gap)


def _walk(rows, ids, labels, order, bound, anchor, a_id, a_label, need, chunk):
    """Walk ``order`` for one anchor; ``need`` takes exact scores of a chunk and returns the threshold to beat."""
    a_norm = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
    at = 0
    while at < len(order):
        take = order[at : at + chunk]
        scores = rows[take] @ anchor
        threshold = need(take, scores)
        at += chunk
        if at < len(order) and bound[order[at]] * a_norm * (1 + SLACK) + SLACK < threshold:
            break
        # A walk that goes on is likely to go far: longer chunks, fewer steps of Python.
        chunk = min(2 * chunk, 1 << 14)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -scores))[:k]
    return scores[keep], ids[keep]


def _cells(rows_t: pa.Table, anchors_t: pa.Table, dim: int, positives: int, negatives: int, low: int, high: int, chunk: int, second: bool):
    rows = _matrix(rows_t.column("v"), dim)
    ids = rows_t.column("id").to_numpy()
    labels = rows_t.column("label").to_numpy()
    out = []
    if not len(rows) or not anchors_t.num_rows:
        return out
    clusters = anchors_t.column("cluster").to_numpy()
    a_vecs = _matrix(anchors_t.column("v"), dim)
    centre_col = anchors_t.column("centre").combine_chunks()
    centres = centre_col.flatten().to_numpy(zero_copy_only=False).reshape(anchors_t.num_rows, dim)
    spreads = anchors_t.column("spread").to_numpy()
    a_ids = anchors_t.column("id").to_numpy()
    a_labels = anchors_t.column("label").to_numpy()
    pos_lists = anchors_t.column("positives").to_pylist() if second else None
    for c in np.unique(clusters):
        members = np.flatnonzero(clusters == c)
        first = members[0]
        bound = _bounds(rows, centres[first], float(spreads[first]))
        order = np.argsort(-bound, kind="stable")
        for m in members:
            a_id, a_label, anchor = int(a_ids[m]), int(a_labels[m]), a_vecs[m]
            if not second:
                best = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

                def need(take, scores, best=best, a_id=a_id, a_label=a_label):
                    same = (labels[take] == a_label) & (ids[take] != a_id)
                    s = np.concatenate([best[0], scores[same]])
                    i = np.concatenate([best[1], ids[take][same]])
                    best[0], best[1] = _top(s, i, positives)
                    return best[0][-1] if len(best[0]) == positives else -np.inf

                _walk(rows, ids, labels, order, bound, anchor, a_id, a_label, need, chunk)
                out += [(a_id, int(i), int(s)) for s, i in zip(*best)]
            else:
                wins = [(int(p["id"]), int(p["score"])) for p in pos_lists[m] or []]
                if not wins:
                    continue
                found = {p: [np.zeros(0, np.int64), np.zeros(0, np.int64)] for p, _ in wins}

                def need(take, scores, found=found, wins=wins, a_label=a_label):
                    other = labels[take] != a_label
                    limits = []
                    for p, ps in wins:
                        inside = other & (low * ps <= 100 * scores) & (100 * scores <= high * ps)
                        s = np.concatenate([found[p][0], scores[inside]])
                        i = np.concatenate([found[p][1], ids[take][inside]])
                        found[p][0], found[p][1] = _top(s, i, negatives)
                        if low * ps > high * ps:
                            limits.append(np.inf)  # an empty window needs nothing
                        elif len(found[p][0]) == negatives:
                            limits.append(found[p][0][-1])
                        else:
                            limits.append(low * ps / 100)
                    return min(limits)

                _walk(rows, ids, labels, order, bound, anchor, a_id, a_label, need, chunk)
                ps_of = dict(wins)
                out += [(a_id, p, ps_of[p], int(i), int(s)) for p in found for s, i in zip(*found[p])]
    return out


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    *,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    members: int = 32,
    max_clusters: int = 4096,
    fit_rows: int = 100_000,
    block_anchors: int = 1024,
    part_rows: int = 50_000,
    chunk: int = 256,
    seed: int = 7,
) -> DataFrame:
    """Anchors, their positives and the hard negatives of each (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` hold integer vectors (array<long>) under ``vector``. A row's score is its inner product
    with the anchor; higher first, ties by smaller id. Positives: the first ``positives`` rows of the
    anchor's label with another id. Negatives of a positive with score p: the first ``negatives``
    rows of another label with ``low * p <= 100 * score <= high * p``; rank counts from 1.

    Rows with a null id, label or vector, or a vector of another length than the first usable row's,
    take no part; repeated rows are candidates as often as they occur; an anchor with no positive
    or a window with no row gives no row; an empty table gives none. Clusters are fitted on at most
    ``fit_rows`` anchors (a documented sample; every anchor is assigned and searched), and bound
    only how far walks go, never what they find.
    """
    spark = rows.sparkSession
    share_package(spark)
    base = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), anchors.alias("is_anchor"))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    first = base.select(F.size("v")).first()
    if first is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim = int(first[0])
    table = durable(base.where(F.size("v") == dim))
    n_rows = table.count()
    anchor_rows = table.where("is_anchor").select("id", "label", "v")
    n_anchors = anchor_rows.count()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    k = max(1, min(max_clusters, -(-n_anchors // members), n_anchors))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b))
    unit = F.transform("v", lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
    directed = anchor_rows.withColumn("u", array_to_vector(unit))
    # A zero vector has no direction; it scores 0 with every row, so any cluster bounds it.
    pointed = directed.where(norm > 0)
    flat = directed.where(~(norm > 0)).withColumn("cluster", F.lit(0))
    sample = pointed.where(F.rand(seed) < fit_rows / n_anchors) if n_anchors > fit_rows else pointed
    if sample.limit(2).count() >= 2:
        model = KMeans(k=max(2, k), seed=seed, featuresCol="u", predictionCol="cluster", distanceMeasure="cosine", maxIter=10).fit(sample)
        centres = [c / (np.linalg.norm(c) or 1.0) for c in model.clusterCenters()]
        clustered = model.transform(pointed).unionByName(flat)
    else:
        only = pointed.select("u").first()
        centres = [only.u.toArray() if only else np.zeros(dim)]
        clustered = directed.withColumn("cluster", F.lit(0))
    centre_rows = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    clustered = clustered.join(centre_rows, "cluster")
    cos = F.aggregate(F.zip_with(F.col("centre"), unit, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    angle = F.when(norm > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).otherwise(F.lit(0.0))
    clustered = clustered.withColumn("angle", angle)
    spread = clustered.groupBy("cluster").agg(F.max("angle").alias("spread"))
    placed = with_position(clustered.join(spread, "cluster").select("id", "label", "v", "cluster", "centre", "spread"), ["cluster", "id"], into="p")
    blocked = durable(placed.withColumn("block", ((F.col("p") - 1) / block_anchors).cast("long")).drop("p"))
    n_blocks = -(-n_anchors // block_anchors)
    n_parts = max(1, -(-n_rows // part_rows))
    cells = table.select("id", "label", "v", F.pmod(F.xxhash64("id"), F.lit(n_parts)).alias("part"))
    cells = cells.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def walk(second: bool, schema: str):
        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            found = _cells(left, right, dim, positives, negatives, low, high, chunk, second)
            names = [f.split()[0] for f in schema.split(", ")]
            return pa.table({n: pa.array([r[i] for r in found], pa.int64()) for i, n in enumerate(names)})

        return run

    def spread_anchors(df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))

    first_walk = cells.groupBy("block", "part").cogroup(spread_anchors(blocked).groupBy("block", "part")).applyInArrow(walk(False, CANDIDATES), CANDIDATES)
    ranked = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "cand_id")
    chosen = durable(first_walk.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= positives))
    lists = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("cand_id").alias("id"), "score")).alias("positives"))
    with_lists = blocked.join(lists, blocked["id"] == lists["anchor_id"]).drop("anchor_id")
    second_walk = cells.groupBy("block", "part").cogroup(spread_anchors(with_lists).groupBy("block", "part")).applyInArrow(walk(True, WINDOWS), WINDOWS)
    ranked = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return second_walk.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )

"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.common import WORD
from tagtide.operators.ordering import with_position
from tagtide.session import durable

#: A draw has this many bits; a level of the search for a source's cut reads ``DIGIT`` of them.
DRAW, DIGIT = 50, 10


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, *columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 64 - DRAW)


def cycled_weights(sources: DataFrame, cycle=(5, 2, 1), source: str = "source") -> DataFrame:
    """Weights that repeat over the sources by code point, null last. Numbered in ranges, not in one task."""
    ordered = sources.select(F.col(source).isNull().alias("none"), F.col(source).alias("source"))
    placed = with_position(ordered, ["none", "source"], into="nth")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return placed.select(F.col("source").alias(source), F.get(weights, (F.col("nth") - 1) % len(cycle)).alias("weight"))


def fill(sources: DataFrame, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """Targets of ``sources`` (source, source_size, weight): weights share the size, capped and refilled.

    A source's cap is ``max_epochs`` times its size. Sources above their cap are clamped and the rest
    is shared again by weight until none is above. The level (words per weight) only rises, so a
    round is one sum over the sources and three numbers come back. Where even all caps cannot take
    the share, every source gets its cap. Weights must be positive; a source without words gets 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size").alias("t")).first().t or 0
    level = -1.0
    while True:
        over = cap < F.col("weight") * F.lit(level)
        got = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("clamped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if not got.weight:
            return sources.withColumn("target", cap)
        risen = (share * total - got.clamped) / got.weight
        if risen <= level:
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
        level = risen


def cuts(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """For each source the bound under which draws add up to what it needs, as near as whole rows can.

    ``rows`` has (source, size, draw), ``needs`` (source, need). The bound is found digit by digit: a
    level adds up sizes by digit of the draw, at most 1,024 sums a source, finds the digit in which
    the need is reached and goes on within it, until few rows share it. So the hottest source is
    summed in all tasks and no task sees its rows. Equal draws stay together.
    """
    state = needs.where("need > 0").select("source", "need", F.lit(0).cast("long").alias("prefix"))
    running = Window.partitionBy("source").orderBy("at")
    level = 0
    while True:
        level += 1
        rest = DRAW - DIGIT * level
        inside = rows.join(state, rows.source.eqNullSafe(state.source)).select(state["*"], "size", "draw")
        inside = inside.where(F.shiftright("draw", rest + DIGIT) == F.col("prefix"))
        summed = inside.groupBy("source", "need", F.shiftright("draw", rest).alias("at")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n")
        )
        reached = summed.withColumn("upto", F.sum("words").over(running)).where("upto >= need")
        state = durable(
            reached.groupBy("source").agg(F.min_by(F.struct("at", "n", (F.col("need") - F.col("upto") + F.col("words")).alias("need")), "at").alias("x"))
            .select("source", F.col("x.need").alias("need"), F.col("x.at").alias("prefix"), F.col("x.n").alias("n"))
        )
        if rest == 0 or (state.agg(F.max("n").alias("n")).first().n or 0) <= 2_000:
            break
    inside = rows.join(state, rows.source.eqNullSafe(state.source)).select(state["*"], "size", "draw")
    inside = inside.where(F.shiftright("draw", rest) == F.col("prefix"))
    each = inside.groupBy("source", "need", F.col("draw").alias("at")).agg(F.sum("size").alias("words"))
    each = each.withColumn("upto", F.sum("words").over(running))
    # Before a row or after it, whichever is nearer.
    ends = F.explode(F.array(F.struct(F.col("at").alias("cut"), (F.col("upto") - F.col("words")).alias("sum")), F.struct((F.col("at") + 1).alias("cut"), F.col("upto").alias("sum"))))
    ends = each.select("source", "need", ends.alias("e"))
    return ends.groupBy("source").agg(F.min_by("e.cut", F.struct(F.abs(F.col("e.sum") - F.col("need")), "e.cut")).alias("cut"))


def plan(sized: DataFrame, weights: DataFrame | None = None, *, share: float = 1.0, max_epochs: float = 3.0, cycle=(5, 2, 1)) -> DataFrame:
    """One row per source: size, target, whole repetitions, and the bound of draws that get one more.

    ``sized`` has (source, size, draw) and is read several times: store it. ``weights`` (source,
    weight) replaces the cycle; sources it lacks are left out of the mix.
    """
    sums = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weights = cycled_weights(sums, cycle) if weights is None else weights
    known = sums.join(weights.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    known = durable(known.withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    targets = fill(known.where("weight > 0"), share, max_epochs).unionByName(known.where("weight <= 0").withColumn("target", F.lit(0.0)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = durable(targets.withColumn("whole", F.floor(rate)))
    needs = targets.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"))
    bound = cuts(sized, needs).withColumnRenamed("source", "_s")
    planned = targets.join(bound, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return durable(planned.withColumn("cut", F.coalesce("cut", F.lit(0))))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    seed: int = 17,
    share: float = 1.0,
    max_epochs: float = 3.0,
    cycle=(5, 2, 1),
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Decide how often each document enters the mix: (id, source, size, draw, repeats, ...), and the plan.

    A document is repeated whole as often as its source's target holds the source's size, and once
    more if its keyed draw is under the source's cut, so the words taken are within half a document
    of the target (equal rows, which share a draw, count as one). Only ids and sizes move; decisions
    need the row and its source alone. Null or empty texts have size 0; a null source is a source
    of its own, last in order; repeated rows get equal decisions; no rows give no rows.
    """
    sized = durable(
        docs.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), draw(seed, id, text).alias("draw"))
    )
    planned = plan(sized, weights, share=share, max_epochs=max_epochs, cycle=cycle)
    per_source = planned.select(F.col("source").alias("_s"), "source_size", "target", "whole", "cut")
    joined = sized.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return joined.withColumn("repeats", F.col("whole") + (F.col("draw") < F.col("cut")).cast("long")), planned


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, *, seed: int = 17, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with the same columns."""
    _, planned = mix(docs, weights, seed=seed, id=id, text=text, source=source, **options)
    s, w, c = (f"_mix_{x}_{'_'.join(docs.columns)}" for x in "swc")
    per_source = planned.select(F.col("source").alias(s), F.col("whole").alias(w), F.col("cut").alias(c))
    joined = docs.join(per_source, F.col(source).eqNullSafe(F.col(s)))
    repeats = F.col(w) + (draw(seed, id, text) < F.col(c)).cast("long")
    # Three rows at most unless the caller allows more epochs.
    return joined.withColumn(s, F.explode(F.sequence(F.lit(0), repeats))).where(F.col(s) > 0).select(*docs.columns)

"""Language-model scores: the marginal probability of a text over all segmentations into subwords."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import map_batches, utf8
from tagtide.session import durable

SPACE = "▁"


@lru_cache(2)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def word_counts(docs: DataFrame, *, text: str, training: str) -> DataFrame:
    """(word binary, c): how often each word is found in texts, 0 where only held-out texts have it.

    Words are added up per batch in the tasks and then by Spark, so a frequent word is a row a batch.
    """

    def run(batch):
        learnt: Counter[bytes] = Counter()
        other: set[bytes] = set()
        for raw, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            learnt.update(words(raw)) if train else other.update(words(raw))
        other.difference_update(learnt)
        found, c = [*learnt, *other], [*learnt.values(), *([0] * len(other))]
        for at in range(0, len(found), 50_000):
            yield {"word": found[at : at + 50_000], "c": c[at : at + 50_000]}

    counted = map_batches(docs.select(utf8(text), training), run, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def piece_weights(counted: DataFrame, model: str, ends: int, prior: float = 0.5) -> tuple[dict[str, float], list[float], float, int]:
    """log10 probabilities of the vocabulary's pieces, of single bytes, and of the end; the longest piece.

    The vocabulary is the given one and is not trained. A merge-type file scores pieces by rank, so its
    scores count as a Zipf prior, worth ``prior`` observations a piece, to the counts of pieces in the
    training words as the vocabulary itself segments them. The vocabulary bounds what comes back here.
    """

    def run(batch):
        sp = processor(model)
        total = np.zeros(sp.get_piece_size())
        found = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
        for ids, c in zip(sp.encode(found, num_threads=1), batch.column(1).to_pylist()):
            for i in ids:
                total[i] += c
        used = np.flatnonzero(total)
        return {"piece": used, "n": total[used].astype(np.int64)}

    pieces = map_batches(counted.where("c > 0"), run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = {r.piece: r.n for r in pieces.collect()}
    sp = processor(model)
    size = sp.get_piece_size()
    kinds = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    rank = {i: size if sp.is_byte(i) else min(size, -sp.get_score(i)) for i in kinds}
    zipf = {i: 1.0 / (r + 2.0) for i, r in rank.items()}
    scale = prior * len(kinds) / sum(zipf.values())
    total = sum(counts.get(i, 0) for i in kinds) + prior * len(kinds) + ends + prior
    weight = {i: math.log10((counts.get(i, 0) + scale * zipf[i]) / total) for i in kinds}
    singles = [0.0] * 256
    for i in kinds:
        if sp.is_byte(i):
            singles[int(sp.id_to_piece(i)[3:5], 16)] = weight[i]
    table = {sp.id_to_piece(i): w for i, w in weight.items() if not sp.is_byte(i)}
    return table, singles, math.log10((ends + prior) / total), max(map(len, table))


LN10 = math.log(10)


def lattice(word: str, table: dict[str, float], singles: list[float], longest: int) -> float:
    """log10 of the summed probability of all segmentations of a word with its leading space.

    Forward recursion in log space: the mass that reaches a place is the sum, over all pieces that end
    there, of the mass at the piece's start times its probability. A character without a piece of its
    own is spelled in bytes.
    """
    text = SPACE + word
    get, exp, log = table.get, math.exp, math.log
    mass = [0.0]
    for end in range(1, len(text) + 1):
        best, terms = -math.inf, []
        for start in range(end - longest if end > longest else 0, end):
            weight = get(text[start:end])
            if weight is not None:
                weight += mass[start]
                terms.append(weight)
                if weight > best:
                    best = weight
        if text[end - 1] not in table:
            weight = mass[end - 1] + sum(singles[b] for b in text[end - 1].encode("utf-8", "surrogatepass"))
            terms.append(weight)
            best = max(best, weight)
        mass.append(best if len(terms) == 1 else best + log(sum([exp((t - best) * LN10) for t in terms])) / LN10)
    return mass[-1]


def score(
    docs: DataFrame,
    model: str,
    training,
    *,
    id: str = "doc_id",
    text: str = "text",
    head: int = 50_000,
) -> DataFrame:
    """Score whole texts: (id, training, n_tokens, n_known, train_tokens, base_score, score), log10.

    ``training`` is a Column: the rows to learn from. Tokens are words with A-Z in lower case, then one end. ``base_score`` is an
    add-one word model, ``score`` the subword lattice. Each distinct word is weighed once. The ``head``
    most frequent words go to all tasks, their number being fixed; all others meet their documents in
    a join, where no key is frequent. A null or empty text is its end alone; repeated rows get equal
    scores; without training rows all counts are 0; no rows give no rows.
    """
    flagged = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(training, F.lit(True)).alias("training"))
    counted = durable(word_counts(flagged, text="text", training="training"))
    ends = flagged.where("training").count()
    sums = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = (sums.n or 0) + ends, sums.v + (1 if ends else 0)
    table, singles, end_weight, longest = piece_weights(counted, model, ends)
    vocabulary = docs.sparkSession.sparkContext.broadcast((table, singles, longest))
    under = total + distinct + 1

    def weigh(batch):
        pieces, bytes_, most = vocabulary.value
        return {
            "word": batch.column(0),
            "c": batch.column(1),
            "weight": [lattice(w.decode("utf-8", "replace"), pieces, bytes_, most) for w in batch.column(0).to_pylist()],
        }

    weighed = durable(map_batches(counted, weigh, "word binary, c long, weight double"))
    top = weighed.orderBy(F.desc("c"), "word").limit(head).collect()
    frequent = docs.sparkSession.sparkContext.broadcast(
        {bytes(r.word): (math.log10((r.c + 1) / under), r.weight, r.c > 0) for r in top}
    )

    def first(batch):
        known_words = frequent.value
        task = TaskContext.get()
        serial = first_row.setdefault(task.taskAttemptId(), 0)
        n = batch.num_rows
        first_row[task.taskAttemptId()] = serial + n
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base": [], "weight": []}
        offsets, rare, times = [0], [], []
        for raw in batch.column(1).to_pylist():
            tokens = words(raw)
            base = weight = 0.0
            known = 0
            for word, c in Counter(tokens).items():
                hit = known_words.get(word)
                if hit is None:
                    rare.append(word)
                    times.append(c)
                else:
                    base += c * hit[0]
                    weight += c * hit[1]
                    known += c * hit[2]
            offsets.append(len(rare))
            for column, value in zip(out.values(), (len(tokens), known, base, weight)):
                column.append(value)
        entries = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], ["word", "n"])
        return out | {
            "row": [(task.partitionId() << 36) + serial + i for i in range(n)],
            "id": batch.column(0),
            "training": batch.column(2),
            "rare": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries),
        }

    first_row: dict[int, int] = {}
    kind = docs.schema[id].dataType.simpleString()
    schema = f"row long, id {kind}, training boolean, n_tokens long, n_known long, base double, weight double, rare array<struct<word: binary, n: int>>"
    rows = durable(map_batches(flagged.select("id", utf8("text"), "training"), first, schema))
    spread = rows.select("row", F.inline("rare")).join(weighed, "word")
    term = F.log10((F.col("c") + 1) / F.lit(under))
    rest = spread.groupBy("row").agg(
        F.sum(F.col("n") * term).alias("b"), F.sum(F.col("n") * F.col("weight")).alias("w"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k")
    )
    joined = rows.drop("rare").join(rest, "row", "left")
    zero = F.lit(0.0)
    end_base = math.log10((ends + 1) / under)
    return joined.select(
        F.col("id").alias(id),
        "training",
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("k", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero) + end_base).alias("base_score"),
        (joined["weight"] + F.coalesce("w", zero) + end_weight).alias("score"),
    )

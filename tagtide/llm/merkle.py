"""Merkle manifests of tables, with every level of an aligned block held as one string of hex digests.

Leaves are numbered within their group by a distributed ranking; aligned blocks of ``2**bits``
consecutive leaves become one row whose level string is the concatenation of the leaves' digests.
Parents are the SHA-256 of fixed-width substrings (two digests, or one where a level ends on an odd
node), so a block climbs its levels inside one row with built-in string functions. Block roots are
the next level's leaves, and the recursion ends when each group has one node: its subroot. Subroots,
ordered by group, climb once more to the root. The sibling of a node is the flanking substring of
its pair; a row's proof is its siblings from leaf to root.

Digests are lowercase hex; a parent is ``sha256(left || right)`` of the hex texts, a lone last node
of a level becomes ``sha256(node)``, and a group with a single leaf has that leaf as its subroot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import free_name
from tagtide.operators.ordering import with_position
from tagtide.session import durable

#: Width of a digest in hex.
WIDTH = 64

#: Steps of a proof: the sibling's digest (null where the node stood alone) and whether the node was on the left.
STEP = "array<struct<sibling:string,left:boolean>>"

#: The same while paths travel: 32 bytes a digest, half of its hex digits, since paths are most of what is shuffled.
PACKED_STEP = "array<struct<sibling:binary,left:boolean>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count of the value's text, ``:``, and the text (integers in decimal)."""
    shown = value.cast("string")
    return F.when(shown.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (lowercase hex) of the fields of a row, each encoded by :func:`field`, concatenated."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _parents(level: Column) -> Column:
    """The next level of a level (bytes of hex): the digest of each fixed-width pair, or of a lone last node.

    Levels are bytes, not text, so that a substring is found by its offset and not by counting characters.
    """
    pairs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (2 * WIDTH)).cast("int") - 1)
    return F.array_join(F.transform(pairs, lambda i: F.sha2(F.substring(level, i * (2 * WIDTH) + 1, 2 * WIDTH), 256)), "").cast("binary")


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names, where a null group matches a null group."""
    l, r = left.alias("l"), right.alias("r")
    cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    return l.join(r, cond, how).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in on])


def _climb(nodes: DataFrame, bits: int, rounds: int) -> DataFrame:
    """Climb ``nodes`` (g, pos from 0, h) to the top of each group: (g, pos, top, path) for every node.

    Paths are packed (:data:`PACKED_STEP`). A group of n nodes climbs ceil(log2 n) levels; ``rounds`` is how often its nodes are cut into
    aligned blocks of ``2**bits`` before one block is left (one more than the largest group needs is harmless).
    """
    size = 1 << bits
    counts = nodes.groupBy("g").agg(F.count("*").alias("n"))
    local = F.col("pos").bitwiseAND(size - 1)
    blocks = (
        nodes.groupBy("g", F.shiftright("pos", bits).alias("b"))
        .agg(F.sort_array(F.collect_list(F.struct(local.alias("i"), "h"))).alias("nodes"))
        .transform(lambda b: _join(b, counts, ["g"]))
        # Levels this block climbs: all of its bits where the group has more blocks, else until one node is left.
        .withColumn("levels", F.when(F.col("n") > size, F.lit(bits)).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0))
        .select("g", "b", "n", "levels", F.array_join(F.transform("nodes", lambda x: x["h"]), "").cast("binary").alias("lv0"))
    )
    for j in range(bits):
        blocks = blocks.withColumn(f"lv{j + 1}", F.when(F.col("levels") > j, _parents(F.col(f"lv{j}"))).otherwise(F.col(f"lv{j}")))
    steps = F.expr(
        f"""transform(sequence(0, octet_length(element_at(lvs, 1)) div {WIDTH} - 1), i -> struct(
              i,
              transform(slice(sequence(0, levels), 1, levels), j -> named_struct(
                'sibling', CASE WHEN (shiftright(i, j) ^ 1) < octet_length(element_at(lvs, j + 1)) div {WIDTH}
                           THEN unhex(CAST(substring(element_at(lvs, j + 1), (shiftright(i, j) ^ 1) * {WIDTH} + 1, {WIDTH}) AS STRING)) END,
                'left', shiftright(i, j) % 2 = 0)) AS steps))"""
    )
    # Written once: both the tops and the steps of the nodes read the levels.
    blocks = durable(blocks.select("g", "b", "n", "levels", F.array(*[F.col(f"lv{j}") for j in range(bits + 1)]).alias("lvs")))
    tops = blocks.select("g", "b", "n", F.element_at("lvs", F.col("levels") + 1).cast("string").alias("top"))
    in_block = blocks.select("g", "b", F.explode(steps).alias("node")).select(
        "g", (F.col("b") * size + F.col("node.i")).alias("pos"), "b", F.col("node.steps").alias("steps")
    )
    if rounds <= 1:
        upper = tops.select("g", "b", "top", F.lit(None).cast(PACKED_STEP).alias("path"))
    else:
        above = _climb(tops.where(F.col("n") > size).select("g", F.col("b").alias("pos"), F.col("top").alias("h")), bits, rounds - 1)
        upper = _join(tops, above.withColumnRenamed("pos", "b").withColumnRenamed("top", "over"), ["g", "b"], "left").select(
            "g", "b", F.coalesce("over", "top").alias("top"), "path"
        )
    return _join(in_block, upper, ["g", "b"]).select(
        "g", "pos", "top", F.concat("steps", F.coalesce("path", F.array().cast(PACKED_STEP))).alias("path")
    )


def _rounds(nodes: DataFrame, bits: int) -> int:
    """How often the largest group is cut into blocks before one block is left (one number to the driver)."""
    largest = nodes.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    rounds = 1
    while largest > (1 << bits):
        largest = -(-largest // (1 << bits))
        rounds += 1
    return rounds


def _shown(path: Column) -> Column:
    """A packed path with its digests in hex (:data:`STEP`)."""
    return F.transform(path, lambda s: F.struct(F.lower(F.hex(s["sibling"])).alias("sibling"), s["left"].alias("left")))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives when climbed with the siblings of ``path``."""
    return F.aggregate(
        path,
        leaf,
        lambda acc, s: F.when(s["sibling"].isNull(), F.sha2(acc, 256))
        .when(s["left"], F.sha2(F.concat(acc, s["sibling"]), 256))
        .otherwise(F.sha2(F.concat(s["sibling"], acc), 256)),
    )


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    order: str = "doc_id",
    bits: int = 10,
    into: str = "merkle",
    leaf: str | None = None,
) -> DataFrame:
    """``docs`` with a struct column ``into`` (a free name) of leaf, subroot, root and path.

    - leaf: :func:`leaf_digest` of ``fields``; subroot: the top of the row's ``group``, whose leaves
      ascend by ``order`` (nulls first), equal orders by leaf, then by a hash of the whole row;
      root: the top of the subroots, ordered by ``group`` as text (null first, UTF-8 bytewise).
    - path: the steps from leaf to root (:data:`STEP`); :func:`fold` of leaf and path gives the root.
    - A null group is a group; a group of one row has its leaf as subroot; one group gives
      root = subroot; an empty table gives no rows. Rows equal in every column are interchangeable.
      Extra columns are kept; ``into`` is renamed until it clashes with none.
    - ``leaf`` names a column of ready leaf digests instead: then ``fields`` are not read, and a
      caller that hashes its rows in the scan moves 64 hex digits a row instead of its texts.
    - Blocks hold ``2**bits`` leaves (64 * 2**bits hex digits), so a hot group is split into many
      blocks; the driver receives one count to know how many rounds of blocks to plan.
    """
    out = free_name(docs, into)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    leaves = docs.select(
        F.struct(*columns).alias("doc"),
        # The group as text that is never null, and sorts as the group does (null first, then UTF-8 bytewise).
        F.when(F.col(f"`{group}`").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string"))).alias("g"),
        (F.col(f"`{leaf}`") if leaf else leaf_digest(*[F.col(f"`{c}`") for c in fields])).alias("h"),
        F.col(f"`{order}`").alias("o"),
        F.xxhash64(*columns).alias("x"),
    )
    placed = with_position(leaves, ["o", "h", "x"], keys=["g"], into="pos").withColumn("pos", F.col("pos") - 1)
    nodes = placed.select("g", "pos", "h")
    inner = _climb(nodes, bits, _rounds(nodes, bits))
    subroots = inner.where(F.col("pos") == 0).select(F.col("g").alias("key"), F.col("top").alias("h"))
    top_nodes = with_position(subroots.withColumn("g", F.lit(0)), ["key"], keys=["g"], into="pos").withColumn("pos", F.col("pos") - 1)
    outer = _climb(top_nodes.select("g", "pos", "h"), bits, _rounds(top_nodes, bits))
    per_group = top_nodes.join(outer, ["g", "pos"]).select(
        F.col("key"), F.col("h").alias("subroot"), F.col("top").alias("root"), F.col("path").alias("upper")
    )
    climbed = _join(placed, inner.select("g", "pos", F.col("path").alias("lower")), ["g", "pos"])
    climbed = climbed.join(per_group, climbed["g"] == per_group["key"])
    result = F.struct(F.col("h").alias("leaf"), "subroot", "root", _shown(F.concat("lower", "upper")).alias("path"))
    return climbed.select("doc.*", result.alias(out))

"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.catalogue.registry import table
from tagtide.llm import lines, lm, merkle, mixing, negatives, oracles, packing, pieces, quality, secrets, simhash, substrings, tokencount, vectors
from tagtide.llm.registry import QUERIES, query

__all__ = ["QUERIES"]

TOKENIZERS = "/opt/tokenizers"


RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


@query()
def op1_edited_token_counts(spark, sf_dir):
    """Token counts of all texts before and after three edits each, placed by a hash of the id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    state = tokencount.count_tokens(docs, RANKS).withColumn("n_before", F.col("n_tokens"))
    chars = F.coalesce(F.length("text"), F.lit(0))
    place = [F.pmod(F.xxhash64(F.lit(k), "doc_id"), chars + 1).cast("int") for k in range(3)]

    def edit(start, removed, added):
        return F.struct(start.alias("start"), F.lit(removed).alias("removed"), added.alias("added"))

    edits = F.array(
        edit(place[0], 12, F.concat_ws("", F.lit(" ("), "source", F.lit(")"))),
        edit(place[1], 0, F.upper(F.substring("text", 1, 20))),
        edit(place[2], 40, F.lit("")),
    )
    done = tokencount.apply_edits(state.withColumn("edits", edits), RANKS)
    return done.select("doc_id", "n_before", "n_tokens", F.size("pre_tokens").alias("n_pre_tokens"), "n_encoded", F.xxhash64("text").alias("text_hash"))


@query(oracles.NEAR_VECTORS)
def op2_rotated_codes(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op3_mix_sources(spark, sf_dir):
    """Which documents the mix takes, and how many of their words."""
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("repeats")).alias("taken")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken, "repeats", "source")


@query(oracles.QUALITY)
def op4_quality_cascade(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents"))


@query()
def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(oracles.SUBSTRINGS)
def op6_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query()
def op7_packed_ids(spark, sf_dir):
    """Packed rows of all texts; matrix and positions are shown by their digests."""
    packed = packing.pack(table(spark, sf_dir, "documents"), RANKS)
    return packed.select(
        "lot", "step", "row", "used", "doc_ids", "parts", "lengths", F.xxhash64("ids").alias("ids_hash"), F.xxhash64("positions").alias("positions_hash")
    )


@query()
def op8_lattice_scores(spark, sf_dir):
    """Scores from the documents whose hash is not held out."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    scored = lm.score(table(spark, sf_dir, "documents"), PIECES, learn)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op9_merge_dropout(spark, sf_dir):
    """Pieces of whole texts, shown by their number and digest, and whether they decode to the text."""
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents"), PIECES)
    return encoded.select("doc_id", "n_pieces", "text_chars", F.xxhash64("pieces").alias("pieces_hash"), "lossless")


@query()
def op10_line_dedup(spark, sf_dir):
    """Texts without equal and near-equal later lines, shown by their numbers and digest."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(oracles.MERKLE)
def op13_merkle_manifest(spark, sf_dir):
    """The manifest of all documents by language, and roots folded again from leaves where a seventh of the lengths are tampered.

    Both leaves are hashed in the scan, so only digests move through the climb.
    """
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    leaves = docs.select(
        "doc_id", "lang",
        merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"),
        merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), tampered, F.col("text")).alias("bad_leaf"),
    )
    made = merkle.manifest(leaves, leaf="leaf")
    folded = merkle.fold(F.col("bad_leaf"), F.col("merkle.path"))
    proof = F.sha2(F.array_join(F.transform("merkle.path", lambda s: s["sibling"]), ""), 256)
    return made.select(
        "doc_id", "merkle.leaf", "merkle.subroot", "merkle.root", proof.alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("merkle.root")).alias("verified"),
    )


@query(oracles.SECRETS)
def op11_secret_scan(spark, sf_dir):
    """Spans of all rules in all whole texts; counts and digest of the three base rules."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )


@query(oracles.NEGATIVES)
def op12_hard_negatives(spark, sf_dir):
    """Three hard negatives for each of five positives of every fiftieth vector, labels of every seventh shifted."""
    emb = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = emb.where(negatives.usable(F.col("embedding"))).select("vec_id", label.alias("label"), negatives.quantized(F.col("embedding")).alias("vector"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)

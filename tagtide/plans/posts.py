"""Jobs over the post dump: first uses, weekly counts and word vectors."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tagtide.operators.appearance import earliest_n, explode_tags, parse_posts
from tagtide.operators.vectors import post_tokens, train_word_vectors, word_index, word_vectors
from tagtide.sources.readers import read_post_lines, read_series
from tagtide.sources.writers import write_columnar, write_csv, write_json


def first_use(lines: DataFrame, n: int = 1) -> DataFrame:
    """``(creation_ts, tag)`` of the ``n`` earliest uses of each tag, ties included."""
    return earliest_n(explode_tags(parse_posts(lines)), n)


def run_first_use(spark: SparkSession, posts: str, output: str, n: int = 1) -> str:
    folder = f"{output}/tag_{n}_earliest_appearance"
    write_csv(first_use(read_post_lines(spark, posts), n), folder)
    return folder


def word_embeddings(lines: DataFrame, dim: int = 200, **params) -> DataFrame:
    """``(word, vector)`` of the cleaned titles and bodies."""
    tokens = post_tokens(parse_posts(lines).select("id", "title", "body"))
    return word_vectors(train_word_vectors(tokens, dim, **params))


def run_word_embeddings(spark: SparkSession, posts: str, output: str, dim: int = 200, **params) -> str:
    folder = f"{output}/word_vectors"
    write_columnar(word_embeddings(read_post_lines(spark, posts), dim, **params), folder)
    return folder


class EmbeddingMatrix(NamedTuple):
    words: DataFrame
    matrix: DataFrame


def embedding_matrix(vectors: DataFrame) -> EmbeddingMatrix:
    """``(word, idx)`` and ``(idx, vector)``."""
    rows = word_index(vectors)
    return EmbeddingMatrix(rows.select("word", "idx"), rows.select("idx", "vector"))


def run_embedding_matrix(spark: SparkSession, vectors: str, output: str) -> None:
    # Both outputs come from one stored numbering.
    write_columnar(word_index(read_series(spark, vectors)), f"{output}/word_index")
    rows = read_series(spark, f"{output}/word_index")
    write_json(rows.select("word", "idx"), f"{output}/words_map")
    write_columnar(rows.select("idx", "vector"), f"{output}/vectors_matrix")

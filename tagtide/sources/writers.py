"""Outputs, written by the executors and replacing what an earlier run left."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(folder)


def write_columnar(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").parquet(folder)

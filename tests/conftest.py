from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent / "llm"))

from tagtide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tagtide-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a Column function on texts: ``one(fn, "a", None)`` gives the list of results."""
    from pyspark.sql import functions as F

    def run(function, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r.out for r in rows.select("i", function(F.col("t")).alias("out")).orderBy("i").collect()]

    return run


def ordered(tuples):
    """Sorted, nulls last."""
    return sorted(tuples, key=lambda row: [(value is None, 0 if value is None else value) for value in row])


def rows(df):
    """Rows as a sorted list of tuples."""
    return ordered(tuple(r) for r in df.collect())

"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Dates are compared as written, so no session zone may shift them.
    "spark.sql.session.timeZone": "UTC",
    # Partition counts, skewed joins and small join sides are settled at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Recording a call site per expression takes half of the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def build_session(app_name: str = "tagtide", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder where the driver has it.

    Needed on one machine only; on a cluster the package is installed with the executors.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in (*known, root) if p])


def for_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, and send them batches of ``BATCH`` bytes, unless the session says otherwise.

    Both sides of a worker hold whole batches, of 64 MB unless this is set.
    """
    share_package(spark)
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one for a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tagtide-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Rows that are read several times are computed once, and a lost executor costs a re-read and
    not a re-run.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tagtide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

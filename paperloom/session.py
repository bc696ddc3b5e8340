"""Helpers around the Spark session that more than one operator needs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the cluster's shared folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary folder; on a cluster that would not survive.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="paperloom-")
    context.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there.

    Used where a result feeds several jobs: it is computed once, and the loss
    of an executor costs a re-read, not a recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cores(spark: SparkSession) -> int:
    """Task slots, at least two."""
    return max(2, spark.sparkContext.defaultParallelism or os.cpu_count() or 2)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context.

    Spark's own file server hands the archive to the executors, new ones
    included, so no folder on them need hold the package.
    """
    context = spark.sparkContext
    if getattr(context, "_paperloom_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="paperloom-")) / "paperloom-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    context.addPyFile(str(archive))
    context._paperloom_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Rows over all slots, if they come in fewer tasks: for work that costs far more than moving its input."""
    slots = cores(df.sparkSession)
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df

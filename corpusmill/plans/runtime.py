"""Session helpers that every iterative or Python-backed job shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
BATCH_BYTES = 32 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir.

    Where it is unset a session on this machine alone (local master, as in tests) gets a fresh folder; on a cluster, where
    executors could not read such a folder, this raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def opaque(df: DataFrame) -> DataFrame:
    """A checkpoint whose columns come out of a generator, so that the optimiser knows nothing of how they were computed.

    What it infers of computed columns is kept through checkpoints and, in a loop of joins with the same table, grows with
    every round until the driver is full.
    """
    return checkpoint(df.select(F.inline(F.array(F.struct(*df.columns)))))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this job wrote, in whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the Arrow batch size, in rows and in bytes, so that a batch of very long texts fits in a Python worker.

    The session keeps the lower bounds: plans are built lazily and would miss a bound that is put back.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:  # a size with a unit is set anew
            spark.conf.set(key, str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df does not use in any case: the wanted ones, or these with underscores after them."""
    used, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out

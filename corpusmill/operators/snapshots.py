"""Tables that are written, kept and checked: appends that a repeated batch does not double, staged exports, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.runtime import delete


def append_batch(batch: DataFrame, number: int, path: str) -> None:
    """Write a micro-batch into its own partition of a table; the same batch again replaces what it wrote before.

    Streams call it with the number that Spark gives a batch, so that a restart between write and commit doubles nothing.
    """
    rows = batch.withColumn("batch_", F.lit(number))
    rows.write.partitionBy("batch_").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def appended(spark: SparkSession, path: str) -> DataFrame:
    """All rows that batches have appended."""
    return spark.read.parquet(path).drop("batch_")


def swap_in(rows: DataFrame, path: str, form: str = "json") -> None:
    """Write rows beside a path and rename them into place, so that a reader sees the old export or the new one, whole."""
    spark = rows.sparkSession
    staged, old = f"{path}.staged", f"{path}.old"
    writer = rows.write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(staged)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    delete(spark, old)
    if fs.exists(jvm_path(path)):
        fs.rename(jvm_path(path), jvm_path(old))
    if not fs.rename(jvm_path(staged), jvm_path(path)):
        raise OSError(f"cannot move {staged} to {path}")
    delete(spark, old)


def manifest(rows: DataFrame, part: str) -> DataFrame:
    """(part, n, checksum) of every part of a table: rows, and a sum of row digests that does not depend on their order.

    A row's digest covers all columns, each by its text with a mark for null; repeated rows count each time. A null part is a part.
    """
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("~"))
    digest = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.concat(F.lit(c), text(c)) for c in sorted(rows.columns)])), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(F.col(f"`{part}`").cast("string").alias("part")).agg(F.count("*").alias("n"), F.sum(digest).cast("decimal(38,0)").alias("checksum"))


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(part, status, n_expected, n_found) of two manifests: same, changed, rows (another number of them), missing or added."""
    a = expected.select(F.col("part").alias("p"), F.col("n").alias("n_expected"), F.col("checksum").alias("c"), F.lit(1).alias("in_a"))
    b = found.select("part", F.col("n").alias("n_found"), "checksum", F.lit(1).alias("in_b"))
    both = a.join(b, F.col("p").eqNullSafe(F.col("part")), "full_outer")
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "added").when(F.col("n_expected") != F.col("n_found"), "rows").when(F.col("c") != F.col("checksum"), "changed").otherwise("same")
    return both.select(F.coalesce("part", "p").alias("part"), status.alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_expected", "n_found")])

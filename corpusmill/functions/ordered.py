"""Global order without a single task: prefix sums, ranks and neighbours over range partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.runtime import checkpoint, shuffle_partitions


def bucket_of(value: Column, bounds: list) -> Column:
    """Number of sorted bounds that are at most value, by a two-level search; a null value has 0."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    coarse, fine = F.array(*map(F.lit, bounds[::step])), F.array(*map(F.lit, bounds))
    base = F.greatest(F.size(F.filter(coarse, lambda b: b <= value)) - 1, F.lit(0)) * step
    return F.coalesce(base + F.size(F.filter(F.slice(fine, base + 1, F.lit(step)), lambda b: b <= value)), F.lit(0))


def quantile_bounds(df: DataFrame, column: str, buckets: int) -> list:
    """At most buckets - 1 distinct cut points of a numeric column, from an approximate percentile sketch."""
    cuts = [k / buckets for k in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, cuts, 10 * max(1000, buckets)).alias("b")).first()["b"] if cuts else None
    return sorted(set(found or []))


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add, under each name of sums, the sum over all rows before this one in the order (0 for the first).

    Rows are range partitioned and checkpointed; only one row per partition meets in one place.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = df.withColumns({f"v_{k}": c for k, c in sums.items()}).repartitionByRange(n, *order)
    ranged = checkpoint(ranged.withColumn("pid_", F.spark_partition_id()))
    totals = ranged.groupBy("pid_").agg(*[F.sum(f"v_{k}").alias(f"t_{k}") for k in sums])
    before = Window.partitionBy(F.lit(0)).orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("pid_", *[F.coalesce(F.sum(f"t_{k}").over(before), F.lit(0)).alias(f"o_{k}") for k in sums])
    here = Window.partitionBy("pid_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "pid_")  # a row per partition
    out = out.withColumns({k: F.coalesce(F.sum(f"v_{k}").over(here), F.lit(0)) + F.col(f"o_{k}") for k in sums})
    return out.drop("pid_", *[f"{x}_{k}" for k in sums for x in "vo"])


def with_previous(df: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """Add prev_<c> for each carried column: its value in the row before in the order, null in the first row.

    Rows are range partitioned and checkpointed, so that no key is bound to one task; a partition's first row takes the last
    row of the nearest partition before it, of which there is one row per partition.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = checkpoint(df.repartitionByRange(n, *order).withColumn("pid_", F.spark_partition_id()))
    ends = ranged.groupBy("pid_").agg(F.max_by(F.struct(*carried), F.struct(*order)).alias("end_"))
    before = Window.partitionBy(F.lit(0)).orderBy("pid_")
    ends = ends.select("pid_", F.lag("end_").over(before).alias("end_"))
    here = Window.partitionBy("pid_").orderBy(*order)
    own = F.lag(F.struct(*carried)).over(here)
    out = ranged.join(F.broadcast(ends), "pid_").withColumn("prev_", F.coalesce(own, F.col("end_")))  # a row per partition
    return out.select(*df.columns, *[F.col("prev_").getField(c).alias(f"prev_{c}") for c in carried])

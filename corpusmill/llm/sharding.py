"""Sharding along a Hilbert curve over document metadata.

Source, language and length are quantised in value order and mapped to one curve index, so that neighbours on the curve are
near in all of them. Groups of equal texts take the place of their first document; the curve is cut into runs of near equal
bytes. Files written from a run cover a small box of every dimension, which min/max statistics can prune.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.ordered import prefix_sums
from corpusmill.plans.runtime import checkpoint, shuffle_partitions

BITS = 8
BROADCAST_VALUES = 50_000


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of points (n, dimensions) with coordinates below 2^bits."""
    x = [a.astype(np.int64) for a in axes.T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(flip, low, swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for a in x:
            out = out << 1 | ((a ^ t) >> b & 1)
    return out


def curve(*dimensions: Column) -> Column:
    """Curve index of dimensions already quantised to 0..255."""

    @F.pandas_udf("long")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1)), dtype="int64")

    return run(*dimensions)


def ranked(values: DataFrame, column: str) -> DataFrame:
    """(value_, code): the rank of each distinct value in order, nulls first, spread over 0..255; broadcast only where few."""
    distinct = values.select(F.col(column).alias("value_")).distinct()
    ranks = checkpoint(prefix_sums(distinct, ["value_"], {"rank": F.lit(1)}))
    n = ranks.count()
    codes = ranks.select("value_", F.floor(F.col("rank") * (1 << BITS) / F.lit(max(n, 1))).cast("long").alias("code"))
    return F.broadcast(codes) if n <= BROADCAST_VALUES else codes  # checked: a string and an integer each


def _placed(docs: DataFrame, shards: int, whole_rows: bool) -> DataFrame:
    """(row_, doc_id, size, text_crc32, curve, shard, slot); row_ holds all columns of docs, or is null."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        (F.struct("*") if whole_rows else F.lit(None).cast("int")).alias("row_"),
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.length(text).alias("n"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
    )
    if not whole_rows:
        rows = checkpoint(rows)
    same = ["h", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.min(F.struct("doc_id", "source", "lang")).alias("first"), F.max("n").alias("n"), (F.count("*") * F.col("size")).alias("bytes"))
    groups = groups.select(*same, "n", "bytes", F.col("first.source").alias("source"), F.col("first.lang").alias("lang"))
    for column in ("source", "lang"):
        codes = ranked(rows, column)
        groups = groups.join(codes, F.col(column).eqNullSafe(F.col("value_"))).withColumnRenamed("code", f"{column}_code").drop("value_")
    length = F.least(F.floor(F.log2(F.col("n") + 1) * 8), F.lit(255))
    groups = groups.select(*same, "bytes", curve(F.col("source_code"), F.col("lang_code"), length).alias("curve"))
    ordered = ["curve", *same]
    groups = checkpoint(prefix_sums(groups, ordered, {"start": F.col("bytes")}))
    total = groups.agg(F.sum("bytes").alias("t")).first()["t"] or 1
    # one order of all rows: a group's rows are neighbours, so that one pass gives both places of cuts and slots
    lined = prefix_sums(rows.select("row_", "doc_id", *same).join(groups, same), [*ordered, "doc_id"], {"at": F.col("size"), "rank": F.lit(1)})
    whole = F.col("bytes") <= total / shards / 2
    middle = F.when(whole, F.col("start") + F.col("bytes") / 2).otherwise(F.col("at") + F.col("size") / 2)
    lined = lined.withColumn("shard", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int"))
    if not whole_rows:
        lined = checkpoint(lined.drop("row_")).withColumn("row_", F.lit(None))
    first = {r["shard"]: r["rank"] for r in lined.groupBy("shard").agg(F.min("rank").alias("rank")).collect()}  # a row per shard
    base = F.create_map(*[F.lit(x) for k in range(shards) for x in (k, first.get(k, 0))])
    return lined.select("row_", "doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - base[F.col("shard")]).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Assign every row (doc_id, text, lang, source) to shards 0.. of near equal bytes, in curve order.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, curve, shard and slot (position in the shard, gapless). Equal
    texts stand together at the place of the group's smallest (doc_id, source, lang). A boundary that falls inside a group
    moves to the group's nearer end, by a quarter of a shard at most; in a group of over half a shard it stays where it falls
    and cuts the group's rows in order of doc_id. Nulls: text counts as empty, source and lang as values before all others;
    rows with null or repeated ids are placed one by one like any other. No rows give no rows; other columns do not matter.
    """
    return _placed(docs, shards, False).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int | None = None) -> None:
    """Write every row of docs, all columns kept, as one folder per shard, for file pruning on source, language and length.

    A shard is many files (about files in all, default the shuffle partitions), each a run of the curve. A column of docs
    named shard gives way to the folder's.
    """
    n = files or shuffle_partitions(docs.sparkSession)
    placed = _placed(docs, shards, True)
    kept = [F.col("row_").getField(c).alias(c) for c in docs.columns if c.lower() != "shard"]
    dealt = placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select(*kept, "shard").write.partitionBy("shard").parquet(path)

"""Tables of the data model, derived from the driver's tables by fixed arithmetic (as_of 2024-01-31, UTC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
KINDS = ["fact", "lesson", "success_pattern", "failure_pattern", "user_preference", "decision", "rule"]
TIERS = ["public", "source", "private"]

FACTS_SQL = """
facts AS (SELECT d.doc_id AS fact_id, d.text AS content,
  (['fact','lesson','success_pattern','failure_pattern','user_preference','decision','rule'])[d.doc_id % 7 + 1] AS kind,
  (CASE WHEN l.quality = 1 THEN 0.9 WHEN l.quality = 0 THEN 0.3 ELSE 0.5 END)::DOUBLE AS importance,
  0.4::DOUBLE + (d.doc_id % 7) * 0.1::DOUBLE AS confidence, d.doc_id % 13 AS access_count, d.doc_id % 5 AS distinct_queries_hit,
  (['public','source','private'])[d.doc_id % 3 + 1] AS tier, 'u' || (d.doc_id % 11) AS user_id,
  d.doc_id % 120 AS age_days, CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE d.doc_id % 150 END AS confirmed_days,
  CASE WHEN d.doc_id % 17 = 0 THEN 5 END AS ended_days, d.doc_id % 23 = 0 AS tombstoned,
  (['short_term','long_term'])[d.doc_id % 2 + 1] AS scope_type,
  CASE WHEN d.doc_id % 2 = 0 THEN (d.doc_id % 60) - 30 END AS expires_in_days, 's' || (d.doc_id % 400) AS stable_id,
  d.source AS topic, d.lang AS lang, CASE WHEN d.doc_id > 0 THEN d.doc_id // 2 END AS parent_id,
  CASE WHEN l.toxic IS DISTINCT FROM 1 THEN 'commons' ELSE 'personal' END AS visibility
  FROM documents d LEFT JOIN labels l USING (doc_id))
"""
LOG_SQL = """
recall_log AS (SELECT event_id, ts, user_id, (['public','source','private'])[event_id % 3 + 1] AS tier, event_type AS intent,
  least(1.0::DOUBLE, value / 50) AS top_hit_score, event_id % 11 AS n_results, 10 AS top_k, event_id % 500 AS qhash,
  event_id % 4 = 0 AS used_hint, value * 10 AS latency_ms, event_id % 100 AS hit_a, event_id % 77 AS hit_b FROM events)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with ages in days before as_of instead of timestamps: valid_from = created = as_of - age_days."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    return d.select(
        i.alias("fact_id"),
        F.col("text").alias("content"),
        _pick(KINDS, "doc_id").alias("kind"),
        F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.3).otherwise(0.5).alias("importance"),
        (0.4 + (i % 7) * 0.1).alias("confidence"),
        (i % 13).alias("access_count"),
        (i % 5).alias("distinct_queries_hit"),
        _pick(TIERS, "doc_id").alias("tier"),
        F.concat(F.lit("u"), i % 11).alias("user_id"),
        (i % 120).alias("age_days"),
        F.when(i % 9 != 0, i % 150).alias("confirmed_days"),
        F.when(i % 17 == 0, 5).alias("ended_days"),
        (i % 23 == 0).alias("tombstoned"),
        _pick(["short_term", "long_term"], "doc_id").alias("scope_type"),
        F.when(i % 2 == 0, i % 60 - 30).alias("expires_in_days"),
        F.concat(F.lit("s"), i % 400).alias("stable_id"),
        F.col("source").alias("topic"),
        "lang",
        F.when(i > 0, F.floor(i / 2)).alias("parent_id"),
        F.when(F.col("toxic").eqNullSafe(1), "personal").otherwise("commons").alias("visibility"),
    )


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def recall_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_recall_log(table(spark, sf_dir, "events"))


def as_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; its path may be a folder or a file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def as_recall_log(events: DataFrame) -> DataFrame:
    """The recall log of events, a table or a stream."""
    e = F.col("event_id")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", _pick(TIERS, "event_id").alias("tier"), F.col("event_type").alias("intent"),
        F.least(F.lit(1.0), F.col("value") / 50).alias("top_hit_score"), (e % 11).alias("n_results"), F.lit(10).alias("top_k"),
        (e % 500).alias("qhash"), (e % 4 == 0).alias("used_hint"), (F.col("value") * 10).alias("latency_ms"),
        (e % 100).alias("hit_a"), (e % 77).alias("hit_b"),
    )

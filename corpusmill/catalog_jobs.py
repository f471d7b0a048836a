"""Queries that run as jobs: streams with state, idempotent appends, exports and verified snapshots, walks with their ends."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.operators import lifecycle, provenance, snapshots
from corpusmill.plans.runtime import ensure_checkpoint_dir
from corpusmill.registry import ORACLES, on_facts, on_log, register
from corpusmill.sources.views import as_recall_log, as_stream, facts, table
from corpusmill.streaming import stateful


def shared(s, name: str) -> str:
    """A fresh folder that driver and executors share."""
    ensure_checkpoint_dir(s)
    return f"{s.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@register("a5_append_events", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def a5(s, d):
    """Events as a stream into a table by batch, and that batch once more, as after a lost commit; counted by day."""
    path = shared(s, "append")

    def twice(batch):
        snapshots.append_batch(batch, 0, f"{path}/table")
        return batch

    rows = stateful.run_through(as_stream(s, d, "events"), path, step=twice)
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@on_facts("a6_export_facts", "SELECT fact_id, kind, importance, md5(coalesce(content, '')) AS content_md5 FROM facts WHERE NOT tombstoned")
def a6(s, d):
    """Live facts written as JSON over an older export of them, and read back."""
    path, f = shared(s, "export"), facts(s, d).where("NOT tombstoned").select("fact_id", "kind", "importance", F.coalesce("content", F.lit("")).alias("content"))
    snapshots.swap_in(f.limit(1), path)
    snapshots.swap_in(f, path)
    back = s.read.schema(f.schema).json(path)
    return back.select("fact_id", "kind", "importance", F.md5("content").alias("content_md5"))


@on_facts(
    "a10_verify",
    """, k AS (SELECT tier || '/' || user_id AS part, fact_id FROM facts), a AS (SELECT part, count(*) AS n FROM k GROUP BY 1),
    b AS (SELECT CASE WHEN part = 'private/u2' THEN 'private/u99' ELSE part END AS part, count(*) AS n FROM k WHERE NOT (part = 'public/u1' AND fact_id % 2 = 0) GROUP BY 1)
    SELECT coalesce(a.part, b.part) AS part, CASE WHEN b.part IS NULL THEN 'missing' WHEN a.part IS NULL THEN 'added' WHEN a.n <> b.n THEN 'rows' WHEN b.part = 'source/u5' THEN 'changed' ELSE 'same' END AS status,
      coalesce(a.n, 0) AS n_expected, coalesce(b.n, 0) AS n_found FROM a FULL JOIN b ON a.part = b.part""",
)
def a10_verify(s, d):
    """A snapshot of facts by tier and user, its copy with rows lost, a text changed and a part renamed, and what verification says."""
    path = shared(s, "snapshot")
    f = facts(s, d).select(F.concat_ws("/", "tier", "user_id").alias("part"), "fact_id", "kind", "content", "importance")
    f.write.parquet(f"{path}/kept")
    kept = s.read.parquet(f"{path}/kept")
    broken = kept.where("NOT (part = 'public/u1' AND fact_id % 2 = 0)")
    broken = broken.withColumn("content", F.when(F.col("part") == "source/u5", F.concat(F.coalesce("content", F.lit("")), F.lit("!"))).otherwise(F.col("content")))
    broken.withColumn("part", F.when(F.col("part") == "private/u2", "private/u99").otherwise(F.col("part"))).write.parquet(f"{path}/copy")
    return snapshots.verify(snapshots.manifest(kept, "part"), snapshots.manifest(s.read.parquet(f"{path}/copy"), "part"))


# facts whose number is divisible by 41 are not there, so that some chains break before the walk ends
LIVE_SQL = ", lf AS (SELECT fact_id AS node FROM facts WHERE fact_id % 41 <> 0 OR fact_id = 0), lk AS (SELECT fact_id AS child, parent_id AS parent FROM facts JOIN lf ON fact_id = node WHERE parent_id IS NOT NULL)"


def ends_sql(source: str, target: str, most: int) -> str:
    """DuckDB SQL of provenance.walk's ends over lk, for all live facts."""
    return f"""{LIVE_SQL}, w AS (WITH RECURSIVE t AS (SELECT node AS seed, node, 0 AS depth FROM lf UNION
      SELECT t.seed, lk.{target}, depth + 1 FROM t JOIN lk ON t.node = lk.{source} JOIN lf ON lf.node = lk.{target} WHERE depth < 8) SELECT * FROM t),
    m AS (SELECT seed, node, min(depth) AS depth FROM w GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) - 1 AS r FROM m),
    p AS (SELECT seed, count(*) FILTER (r BETWEEN 1 AND {most}) AS n, coalesce(max(depth) FILTER (r <= {most}), 0)::INT AS depth, max(r) > {most} AS truncated, min(depth) FILTER (r = {most + 1}) AS full_at FROM r GROUP BY 1),
    b AS (SELECT m.seed, bool_or(CASE WHEN m.depth < 8 THEN m.depth < coalesce(full_at, 99) AND lf.node IS NULL ELSE full_at IS NULL END) AS broken
      FROM m JOIN p USING (seed) JOIN lk ON m.node = lk.{source} LEFT JOIN lf ON lf.node = lk.{target} GROUP BY 1)
    SELECT p.seed, n, p.depth, coalesce(broken, FALSE) AS chain_broken, truncated FROM p LEFT JOIN b USING (seed)"""


def links(s, d):
    """(edges(child, parent), nodes(node)) of the facts that are there."""
    f = facts(s, d).where("fact_id % 41 <> 0 OR fact_id = 0")
    return f.where("parent_id IS NOT NULL").select(F.col("fact_id").alias("child"), F.col("parent_id").alias("parent")), f.select(F.col("fact_id").alias("node"))


@on_facts("i1_provenance", ends_sql("child", "parent", 64))
def i1_provenance(s, d):
    edges, nodes = links(s, d)
    return provenance.provenance(edges, nodes, nodes.select(F.col("node").alias("seed")))[1]


@on_facts("i2_lineage", ends_sql("parent", "child", 256))
def i2_lineage(s, d):
    edges, nodes = links(s, d)
    return provenance.lineage(edges, nodes, nodes.select(F.col("node").alias("seed")))[1]


@register("m2_rate_stream", ORACLES["m2_rate_admission"])
def m2_stream(s, d):
    return stateful.run_through(stateful.admissions(as_recall_log(as_stream(s, d, "events")), cap=3, hours=24 * 7), shared(s, "rate"))


@register("m3_nonce_stream", ORACLES["m3_nonce_dedup"])
def m3_stream(s, d):
    log = as_recall_log(as_stream(s, d, "events")).select("user_id", (F.col("qhash") % 5).alias("nonce"), "event_id", "ts")
    return stateful.run_through(stateful.replays(log), shared(s, "nonce"))


@on_log("m7_distinct_stream", "SELECT hit AS fact_id, count(DISTINCT qhash) AS queries FROM (SELECT qhash, unnest([hit_a, hit_b]) AS hit FROM recall_log) GROUP BY 1")
def m7_stream(s, d):
    """Counts as they grow, batch by batch; the last of each fact."""
    reads = as_recall_log(as_stream(s, d, "events")).select("qhash", F.explode(F.array("hit_a", "hit_b")).alias("fact_id"))
    grown = stateful.run_through(stateful.distinct_queries(reads), shared(s, "distinct"), mode="update")
    return grown.groupBy("fact_id").agg(F.max("queries").alias("queries"))


@register("m8_gate_stream", ORACLES["m8_observe_gate"])
def m8_stream(s, d):
    gated = stateful.gate(as_stream(s, d, "conversations"), "text").select("conv_id", "turn", F.col("decision").alias("gate"))
    return stateful.run_through(gated, shared(s, "gate")).groupBy("gate").agg(F.count("*").alias("n"))


@register("m5_decay_stream", ORACLES["m5_incremental_decay"])
def m5_stream(s, d):
    """The decay sweep on every batch of new facts above the watermark; the rest of a fact is looked up by its id."""
    every = facts(s, d)
    ids = as_stream(s, d, "documents").select(F.col("doc_id").alias("fact_id"))
    return stateful.run_through(ids, shared(s, "decay"), step=lambda batch: lifecycle.decay_sweep(every.join(batch, "fact_id", "left_semi"), since=100))

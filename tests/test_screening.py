"""Operators that SQL cannot express against plain Python, and the edge rows of the screening rules."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpusmill.operators import changes, fusion, lexical, screening
from corpusmill.operators.pairing import against

LOG = "user_id long, event_id long, s long, nonce long"


def log(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), k, rnd.randrange(20_000), rnd.randrange(4)) for k in range(n)] + [(None, n, 5, 1), (1, n + 1, None, 1)]
    return rows, spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_seconds("s"))


def test_rate_admission_equals_plain_python(spark):
    rows, df = log(spark)
    recent, want = defaultdict(list), {}
    for user, event, s, _ in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        times = [t for t in recent[user] if t > s - 3600]
        want[event] = 0 if len(times) < 5 else times[0] + 3600 - s
        recent[user] = times + [s] if len(times) < 5 else times
    got = {r["event_id"]: r["retry_after"] for r in changes.rate_admission(df, cap=5, hours=1).collect()}
    assert got == want and any(want.values())


def test_nonce_dedup_equals_plain_python(spark):
    rows, df = log(spark)
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") * 100))
    last, want = {}, {}
    for user, event, s, nonce in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        want[event] = (user, nonce) not in last or s * 100 - last[user, nonce] >= 86400
        if want[event]:
            last[user, nonce] = s * 100
    got = {r["event_id"]: r["accepted"] for r in changes.nonce_dedup(df, days=1).collect()}
    assert got == want


def test_mmr_prefers_new_terms_and_keeps_ties_in_order(spark):
    rows = [(1, 10, 1.0, ["a", "b"]), (1, 11, 0.99, ["a", "b"]), (1, 12, 0.8, ["c"]), (2, 5, 1.0, []), (2, 6, 1.0, [])]
    pool = spark.createDataFrame(rows, "query_id long, doc_id long, score double, terms array<string>")
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in fusion.mmr(pool, 3).collect())
    assert got == [(1, 1, 10), (1, 2, 12), (1, 3, 11), (2, 1, 5), (2, 2, 6)]
    assert fusion.mmr(pool.where("query_id = 9")).count() == 0


def test_luhn_and_redaction(spark):
    df = spark.createDataFrame([(1, "pay 4111-1111-1111-1111 now"), (2, "4111 1111 1111 1112"), (3, "a.b@c.org and 10.0.0.1"), (4, None), (5, "")], "fact_id long, content string")
    assert sorted(map(tuple, screening.card_numbers(df).collect())) == [(1, 1, 1), (2, 1, 0)]
    out = {r[0]: r[1] for r in df.select("fact_id", screening.redact(F.col("content"))).collect()}
    assert out == {1: "pay [REDACTED:card] now", 2: "[REDACTED:card]", 3: "[REDACTED:email] and [REDACTED:ipv4]", 4: None, 5: ""}


def test_capture_gate_and_route_of_edge_texts(spark):
    texts = [None, "  ", "hi", "thanks for this, it is a long enough text", "python -c print(1) and some more text to be long", "A rule comes first and only then the command"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    gates = [r[0] for r in df.select(screening.capture_gate(F.col("t"))).collect()]
    assert gates == ["empty", "empty", "too_short", "noise_prefix", "execution_log", "keep"]
    q = spark.createDataFrame([(None,), ("because of it",), ("who was there",), ("short one",), ("Long texts about Paris and its many rivers",)], "t string")
    assert [r[0] for r in q.select(screening.choose_route(F.col("t"))).collect()] == ["hybrid", "graph", "dense", "graph", "hybrid"]


def test_blocks_meet_like_a_broadcast(spark, monkeypatch):
    rows, queries = spark.range(40).toDF("fact_id"), spark.range(9).toDF("query_id")
    want = sorted(map(tuple, against(rows, queries, "query_id").select("fact_id", "query_id").collect()))
    monkeypatch.setattr("corpusmill.operators.pairing.BROADCAST_BYTES", 3)
    assert sorted(map(tuple, against(rows, queries, "query_id").select("fact_id", "query_id").collect())) == want and len(want) == 360


def test_empty_tables(spark):
    facts = spark.createDataFrame([], "fact_id long, content string, importance double, kind string, tier string, tombstoned boolean, topic string")
    assert changes.hygiene_scan(facts).count() == 0 and screening.private_counts(facts).count() == 0
    assert changes.semantic_groups(spark.createDataFrame([], "a long, b long"), facts).count() == 0
    assert lexical.top_k(spark.createDataFrame([], "query_id long, doc_id long, score double"), 3).count() == 0


def test_depth_takes_the_longest_way(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (5, 6), (6, 5)], "child long, parent long")
    facts = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "fact_id long")
    assert sorted(map(tuple, changes.provenance_depth(edges, facts).collect())) == [(1, 0), (2, 1), (3, 2), (4, 0)]


def test_first_line_markers_and_boosts(spark):
    rows = [(1, "[LESSON] one\ntwo", "fact", 0.3), (2, "Failed again", "fact", 0.3), (3, "worked\nfail", "fact", 0.9), (4, "worked", "rule", 0.9), (5, None, "fact", 0.1), (6, "see [LESSON]", "fact", 0.85)]
    df = spark.createDataFrame(rows, "fact_id long, content string, kind string, importance double")
    assert sorted(map(tuple, screening.classify_first_line(df).collect())) == [(1, "lesson"), (2, "failure_pattern"), (3, "success_pattern")]
    assert sorted(map(tuple, screening.importance_audit(df).collect())) == [(1, 0.3, 0.85)]

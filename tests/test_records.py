"""Edge rows of pair relations, scenario scores, rescoring, exports and records."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import records, relations

PAIR = "a_text string, a_entities array<string>, b_text string, b_entities array<string>"


def test_relation_of_each_kind(spark):
    base = "the red door opens with a small brass key at noon"
    rows = [
        (base, ["x"], base, ["x"], "repeat"),
        (base, ["x"], base + " " + "y" * 60, ["x"], "corroboration"),
        (base, ["x"], base.replace("opens", "never opens"), ["x"], "conflict"),
        ("red door", ["x"], "red door opens with a small brass key", [], "clarification"),
        ("one two", ["x"], "three four", ["x"], "new_fact"),
        ("one two", ["x"], "three four", ["y"], "new_fact"),
        ("one two", [], "three four", ["y"], "none"),
        ("", ["x"], "three", ["x"], "none"),
        (None, [], None, [], "none"),
    ]
    got = relations.pair_relation(spark.createDataFrame([r[:4] for r in rows], PAIR).coalesce(1)).collect()
    assert [r["relation"] for r in got] == [r[4] for r in rows]
    assert got[0]["confidence"] == 1.0 and got[5]["confidence"] == 0.5 and got[7]["confidence"] == 0.0


def test_temporal_score_keeps_the_order_of_dates(spark):
    rows = [
        ("2024-01-20", ["2024-01-20"], 1.0), ("2024-01-20", ["2024-01-02"], 0.6), ("2024-01-20", ["2023-01-20"], -0.5), ("2024-01-20", ["2024-03"], 0.5),
        ("2024-01-20", ["2023", "2024"], 1.0), ("2024", ["2024-05-05"], 1.0), ("2024-01-20", [], -0.5), ("2024-01-20", ["soon", None], -0.5), (None, ["2024"], 0.0), ("then", ["2024"], 0.0),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "day string, asked array<string>").coalesce(1)
    assert [r[0] for r in df.select(relations.temporal_score(F.col("day"), F.col("asked"))).collect()] == [r[2] for r in rows]


def test_usefulness_bounds(spark):
    rows = [("red door", "red door", ["red"], ["door"], 1.0, 10), ("red", "blue", None, None, 0.0, 0), (None, "x", [], [], 1.0, 1), ("x", "", [], [], 1.0, 1)]
    df = spark.createDataFrame(rows, "q string, t string, k array<string>, e array<string>, c double, a long").coalesce(1)
    out = [r[0] for r in df.select(relations.usefulness(*[F.col(c) for c in "qtkeca"])).collect()]
    assert out == pytest.approx([0.4 + 0.125 + 0.125 + 0.1, 0.05, 0.05, 0.05])


def test_entity_links_count_without_pairs(spark):
    rows = [(1, "topic", "a"), (1, "lang", "x"), (2, "topic", "a"), (2, "lang", "x"), (3, "topic", "b"), (3, "lang", "x"), (4, "topic", "c"), (1, "topic", "a")]
    got = dict(map(tuple, relations.entity_links(spark.createDataFrame(rows, "fact_id long, type string, value string")).collect()))
    assert got == {1: 2, 2: 2, 3: 2, 4: 0}


def test_rerank_and_boost_of_nothing(spark):
    scored = spark.createDataFrame([], "query_id long, fact_id long, score double")
    queries = spark.createDataFrame([(1, None)], "query_id long, query string")
    texts = spark.createDataFrame([(1, None)], "fact_id long, content string")
    assert relations.lexical_rerank(scored, queries, texts).count() == 0
    one = spark.createDataFrame([(1, 1, 2.0)], scored.schema)
    assert relations.lexical_rerank(one, queries, texts).first()["score"] == pytest.approx(0.7)
    assert relations.stage_boost(one, queries, texts).first()["score"] == 2.0
    assert relations.bridge_boost(one, spark.createDataFrame([], "fact_id long, entity string")).first()["score"] == 2.0


def test_scenarios_of_empty_texts_and_ties(spark):
    facts = spark.createDataFrame([(1, "red door"), (2, None), (3, ""), (4, "sea")], "fact_id long, content string")
    scenes = spark.createDataFrame([(7, ["red", "door"]), (5, ["red", "door"])], "scenario_id long, words array<string>")
    got = {r["fact_id"]: r["scenario"] for r in relations.scenario_assign(facts, scenes).collect()}
    assert got[1] == "sc_5" and got[4].startswith("new_") and set(got) == {1, 4}


def test_conflicts_pass_over_the_fact_itself(spark):
    schema = "fact_id long, kind string, user_id string, importance double, topic string, lang string, tombstoned boolean, ended_days int"
    rows = [(1, "decision", "u", 0.9, "t", "en", False, None), (2, "decision", "u", 0.5, "t", "de", False, None), (3, "decision", "v", 0.5, "t", "de", False, None),
            (4, "decision", None, 0.4, "t", None, False, None), (5, "decision", "u", 0.5, "t", "de", True, None), (6, "fact", "u", 0.5, "t", "de", False, None)]
    f = spark.createDataFrame(rows, schema)
    got = {r["fact_id"]: (r["gated_by"], r["importance"]) for r in records.resolve_conflicts(f.where("fact_id < 3"), f).collect()}
    assert got == {1: (2, 0.45), 2: (1, 0.25), 4: (1, 0.2)}


def test_log_quality_and_restore(spark):
    lines = spark.createDataFrame([('{"ts": "2024-01-02T00:00:00Z"}',), ('{"ts": "2024-01-03T00:00:00Z"}',), ("{",), ("",), (None,), ('{"qhash": 1}',)], "line string")
    assert dict(map(tuple, records.log_quality(lines, "2024-01-01", "2024-01-03").collect())) == {"ok": 1, "out_of_window": 1, "malformed": 4}
    log = spark.createDataFrame([(1, 1, '{"k": 1}'), (1, 2, '{"k": 2}'), (1, 3, "broken"), (2, 1, None)], "fact_id long, version long, old_state string")
    got = {r["fact_id"]: (r["versions"], r["state"] and r["state"]["k"]) for r in records.restore(log, "k long").collect()}
    assert got == {1: (3, 2), 2: (1, None)}


def test_exports_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, "ü")], "fact_id long, content string")
    records.export(df, str(tmp_path / "j"), "json")
    records.export(df, str(tmp_path / "c"), "csv")
    records.export(df.select("content"), str(tmp_path / "t"), "text")
    want = sorted(map(tuple, df.collect()))
    assert sorted((r["fact_id"], r["content"]) for r in spark.read.json(str(tmp_path / "j")).collect()) == want
    assert sorted((int(r["fact_id"]), r["content"]) for r in spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "c")).collect()) == want
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == sorted(w[1] for w in want)
    events = spark.createDataFrame([(1, "2024-01-01 10:00:00")], "event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    records.append_events(events, str(tmp_path / "e"))
    records.append_events(events, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2


def test_signals_and_stripped_texts(spark):
    texts = ["my key", "our approach", "our salary", "I", "write to a@b.org", "in", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in df.select(records.signals(F.coalesce("t", F.lit("")))).collect()]
    assert got == [["singular"], [], ["plural"], ["singular"], ["contact"], [], [], []]
    q = spark.createDataFrame([("what is the red door?",), ("the",), ("",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in q.select(records.strip_discourse(F.col("t"))).collect()] == ["is red door?", "the", "", None]
    e = spark.createDataFrame([("error at C:\\a\\b.py line 0xff: KeyError foo foo /x/y.py",), ("",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in e.select(records.error_query(F.col("t"))).collect()] == ["at KeyError foo", "", None]


def test_signals_are_found_in_the_same_texts_and_in_long_runs_at_once(spark):
    rnd = random.Random(3)
    parts = ["my", "mine", "me", "I", "our", "us", "we", "wife", "son", "family", "trip", "tickets", "ticket", "suicide", "anxiety", "a@b.co", "@b.co", "a@.co", "a@b.c", "a@..x.yz", "é", "_", " ", "\n", "\U0001f600", "x", "m", ".", "9"]
    rows = [(k, "".join(rnd.choice(parts) + rnd.choice(["", " ", "", "-"]) for _ in range(rnd.randrange(1, 5)))) for k in range(3000)]
    df = spark.createDataFrame([*rows, (3000, ""), (3001, "I"), (3002, "we\n"), (3003, "\nme")], "fact_id long, text string")
    both = df.select(*[F.col("text").rlike(p).alias(n) for n, p in records.SIGNALS], *[c.alias(f"{n}_") for n, c in records._shown(F.col("text")).items()])
    for r in both.groupBy(*both.columns).count().collect():
        assert all(r[n] == r[f"{n}_"] for n, _ in records.SIGNALS), r
    assert all(0 < both.where(n).count() < 3000 for n, _ in records.SIGNALS)
    began = time.time()
    run = spark.range(4).select(F.repeat(F.lit("x"), 200_000).alias("text")).repartition(4)
    assert run.where(F.size(records.signals(F.col("text"))) > 0).count() == 0 and time.time() - began < 20

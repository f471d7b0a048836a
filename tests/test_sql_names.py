"""Operators by SQL name, and runs of chains that tell how each step ended."""

from pyspark.sql import functions as F

from corpusmill.operators import distilling, lexical, private
from corpusmill.plans import sql_names
from corpusmill.plans.chain import Registry

SF = "/root/testdata/sf0.001"


def test_names_in_sql(spark):
    names = sql_names.register(spark)
    assert set(names) == {"lex_tokens", "scrub_text", "distill_text", "private_signals", "private_spans"}
    rows = [(1, None), (2, "my step: ~/docs/b then BM25 of ann@example.org"), (3, "")]
    spark.createDataFrame(rows, "id int, t string").createOrReplaceTempView("named_texts")
    got = {r["id"]: r for r in spark.sql("SELECT id, lex_tokens(t) AS tokens, scrub_text(t) AS scrubbed, distill_text(t) AS distilled, private_signals(t) AS signals FROM named_texts").collect()}
    assert tuple(got[1])[1:] == ([], None, "", []) and tuple(got[3])[1:] == ([], "", "", [])
    assert got[2]["tokens"] == lexical.tokenize(rows[1][1]) and got[2]["scrubbed"].startswith("my step: <home>/docs/b") and got[2]["signals"] == ["pii", "first_person"]
    assert got[2]["distilled"] == distilling.distill(rows[1][1])[0]
    spans = spark.sql("SELECT id, s.* FROM named_texts, LATERAL private_spans(t) s").collect()
    assert [(r["id"], r["start"], r["end"], r["name"]) for r in spans] == [(2, f[0], f[2], f[3]) for f in private.Finder(private.PATTERNS).find(rows[1][1])] and spans


def test_runs_tell_how_steps_ended(spark):
    steps = Registry()
    steps.add("even", lambda d: d.where("id % 2 = 0"))
    steps.add("broken", lambda d: d.where("no_such_column > 1"))
    steps.add("big", lambda d: d.where("id > 4").withColumn("x", F.lit(1)))
    rows, told = steps.run(spark.range(10), ["even", "broken", "missing", "big"])
    assert sorted(r["id"] for r in rows.collect()) == [6, 8]
    assert [(t.name, t.ok, t.rows) for t in told] == [("even", True, 5), ("broken", False, None), ("missing", False, None), ("big", True, 2)]
    assert "no_such_column" in told[1].error and all(t.seconds >= 0 for t in told)
    assert steps.run(spark.range(0), [])[1] == []

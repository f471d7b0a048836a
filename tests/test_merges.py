"""Merged rows with their audit, and daily sketches, against plain Python."""

from pyspark.sql import functions as F

from corpusmill import catalog
from corpusmill.operators import changes, reports

SF = "/root/testdata/sf0.001"
FACTS = "fact_id long, importance double, tags array<string>, content string"


def test_merged_rows_and_audit(spark):
    facts = [(1, 0.5, ["b", "a"], "one"), (2, 0.9, ["a", "c", None], "x" * 300), (3, 0.1, None, None), (4, 0.2, ["z"], "four"), (5, 0.3, [], "five"), (6, 0.4, ["q"], "six")]
    groups = [(2, 1), (1, 1), (3, 1), (3, 1), (4, 4), (5, 99), (6, None), (77, 1)]
    rows, audit = changes.merge_rows(spark.createDataFrame(groups, "fact_id long, winner long"), spark.createDataFrame(facts, FACTS))
    got = {r["fact_id"]: tuple(r)[1:] for r in rows.collect()}
    assert got == {1: (False, 0.9, ["b", "a", "c"], 2, None), 2: (True, 0.9, ["a", "c", None], 0, 1), 3: (True, 0.1, [], 0, 1)}
    assert sorted(map(tuple, audit.collect())) == [(1, 2, "warning", "x" * 120, 0.9, 3), (1, 3, "warning", "", 0.9, 3)]
    assert rows.limit(0).count() == 0 and changes.merge_rows(spark.createDataFrame([], "fact_id long, winner long"), spark.createDataFrame(facts, FACTS))[0].count() == 0


def test_sketches_are_near_the_exact_count(spark):
    rows = catalog.queries()["m7_daily_sketches"](spark, SF).collect()
    assert rows and all(abs(r["estimate"] - r["exact"]) <= max(1, 0.05 * r["exact"]) for r in rows)
    reads = spark.range(60_000).select((F.col("id") % 2).alias("item"), (F.col("id") % 20_000).alias("what"), F.timestamp_seconds(F.col("id") * 30).alias("ts"))
    reads = reads.union(spark.createDataFrame([(None, 1, None), (5, None, None)], "item long, what long, ts timestamp"))
    daily = reports.daily_sketches(reads, "item", "what")
    assert daily.count() > 20
    got = {r["item"]: r["estimate"] for r in reports.distinct_of(daily).collect()}
    assert got.keys() == {0, 1} and all(abs(n - 10_000) < 500 for n in got.values())

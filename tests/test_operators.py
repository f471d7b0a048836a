import random

from corpusmill.operators.components import connected_components
from corpusmill.operators import lexical, lifecycle
from corpusmill.sources.views import table
from corpusmill.streaming import jobs
from corpusmill.operators.reports import daily_counts
from pyspark.sql import functions as F


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


def test_tokens_of_null_and_stopwords(spark):
    df = spark.createDataFrame([(None,), ("The BM25 of x and Spark-SQL",)], "t string")
    assert [r[0] for r in df.select(lexical.tokens(F.col("t"))).collect()] == [[], ["bm25", "spark", "sql"]]


def test_session_boundary_is_strict(spark):
    rows = [(1, 7, 0), (2, 7, 1800), (3, 7, 3601)]
    chunks = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r["n"] for r in lifecycle.session_clusters(chunks).collect()) == [1, 2]


def test_streaming_counts_equal_batch(spark, tmp_path):
    events = table(spark, "/root/testdata/sf0.001", "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = jobs.run_to_memory(jobs.daily_counts(stream), "daily", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, daily_counts(events).collect()))

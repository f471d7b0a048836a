"""Walks with their ends, idempotent appends, staged exports, verified manifests and restarted streams."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import changes, provenance, snapshots
from corpusmill.streaming import stateful

SF = "/root/testdata/sf0.001"


def plain_walk(links, nodes, seed, most, max_depth):
    out, seen, level, broken = [], {seed}, [seed], False
    for depth in range(1, max_depth + 1):
        ends = {t for a, t in links if a in level}
        broken |= bool(ends - nodes)
        level = sorted((ends & nodes) - seen)
        seen |= set(level)
        out += [(seed, n, depth) for n in level]
        if not level:
            break
        if len(out) > most:
            break
    else:
        broken |= any(a in level for a, _ in links)
    kept = out[:most]
    return kept, (seed, len(kept), max((d for _, _, d in kept), default=0), broken, len(out) > most)


def test_walks_equal_a_plain_walk(spark):
    rnd = random.Random(7)
    nodes = set(range(60)) - {13, 14}
    links = {(rnd.randrange(60), rnd.randrange(64)) for _ in range(90)} | {(5, 5), (1, 2), (2, 1), (100, 3)} | {(50, k) for k in range(40)}
    seeds = [0, 1, 2, 5, 13, 50, 33, 100, 99]
    df = spark.createDataFrame(sorted(links) + [(1, 2), (None, 3), (3, None)], "source long, target long")
    n = spark.createDataFrame([(x,) for x in nodes] + [(None,), (1,)], "node long")
    s = spark.createDataFrame([(x,) for x in seeds] + [(None,), (1,)], "seed long")
    for most, depth in ((4, 3), (100, 8), (1, 1)):
        found, ends = provenance.walk(df, n, s, most, depth)
        want = [plain_walk(links, nodes, x, most, depth) for x in seeds]
        assert sorted(map(tuple, found.collect())) == sorted(r for k, _ in want for r in k)
        assert sorted(map(tuple, ends.collect())) == sorted(e for _, e in want)
    assert provenance.provenance(df.toDF("child", "parent").limit(0), n, s.limit(0))[1].count() == 0


def test_appends_of_one_batch_count_once(spark, tmp_path):
    path = str(tmp_path / "t")
    a, b = spark.range(5), spark.range(5, 7)
    for rows, number in ((a, 0), (b, 1), (a, 0), (b, 1)):
        snapshots.append_batch(rows, number, path)
    assert sorted(r[0] for r in snapshots.appended(spark, path).collect()) == list(range(7))


def test_export_replaces_the_old_one_whole(spark, tmp_path):
    path = str(tmp_path / "e")
    for rows, form in ((spark.range(3), "json"), (spark.range(9), "json"), (spark.range(4), "csv")):
        snapshots.swap_in(rows, path, form)
        assert spark.read.option("header", True).format(form).load(path).count() == rows.count()
    assert not list(tmp_path.glob("e.*"))


def test_verify_tells_parts_apart(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), ("c", 4, ""), (None, 5, "z"), ("d", 6, "q"), ("d", 6, "q")]
    df = spark.createDataFrame(rows, "p string, k int, t string")
    base = snapshots.manifest(df, "p")
    same = snapshots.verify(base, snapshots.manifest(df.repartition(3), "p"))
    assert {r["status"] for r in same.collect()} == {"same"} and same.count() == 5
    other = spark.createDataFrame([("a", 1, "x"), ("a", 2, "~"), ("b", 3, "y"), ("b", 3, "y"), ("c", 4, None), (None, 5, "z"), ("e", 7, "n")], df.schema)
    got = {r["part"]: (r["status"], r["n_expected"], r["n_found"]) for r in snapshots.verify(base, snapshots.manifest(other, "p")).collect()}
    assert got == {"a": ("changed", 2, 2), "b": ("rows", 1, 2), "c": ("changed", 1, 1), None: ("same", 1, 1), "d": ("missing", 2, 0), "e": ("added", 0, 1)}
    assert snapshots.manifest(df.limit(0), "p").count() == 0


def key(df):
    return sorted(map(tuple, df.collect()))


def test_streams_go_on_after_a_restart(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", (F.col("event_id") % 5).alias("nonce"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 17).alias("qhash"), (F.col("event_id") % 4).alias("fact_id"))
    half = rows.selectExpr("percentile(unix_timestamp(ts), 0.5) AS m").first()["m"]
    early, late = rows.where(F.unix_timestamp("ts") <= half), rows.where(F.unix_timestamp("ts") > half)
    source = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(source)
    forms = {
        "replays": (lambda: stateful.replays(stream()), changes.nonce_dedup, "append"),
        "admissions": (lambda: stateful.admissions(stream(), 3, 168), lambda e: changes.rate_admission(e, 3, 168), "append"),
        "distinct": (lambda: stateful.distinct_queries(stream()), lambda e: e.groupBy("fact_id").agg(F.countDistinct("qhash").alias("queries")), "update"),
    }
    for part in (early, late):
        part.coalesce(1).write.mode("append").parquet(source)
        for name, (made, batch, mode) in forms.items():
            out = stateful.run_through(made(), str(tmp_path / name), mode=mode)
            if mode == "update":
                out = out.groupBy("fact_id").agg(F.max("queries").alias("queries"))
            want = batch(spark.read.parquet(source)).select(*out.columns)
            assert key(out) == key(want), name
    assert stateful.run_through(forms["replays"][0](), str(tmp_path / "replays")).count() == rows.count()


def test_stateful_streams_leave_out_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 1, 5), (2, 1, None, 6), (3, 1, 1, None), (4, 1, 1, 7), (4, 1, 1, 7)], "event_id long, user_id long, nonce long, s long").select("event_id", "user_id", "nonce", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert key(stateful.run_through(stateful.replays(stream()), str(tmp_path / "r"))) == [(1, 1, 4, False), (1, 1, 4, True)]
    assert {r["event_id"] for r in stateful.run_through(stateful.admissions(stream()), str(tmp_path / "a")).collect()} == {2, 4}

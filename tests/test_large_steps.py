"""Steps that failed or grew too fast on larger tables, on small rows that show why."""

from pyspark.sql import functions as F


def test_depth_along_computed_parents_keeps_a_small_plan(spark):
    from corpusmill.operators import changes

    nodes = spark.range(1 << 11).withColumnRenamed("id", "fact_id")
    edges = nodes.where("fact_id > 0").select(F.col("fact_id").alias("child"), F.floor(F.col("fact_id") / 2).alias("parent"))
    found = changes.provenance_depth(edges, nodes)
    assert len(found._jdf.queryExecution().optimizedPlan().constraints().mkString("|")) < 20_000
    assert {r["fact_id"]: r["depth"] for r in found.collect()} == {k: k.bit_length() for k in range(1 << 11)}


def test_products_of_queries_and_vectors_are_of_bounded_size(monkeypatch):
    import numpy as np

    from corpusmill.operators import vectors

    monkeypatch.setattr(vectors, "MEET_CELLS", 64)
    rnd = np.random.default_rng(1)
    x, y = vectors.unit(rnd.normal(size=(40, 4))), vectors.unit(rnd.normal(size=(30, 4)))
    a, b = np.arange(40), np.arange(100, 130)
    whole = list(vectors._chunks(x, a, y, b, -2.0))
    assert max(map(len, whole)) <= 64 and sum(map(len, whole)) == 1200
    tops = np.full((40, 3), -2.0)
    found = [f for part in np.array_split(np.arange(30), 5) for f in vectors._chunks(x, a, y[part], b[part], -2.0, 3, tops)]
    kept = {(q, f) for part in found for q, f in zip(part["query_id"], part["fact_id"])}
    assert {(q, 100 + f) for q in range(40) for f in np.argsort(-(y @ x[q]))[:3]} <= kept and len(kept) < 1200


def test_best_pairs_meet_within_their_group_only(spark):
    from corpusmill.operators import vectors

    rows = [(k, [1.0, float(k % 5)], "ab"[k % 2]) for k in range(20)]
    e = spark.createDataFrame(rows, "fact_id long, embedding array<float>, grp string")
    got = vectors.cosine_scores(e.where("fact_id < 4").withColumnRenamed("fact_id", "query_id"), e).collect()
    assert {(r["query_id"], r["fact_id"]) for r in got} == {(q, f) for q in range(4) for f in range(20) if q != f and q % 2 == f % 2}


def test_index_is_written_in_small_batches(spark, tmp_path):
    from corpusmill.operators import lex_index

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    lex_index.write_index(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), "doc_id", "text", str(tmp_path / "i"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_mined_texts_are_distilled_once(spark):
    from corpusmill.operators import texts

    rows = [(1, "lesson", False, "The build was slow because of a cold cache. So says my wife! Keep the cache warm between the runs of one day."), (2, "lesson", False, "short"), (3, "rule", False, "x" * 80)]
    f = spark.createDataFrame(rows, "fact_id long, kind string, tombstoned boolean, content string")
    mined = texts.mine_public(f, ["lesson"], f.where("fact_id = 9").select("fact_id"))
    plan = mined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tool_result_CLEARED") + plan.count("TOOL_RESULT_CLEARED") == 1
    assert [tuple(r) for r in mined.collect()] == [(1, "The build was slow because of a cold cache. Keep the cache warm between the runs of one day.")]


def test_candidates_are_pruned_where_they_meet_and_none_is_lost(spark):
    import random

    from corpusmill.operators import experiences

    rnd = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [rnd.sample(vocabulary, 25) for _ in range(12)]
    near = [[w for w in b if rnd.random() > 0.2] + rnd.sample(vocabulary, 3) for b in base * 3]
    rows = [(k, " ".join(ws) + (" not" if k // 12 % 2 else "")) for k, ws in enumerate(base + near)]
    sets = {k: frozenset(t.split()) for k, t in rows}
    first = {(s, k // 12 % 2): k for k, s in reversed(list(sets.items()))}
    want = {(a, b) for (x, p), a in first.items() for (y, q), b in first.items() if p < q and round(len(x & y) / len(x | y), 6) >= 0.6}
    pairs, _ = experiences.negation_conflicts(spark.createDataFrame(rows, "fact_id long, content string"))
    assert {(r["plain_class"], r["negated_class"]) for r in pairs.collect()} == want and want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan


def test_pairs_at_the_threshold_pass_the_bounds(spark):
    from corpusmill.operators import similar

    a, b = list("abcdefgh"), list("abcdefgxyz")  # 7 of 11 shared
    rows = spark.createDataFrame([(a, b)], "wa array<string>, wb array<string>")
    for place in (1, 2):
        cols = rows.select(F.size("wa").alias("na"), F.size("wb").alias("nb"), F.lit(place).alias("ra"), F.lit(place).alias("rb"), similar.parities(F.col("wa"), 2).alias("pa"), similar.parities(F.col("wb"), 2).alias("pb"))
        assert cols.where(similar.may_reach(7 / 11, 2)).count() == 1
    assert cols.where(similar.may_reach(0.95, 2)).count() == 0


def test_piece_probabilities_come_from_all_texts(spark, monkeypatch, tmp_path):
    import numpy as np

    from corpusmill.llm import queries, token_counts

    asked, estimate = [], token_counts.estimate
    monkeypatch.setattr(token_counts, "estimate", lambda docs, text, pieces, sample_docs=None, **k: asked.append(sample_docs) or estimate(docs, text, pieces, sample_docs, **k))
    spark.createDataFrame([(k, f"word{k} again") for k in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op9_token_counts(spark, str(tmp_path)).collect()
    assert asked == [None] and len(found) == 20 and np.isfinite([r["log_p"] for r in found]).all()

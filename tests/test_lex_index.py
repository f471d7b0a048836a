"""The kept index: scores and best lists against plain Python, updates against a fresh index, skipped blocks and pruned buckets."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lex_index, lexical

DOCS = "d long, t string"


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(80)] + ["the", "and", "漢字", "ＡＢＣ"]
    weights = [1 / (k + 1) for k in range(84)]
    rows = [(k, " ".join(rnd.choices(words, weights, k=rnd.randrange(1, 40)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "the and"), (n + 3, "w1 " * 5000), (n + 4, "w2 w3"), (n + 4, "w3 w4 w4"), (None, "w1 w2"), (n + 5, "w7"), (n + 5, None)]


def plain_scores(rows, queries, repeats=False):
    texts = defaultdict(list)
    for k, t in rows:
        if k is not None:
            texts[k] += lexical.tokenize(t or "")
    docs = {k: Counter(t) for k, t in texts.items() if t}
    n, avgdl = len(docs), sum(c.total() for c in docs.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    out = {}
    for q, text in queries:
        asked = Counter(lexical.tokenize(text))
        for k, c in docs.items():
            score, matched = 0.0, 0
            for t, times in asked.items():
                if c[t]:
                    idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)
                    times = times if repeats else 1
                    score += times * idf * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / avgdl))
                    matched += times
            if matched:
                out[q, k] = (round(score, 6), matched)
    return out


def ranked(scores, k):
    by = defaultdict(list)
    for (q, d), (s, _) in scores.items():
        by[q].append((-s, d))
    return {(q, d, r + 1) for q, l in by.items() for r, (_, d) in enumerate(sorted(l)[:k])}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = corpus(1500)
    path = str(tmp_path_factory.mktemp("lex") / "index")
    return rows, lex_index.write_index(spark.createDataFrame(rows, DOCS).repartition(6), "d", "t", path, buckets=8, parts=4)


QUERIES = [(0, "w1 w5 w70 the"), (1, "w2 w2 nowhere"), (2, "漢字 abc"), (3, "none of this"), (4, ""), (5, "w79"), (6, "w0 w1 w2 w3 w4 w5 w6"), (7, "w7 w60")]


@pytest.mark.parametrize("repeats", [False, True])
def test_scores_and_best_equal_plain_python(spark, made, repeats):
    rows, index = made
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    want = plain_scores(rows, QUERIES, repeats)
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["matched"]) for r in lex_index.bm25(queries, index, repeats).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in want)
    for k in (1, 5, 5000):
        best = {(r["query_id"], r["doc_id"], r["rank"]) for r in lex_index.best(queries, index, k, repeats).collect()}
        assert best == ranked({x: (got[x][0], 0) for x in got}, k)


def test_blocks_under_the_bar_stay_closed(spark, made):
    rows, index = made
    asked = lex_index.ask(spark.createDataFrame(QUERIES, "query_id long, query string"), index)
    bounds = {(r["query_id"], r["grp"]): r["bound"] for r in lex_index.bounds(asked).collect()}
    grp = {r["doc_id"]: r["grp"] for r in index.hits(list(range(8))).select("grp", "doc_id").collect()}
    for (q, d), (score, _) in plain_scores(rows, QUERIES).items():
        assert bounds[q, grp[d]] >= score - 1e-6
    _, still = lex_index.open_groups(asked, 3)
    opened = {tuple(r) for r in still.select("query_id", "grp").collect()}
    assert opened < bounds.keys() and len(opened) < 0.8 * len(bounds)


def test_only_buckets_of_asked_terms_are_read(spark, made):
    _, index = made
    buckets = index.buckets_of(spark.createDataFrame([("w5",)], "term string"))
    for table in (index.hits(buckets), index.headers(buckets)):
        assert "bucket#" in table._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
        files = {r[0].split("bucket=")[1].split("/")[0] for r in table.select(F.input_file_name()).distinct().collect()}
        assert files == {str(b) for b in buckets} and len(buckets) == 1
    assert index.hits([]).count() == 0


def test_update_equals_a_fresh_index(spark, tmp_path):
    rows = corpus(300, 2)[:300]
    index = lex_index.write_index(spark.createDataFrame(rows, DOCS), "d", "t", str(tmp_path / "a"), buckets=32, parts=4)
    every = list(range(32))
    before = {f for t in (index.hits(every), index.headers(every)) for f in t.inputFiles()}
    changed = [(5, "fresh words here"), (900, "w1 fresh"), (6, None)]
    touched = index.update(spark.createDataFrame(changed, DOCS), spark.createDataFrame([(7,), (8,), (12345,), (None,)], "d long"), "d", "t")
    gone = {5, 6, 7, 8}
    now = [r for r in rows if r[0] not in gone] + changed
    fresh = lex_index.write_index(spark.createDataFrame(now, DOCS), "d", "t", str(tmp_path / "b"), buckets=32, parts=4)
    key = lambda i: sorted(map(tuple, i.hits(every).drop("grp").collect()))
    counted = lambda i: sorted(map(tuple, i.headers(every).groupBy("term").agg(F.sum("n"), F.max("max_tf"), F.min("min_length")).collect()))
    assert key(index) == key(fresh) and counted(index) == counted(fresh) and index.stats().first() == fresh.stats().first()
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, fresh.postings().collect()))
    after = {f for t in (index.hits(every), index.headers(every)) for f in t.inputFiles()}
    left = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert left and left <= after and not (before - left) & after


def test_empty_corpus(spark, tmp_path):
    index = lex_index.write_index(spark.createDataFrame([], DOCS), "d", "t", str(tmp_path / "e"))
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert lex_index.best(queries, index, 3).count() == 0 and lex_index.bm25(queries, index).count() == 0
    assert {r["ratio"] for r in lex_index.known_term_ratio(queries, index).collect()} == {0.0}

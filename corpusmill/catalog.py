"""All registered queries of the library, by inventory id, with DuckDB SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill import catalog_more, catalog_ranking, catalog_records, catalog_relations, catalog_screening, catalog_texts  # noqa: F401  (they register their queries)
from corpusmill.operators import lex_index, lexical, lifecycle, reports, vectors
from corpusmill.plans.runtime import checkpoint
from corpusmill.registry import ORACLES, QUERIES, VEC_SQL, Query, docs, emb, kept_index, on_facts, on_index, on_log, query_vectors, register, tok_sql
from corpusmill.sources.views import facts, queries_table, recall_log, table


@on_facts("a1_active_facts", "SELECT fact_id, kind FROM facts WHERE NOT tombstoned AND age_days >= 7 AND kind NOT IN ('lock_rule', 'rule')")
def a1(s, d):
    return lifecycle.active_facts(facts(s, d)).select("fact_id", "kind")


@on_facts(
    "a7_export_by_kind",
    """, g AS (SELECT kind, md5(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS h, count(*) FILTER (NOT tombstoned) AS live, count(*) FILTER (tombstoned) AS gone FROM facts GROUP BY 1, 2)
    SELECT kind, count(*) FILTER (live > 0) AS entries, sum(greatest(live - 1, 0))::BIGINT AS collapsed, sum(gone)::BIGINT AS tombstoned FROM g GROUP BY 1""",
)
def a7(s, d):
    return lifecycle.export_by_kind(facts(s, d))


@on_facts(
    "a9_entity_index",
    """, x AS (SELECT fact_id, 'topic' AS type, topic AS value FROM facts UNION ALL SELECT fact_id, 'lang', lang FROM facts)
    SELECT type, value, count(DISTINCT fact_id) AS fact_count, min(fact_id) AS first_id, sum(fact_id)::BIGINT AS id_sum FROM x GROUP BY 1, 2""",
)
def a9(s, d):
    return reports.entity_index(facts(s, d))


@on_facts(
    "a11_integrity_scan",
    """SELECT 'rows' AS name, count(*) AS n FROM facts UNION ALL SELECT 'null_content', count(*) FROM facts WHERE content IS NULL
    UNION ALL SELECT 'facts_without_embedding', count(*) FROM facts WHERE fact_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'embeddings_without_fact', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT fact_id FROM facts)""",
)
def a11(s, d):
    return lifecycle.integrity_scan(facts(s, d), emb(s, d))


@on_facts("b1_is_active", "SELECT fact_id FROM facts WHERE NOT tombstoned AND ended_days IS NULL")
def b1(s, d):
    return facts(s, d).where(lifecycle.is_active()).select("fact_id")


@on_facts("b13_retired", "SELECT fact_id, kind, tier FROM facts WHERE NOT tombstoned AND ended_days IS NOT NULL")
def b13(s, d):
    return facts(s, d).where(~F.col("tombstoned") & F.col("ended_days").isNotNull()).select("fact_id", "kind", "tier")


@on_log("b11_recall_trail", "SELECT hit, count(DISTINCT qhash) AS queries, count(*) AS reads FROM (SELECT qhash, unnest([hit_a, hit_b]) AS hit FROM recall_log) GROUP BY 1")
def b11(s, d):
    hits = recall_log(s, d).select("qhash", F.explode(F.array("hit_a", "hit_b")).alias("hit"))
    return hits.groupBy("hit").agg(F.countDistinct("qhash").alias("queries"), F.count("*").alias("reads"))


@on_facts("c7_cross_tier", "SELECT stable_id, count(DISTINCT tier) AS tiers, count(*) AS n FROM facts GROUP BY 1 HAVING count(DISTINCT tier) > 1")
def c7(s, d):
    return facts(s, d).groupBy("stable_id").agg(F.countDistinct("tier").alias("tiers"), F.count("*").alias("n")).where("tiers > 1")


@register("d1_tokenize", f"SELECT doc_id, len({tok_sql('text')}) AS n, md5(array_to_string({tok_sql('text')}, ' ')) AS digest FROM documents")
def d1(s, d):
    t = docs(s, d).select("doc_id", lexical.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@on_index("d2_build_index", "SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY 1")
def d2(s, d):
    return kept_index(s, d).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@on_index(
    "d3_bm25_topk",
    "SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 5",
)
def d3(s, d):
    return lex_index.best(queries_table(s, d), kept_index(s, d), 5, skip=False).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@on_index("d4_bm25_coverage", "SELECT query_id, doc_id, score, matched FROM bm WHERE matched >= 3")
def d4(s, d):
    return lex_index.bm25(queries_table(s, d), kept_index(s, d), least=3)


@on_index(
    "d5_known_term_ratio",
    """SELECT query_id, count(df) AS n_known, round(sum(coalesce(idf, 0)) / sum(coalesce(idf, ln((n + 0.5::DOUBLE) / 0.5::DOUBLE + 1))), 6) AS ratio
    FROM qt LEFT JOIN idf USING (term), st GROUP BY 1""",
)
def d5(s, d):
    return lex_index.known_term_ratio(queries_table(s, d), kept_index(s, d))


@on_index(
    "d6_idf_coverage",
    """, m AS (SELECT query_id, sum(idf) AS mass FROM qt JOIN idf USING (term) GROUP BY 1),
    p AS (SELECT query_id, doc_id, sum(idf) AS part, count(*) AS m FROM qt JOIN idf USING (term) JOIN post USING (term) GROUP BY 1, 2)
    SELECT query_id, round(max(part) / any_value(mass), 6) AS coverage, max(m) AS matched FROM p JOIN m USING (query_id) GROUP BY 1""",
)
def d6(s, d):
    return lex_index.idf_coverage(queries_table(s, d), kept_index(s, d))


@register(
    "e1_vector_topk",
    f"""WITH {VEC_SQL}, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, fact_id) AS r FROM cs),
    f AS (SELECT query_id, fact_id, round(0.8::DOUBLE * cosine + 0.2::DOUBLE * pow(0.5::DOUBLE, age_days / 30), 6) AS score FROM pool JOIN e USING (fact_id) WHERE r <= 40)
    SELECT query_id, fact_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM f) WHERE rank <= 10""",
)
def e1(s, d):
    return vectors.vector_topk(query_vectors(s, d), emb(s, d), 10).withColumn("rank", F.col("rank").cast("long"))


@register(
    "e2_chunk_vector_topk",
    f"WITH {VEC_SQL} SELECT query_id, fact_id, score FROM (SELECT query_id, fact_id, round(cosine, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 6) DESC, fact_id) AS r FROM cs JOIN e USING (fact_id) WHERE age_days <= 60) WHERE r <= 5",
)
def e2(s, d):
    scored = vectors.cosine_scores(query_vectors(s, d), emb(s, d).where("age_days <= 60"), best=5)
    return lexical.top_k(scored.select("query_id", "fact_id", F.round("cosine", 6).alias("score")), 5, item="fact_id").drop("rank")


@register(
    "e3_centroids",
    """WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
    m AS (SELECT label, pos, avg(x) AS m FROM p GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS nrm FROM m GROUP BY 1),
    c AS (SELECT label, count(*) AS members FROM embeddings GROUP BY 1 HAVING count(*) >= 2)
    SELECT label, pos::BIGINT AS pos, members, round(m / nrm, 6) AS x FROM m JOIN n USING (label) JOIN c USING (label)""",
)
def e3(s, d):
    c = vectors.centroids(emb(s, d), "label")
    return c.select("label", "members", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), "members", F.round("x", 6).alias("x"))


@register(
    "g5_semantic_pairs",
    f"""WITH {VEC_SQL.split('cs AS')[0].rstrip().rstrip(',')} SELECT a.fact_id AS a, b.fact_id AS b,
    round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine
    FROM e a JOIN e b ON a.fact_id < b.fact_id WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.35""",
)
def g5(s, d):
    return vectors.cosine_pairs(emb(s, d), 0.35)


@on_index(
    "f4_rrf",
    """, bl AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm),
    cl AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, doc_id) AS rank FROM bm),
    u AS (SELECT * FROM bl WHERE rank <= 20 UNION ALL SELECT * FROM cl WHERE rank <= 20)
    SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM u GROUP BY 1, 2""",
)
def f4(s, d):
    b = checkpoint(lex_index.bm25(queries_table(s, d), kept_index(s, d)))
    return vectors.rrf([lexical.top_k(b, 20), lexical.top_k(b, 20, score="matched")])


@on_facts("g2_upgrade", "SELECT fact_id, 0.7::DOUBLE AS importance FROM facts WHERE importance = 0.5 AND access_count >= 5 AND NOT tombstoned")
def g2(s, d):
    return lifecycle.upgrade(facts(s, d))


@on_facts(
    "g4_promote_private",
    """SELECT fact_id, stable_id FROM facts WHERE tier = 'private' AND importance >= 0.85 AND access_count >= 10 AND distinct_queries_hit >= 3
    AND visibility = 'commons' AND NOT tombstoned AND stable_id NOT IN (SELECT stable_id FROM facts WHERE tier = 'public')""",
)
def g4(s, d):
    return lifecycle.promote_private(facts(s, d))


@on_facts(
    "g1_near_dup_prefix",
    """, f AS (SELECT fact_id, importance, trim(content, ' ') AS body FROM facts WHERE NOT tombstoned AND content IS NOT NULL),
    g AS (SELECT fact_id, substr(body, 1, 30) AS block, list_distinct(CASE WHEN length(body) >= 3 THEN [substr(body, i, 3) for i in range(1, length(body) - 1)] ELSE [body] END) AS g FROM f),
    p AS (SELECT a.fact_id AS a, b.fact_id AS b FROM g a JOIN g b ON a.block = b.block AND a.fact_id <> b.fact_id
      WHERE len(list_intersect(a.g, b.g)) >= 0.7 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))),
    r AS (SELECT fact_id AS id, fact_id AS reach FROM f), c AS (WITH RECURSIVE w AS (SELECT id, reach FROM r UNION SELECT w.id, p.b FROM w JOIN p ON w.reach = p.a) SELECT id, min(reach) AS cls FROM w GROUP BY 1),
    n AS (SELECT cls, count(*) AS n, arg_max(fact_id, (importance, -fact_id)) AS winner FROM c JOIN f ON c.id = f.fact_id GROUP BY 1)
    SELECT id AS fact_id, winner FROM c JOIN n USING (cls) WHERE n > 1""",
)
def g1(s, d):
    return lifecycle.near_dup_prefix(facts(s, d))


@on_facts("h3_as_of_view", "SELECT fact_id FROM facts WHERE age_days >= 10 AND (ended_days IS NULL OR ended_days < 10)")
def h3(s, d):
    return lifecycle.as_of_view(facts(s, d), 10).select("fact_id")


@on_facts(
    "h6_recall_decay",
    """, h AS (SELECT DISTINCT event_id % 100 AS fact_id FROM events)
    SELECT fact_id, round(CASE WHEN h.fact_id IS NOT NULL THEN least(1.0::DOUBLE, importance * 1.05::DOUBLE)
      WHEN confirmed_days > 90 AND importance > 0.1 AND importance * 0.95::DOUBLE >= 0.1 THEN importance * 0.95::DOUBLE ELSE importance END, 6) AS importance,
    access_count + (h.fact_id IS NOT NULL)::INT AS access_count FROM facts LEFT JOIN h USING (fact_id)""",
)
def h6(s, d):
    return lifecycle.recall_decay(facts(s, d), recall_log(s, d).select(F.col("hit_a").alias("fact_id")))


@on_facts("h7_decay_sweep", "SELECT fact_id FROM facts WHERE importance <= 0.5 AND access_count <= 0 AND (confirmed_days IS NULL OR confirmed_days > 30) AND NOT tombstoned")
def h7(s, d):
    return lifecycle.decay_sweep(facts(s, d))


@on_facts(
    "h10_classify_scope",
    """, r AS (SELECT fact_id, CASE WHEN kind IN ('rule', 'user_preference', 'decision') THEN 'kind' WHEN access_count >= 3 THEN 'confirmations' WHEN importance >= 0.7 THEN 'importance' ELSE 'default' END AS reason FROM facts)
    SELECT fact_id, CASE WHEN reason = 'default' THEN 'short_term' ELSE 'long_term' END AS scope, reason, CASE WHEN reason = 'default' THEN 30 ELSE 0 END AS ttl_days FROM r""",
)
def h10(s, d):
    return lifecycle.classify_scope(facts(s, d))


@on_facts(
    "i1_ancestors",
    """, w AS (WITH RECURSIVE t AS (SELECT fact_id AS seed, fact_id AS node, 0 AS depth FROM facts UNION SELECT t.seed, f.parent_id, depth + 1 FROM t JOIN facts f ON t.node = f.fact_id WHERE f.parent_id IS NOT NULL AND depth < 8) SELECT * FROM t)
    SELECT seed, node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1, 2""",
)
def i1(s, d):
    f = facts(s, d)
    edges = f.where("parent_id IS NOT NULL").select(F.col("fact_id").alias("child"), F.col("parent_id").alias("parent"))
    return lifecycle.ancestors(edges, f.select("fact_id"))


@on_log(
    "k1_usage_stats",
    "SELECT tier, count(*) AS reads, count(DISTINCT qhash) AS queries, count(DISTINCT user_id) AS users, round(avg(n_results), 6) AS avg_results, round(avg(used_hint::INT), 6) AS hint_ratio FROM recall_log GROUP BY 1",
)
def k1(s, d):
    return reports.usage_stats(recall_log(s, d))


@on_log(
    "k2_self_eval",
    "SELECT intent, count(*) AS events, count(*) FILTER (top_hit_score >= 0.5) AS hits, count(*) FILTER (n_results = 0) AS empty, round(avg((top_hit_score >= 0.5)::INT), 6) AS hit_rate, round(avg(top_hit_score), 4) AS avg_top FROM recall_log GROUP BY 1",
)
def k2(s, d):
    return reports.self_eval(recall_log(s, d))


@on_log(
    "k3_llm_spend",
    "SELECT tier, intent AS provider, count(*) AS calls, count(*) FILTER (intent = 'error') AS failures, sum(event_id % 1000)::BIGINT AS input_length FROM recall_log GROUP BY GROUPING SETS ((tier), (intent), ())",
)
def k3(s, d):
    calls = recall_log(s, d).select("tier", F.col("intent").alias("provider"), (F.col("intent") != "error").alias("success"), (F.col("event_id") % 1000).alias("input_length"))
    return reports.llm_spend(calls)


@on_facts(
    "k4_importance_histogram",
    "SELECT CASE WHEN importance < 0.25 THEN '0-25' WHEN importance < 0.5 THEN '25-50' WHEN importance < 0.75 THEN '50-75' ELSE '75-100' END AS band, count(*) AS n FROM facts WHERE NOT tombstoned GROUP BY 1",
)
def k4(s, d):
    return reports.importance_histogram(facts(s, d))


@on_facts("k5_growth", "SELECT age_days, count(*) AS n, count(*) FILTER (tombstoned) AS gone FROM facts GROUP BY 1")
def k5(s, d):
    return reports.growth(facts(s, d))


@on_facts(
    "k6_top_keywords",
    "SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(content), '[a-z]{4,}'))) AS word FROM facts) GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
)
def k6(s, d):
    return reports.top_keywords(facts(s, d))


@on_facts("k7_class_distribution", "SELECT tier, kind, count(*) AS n, round(avg(tombstoned::INT), 6) AS gone_ratio FROM facts GROUP BY 1, 2")
def k7(s, d):
    return reports.class_distribution(facts(s, d))


@on_facts(
    "k8_tombstone_ages",
    "SELECT count(*) AS total, count(*) FILTER (confirmed_days <= 30) AS recent_30d, count(*) FILTER (confirmed_days > 30) AS old, count(*) FILTER (confirmed_days IS NULL) AS no_timestamp FROM facts WHERE tombstoned",
)
def k8(s, d):
    return reports.tombstone_age_buckets(facts(s, d))


@on_facts("k12_recent_capture", "SELECT kind, fact_id, rank FROM (SELECT kind, fact_id, row_number() OVER (PARTITION BY kind ORDER BY age_days, fact_id)::INT AS rank FROM facts) WHERE rank <= 3")
def k12(s, d):
    return reports.recent_capture(facts(s, d), "kind")


@on_facts(
    "k16_governance",
    """, g AS (SELECT substr(content, 1, 60) AS head, count(*) AS n, count(DISTINCT content) AS u, count(*) FILTER (confirmed_days IS NULL) AS m FROM facts GROUP BY 1)
    SELECT sum(n)::BIGINT AS rows, sum(m)::BIGINT AS unconfirmed, sum(n - u)::BIGINT AS exact_dups, sum(n - 1)::BIGINT AS prefix_dups FROM g""",
)
def k16(s, d):
    return reports.governance(facts(s, d))


@on_index(
    "l1_hit_mrr",
    """, kw AS (SELECT item_id AS query_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}')))[1:3] AS keywords FROM benchmark),
    r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm),
    ok AS (SELECT query_id, min(rank) AS first, count(*) AS matched FROM r JOIN kw USING (query_id) JOIN documents d USING (doc_id)
      WHERE rank <= 10 AND len(list_filter(keywords, lambda k: contains(lower(d.text), k))) > 0 GROUP BY 1)
    SELECT query_id, coalesce(matched, 0) AS matched, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM kw LEFT JOIN ok USING (query_id)""",
)
def l1(s, d):
    q = queries_table(s, d)
    keywords = F.slice(F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z]{8,}"), F.lit(0)))), 1, 3)
    results = lex_index.best(q, kept_index(s, d), 10, skip=False)
    return reports.hit_mrr(results, q.select("query_id", keywords.alias("keywords")), docs(s, d))


CHUNKS_SQL = """chunks AS (SELECT conv_id * 1000 + turn AS event_id, conv_id % 20 AS user_id,
  epoch(TIMESTAMP '2024-01-01')::BIGINT + conv_id * 10800 + turn * (10 + 10 * (conv_id % 4)) * 60 AS s FROM conversations)"""


@register(
    "m1_session_clusters",
    f"""WITH {CHUNKS_SQL}, g AS (SELECT *, CASE WHEN s - lag(s) OVER w > 1800 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM chunks WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
    c AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s, event_id)::BIGINT AS cluster FROM g)
    SELECT user_id, cluster, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, max(s) - min(s) AS seconds FROM c GROUP BY 1, 2""",
)
def m1(s, d):
    c = table(s, d, "conversations")
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("conv_id") * 10800 + F.col("turn") * (10 + 10 * (F.col("conv_id") % 4)) * 60
    chunks = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), (F.col("conv_id") % 20).alias("user_id"), F.timestamp_seconds(start).alias("ts"))
    return lifecycle.session_clusters(chunks)


@on_log(
    "m4_rate_snapshot",
    """, w AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM recall_log))
    SELECT user_id, max(n) AS most, count(*) AS reads FROM w GROUP BY 1""",
)
def m4(s, d):
    return reports.rate_snapshot(recall_log(s, d))


@register("m6_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def m6(s, d):
    return reports.daily_counts(table(s, d, "events"))


@on_log("m7_distinct_query_hits", "SELECT hit, count(DISTINCT qhash) AS distinct_queries_hit FROM (SELECT qhash, unnest([hit_a, hit_b]) AS hit FROM recall_log) GROUP BY 1")
def m7(s, d):
    return b11(s, d).select("hit", F.col("queries").alias("distinct_queries_hit"))


@register("m7_daily_sketches", None)
def m7_sketches(s, d):
    """The same counts from daily sketches, with the exact number beside the estimate; tests hold the error."""
    reads = recall_log(s, d).select("qhash", "ts", F.explode(F.array("hit_a", "hit_b")).alias("hit"))
    exact = reads.groupBy(F.col("hit").alias("item")).agg(F.countDistinct("qhash").alias("exact"))
    return reports.distinct_of(reports.daily_sketches(reads, "hit", "qhash")).join(exact, "item").select(F.col("item").alias("hit"), "days", "estimate", "exact")


@on_facts("h2_lifecycle", "SELECT fact_id, (age_days - ended_days)::DOUBLE AS lifetime_days, NOT tombstoned AND ended_days IS NULL AS active FROM facts")
def h2(s, d):
    return lifecycle.lifecycle(facts(s, d))


@on_facts("h18_staleness", "SELECT fact_id, age_days, age_days > 30 AS stale FROM facts WHERE NOT tombstoned")
def h18(s, d):
    return lifecycle.staleness(facts(s, d))


@on_facts(
    "b8_promotion_gate",
    "SELECT fact_id, CASE WHEN round(confidence, 6) < 0.5 THEN 'low_confidence' WHEN tier = 'public' AND visibility <> 'commons' THEN 'not_commons' ELSE 'accepted' END AS reason FROM facts",
)
def b8(s, d):
    return lifecycle.promotion_gate(facts(s, d))


@on_facts(
    "h12_scope_stats",
    "SELECT scope_type, count(*) AS n, count(*) FILTER (expires_in_days < 0) AS expired, count(*) FILTER (expires_in_days BETWEEN 0 AND 7) AS expiring FROM facts WHERE NOT tombstoned GROUP BY 1",
)
def h12(s, d):
    return lifecycle.scope_stats(facts(s, d))


@on_facts(
    "i2_descendants",
    """, w AS (WITH RECURSIVE t AS (SELECT fact_id AS seed, fact_id AS node, 0 AS depth FROM facts UNION SELECT t.seed, f.fact_id, depth + 1 FROM t JOIN facts f ON t.node = f.parent_id WHERE depth < 3) SELECT * FROM t)
    SELECT seed, node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1, 2""",
)
def i2(s, d):
    f = facts(s, d)
    edges = f.where("parent_id IS NOT NULL").select(F.col("fact_id").alias("child"), F.col("parent_id").alias("parent"))
    return lifecycle.descendants(edges, f.select("fact_id"), 3)


@on_facts("j15_overview", "SELECT fact_id, substr(split_part(content, chr(10), 1), 1, 320) AS abstract, substr(content, 1, 240) AS overview FROM facts")
def j15(s, d):
    return lifecycle.overview(facts(s, d))


@on_facts("k11_per_user", "SELECT user_id, count(*) AS n, count(*) FILTER (tombstoned) AS gone, round(avg(importance), 6) AS avg_importance, count(DISTINCT kind) AS kinds FROM facts GROUP BY 1")
def k11(s, d):
    return reports.per_user(facts(s, d))


@on_facts(
    "f15_entity_frequency",
    """, x AS (SELECT fact_id, 'topic' AS type, topic AS value FROM facts UNION ALL SELECT fact_id, 'lang', lang FROM facts)
    SELECT type, value, count(DISTINCT fact_id) AS fact_count FROM x GROUP BY 1, 2 ORDER BY fact_count DESC, type, value LIMIT 10""",
)
def f15(s, d):
    return reports.entity_frequency(facts(s, d))


@on_facts("c2_facts_without_vector", "SELECT fact_id FROM facts WHERE fact_id NOT IN (SELECT vec_id FROM embeddings)")
def c2(s, d):
    return facts(s, d).select("fact_id").join(emb(s, d).select("fact_id"), "fact_id", "left_anti")


@on_index(
    "d8_gate_calibration",
    """, m AS (SELECT query_id, sum(idf) AS mass FROM qt JOIN idf USING (term) GROUP BY 1),
    p AS (SELECT query_id, doc_id, sum(idf) AS part FROM qt JOIN idf USING (term) JOIN post USING (term) GROUP BY 1, 2),
    c AS (SELECT query_id, round(max(part) / any_value(mass), 6) AS coverage FROM p JOIN m USING (query_id) GROUP BY 1)
    SELECT threshold::DOUBLE AS threshold, count(*) FILTER (coverage >= threshold) AS passed, round(avg((coverage >= threshold)::INT), 6) AS rate
    FROM c, (VALUES (0.25), (0.5), (0.75), (0.9)) v(threshold) GROUP BY 1""",
)
def d8(s, d):
    return reports.gate_calibration(d6(s, d), "coverage", [0.25, 0.5, 0.75, 0.9])


from corpusmill import catalog_jobs  # noqa: E402, F401  (its streams share the SQL of their batch twins above)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

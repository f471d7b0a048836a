"""Queries of fusion, reranking, reports and retrieval evaluation, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import fusion, lex_index, lexical, reports, vectors
from corpusmill.registry import INDEX_SQL, VEC_SQL, docs, emb, kept_index, on_facts, on_index, query_vectors, register
from corpusmill.sources.views import FACTS_SQL, facts, queries_table, recall_log, table

OUTCOME_WEIGHT = {"success_pattern": 1.2, "lesson": 1.1, "failure_pattern": 0.8}
WEIGHT_SQL = "CASE kind WHEN 'success_pattern' THEN 1.2 WHEN 'lesson' THEN 1.1 WHEN 'failure_pattern' THEN 0.8 ELSE 1.0 END::DOUBLE"
EXPECTED_SQL = "kw AS (SELECT item_id AS query_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}')))[1:3] AS keywords FROM benchmark)"
TOP_SQL = "r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"


def expected(s, d):
    words = F.regexp_extract_all(F.lower("query"), F.lit("[a-z]{8,}"), F.lit(0))
    return queries_table(s, d).select("query_id", F.slice(F.sort_array(F.array_distinct(words)), 1, 3).alias("keywords"))


def best(s, d, k):
    """(query_id, doc_id, score, rank): the k best texts of every benchmark query; these are long, so that no block is skipped."""
    return lex_index.best(queries_table(s, d), kept_index(s, d), k, skip=False).select("query_id", "doc_id", "score", "rank")


def by_fact(df):
    return df.select("query_id", F.col("doc_id").alias("fact_id"), "score")


def vector_list(s, d, k):
    """Cosine lists of the vectors whose id is divisible by 50, numbered from 0 like the text queries."""
    near = vectors.cosine_scores(query_vectors(s, d), emb(s, d), best=k).select(F.floor(F.col("query_id") / 50).alias("query_id"), "fact_id", F.round("cosine", 6).alias("score"))
    return lexical.top_k(near, k, item="fact_id").drop("rank")


LISTS_SQL = f"""{INDEX_SQL.strip()}, {FACTS_SQL}, {VEC_SQL}, {TOP_SQL},
lx AS (SELECT query_id, doc_id AS fact_id, score FROM r WHERE rank <= 20),
vx AS (SELECT query_id // 50 AS query_id, fact_id, score FROM (SELECT query_id, fact_id, round(cosine, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 6) DESC, fact_id) AS n FROM cs) WHERE n <= 20)"""


def on_lists(name, sql):
    return register(name, f"WITH {LISTS_SQL} {sql}")


@on_lists(
    "f1_hybrid_merge",
    f""", mx AS (SELECT query_id, max(abs(score)) AS m FROM lx GROUP BY 1), a AS (SELECT query_id, fact_id, CASE WHEN m > 0 THEN abs(score) / m ELSE 0 END AS lex FROM lx JOIN mx USING (query_id)),
    h AS (SELECT query_id, fact_id, round((0.6::DOUBLE * coalesce(lex, 0) + 0.4::DOUBLE * coalesce(score, 0)) * (1 + 0.3::DOUBLE * (coalesce({WEIGHT_SQL}, 1) - 1)), 6) AS score
      FROM a FULL JOIN vx USING (query_id, fact_id) LEFT JOIN facts USING (fact_id))
    SELECT query_id, fact_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id)::INT AS rank FROM h) WHERE rank <= 10""",
)
def f1(s, d):
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in OUTCOME_WEIGHT.items() for x in kv])[F.col("kind")], F.lit(1.0))
    weighed = facts(s, d).select("fact_id", weight.alias("outcome_weight"))
    return fusion.hybrid_merge(by_fact(best(s, d, 20)), vector_list(s, d, 20), weighed)


@on_facts(
    "f3_anchor_proximity",
    "SELECT fact_id, CASE WHEN x <= 7 THEN 1.0 WHEN x <= 30 THEN 0.7 WHEN x <= 90 THEN 0.4 WHEN x <= 365 THEN 0.2 ELSE 0.0 END::DOUBLE AS proximity FROM (SELECT fact_id, abs(age_days - 20) AS x FROM facts)",
)
def f3(s, d):
    return facts(s, d).select("fact_id", fusion.anchor_proximity(F.col("age_days") - 20).alias("proximity"))


@on_lists("f5_weighted_max", "SELECT query_id, fact_id, round(max(score), 7) AS score FROM (SELECT * FROM lx UNION ALL SELECT query_id, fact_id, 0.5::DOUBLE * score FROM vx) GROUP BY 1, 2")
def f5(s, d):
    return fusion.weighted_max(by_fact(best(s, d, 20)), vector_list(s, d, 20))


@on_index(
    "f6_mmr",
    f""", tk AS (SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM bm) WHERE n <= 50),
    tm AS (SELECT doc_id, list(DISTINCT term) AS terms FROM tok GROUP BY 1), pl AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS s, terms FROM tk JOIN tm USING (doc_id)),
    pick AS (WITH RECURSIVE w AS (
      SELECT query_id, 1 AS k, arg_max(doc_id, (s, -doc_id)) AS doc_id, [arg_max(doc_id, (s, -doc_id))] AS ids, [arg_max(terms, (s, -doc_id))] AS sets FROM pl GROUP BY 1
      UNION ALL SELECT query_id, k + 1, doc_id, list_append(ids, doc_id), list_append(sets, terms) FROM (
        SELECT w.query_id, w.k, w.ids, w.sets, p.doc_id, p.terms, row_number() OVER (PARTITION BY w.query_id ORDER BY
          0.7::DOUBLE * p.s - (1 - 0.7::DOUBLE) * list_max(list_transform(w.sets, lambda t: len(list_intersect(t, p.terms))::DOUBLE / (len(t) + len(p.terms) - len(list_intersect(t, p.terms))))) DESC, p.s DESC, p.doc_id) AS n
        FROM w JOIN pl p ON w.query_id = p.query_id AND w.k < 5 AND NOT list_contains(w.ids, p.doc_id)) WHERE n = 1) SELECT * FROM w)
    SELECT query_id, doc_id, k::BIGINT AS rank FROM pick""",
)
def f6(s, d):
    found = best(s, d, 50).select("query_id", "doc_id", "score")
    top = F.max("score").over(Window.partitionBy("query_id"))
    terms = docs(s, d).select("doc_id", F.array_distinct(lexical.tokens(F.col("text"))).alias("terms"))
    return fusion.mmr(found.withColumn("score", F.col("score") / top).join(terms, "doc_id"), 5)


@on_facts(
    "f14_graph_recall",
    """, x AS (SELECT fact_id, age_days, 'topic' AS type, topic AS value FROM facts UNION ALL SELECT fact_id, age_days, 'lang', lang FROM facts)
    SELECT fact_id, type, value FROM x WHERE contains(value, '1') ORDER BY age_days, fact_id DESC, type LIMIT 20""",
)
def f14(s, d):
    return fusion.graph_recall(facts(s, d), "1")


@on_lists(
    "f20_dedupe_hits",
    """SELECT query_id, fact_id, max(score) AS score, bool_and(i) AS injected FROM (SELECT query_id, fact_id, score, FALSE AS i FROM lx UNION ALL SELECT query_id, fact_id, NULL, TRUE FROM vx) GROUP BY 1, 2""",
)
def f20(s, d):
    return fusion.dedupe_hits(by_fact(best(s, d, 20)), vector_list(s, d, 20))


@on_lists("f22_scope_weight", "SELECT query_id, fact_id, round(CASE WHEN scope_type = 'short_term' THEN 0.85::DOUBLE * score ELSE score END, 6) AS score FROM lx JOIN facts USING (fact_id)")
def f22(s, d):
    return fusion.scope_weight(by_fact(best(s, d, 20)), facts(s, d))


@on_index(
    "f23_set_cosine",
    """, nq AS (SELECT query_id, count(*) AS nq FROM qt GROUP BY 1), ns AS (SELECT doc_id, count(*) AS ns FROM post GROUP BY 1),
    m AS (SELECT query_id, doc_id, count(*) AS m FROM qt JOIN post USING (term) GROUP BY 1, 2),
    c AS (SELECT query_id, doc_id, round(m / sqrt((nq * ns)::DOUBLE), 6) AS score FROM m JOIN nq USING (query_id) JOIN ns USING (doc_id))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM c) WHERE rank <= 5""",
)
def f23(s, d):
    return fusion.set_cosine(kept_index(s, d).postings(), lexical.query_terms(queries_table(s, d)))


@on_lists(
    "f25_multi_scope_merge",
    """, j AS (SELECT query_id, fact_id, tier, score FROM lx JOIN facts USING (fact_id)), z AS (SELECT query_id, fact_id, round(CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END
      * CASE tier WHEN 'public' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM j WINDOW w AS (PARTITION BY query_id, tier))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id)::INT AS rank FROM z) WHERE rank <= 10""",
)
def f25(s, d):
    tiers = facts(s, d).select("fact_id", F.col("tier").alias("scope"))
    return fusion.multi_scope_merge(by_fact(best(s, d, 20)).join(tiers, "fact_id"), {"public": 0.5, "private": 1.0})


@on_index("h17_forget_by_query", f", {TOP_SQL} SELECT query_id, doc_id, score FROM r WHERE rank = 1 AND score >= 5")
def h17(s, d):
    return best(s, d, 1).where("score >= 5").select("query_id", "doc_id", "score")


@on_facts("k9_entity_coverage", "SELECT tier, count(*) AS n, round(avg((topic IS NOT NULL OR lang IS NOT NULL)::INT), 6) AS covered FROM facts GROUP BY 1")
def k9(s, d):
    return reports.entity_coverage(facts(s, d))


@on_facts(
    "k14_initial_report",
    """SELECT 'kind' AS axis, kind AS value, count(*) AS n FROM facts WHERE NOT tombstoned GROUP BY 2 UNION ALL SELECT 'tier', tier, count(*) FROM facts WHERE NOT tombstoned GROUP BY 2
    UNION ALL SELECT 'total', '', count(*) FROM facts WHERE NOT tombstoned""",
)
def k14(s, d):
    return reports.initial_report(facts(s, d))


@on_index(
    "k18_token_savings",
    f""", {TOP_SQL}, x AS (SELECT query_id, sum(least(length(d.text), 240)) / 1.6::DOUBLE AS sent, sum(length(d.text)) / 1.6::DOUBLE AS source FROM r JOIN documents d USING (doc_id) WHERE rank <= 5 GROUP BY 1)
    SELECT count(*) AS queries, round(avg(1 - sent / source), 6) AS mean_saving, round(median(1 - sent / source), 6) AS median_saving FROM x""",
)
def k18(s, d):
    return reports.token_savings(best(s, d, 5), docs(s, d))


@on_facts("k19_topic_index", "SELECT topic, count(DISTINCT user_id) AS peers, round(avg(importance), 6) AS avg_weight, max(importance) AS max_weight FROM facts WHERE importance >= 0.5 GROUP BY 1")
def k19(s, d):
    return reports.topic_index(facts(s, d))


GOLD_SQL = f"""{EXPECTED_SQL}, {FACTS_SQL}, g AS (SELECT query_id, fact_id, importance, len(list_filter(keywords, lambda k: contains(lower(content), k))) AS m FROM kw, facts),
gold AS (SELECT query_id, arg_max(fact_id, (m, importance, -fact_id)) AS gold, max(m) AS m FROM g WHERE m > 0 GROUP BY 1)"""


def gold(s, d):
    return reports.lexical_gold(expected(s, d), facts(s, d))


@on_index(
    "l2_golden_mrr",
    f""", {GOLD_SQL}, {TOP_SQL} SELECT query_id, coalesce(rank <= 10, FALSE) AS hit, round(coalesce(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank END, 0), 6) AS mrr
    FROM gold LEFT JOIN r ON gold.query_id = r.query_id AND gold = doc_id""".replace("SELECT query_id, coalesce", "SELECT gold.query_id, coalesce"),
)
def l2(s, d):
    return reports.golden_mrr(best(s, d, 10), gold(s, d))


@on_index("l3_lexical_gold", f", {GOLD_SQL} SELECT query_id, gold, m AS matched FROM gold")
def l3(s, d):
    return gold(s, d)


HITS_SQL = f"""{EXPECTED_SQL}, {TOP_SQL}, ok AS (SELECT query_id, min(rank) AS first FROM r JOIN kw USING (query_id) JOIN documents d USING (doc_id) WHERE rank <= 10 AND len(list_filter(keywords, lambda k: contains(lower(d.text), k))) > 0 GROUP BY 1),
st AS (SELECT DISTINCT query_id FROM kw, documents d WHERE len(list_filter(keywords, lambda k: contains(lower(d.text), k))) > 0)"""


@on_index("l4_gap_class", f", {HITS_SQL.replace('st AS', 'stored AS')} SELECT query_id, CASE WHEN first IS NOT NULL THEN 'hit' WHEN s.query_id IS NOT NULL THEN 'retrieval_gap' ELSE 'storage_gap' END AS gap FROM kw LEFT JOIN ok USING (query_id) LEFT JOIN stored s USING (query_id)")
def l4(s, d):
    hits = reports.hit_mrr(best(s, d, 10), expected(s, d), docs(s, d))
    return reports.gap_class(hits, gold(s, d))


@on_index(
    "l5_complete_retrieval",
    f""", {EXPECTED_SQL}, {TOP_SQL}, k AS (SELECT query_id, unnest(keywords) AS word FROM kw), c AS (SELECT query_id, word, bool_or(coalesce(contains(lower(d.text), word), FALSE)) AS ok
      FROM k LEFT JOIN (SELECT * FROM r WHERE rank <= 10) USING (query_id) LEFT JOIN documents d USING (doc_id) GROUP BY 1, 2)
    SELECT query_id, count(*) AS n, count(*) FILTER (ok) AS covered, bool_and(ok) AS complete FROM c GROUP BY 1""",
)
def l5(s, d):
    return reports.keyword_coverage(best(s, d, 10), expected(s, d), docs(s, d))


@on_index(
    "l7_retirement_impact",
    f""", {HITS_SQL.split(', ok AS')[0]}, h AS (SELECT query_id, rank, len(list_filter(keywords, lambda k: contains(lower(d.text), k))) > 0 AS ok FROM r JOIN kw USING (query_id) JOIN documents d USING (doc_id) WHERE rank <= 11),
    a AS (SELECT query_id, min(rank) FILTER (ok AND rank <= 10) AS b, min(rank - 1) FILTER (ok AND rank > 1) AS a FROM h GROUP BY 1)
    SELECT query_id, round(coalesce(1.0::DOUBLE / b, 0), 6) AS before, round(coalesce(1.0::DOUBLE / a, 0), 6) AS after FROM a""",
)
def l7(s, d):
    return reports.retirement_impact(best(s, d, 11), expected(s, d), docs(s, d), 10)


@on_index(
    "l9_gate",
    f""", {EXPECTED_SQL}, {TOP_SQL}, k AS (SELECT query_id, unnest(keywords) AS word FROM kw), c AS (SELECT query_id, word, bool_or(coalesce(contains(lower(d.text), word), FALSE)) AS ok
      FROM k LEFT JOIN (SELECT * FROM r WHERE rank <= 10) USING (query_id) LEFT JOIN documents d USING (doc_id) GROUP BY 1, 2)
    SELECT query_id, count(*) FILTER (ok) >= greatest(1, ceil(0.34::DOUBLE * count(*))) AS passed FROM c GROUP BY 1""",
)
def l9(s, d):
    return reports.gate(l5(s, d), 0.34)


@register(
    "m5_incremental_decay",
    f"WITH {FACTS_SQL} SELECT fact_id FROM facts WHERE fact_id > 100 AND importance <= 0.5 AND access_count <= 0 AND (confirmed_days IS NULL OR confirmed_days > 30) AND NOT tombstoned",
)
def m5(s, d):
    from corpusmill.operators.lifecycle import decay_sweep

    return decay_sweep(facts(s, d), since=100)


@register(
    "k13_eval_trend",
    """WITH x AS (SELECT event_type AS variant, date_trunc('day', ts) AS day, round(avg(value), 6) AS score FROM events GROUP BY 1, 2),
    y AS (SELECT *, lag(score) OVER w AS before, row_number() OVER (PARTITION BY variant ORDER BY day DESC) AS back FROM x WINDOW w AS (PARTITION BY variant ORDER BY day))
    SELECT variant, round(max(score) FILTER (back = 1), 6) AS last, round(median(score) FILTER (back <= 3), 6) AS median3, round(max(score - before) FILTER (back = 1), 6) AS delta FROM y GROUP BY 1""",
)
def k13(s, d):
    runs = table(s, d, "events").groupBy(F.col("event_type").alias("variant"), F.date_trunc("day", "ts").alias("run")).agg(F.round(F.avg("value"), 6).alias("score"))
    return reports.eval_trend(runs)


@register("k1_usage_by_user", "SELECT coalesce(user_id, -1) AS user_id, count(*) AS reads, round(avg((event_id % 4 = 0)::INT), 6) AS hint_ratio FROM events GROUP BY ROLLUP (user_id)")
def k1(s, d):
    by = recall_log(s, d).rollup("user_id").agg(F.count("*").alias("reads"), reports.ratio(F.col("used_hint")).alias("hint_ratio"))
    return by.withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


CHUNK_INDEX_SQL = INDEX_SQL.replace("FROM documents", "FROM (SELECT conv_id * 1000 + turn AS doc_id, substr(text, 1, 200) AS text FROM conversations)").replace("SELECT DISTINCT item_id", "SELECT item_id")


@register(
    "d7_chunk_bm25",
    f"WITH {CHUNK_INDEX_SQL} SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM bm) WHERE rank <= 5",
)
def d7(s, d):
    return lex_index.best(queries_table(s, d), kept_index(s, d, "conversations"), 5, repeats=True, skip=False).select("query_id", "doc_id", "score", "rank")


@on_facts(
    "a10_manifest",
    "SELECT tier, count(*) AS n, min(fact_id) AS first_id, max(fact_id) AS last_id, sum(('0x' || substr(md5(coalesce(content, '')), 1, 8))::BIGINT)::BIGINT AS checksum FROM facts GROUP BY 1",
)
def a10(s, d):
    return reports.manifest(facts(s, d), "tier")

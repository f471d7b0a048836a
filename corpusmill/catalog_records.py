"""Queries of logs, exports, peers, versions, invariants and audits, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog_ranking import by_fact, best, by_fact, expected, on_lists
from corpusmill.catalog_relations import quoted
from corpusmill.catalog_screening import EXPECTED_SQL, case_sql, text_sql
from corpusmill.operators import lexical, records, vectors
from corpusmill.operators.records import DISCOURSE, ERROR_NOISE, GATED_KINDS, INTENTS, SIGNALS, UPDATE_KINDS
from corpusmill.registry import VEC_SQL, docs, emb, kept_index, on_facts, on_index, on_log, query_vectors, register
from corpusmill.sources.views import facts, queries_table, recall_log, table

ZONES = [("failure", ["failure_pattern"]), ("lesson", ["lesson"]), ("success", ["success_pattern"]), ("all", [])]
PAIR = "([a-z]{3,}) ([0-9]{4,})"


@on_facts("a2_scan_stores", "SELECT fact_id, kind, tier AS origin, CASE WHEN tier = 'private' THEN user_id END AS user_id FROM facts")
def a2(s, d):
    f = facts(s, d).select("fact_id", "kind", "user_id", "tier")
    stores = {t: f.where(F.col("tier") == t).select("fact_id", "kind", *(["user_id"] if t == "private" else [])) for t in ("public", "source", "private")}
    return records.union_stores(stores).select("fact_id", "kind", "origin", "user_id")


@on_log(
    "a3_read_recall_log",
    "SELECT CASE WHEN event_id % 50 = 0 THEN 'malformed' WHEN ts < TIMESTAMP '2024-01-05' OR ts >= TIMESTAMP '2024-01-25' THEN 'out_of_window' ELSE 'ok' END AS status, count(*) AS n FROM recall_log GROUP BY 1",
)
def a3(s, d):
    line = F.to_json(F.struct("ts", "qhash", "n_results"))
    cut = F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 9)).otherwise(line)
    return records.log_quality(recall_log(s, d).select(cut.alias("line")), "2024-01-05", "2024-01-25")


@register(
    "a4_ingest_log",
    f"""WITH x AS (SELECT doc_id, regexp_extract_all(text, '{PAIR}', 1) AS a, regexp_extract_all(text, '{PAIR}', 2) AS b FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)),
    y AS (SELECT doc_id, unnest(range(len(a)))::INT AS pos, a, b FROM x) SELECT doc_id AS source, pos, a[pos + 1] AS name, b[pos + 1] AS value FROM y""",
)
def a4(s, d):
    rows = docs(s, d).select(F.col("doc_id").alias("source"), "text")
    return records.ingest_log(rows, table(s, d, "labels").select(F.col("doc_id").alias("source")), PAIR)


@on_facts(
    "a8_render_documents",
    """SELECT fact_id, '- [' || kind || '] ' || trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')) AS prompt,
    md5('# ' || kind || ' ' || fact_id || chr(10) || chr(10) || '- tier: ' || tier || chr(10) || '- user: ' || user_id || chr(10) || chr(10) || coalesce(content, '') || chr(10)) AS document_md5 FROM facts WHERE NOT tombstoned""",
)
def a8(s, d):
    return records.render(facts(s, d)).select("fact_id", "prompt", F.md5("document").alias("document_md5"))


@register("b14_read_intent", f"SELECT conv_id, turn, {case_sql('lower(coalesce(text, chr(32)))', INTENTS, text_sql('factual'))} AS intent FROM conversations")
def b14(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", records.read_intent(F.col("text")).alias("intent"))


PEERS_SQL = """pe AS (SELECT user_id AS peer_id, (40 + count(*) * 7) % 100 AS trust, CASE WHEN user_id % 11 = 0 THEN 'quarantine' WHEN user_id % 13 = 0 THEN 'blacklist' ELSE 'friend' END AS kind,
  CASE WHEN user_id % 5 <> 0 THEN 'h' || user_id END AS endpoint, user_id % 7 <> 0 AS outbound, user_id % 3 <> 0 AS online, user_id % 4 <> 0 AS allow_search FROM events WHERE user_id IS NOT NULL GROUP BY 1),
 tp AS (SELECT user_id AS peer_id, event_type AS topic, count(*) / any_value(n) AS weight FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) USING (user_id) GROUP BY 1, 2)"""


def peers(s, d):
    """(peers, topics) from the users of the events."""
    e, u = table(s, d, "events").where("user_id IS NOT NULL"), F.col("user_id")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    kind = F.when(u % 11 == 0, "quarantine").when(u % 13 == 0, "blacklist").otherwise("friend")
    who = n.select(
        u.alias("peer_id"), ((40 + F.col("n") * 7) % 100).alias("trust"), kind.alias("kind"), F.when(u % 5 != 0, F.concat(F.lit("h"), u)).alias("endpoint"),
        (u % 7 != 0).alias("outbound"), (u % 3 != 0).alias("online"), (u % 4 != 0).alias("allow_search"),
    )
    topics = e.groupBy("user_id", "event_type").agg(F.count("*").alias("m")).join(n, "user_id")
    return who, topics.select(u.alias("peer_id"), F.col("event_type").alias("topic"), (F.col("m") / F.col("n")).alias("weight"))


@register(
    "b16_peer_targets",
    f"WITH {PEERS_SQL} SELECT peer_id FROM pe JOIN tp USING (peer_id) WHERE topic = 'view' AND weight >= 0.15 AND trust >= 50 AND kind = 'friend' AND endpoint IS NOT NULL AND outbound",
)
def b16(s, d):
    return records.peer_targets(*peers(s, d), "view", 0.15)


@register(
    "b17_peer_health",
    f"""WITH {PEERS_SQL} SELECT peer_id, CASE WHEN kind = 'quarantine' THEN 'quarantined' WHEN endpoint IS NULL THEN 'unknown' WHEN NOT online THEN 'unreachable' WHEN trust < 30 OR NOT allow_search THEN 'degraded' ELSE 'healthy' END AS health FROM pe""",
)
def b17(s, d):
    return peers(s, d)[0].select("peer_id", records.peer_health().alias("health"))


@on_log("c1_candidate_events", "SELECT event_id, hit_a AS doc_id, intent, lang FROM recall_log JOIN documents ON hit_a = doc_id WHERE intent <> 'error' AND text IS NOT NULL")
def c1(s, d):
    log = recall_log(s, d).where("intent <> 'error'").select("event_id", F.col("hit_a").alias("doc_id"), "intent")
    return log.join(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "lang"), "doc_id")


@on_index("c3_live_postings", ", " + "li AS (SELECT doc_id FROM documents WHERE doc_id % 23 <> 0) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post JOIN li USING (doc_id) GROUP BY 1")
def c3(s, d):
    postings = kept_index(s, d).postings()
    live = facts(s, d).where("NOT tombstoned").select(F.col("fact_id").alias("doc_id"))
    return postings.join(live, "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@on_facts(
    "c8_stale_derived",
    """, v AS (SELECT fact_id AS derived_id, fact_id + CASE WHEN fact_id % 37 = 0 THEN 1000000000 ELSE 0 END AS source_id, sha256(coalesce(content, '') || CASE WHEN fact_id % 19 = 0 THEN '!' ELSE '' END) AS hash FROM facts)
    SELECT derived_id, CASE WHEN fact_id IS NULL THEN 'missing' WHEN tombstoned THEN 'tombstoned' ELSE 'changed' END AS reason FROM v LEFT JOIN facts ON source_id = fact_id WHERE fact_id IS NULL OR tombstoned OR sha256(coalesce(content, '')) <> hash""",
)
def c8(s, d):
    f, i = facts(s, d), F.col("fact_id")
    old = F.sha2(F.concat(F.coalesce("content", F.lit("")), F.when(i % 19 == 0, "!").otherwise("")), 256)
    return records.stale_derived(f.select(i.alias("derived_id"), (i + F.when(i % 37 == 0, 1000000000).otherwise(0)).alias("source_id"), old.alias("hash")), f)


@register(
    "c9_invariants",
    """SELECT 'one_query' AS rule, CAST(qhash AS VARCHAR) || ':' || CAST(user_id AS VARCHAR) AS key, n FROM (SELECT event_id % 500 AS qhash, user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2) WHERE n > 1
    UNION ALL SELECT 'labelled_document', coalesce(CAST(doc_id AS VARCHAR), 'null'), count(*) FROM labels WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY 2
    UNION ALL SELECT 'embedded_document', CAST(vec_id AS VARCHAR), count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) GROUP BY 2
    UNION ALL SELECT 'text', 'text', n FROM (SELECT count(*) AS n FROM documents WHERE coalesce(text, '') = '') WHERE n > 0""",
)
def c9(s, d):
    known = table(s, d, "documents")
    parts = [
        records.duplicate_keys(recall_log(s, d), "one_query", "qhash", "user_id"),
        records.dangling(table(s, d, "labels"), "labelled_document", "doc_id", known, "doc_id"),
        records.dangling(table(s, d, "embeddings"), "embedded_document", "vec_id", known, "doc_id"),
        records.empty_values(known, "text", "text"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@register(
    "e5_cluster_topk",
    f"""WITH {VEC_SQL.split("cs AS")[0].strip().rstrip(",")}, x AS (SELECT label, unnest(range(len(v))) AS p, unnest(v) AS x FROM e), m AS (SELECT label, p, avg(x) AS x FROM x GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY p) AS v FROM m GROUP BY 1),
    r AS (SELECT fact_id AS query_id, c.label::BIGINT AS cluster, round(list_dot_product(e.v, c.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.v, c.v))), 6) AS score FROM e, c WHERE fact_id % 50 = 0)
    SELECT query_id, cluster, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cluster)::INT AS rank FROM r) WHERE rank <= 3""",
)
def e5(s, d):
    summary = vectors.centroids(emb(s, d), "label").select((-1 - F.col("label").cast("long")).alias("fact_id"), F.col("centroid").alias("embedding"))
    near = vectors.cosine_scores(query_vectors(s, d), summary).select("query_id", (-1 - F.col("fact_id")).alias("cluster"), F.round("cosine", 6).alias("score"))
    return lexical.top_k(near, 3, item="cluster")


@register(
    "e7_mixed_dimensions",
    """WITH e AS (SELECT vec_id AS fact_id, CASE WHEN vec_id % 4 = 0 THEN embedding::DOUBLE[] ELSE (embedding::DOUBLE[])[1:32] END AS v FROM embeddings),
    c AS (SELECT q.fact_id AS query_id, e.fact_id, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS score
      FROM (SELECT * FROM e WHERE fact_id % 50 = 0) q JOIN e ON len(q.v) = len(e.v) AND q.fact_id <> e.fact_id)
    SELECT query_id, fact_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id)::INT AS rank FROM c) WHERE rank <= 5""",
)
def e7(s, d):
    v = emb(s, d).withColumn("embedding", F.when(F.col("fact_id") % 4 == 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 32)))
    near = vectors.cosine_scores(v.where("fact_id % 50 = 0").select(F.col("fact_id").alias("query_id"), "embedding"), v, best=5)
    return lexical.top_k(near.select("query_id", "fact_id", F.round("cosine", 6).alias("score")), 5, item="fact_id")


@register(
    "f16_conversation_graph",
    """WITH w AS (SELECT conv_id, turn, role, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{2,}'), lambda w: lower(w))) AS ws FROM conversations),
    x AS (SELECT conv_id, conv_id * 1000 + turn AS id, role, unnest(ws) AS t FROM w), n AS (SELECT a.id AS query_id, b.id AS snippet_id, count(*) AS n FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.t = b.t AND a.role = 'user' AND b.role = 'assistant' GROUP BY 1, 2)
    SELECT query_id, snippet_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, snippet_id)::INT AS rank FROM n) WHERE rank <= 4""",
)
def f16(s, d):
    c = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("scope"), "role", "text")
    asked = c.where("role = 'user'").select(F.col("id").alias("query_id"), "scope", F.col("text").alias("query"))
    return records.conversation_graph(asked, c.where("role = 'assistant'").select(F.col("id").alias("snippet_id"), "scope", "text"))


_LEFT = f"array_to_string(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: lower(regexp_replace(w, '^[,.?!;:()\\[\\]{{}}]+|[,.?!;:()\\[\\]{{}}]+$', '', 'g')) NOT IN ({quoted(DISCOURSE)})), ' ')"


@register("f19_strip_discourse", f"SELECT conv_id, turn, CASE WHEN length({_LEFT}) < greatest(4, length(text) // 4) THEN text ELSE {_LEFT} END AS query FROM conversations")
def f19(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", records.strip_discourse(F.col("text")).alias("query"))


@on_lists(
    "f21_explore",
    """, j AS (SELECT r.*, access_count FROM r JOIN facts ON doc_id = fact_id WHERE rank <= 20), dp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY access_count, rank) AS n FROM j WHERE rank > 5 AND query_id % 3 = 0)
    SELECT query_id, doc_id AS fact_id, rank::INT AS rank, FALSE AS explored FROM j WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, (5 + n)::INT, TRUE FROM dp WHERE n <= 2""",
)
def f21(s, d):
    ranked = best(s, d, 20).select("query_id", F.col("doc_id").alias("fact_id"), "rank")
    return records.explore(ranked, facts(s, d), share=3)


@on_log(
    "f24_merge_peer_results",
    """, r AS (SELECT qhash AS query_id, user_id AS peer_id, event_id AS item, top_hit_score AS relevance, row_number() OVER (PARTITION BY qhash ORDER BY top_hit_score DESC, event_id, user_id)::INT AS rank FROM recall_log WHERE top_hit_score IS NOT NULL) SELECT * FROM r WHERE rank <= 10""",
)
def f24(s, d):
    return records.merge_peer_results(recall_log(s, d).where("top_hit_score IS NOT NULL").select(F.col("qhash").alias("query_id"), "user_id", F.col("event_id").alias("item"), F.col("top_hit_score").alias("relevance")).withColumnRenamed("user_id", "peer_id"))


_BARE = "regexp_replace(regexp_replace(text, '[A-Za-z]:\\\\[^\\s]+|[^\\s]*[/\\\\][^\\s]+\\.[A-Za-z0-9_]{1,5}', ' ', 'g'), '0x[0-9a-fA-F]+', ' ', 'g')"


@register(
    "f26_error_query",
    f"""WITH x AS (SELECT conv_id, turn, list_filter(regexp_extract_all({_BARE}, '[A-Za-z_][A-Za-z0-9_]+'), lambda w: lower(w) NOT IN ({quoted(ERROR_NOISE)})) AS l FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter(l, lambda w, i: list_position(l, w) = i)[1:12], ' ') AS query FROM x""",
)
def f26_query(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", records.error_query(F.col("text")).alias("query"))


@on_lists(
    "f26_zone_fallback",
    """, z AS (SELECT query_id, lx.fact_id, score, CASE kind WHEN 'failure_pattern' THEN 0 WHEN 'lesson' THEN 1 WHEN 'success_pattern' THEN 2 ELSE 3 END AS z FROM lx JOIN facts USING (fact_id) WHERE score >= 5),
    f AS (SELECT *, min(z) OVER (PARTITION BY query_id) AS b FROM z), r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id)::INT AS rank FROM f WHERE z = b OR b = 3)
    SELECT query_id, (['failure', 'lesson', 'success', 'all'])[b + 1] AS zone, fact_id, rank FROM r2 WHERE rank <= 3""",
)
def f26(s, d):
    return records.zone_fallback(by_fact(best(s, d, 20)).where("score >= 5"), facts(s, d), ZONES)


@on_facts(
    "h5_resolve_conflicts",
    f""", n AS (SELECT * FROM facts WHERE fact_id % 10 = 0 AND kind IN ({quoted(UPDATE_KINDS)})), o AS (SELECT * FROM facts WHERE kind IN ({quoted(GATED_KINDS)}) AND NOT tombstoned AND ended_days IS NULL)
    SELECT o.fact_id, min(n.fact_id) AS gated_by, round(any_value(o.importance) * 0.5::DOUBLE, 4) AS importance FROM o JOIN n ON o.fact_id <> n.fact_id AND (o.user_id = n.user_id OR o.user_id IS NULL) AND (o.topic = n.topic OR o.lang = n.lang) GROUP BY 1""",
)
def h5(s, d):
    f = facts(s, d)
    return records.resolve_conflicts(f.where("fact_id % 10 = 0"), f)


@on_log(
    "h9_stagnation",
    """, n AS (SELECT DISTINCT ts::DATE AS run FROM recall_log ORDER BY run DESC LIMIT 5), l AS (SELECT ts::DATE AS run, unnest([{'dim': 'intent', 'value': intent}, {'dim': 'tier', 'value': tier}], recursive := true) FROM recall_log WHERE ts::DATE IN (SELECT run FROM n)),
    c AS (SELECT run, dim, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, dim ORDER BY n DESC, value) AS r FROM c) WHERE r = 1),
    t AS (SELECT dim, value, count(*) AS runs FROM b GROUP BY 1, 2) SELECT dim, value, runs, runs >= 4 AS stagnant FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY runs DESC, value) AS r FROM t) WHERE r = 1""",
)
def h9(s, d):
    return records.stagnation(recall_log(s, d).select(F.to_date("ts").alias("run"), "intent", "tier"), ["intent", "tier"])


@register(
    "h14_restore",
    """WITH x AS (SELECT user_id AS fact_id, event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 7 <> 0 AND props IS NOT NULL AS ok FROM events WHERE user_id IS NOT NULL)
    SELECT fact_id, count(*) AS versions, arg_max(k, event_id) FILTER (ok) AS k FROM x GROUP BY 1""",
)
def h14(s, d):
    log = table(s, d, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("fact_id"), F.col("event_id").alias("version"), F.when(F.col("event_id") % 7 != 0, F.col("props")).otherwise("broken").alias("old_state"))
    return records.restore(log, "k long").select("fact_id", "versions", F.col("state.k").alias("k"))


def signals_sql(c: str) -> str:
    """The list of signals of a text, in order."""
    has = {n: f"regexp_matches({c}, {text_sql(p)})" for n, p in SIGNALS}
    arms = [("singular", has["singular"]), ("plural", f"({has['plural']} AND ({has['marker']} OR {has['travel']}))"), ("emotion", has["emotion"]), ("contact", has["contact"])]
    return "list_filter([" + ", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x in arms) + "], lambda x: x IS NOT NULL)"


@on_facts("j5_signals", f"SELECT fact_id, array_to_string({signals_sql('content')}, ',') AS signals FROM facts WHERE len({signals_sql('content')}) > 0")
def j5(s, d):
    return facts(s, d).select("fact_id", records.signals(F.col("content")).alias("x")).where(F.size("x") > 0).select("fact_id", F.array_join("x", ",").alias("signals"))


@on_facts(
    "j24_metadata_entities",
    """, x AS (SELECT fact_id, CASE WHEN fact_id % 2 = 0 THEN list_filter([CASE WHEN parent_id IS NOT NULL THEN 'evidence:' || parent_id END, CASE WHEN topic <> '' THEN 'topic:' || topic END], lambda e: e IS NOT NULL) ELSE [] END AS m,
      list_transform(regexp_extract_all(coalesce(content, ''), '[A-Z][a-zA-Z]{2,}')[1:12], lambda w: 'keyword:' || lower(w)) AS w FROM facts), y AS (SELECT fact_id, CASE WHEN len(m) > 0 THEN m ELSE w END AS l FROM x)
    SELECT fact_id, array_to_string(list_filter(l, lambda e, i: list_position(l, e) = i)[1:32], '|') AS entities FROM y""",
)
def j24(s, d):
    even = F.col("fact_id") % 2 == 0
    parents = F.when(even & F.col("parent_id").isNotNull(), F.array("parent_id"))
    found = records.metadata_entities(parents, F.lit(None).cast("array<string>"), F.when(even, F.col("topic")), F.col("content"))
    return facts(s, d).select("fact_id", F.array_join(found, "|").alias("entities"))


@on_facts(
    "k15_reflection_summary",
    """, f AS (SELECT * FROM facts WHERE NOT tombstoned AND age_days <= 30), w AS (SELECT importance, unnest(list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[a-z]{4,}'))) AS name FROM f)
    SELECT 'kind' AS part, kind AS name, count(*) AS n, round(avg(importance), 6) AS importance FROM f GROUP BY 2 UNION ALL SELECT 'topic', topic, count(*), round(avg(importance), 6) FROM f WHERE topic IS NOT NULL GROUP BY 2
    UNION ALL (SELECT 'word', name, count(*) AS n, round(avg(importance), 6) FROM w GROUP BY 2 ORDER BY n DESC, name LIMIT 10)""",
)
def k15(s, d):
    return records.reflection_summary(facts(s, d))


@on_facts(
    "k17_tier_audit",
    f""", f AS (SELECT * FROM facts WHERE NOT tombstoned), x AS (SELECT 'tier' AS part, tier AS name FROM f UNION ALL SELECT 'visibility', visibility FROM f UNION ALL SELECT 'kind', kind FROM f UNION ALL SELECT 'leak', unnest({signals_sql("content")}) FROM f WHERE tier = 'public')
    SELECT part, name, count(*) AS n FROM x GROUP BY 1, 2""",
)
def k17(s, d):
    return records.tier_audit(facts(s, d))


@register(
    "k20_signal_matrix",
    f"""WITH x AS (SELECT toxic = 1 AS p, {signals_sql("text")} AS s FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL), y AS (SELECT p, s, unnest(['singular', 'plural', 'emotion', 'contact', 'any']) AS signal FROM x),
    z AS (SELECT p, signal, CASE WHEN signal = 'any' THEN len(s) > 0 ELSE list_contains(s, signal) END AS h FROM y)
    SELECT signal, count(*) FILTER (p AND NOT h) AS leaks, count(*) FILTER (NOT p AND h) AS false_blocks, count(*) FILTER (p AND h) AS caught FROM z GROUP BY 1""",
)
def k20(s, d):
    marks = table(s, d, "labels").where("toxic IS NOT NULL").select("doc_id", (F.col("toxic") == 1).alias("private"))
    return records.signal_matrix(docs(s, d).join(marks, "doc_id"))


@on_lists(
    "l6_usage_rate",
    f""", {EXPECTED_SQL}, j AS (SELECT r.query_id, rank, ended_days IS NULL AND NOT tombstoned AND length(trim(content)) >= 24 AS ok FROM r JOIN kw USING (query_id) JOIN facts ON doc_id = fact_id WHERE rank <= 10 AND len(list_filter(keywords, lambda k: contains(lower(content), k))) > 0),
    f AS (SELECT query_id, min(rank) AS r1, arg_min(ok, rank) AS ok FROM j GROUP BY 1), c AS (SELECT count(*) AS queries, count(r1) AS found, count(*) FILTER (r1 <= 5) AS cited, count(*) FILTER (coalesce(ok, FALSE)) AS usable FROM kw LEFT JOIN f USING (query_id))
    SELECT *, round(CASE WHEN found > 0 THEN 100.0::DOUBLE * (found - usable) / found ELSE 0 END, 4) AS gap FROM c""",
)
def l6(s, d):
    top = best(s, d, 10).select("query_id", F.col("doc_id").alias("fact_id"), "rank")
    return records.usage_rate(top, expected(s, d), facts(s, d))


@on_log(
    "l8_snapshot_ratchet",
    """, u AS (SELECT intent AS variant, ts::DATE AS run, round(avg(top_hit_score), 6) AS score FROM recall_log WHERE top_hit_score IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT *, list_sort(list(score) OVER (PARTITION BY variant ORDER BY run ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS l FROM u), p AS (SELECT *, l[len(l) // 2 + 1] AS med FROM m),
    q AS (SELECT *, list(med) OVER (PARTITION BY variant ORDER BY run) AS ms FROM p) SELECT variant, run::VARCHAR AS run, round(med, 6) AS median, round(list_reduce(ms, lambda a, b: CASE WHEN b >= a + 0.005::DOUBLE THEN b ELSE a END), 6) AS snapshot FROM q""",
)
def l8(s, d):
    log = recall_log(s, d).where("top_hit_score IS NOT NULL").groupBy(F.col("intent").alias("variant"), F.to_date("ts").alias("run")).agg(F.round(F.avg("top_hit_score"), 6).alias("score"))
    return records.snapshot_ratchet(log).withColumn("run", F.col("run").cast("string"))


@on_facts(
    "l10_build_holdout",
    f""", c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_-]{{4,}}')) AS w FROM benchmark WHERE item_id % 4 = 0),
    f AS (SELECT fact_id, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z0-9_-]{{4,}}'))) AS w FROM facts WHERE NOT tombstoned AND importance >= 0.85 AND kind NOT IN ('lock_rule', 'rule', 'mental_model', 'knowledge_page')
      AND NOT regexp_matches(content, '^(cd |cp |powershell|python |git |mkdir |ls |cat )') AND NOT regexp_matches(content, {text_sql(SIGNALS[-1][1])}))
    SELECT fact_id, count(*) AS n_words, count(c.w) AS covered FROM f LEFT JOIN c USING (w) GROUP BY 1 HAVING count(c.w) <= 0.5 * count(*)""",
)
def l10(s, d):
    return records.build_holdout(facts(s, d), queries_table(s, d).where("query_id % 4 = 0"))

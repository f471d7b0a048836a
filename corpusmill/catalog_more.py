"""Queries of path scores, reflection, entities, private spans, two-level search, planned changes and chains, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog_ranking import OUTCOME_WEIGHT, WEIGHT_SQL, on_lists, vector_list
from corpusmill.catalog_relations import candidates, words_sql
from corpusmill.catalog_screening import case_sql, text_sql
from corpusmill.catalog_texts import noted, on_notes
from corpusmill.operators import changes, coreference, entities, fusion, lifecycle, private, reflection, relations, screening, vectors
from corpusmill.operators.lexical import top_k
from corpusmill.operators.relations import NEGATIONS
from corpusmill.plans.chain import Registry
from corpusmill.plans.runtime import checkpoint
from corpusmill.registry import VEC_SQL, docs, emb, on_facts, on_log, query_vectors, register
from corpusmill.sources.views import facts, queries_table, recall_log

RELATION_SQL = f"""p1 AS (SELECT *, len(wa)::DOUBLE AS na, len(wb)::DOUBLE AS nb, len(list_intersect(wa, wb))::DOUBLE AS m, len(list_intersect(ea, eb))::DOUBLE AS em, len(list_distinct(ea)) AS xa, len(list_distinct(eb)) AS xb FROM p0),
    p2 AS (SELECT *, CASE WHEN na + nb > 0 THEN m / (na + nb - m) ELSE 0 END AS j, CASE WHEN xa + xb > 0 THEN em / (xa + xb - em) ELSE 0 END AS e, abs(length(ta) - length(tb)) AS gap,
      (len(list_intersect(wa, [{", ".join(f"'{w}'" for w in NEGATIONS)}])) > 0) <> (len(list_intersect(wb, [{", ".join(f"'{w}'" for w in NEGATIONS)}])) > 0) AS flip FROM p1),
    p3 AS (SELECT *, CASE WHEN na = 0 OR nb = 0 THEN ('none', 0.0::DOUBLE) WHEN flip AND (j > 0.3 OR e > 0) THEN ('conflict', greatest(j, e)) WHEN j >= 0.6 AND gap < 50 AND abs(na - nb) < 3 THEN ('repeat', j)
      WHEN j >= 0.6 THEN ('corroboration', j) WHEN m / na >= 0.7 AND m / nb < 0.7 AND nb > na THEN ('clarification', m / na) WHEN e >= 0.5 AND j >= 0.2 THEN ('clarification', e) WHEN e >= 0.5 THEN ('new_fact', e)
      WHEN xa > 0 AND xb > 0 AND e = 0 THEN ('new_fact', 0.5::DOUBLE) WHEN j < 0.1 AND e < 0.1 THEN ('none', 0.0::DOUBLE) ELSE ('none', greatest(j, e) * 0.5::DOUBLE) END AS rel FROM p2)"""


@on_lists(
    "f12_path_score",
    f""", w0 AS (SELECT DISTINCT fact_id, regexp_extract_all(lower(coalesce(content, '')), '[a-z]{{4,}}') AS l, content, topic, lang, confidence, access_count FROM facts WHERE fact_id IN (SELECT fact_id FROM lx)),
    w1 AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] AS k FROM w0),
    w2 AS (SELECT query_id, fact_id, {words_sql("b.text")} AS q, {words_sql("content")} AS c, {words_sql("array_to_string(k, ' ')")} AS kw, {words_sql("concat_ws(' ', topic, lang)")} AS en, confidence, access_count
      FROM lx JOIN w1 USING (fact_id) JOIN benchmark b ON query_id = b.item_id),
    w3 AS (SELECT *, len(list_intersect(q, c))::DOUBLE AS m FROM w2),
    di AS (SELECT query_id, fact_id, CASE WHEN len(q) = 0 OR len(c) = 0 THEN 0.05::DOUBLE ELSE greatest(0.05::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * m / (len(q) + len(c) - m) + 0.25::DOUBLE * len(list_intersect(q, kw)) / len(q)
      + 0.25::DOUBLE * len(list_intersect(q, en)) / len(q) + 0.1::DOUBLE * (greatest(0, least(1, confidence)) + least(1, access_count / 10)) / 2)) END AS direct FROM w3),
    top AS (SELECT query_id, doc_id AS fact_id, rank FROM r WHERE rank <= 20),
    pr AS (SELECT DISTINCT a.fact_id AS x, b.fact_id AS y FROM top a JOIN top b USING (query_id) WHERE a.fact_id <> b.fact_id),
    p0 AS (SELECT x, y, fa.content AS ta, fb.content AS tb, {words_sql("fa.content")} AS wa, {words_sql("fb.content")} AS wb, list_filter([fa.topic, fa.lang], lambda z: z IS NOT NULL) AS ea, list_filter([fb.topic, fb.lang], lambda z: z IS NOT NULL) AS eb
      FROM pr JOIN facts fa ON x = fa.fact_id JOIN facts fb ON y = fb.fact_id), {RELATION_SQL},
    sp AS (SELECT a.query_id, a.fact_id, b.fact_id AS other, b.rank, round(round(rel[2], 6) * CASE rel[1] WHEN 'corroboration' THEN 1.0 WHEN 'clarification' THEN 0.7 WHEN 'new_fact' THEN 0.5 WHEN 'repeat' THEN 0.3 WHEN 'conflict' THEN -0.3 ELSE 0 END::DOUBLE, 6) AS s
      FROM top a JOIN top b USING (query_id) JOIN p3 ON a.fact_id = x AND b.fact_id = y),
    s1 AS (SELECT *, count(*) FILTER (s < 0) OVER w AS g FROM sp WINDOW w AS (PARTITION BY query_id, fact_id ORDER BY rank)),
    s2 AS (SELECT *, count(*) FILTER (s > 0) OVER (PARTITION BY query_id, fact_id, g ORDER BY rank) AS len FROM s1),
    s3 AS (SELECT *, min(CASE WHEN s > 0 AND len >= 6 THEN rank END) OVER (PARTITION BY query_id, fact_id) AS stop FROM s2),
    s4 AS (SELECT * FROM s3 WHERE s > 0 AND (stop IS NULL OR rank <= stop)),
    be AS (SELECT query_id, fact_id, max(s) AS best FROM s4 GROUP BY 1, 2),
    bp AS (SELECT query_id, fact_id, best, min(rank) AS last_rank, arg_min(g, rank) AS bg FROM s4 JOIN be USING (query_id, fact_id) WHERE s = best GROUP BY 1, 2, 3),
    ch AS (SELECT query_id, fact_id, any_value(best) AS best, string_agg(other::VARCHAR, ',' ORDER BY rank) AS chain FROM s4 JOIN bp USING (query_id, fact_id) WHERE g = bg AND rank <= last_rank GROUP BY 1, 2)
    SELECT query_id, fact_id, round(direct, 6) AS direct, round(least(0.3::DOUBLE, coalesce(best, 0)), 6) AS boost, round(least(1.0::DOUBLE, direct + least(0.3::DOUBLE, coalesce(best, 0))), 6) AS path, coalesce(chain, '') AS chain
    FROM di LEFT JOIN ch USING (query_id, fact_id)""",
)
def f12(s, d):
    """Support of each query's 20 best documents by the other 19."""
    c = F.col
    f = facts(s, d).select("fact_id", "content", "topic", "lang", "confidence", "access_count")
    found = checkpoint(candidates(s, d))
    listed = top_k(found, 20, item="fact_id").select("query_id", "fact_id", "rank")
    use = relations.usefulness(c("query"), c("content"), screening.keywords(c("content")), F.array("topic", "lang"), c("confidence"), c("access_count"))
    direct = found.join(f, "fact_id").join(queries_table(s, d), "query_id").select("query_id", "fact_id", use.alias("direct"))
    both = listed.select("query_id", "fact_id").join(listed.select("query_id", c("fact_id").alias("other"), "rank"), "query_id").where("fact_id <> other")
    named = f.select("fact_id", "content", F.array_compact(F.array("topic", "lang")).alias("entities"))
    pairs = both.select("fact_id", "other").distinct().join(named.toDF("fact_id", "a_text", "a_entities"), "fact_id").join(named.toDF("other", "b_text", "b_entities"), "other")
    related = relations.pair_relation(pairs).select("fact_id", "other", "relation", "confidence")
    return reflection.path_scores(found, both.join(related, ["fact_id", "other"]), direct)


_LINKED = """, t AS (SELECT fact_id, kind, scope_type, importance, age_days, confidence, length(content) AS n, list_distinct(list_transform(regexp_extract_all(content, '[a-zA-Z一-鿿]{4,}'), lambda w: lower(w))) AS ws
      FROM facts WHERE NOT tombstoned AND length(content) > 0),
    e AS (SELECT a.fact_id AS a, b.fact_id AS b FROM t a JOIN t b ON a.kind = b.kind AND a.scope_type = b.scope_type AND a.fact_id <> b.fact_id
      WHERE greatest(a.n, b.n) <= 2 * least(a.n, b.n) AND len(list_intersect(a.ws, b.ws)) >= 3),
    c AS (WITH RECURSIVE w AS (SELECT fact_id AS id, fact_id AS reach FROM t UNION SELECT w.id, e.b FROM w JOIN e ON w.reach = e.a) SELECT id, min(reach) AS cluster FROM w GROUP BY 1),
    k AS (SELECT cluster FROM c GROUP BY 1 HAVING count(*) > 1), m AS (SELECT id AS fact_id, cluster FROM c JOIN k USING (cluster))"""


@on_facts("g7_reflection_clusters", f"{_LINKED} SELECT fact_id, cluster FROM m")
def g7(s, d):
    return reflection.clusters(facts(s, d))


@on_facts(
    "g8_merge_numbers",
    f"""{_LINKED}, j AS (SELECT fact_id, cluster, kind, importance, age_days, confidence FROM m JOIN t USING (fact_id)),
    b AS (SELECT cluster, arg_max(fact_id, (importance, -age_days, confidence, -fact_id)) AS winner, max(importance) AS top, count(*) AS n FROM j GROUP BY 1)
    SELECT fact_id, cluster, winner, round(CASE WHEN fact_id = winner THEN least(1.0::DOUBLE, top + 0.1::DOUBLE) ELSE importance END, 6) AS importance,
      round(CASE WHEN fact_id = winner THEN least(0.99::DOUBLE, confidence + 0.1::DOUBLE * (n - 1)) ELSE confidence * 0.7::DOUBLE END, 6) AS confidence,
      fact_id <> winner AND kind NOT IN ('lock_rule', 'rule', 'mental_model', 'knowledge_page') AS tombstoned FROM j JOIN b USING (cluster)""",
)
def g8(s, d):
    return reflection.merge_numbers(g7(s, d), facts(s, d))


@register("g8_merged_parts", None)
def g8_parts(s, d):
    """Which texts, in which order, make each cluster's merged text; held against plain Python."""
    return reflection.merged_parts(g8(s, d).select("fact_id", "cluster", "winner"), facts(s, d))


@on_facts(
    "g11_recurring_success",
    """, t AS (SELECT fact_id, tier, list_distinct(regexp_extract_all(content, '[A-Za-z0-9_]+|[一-鿿]')) AS ws FROM facts WHERE NOT tombstoned AND kind = 'success_pattern' AND content IS NOT NULL)
    SELECT a.fact_id, count(*) AS similar, any_value(a.tier) <> 'public' AND count(*) >= 3 AS promoted FROM t a JOIN t b ON a.tier = b.tier WHERE len(a.ws) > 0 AND len(b.ws) > 0
      AND round(len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))::DOUBLE, 9) >= 0.3 GROUP BY 1""",
)
def g11(s, d):
    return reflection.recurring_success(facts(s, d))


@register(
    "e4_two_level",
    f"""WITH {VEC_SQL}, p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM p GROUP BY 1, 2),
    ce AS (SELECT label, list(m ORDER BY pos) AS c FROM m JOIN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 2) USING (label) GROUP BY 1),
    q AS (SELECT fact_id AS query_id, v FROM e WHERE fact_id % 50 = 0),
    l1 AS (SELECT query_id, label FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))) DESC, label) AS n FROM q, ce) WHERE n <= 3),
    l2 AS (SELECT query_id, fact_id, round(cosine, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 6) DESC, fact_id)::INT AS rank FROM cs JOIN e USING (fact_id) JOIN l1 USING (query_id, label))
    SELECT query_id, fact_id, score, rank FROM l2 WHERE rank <= 10""",
)
def e4(s, d):
    return vectors.two_level_topk(query_vectors(s, d), emb(s, d), "label").select("query_id", "fact_id", "score", "rank")


_STOP = ", ".join(f"'{w}'" for w in entities.NOT_NAMES)
_WORDS = r"list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '%s') AND w NOT IN (" + _STOP + "))"
_NAMED = " || ".join(
    f"list_transform({values}, lambda v: {{'type': '{kind}', 'value': trim(v)}})"
    for kind, values in [
        ("person", _WORDS % "^[A-Z][a-zA-Z]{1,30}$"), ("time", r"regexp_extract_all(t, '\b[0-9]{4}-[0-9]{1,2}(?:-[0-9]{1,2})?\b')"), ("topic", _WORDS % "^[A-Z]{2,5}$"), ("topic", f"regexp_extract_all(t, {text_sql(entities.QUOTED)}, 1)"),
    ]
)


@on_notes(
    "j14_extract_entities",
    f""", x AS (SELECT fact_id, list_filter({_NAMED}, lambda z: z.value <> '') AS l FROM (SELECT fact_id, regexp_replace(t, '老板 went|用户决定: x', '', 'g') AS t FROM nt)),
    y AS (SELECT fact_id, l, list_transform(l, lambda z: z.type || '|' || lower(z.value)) AS k FROM x), z AS (SELECT fact_id, list_filter(l, lambda v, i: list_position(k, k[i]) = i)[1:16] AS l FROM y)
    SELECT fact_id, pos, l[pos].type AS type, substr(l[pos].value, 1, 128) AS value FROM (SELECT fact_id, l, unnest(range(1, len(l) + 1)) AS pos FROM z)""",
)
def j14(s, d):
    """Entities of the led texts, two ideograph phrases taken out, whose context rules SQL cannot say; tests hold those."""
    t = F.regexp_replace("t", "老板 went|用户决定: x", "")
    found = noted(s, d).select("fact_id", F.posexplode(entities.extract(t)).alias("pos", "e"))
    return found.select("fact_id", (F.col("pos") + 1).cast("long").alias("pos"), "e.type", "e.value")


@register("j1_private_spans", None)
def j1_spans(s, d):
    """Every match of the 44 patterns with its place; patterns look around, which SQL's engine cannot; held against plain Python."""
    return private.pii_spans(docs(s, d), "doc_id", "text")


@register("j2_private_redact", None)
def j2_redact(s, d):
    """Texts redacted by earliest span; held against plain Python."""
    out = private.pii_redact(docs(s, d), "doc_id", "text")
    return out.select("doc_id", F.md5("redacted").alias("digest"), F.length("redacted").alias("n_chars"), "hits", "blocked")


@on_facts(
    "h12_renewals",
    """, h AS (SELECT DISTINCT event_id % 100 AS fact_id FROM events WHERE event_id % 3 = 0),
    x AS (SELECT fact_id, CASE WHEN access_count >= 3 THEN 'promoted' WHEN h.fact_id IS NOT NULL THEN 'renewed' WHEN expires_in_days < 0 THEN 'demoted' END AS reason
      FROM facts LEFT JOIN h USING (fact_id) WHERE NOT tombstoned AND scope_type = 'short_term')
    SELECT fact_id, CASE WHEN reason = 'promoted' THEN 'long_term' ELSE 'short_term' END AS scope, CASE reason WHEN 'renewed' THEN 30 WHEN 'demoted' THEN 0 ELSE -1 END AS expires_in_days, reason FROM x WHERE reason IS NOT NULL""",
)
def h12_renewals(s, d):
    hits = recall_log(s, d).where("event_id % 3 = 0").select(F.col("hit_a").alias("fact_id"))
    return changes.renewals(facts(s, d), hits).fillna(-1, ["expires_in_days"])


@on_log(
    "h20_retry_actions",
    """, x AS (SELECT event_id AS item_id, CASE intent WHEN 'error' THEN 'error' WHEN 'view' THEN 'running' ELSE 'done' END AS status, n_results AS attempts, event_id % 60 AS age, qhash % 30 AS lease FROM recall_log),
    y AS (SELECT item_id, CASE WHEN status = 'done' AND age > 30 THEN 'purge' WHEN status = 'error' AND attempts >= 5 THEN 'give_up' WHEN status = 'error' THEN 'requeue' WHEN status = 'running' AND lease > 15 THEN 'reclaim' END AS action FROM x)
    SELECT item_id, action FROM y WHERE action IS NOT NULL""",
)
def h20_actions(s, d):
    log = recall_log(s, d)
    status = F.when(F.col("intent") == "error", "error").when(F.col("intent") == "view", "running").otherwise("done")
    items = log.select(F.col("event_id").alias("item_id"), status.alias("status"), F.col("n_results").alias("attempts"), (F.col("event_id") % 60).alias("age_days"), (F.col("qhash") % 30).alias("lease_minutes"))
    return changes.retry_actions(items)


@on_log(
    "h21_trust_changes",
    """, o AS (SELECT user_id AS peer_id, sum(CASE WHEN intent = 'error' THEN -10 ELSE 3 END) AS bump FROM recall_log GROUP BY 1),
    p AS (SELECT DISTINCT user_id AS peer_id, user_id % 101 AS was FROM recall_log), n AS (SELECT peer_id, was, greatest(0, least(100, was + coalesce(bump, 0)))::BIGINT AS trust FROM p LEFT JOIN o USING (peer_id))
    SELECT peer_id, trust, trust < 10 AS quarantined, CASE WHEN trust < 10 THEN was ELSE -1 END AS original FROM n""",
)
def h21_changes(s, d):
    log = recall_log(s, d).where("user_id IS NOT NULL")
    peers = log.select(F.col("user_id").alias("peer_id"), (F.col("user_id") % 101).alias("trust")).distinct()
    return changes.trust_changes(peers, log.select(F.col("user_id").alias("peer_id"), F.when(F.col("intent") == "error", -10).otherwise(3).alias("bump"))).fillna(-1, ["original"])


@on_facts(
    "h1_invalidate_requests",
    """, q AS (SELECT event_id % 1200 AS fact_id, event_id % 40 AS at_days, 'u' || (user_id % 5) AS by_, event_type AS reason FROM events WHERE event_id % 2 = 0),
    f1 AS (SELECT fact_id, arg_max({'at': at_days, 'by_': by_, 'reason': reason}, (at_days, by_, reason)) AS r FROM q GROUP BY 1),
    x AS (SELECT f1.fact_id, r, ended_days, CASE WHEN f.fact_id IS NULL THEN 'missing' WHEN tombstoned THEN 'gone' WHEN ended_days IS NOT NULL THEN 'already' ELSE 'invalidated' END AS status FROM f1 LEFT JOIN facts f USING (fact_id))
    SELECT fact_id, status, coalesce(CASE WHEN status = 'invalidated' THEN r.at ELSE ended_days END, -1)::BIGINT AS ended_days, CASE WHEN status = 'invalidated' THEN r.by_ END AS ended_by, CASE WHEN status = 'invalidated' THEN r.reason END AS reason FROM x""",
)
def h1_requests(s, d):
    e = F.col("event_id")
    asked = recall_log(s, d).where("event_id % 2 = 0").select((e % 1200).alias("fact_id"), (e % 40).alias("at_days"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("by"), F.col("intent").alias("reason"))
    return changes.invalidate_requests(facts(s, d), asked).fillna(-1, ["ended_days"])


@on_facts(
    "a7_export_rows",
    """, b AS (SELECT kind, fact_id, importance, tombstoned, md5(trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g'))) AS h FROM facts),
    l AS (SELECT kind, h, arg_max(fact_id, (importance, -fact_id)) AS fact_id, count(*) AS copies FROM b WHERE NOT tombstoned GROUP BY 1, 2)
    SELECT kind, fact_id, 'entry' AS part, copies FROM l UNION ALL SELECT kind, b.fact_id, CASE WHEN l.fact_id IS NOT NULL THEN 'moved' ELSE 'removed' END, 1 FROM b LEFT JOIN l USING (kind, h) WHERE tombstoned""",
)
def a7_rows(s, d):
    return changes.export_rows(facts(s, d))


@register("j19_coreference", None)
def j19(s, d):
    """Led texts with pronouns replaced from the ten texts before of their user and topic; held against plain Python."""
    f = facts(s, d).select("fact_id", "user_id", "topic", "age_days").join(noted(s, d).select("fact_id", F.col("t").alias("content")), "fact_id")
    dated = f.withColumn("created", -F.col("age_days"))
    out = coreference.resolve_pronouns(dated, ["user_id", "topic"], ["created"])
    return out.select("fact_id", F.md5("resolved").alias("digest"), "changed")


STEPS = Registry()
STEPS.add("live", lambda f: f.where(lifecycle.is_active()), "screen")
STEPS.add("commons", lambda f: f.where("visibility = 'commons'"), "screen")
STEPS.add("weigh", lambda f: f.withColumn("weight", F.round(F.col("importance") * F.col("confidence"), 6)), "score")
STEPS.add("certain", lambda f: f.where("confidence >= 0.5"), "screen")


@on_facts("n1_chain", "SELECT fact_id, round(importance * confidence, 6) AS weight FROM facts WHERE NOT tombstoned AND ended_days IS NULL AND visibility = 'commons' AND round(confidence, 6) >= 0.5")
def n1(s, d):
    """Steps chosen by tag and chained over the facts: all screens, then the scores."""
    sure = facts(s, d).withColumn("confidence", F.round("confidence", 6))
    return STEPS.chain(sure, [*STEPS.select("screen"), *STEPS.select("score")]).select("fact_id", "weight")


@on_notes("g3_classify_noted", f"SELECT * FROM (SELECT fact_id, {case_sql('trim(split_part(t, chr(10), 1))', screening.ZONE_MARKERS)} AS kind FROM nt WHERE fact_id % 7 = 0) WHERE kind IS NOT NULL")
def g3_noted(s, d):
    """Plain facts whose led text begins with a marker."""
    return screening.classify_first_line(noted(s, d).where("fact_id % 7 = 0").select("fact_id", F.col("t").alias("content"), F.lit("fact").alias("kind")))


@on_notes("g14_importance_noted", f"SELECT * FROM (SELECT fact_id, round(0.1::DOUBLE * (fact_id % 10), 6) AS importance, {case_sql('t', screening.BOOSTS)}::DOUBLE AS target FROM nt) WHERE target > importance")
def g14_noted(s, d):
    """Led texts whose signal asks for more importance than a tenth of their id's last digit."""
    return screening.importance_audit(noted(s, d).select("fact_id", F.col("t").alias("content"), F.round(0.1 * (F.col("fact_id") % 10), 6).alias("importance")))


@on_lists(
    "f1_hybrid_full",
    f""", mx AS (SELECT query_id, max(abs(score)) AS m FROM lx GROUP BY 1), a AS (SELECT query_id, fact_id, CASE WHEN m > 0 THEN abs(score) / m ELSE 0 END AS lex FROM lx JOIN mx USING (query_id)),
    q0 AS (SELECT item_id AS query_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}') AS l FROM benchmark), qk AS (SELECT query_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] AS qk FROM q0),
    f0 AS (SELECT *, regexp_extract_all(lower(coalesce(content, '')), '[a-z]{{4,}}') AS l FROM facts), fk AS (SELECT fact_id, kind, list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] AS k, CASE WHEN age_days % 3 = 0 THEN -0.5 WHEN age_days <= 30 THEN 0.7 ELSE 0 END::DOUBLE AS b FROM f0),
    h AS (SELECT query_id, fact_id, (0.6::DOUBLE * coalesce(lex, 0) + 0.4::DOUBLE * coalesce(score, 0)
        + 0.15::DOUBLE * coalesce(CASE WHEN len(qk) + len(k) > 0 THEN len(list_intersect(qk, k))::DOUBLE / (len(qk) + len(k) - len(list_intersect(qk, k))) END, 0))
        * (1 + 0.3::DOUBLE * (coalesce({WEIGHT_SQL}, 1) - 1)) * (1 + CASE WHEN coalesce(b, 0) > 0 THEN 0.4::DOUBLE * b ELSE 0.15::DOUBLE * coalesce(b, 0) END) AS s
      FROM a FULL JOIN vx USING (query_id, fact_id) LEFT JOIN fk USING (fact_id) LEFT JOIN qk USING (query_id))
    SELECT query_id, fact_id, score, rank FROM (SELECT query_id, fact_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, fact_id)::INT AS rank FROM h) WHERE rank <= 10""",
)
def f1_full(s, d):
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in OUTCOME_WEIGHT.items() for x in kv])[F.col("kind")], F.lit(1.0))
    age = F.when(F.col("age_days") % 3 == 0, -0.5).when(F.col("age_days") <= 30, 0.7).otherwise(0.0)
    f = facts(s, d).select("fact_id", weight.alias("outcome_weight"), screening.keywords(F.col("content")).alias("keywords"), age.alias("temporal"))
    asked = queries_table(s, d).select("query_id", screening.keywords(F.col("query")).alias("keywords"))
    return fusion.hybrid_full(candidates(s, d), vector_list(s, d, 20), f, asked)

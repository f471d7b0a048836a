"""Queries of screening rules, planned changes, provenance and text functions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import changes, screening, vectors
from corpusmill.registry import VEC_SQL, emb, on_facts, on_log, register
from corpusmill.sources.views import FACTS_SQL, facts, queries_table, recall_log, table

ROUTES = [
    ("address", 20, r"[a-z0-9.]+@[a-z0-9.]+", "private"),
    ("licence", 10, r"(?i)licen[cs]e", "source"),
    ("numbers", 10, r"[0-9]{4}", "review"),
    ("please", 5, r"(?i)the ", "public"),
]
JUNK = [(r"^[0-9 ]+$", "digits"), (r"(?i)^(spam|smoke|admin) test", "probe"), (r"^.{0,20}$", "tiny"), (r"[0-9]{8}", "number")]
ZONE_SQL = "CASE kind WHEN 'failure_pattern' THEN 'failure' WHEN 'lesson' THEN 'lesson' WHEN 'success_pattern' THEN 'success' ELSE 'other' END"
OUTCOME_SQL = ZONE_SQL.replace("'other'", "'neutral'")
KEYWORDS_SQL = """x5 AS (SELECT fact_id, confidence, regexp_extract_all(lower(coalesce(content, '')), '[a-z]{4,}') AS ws FROM facts),
p5 AS (SELECT fact_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM x5), d5 AS (SELECT fact_id, w, min(p) AS p FROM p5 GROUP BY 1, 2),
n5 AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY p) AS n FROM d5), k5 AS (SELECT fact_id, list(w ORDER BY p) AS k FROM n5 WHERE n <= 5 GROUP BY 1)"""
EXPECTED_SQL = "kw AS (SELECT item_id AS query_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}')))[1:3] AS keywords FROM benchmark)"


def text_sql(value: object) -> str:
    return str(value) if isinstance(value, float) else "'" + str(value).replace("'", "''") + "'"


def case_sql(col: str, rules: list[tuple[str, object]], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN regexp_matches({col}, {text_sql(p)}) THEN {text_sql(v)}" for p, v in rules)
    return f"CASE {arms} ELSE {default} END"


def expected(s, d):
    words = F.regexp_extract_all(F.lower("query"), F.lit("[a-z]{8,}"), F.lit(0))
    return queries_table(s, d).select("query_id", F.slice(F.sort_array(F.array_distinct(words)), 1, 3).alias("keywords"))


GRANTS = [("u1", "admin:root", False, 10), ("u2", "admin:root", True, 10), ("u3", "admin:root", False, -1), ("u4", "user:u5", False, 10)]


@on_facts(
    "b2_access",
    """, g AS (SELECT * FROM (VALUES ('u1', 'admin:root', FALSE, 10), ('u2', 'admin:root', TRUE, 10), ('u3', 'admin:root', FALSE, -1), ('u4', 'user:u5', FALSE, 10)) t(grantor, grantee, revoked, days)),
    p AS (SELECT * FROM (VALUES ('admin', 'root'), ('user', 'u5')) t(role, usr)),
    r AS (SELECT role, fact_id, CASE WHEN tier = 'public' THEN 'public' WHEN tier = 'source' THEN CASE WHEN role = 'admin' THEN 'role' ELSE 'denied_role' END WHEN user_id = usr THEN 'own'
      WHEN role = 'admin' AND EXISTS (SELECT 1 FROM g WHERE grantor = user_id AND grantee = role || ':' || usr AND NOT revoked AND days > 0) THEN 'granted' ELSE 'denied_no_grant' END AS reason FROM facts, p)
    SELECT role, fact_id, NOT starts_with(reason, 'denied') AS allowed, reason FROM r""",
)
def b2(s, d):
    grants = s.createDataFrame(GRANTS, "grantor string, grantee string, revoked boolean, expires_in_days int")
    f = facts(s, d)
    admin = screening.access(f, "admin", "root", grants).withColumn("role", F.lit("admin"))
    return admin.unionByName(screening.access(f, "user", "u5", grants).withColumn("role", F.lit("user")))


@on_facts("b3_zone_filter", f"SELECT fact_id, {ZONE_SQL} AS zone FROM facts WHERE {ZONE_SQL} <> 'other' AND NOT tombstoned")
def b3(s, d):
    return facts(s, d).where(~F.col("tombstoned")).select("fact_id", screening.zone(F.col("kind")).alias("zone")).where("zone <> 'other'")


_BY_RANK = sorted(ROUTES, key=lambda r: (-r[1], r[0]))


@on_facts(
    "b4_route_by_rules",
    f"SELECT * FROM (SELECT fact_id, {case_sql('content', [(r[2], r[0]) for r in _BY_RANK])} AS rule, {case_sql('content', [(r[2], r[3]) for r in _BY_RANK])} AS action FROM facts) WHERE rule IS NOT NULL",
)
def b4(s, d):
    return screening.route_by_rules(facts(s, d), ROUTES)


@on_facts("b6_junk_class", f"SELECT * FROM (SELECT fact_id, {case_sql('content', JUNK)} AS junk FROM facts) WHERE junk IS NOT NULL")
def b6(s, d):
    return facts(s, d).select("fact_id", screening.first_match(F.col("content"), JUNK).alias("junk")).where("junk IS NOT NULL")


_TALK = ", ".join(f"'{p}'" for p in screening.SMALL_TALK)
GATE_SQL = f"""CASE WHEN text IS NULL OR length(regexp_replace(text, '^\\s+', '')) = 0 THEN 'empty' WHEN length(text) < 30 THEN 'too_short'
  WHEN lower(regexp_extract(regexp_replace(text, '^\\s+', ''), '^[^\\s]+')) IN ({_TALK}) OR lower(substr(regexp_replace(text, '^\\s+', ''), 1, 2)) IN ({_TALK}) THEN 'noise_prefix'
  WHEN regexp_matches(regexp_replace(text, '^\\s+', ''), {text_sql(screening.command_start())}) THEN 'execution_log' ELSE 'keep' END"""


@register("b7_capture_gate", f"SELECT conv_id, turn, {GATE_SQL} AS gate FROM conversations")
def b7(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", screening.capture_gate(F.col("text")).alias("gate"))


@on_facts(
    "b9_keyword_oracle",
    f""", {EXPECTED_SQL}, h AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, fact_id)::INT AS rank FROM kw, facts
    WHERE len(list_filter(keywords, lambda k: contains(lower(content), k))) > 0) SELECT query_id, fact_id, rank FROM h WHERE rank <= 5""",
)
def b9(s, d):
    return screening.keyword_oracle(expected(s, d), facts(s, d))


@on_facts(
    "b10_consult",
    f""", {EXPECTED_SQL}, h AS (SELECT query_id, {ZONE_SQL} AS bucket, fact_id, row_number() OVER (PARTITION BY query_id, {ZONE_SQL} ORDER BY importance DESC, age_days, fact_id)::INT AS rank FROM kw, facts
    WHERE {ZONE_SQL} <> 'other' AND content IS NOT NULL AND len(list_filter(keywords, lambda k: NOT contains(lower(content), k))) = 0) SELECT query_id, bucket, fact_id, rank FROM h WHERE rank <= 3""",
)
def b10(s, d):
    return screening.consult(expected(s, d), facts(s, d))


@on_log("b12_audit_query", "SELECT event_id, user_id, intent FROM recall_log WHERE intent = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50")
def b12(s, d):
    log = recall_log(s, d).where((F.col("intent") == "error") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp")))
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "intent")


_BODY = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@register(
    "b15_choose_route",
    f"""SELECT conv_id, turn, CASE WHEN {_BODY} = '' THEN 'hybrid' WHEN regexp_matches({_BODY}, {text_sql(screening.MULTIHOP)}) THEN 'graph' WHEN regexp_matches({_BODY}, {text_sql(screening.FACTOID)}) THEN 'dense'
    WHEN len(string_split({_BODY}, ' ')) <= 4 AND NOT regexp_matches({_BODY}, {text_sql(screening.PROPER_NOUN)}) THEN 'graph' ELSE 'hybrid' END AS route FROM conversations""",
)
def b15(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", screening.choose_route(F.col("text")).alias("route"))


@register(
    "c10_session_neighbours",
    "SELECT a.conv_id, a.turn, b.turn AS neighbour FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn WHERE (a.conv_id * 1000 + a.turn) % 100 = 0",
)
def c10(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn")
    hits = c.where((F.col("conv_id") * 1000 + F.col("turn")) % 100 == 0)
    return hits.join(c.withColumnRenamed("turn", "neighbour"), "conv_id").where("turn <> neighbour")


@on_facts(
    "g3_classify",
    f"SELECT * FROM (SELECT fact_id, {case_sql('trim(split_part(content, chr(10), 1))', screening.ZONE_MARKERS)} AS kind FROM facts WHERE kind = 'fact') WHERE kind IS NOT NULL",
)
def g3(s, d):
    return screening.classify_first_line(facts(s, d))


PAIRS_SQL = f"""{VEC_SQL.split('cs AS')[0].strip().rstrip(',')},
p AS (SELECT a.fact_id AS a, b.fact_id AS b FROM e a JOIN e b ON a.fact_id <> b.fact_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.35),
r AS (SELECT DISTINCT a AS id FROM p), c AS (WITH RECURSIVE w AS (SELECT id, id AS reach FROM r UNION SELECT w.id, p.b FROM w JOIN p ON w.reach = p.a) SELECT id, min(reach) AS cls FROM w GROUP BY 1),
m AS (SELECT id, cls, importance, topic, length(content) AS n FROM c JOIN facts ON id = fact_id),
b AS (SELECT cls, arg_max(id, (importance, n, -id)) AS winner FROM m GROUP BY 1)"""


def _groups(s, d):
    return changes.semantic_groups(vectors.cosine_links(emb(s, d), 0.35), facts(s, d))


@on_facts("g5_semantic_groups", f", {PAIRS_SQL} SELECT id AS fact_id, winner FROM m JOIN b USING (cls)")
def g5(s, d):
    return _groups(s, d)


@on_facts("g6_apply_merges", f", {PAIRS_SQL} SELECT winner, max(importance) AS importance, count(*) FILTER (id <> winner) AS merged, count(DISTINCT topic) AS topics FROM m JOIN b USING (cls) GROUP BY 1")
def g6(s, d):
    return changes.apply_merges(_groups(s, d), facts(s, d))


TAGS_SQL = "[f.topic, f.lang, 't' || (f.fact_id % 4)]"
MERGED_SQL = f""", {PAIRS_SQL}, mt AS (SELECT f.fact_id, b.winner, f.importance, f.content, {TAGS_SQL} AS tags FROM m JOIN b ON b.cls = m.cls JOIN facts f ON f.fact_id = m.id),
    me AS (SELECT fact_id, winner, unnest(tags) AS tag, unnest(range(3)) AS pos FROM mt),
    mf AS (SELECT winner, tag, min((fact_id <> winner, fact_id, pos)) AS first FROM me WHERE tag IS NOT NULL GROUP BY 1, 2), mu AS (SELECT winner, list(tag ORDER BY first) AS tags FROM mf GROUP BY 1),
    mw AS (SELECT winner, max(importance) AS most, count(*) FILTER (fact_id <> winner) AS merged FROM mt GROUP BY 1 HAVING count(*) FILTER (fact_id <> winner) > 0)"""


def _merged(s, d):
    tags = F.array("topic", "lang", F.concat(F.lit("t"), F.col("fact_id") % 4))
    return changes.merge_rows(_groups(s, d), facts(s, d).withColumn("tags", tags))


@on_facts(
    "g6_merged_rows",
    f"""{MERGED_SQL} SELECT fact_id, fact_id <> t.winner AS tombstoned, CASE WHEN fact_id = t.winner THEN most ELSE t.importance END AS importance,
    array_to_string(CASE WHEN fact_id = t.winner THEN u.tags ELSE t.tags END, ',') AS tags, CASE WHEN fact_id = t.winner THEN merged ELSE 0 END AS merged, t.winner AS merged_into
    FROM mt t JOIN mw w ON w.winner = t.winner LEFT JOIN mu u ON u.winner = t.winner""",
)
def g6_rows(s, d):
    """Rows after the merge; a winner names itself."""
    return _merged(s, d)[0].withColumns({"tags": F.array_join("tags", ","), "merged_into": F.coalesce("merged_into", "fact_id")})


@on_facts(
    "g6_merge_audit",
    f"""{MERGED_SQL} SELECT t.winner AS target_id, fact_id AS loser_id, 'warning' AS severity, md5(substr(coalesce(content, ''), 1, 120)) AS content_md5, most AS importance, len(u.tags)::INT AS n_tags
    FROM mt t JOIN mw w ON w.winner = t.winner JOIN mu u ON u.winner = t.winner WHERE fact_id <> t.winner""",
)
def g6_audit(s, d):
    a = _merged(s, d)[1]
    return a.withColumn("content_md5", F.md5("loser_content")).drop("loser_content")


@on_facts(
    "g10_hygiene_scan",
    """, x AS (SELECT fact_id, substr(regexp_replace(content, '[0-9]+', '#', 'g'), 1, 600) AS shape FROM facts WHERE NOT tombstoned AND content IS NOT NULL),
    y AS (SELECT fact_id, min(fact_id) OVER (PARTITION BY shape) AS first_id, count(*) OVER (PARTITION BY shape) AS n FROM x) SELECT fact_id, first_id FROM y WHERE n >= 3 AND fact_id <> first_id""",
)
def g10(s, d):
    return changes.hygiene_scan(facts(s, d))


@on_facts(
    "g12_keyword_pairs",
    f""", {KEYWORDS_SQL}, x AS (SELECT confidence, list_sort(k)[1:2] AS k FROM x5 JOIN k5 USING (fact_id))
    SELECT k[1] AS a, k[2] AS b, count(*) AS n, round(avg(confidence), 6) AS confidence FROM x WHERE len(k) = 2 GROUP BY 1, 2 HAVING count(*) >= 2 AND round(avg(confidence), 6) >= 0.5""",
)
def g12(s, d):
    return changes.keyword_pairs(facts(s, d), smallest=2, confidence=0.5)


@on_facts("g14_importance_audit", f"SELECT * FROM (SELECT fact_id, importance, {case_sql('content', screening.BOOSTS)}::DOUBLE AS target FROM facts) WHERE target > importance")
def g14(s, d):
    return screening.importance_audit(facts(s, d))


@on_facts(
    "g18_relocate",
    """, m AS (SELECT * FROM facts WHERE tier <> 'public' AND importance >= 0.85) SELECT 'copy' AS part, fact_id, 'public' AS tier, FALSE AS tombstoned FROM m
    UNION ALL SELECT 'source', fact_id, tier, TRUE FROM m UNION ALL SELECT 'audit', fact_id, 'public', FALSE FROM m""",
)
def g18(s, d):
    f = facts(s, d)
    return changes.relocate(f, f.where("importance >= 0.85"), "public")


@on_facts(
    "h1_invalidate",
    """, q AS (SELECT DISTINCT event_id % 1500 AS fact_id FROM events) SELECT fact_id, CASE WHEN f.kind IS NULL THEN 'missing' WHEN f.ended_days IS NOT NULL THEN 'already_invalid' ELSE 'invalidated' END AS status
    FROM q LEFT JOIN facts f USING (fact_id)""",
)
def h1(s, d):
    return changes.invalidate(facts(s, d), table(s, d, "events").select((F.col("event_id") % 1500).alias("fact_id")))


@on_facts(
    "h8_halve_and_expire",
    """SELECT fact_id, (CASE WHEN coalesce(confirmed_days, age_days) >= 30 THEN greatest(1, access_count // 2) ELSE access_count END)::BIGINT AS access_count,
    coalesce(confirmed_days, age_days) >= 90 AS tombstoned FROM facts WHERE NOT tombstoned""",
)
def h8(s, d):
    return changes.halve_and_expire(facts(s, d))


SCOPE_SQL = """r AS (SELECT fact_id, scope_type AS old, CASE WHEN kind IN ('rule', 'user_preference', 'decision') THEN 'kind' WHEN access_count >= 3 THEN 'confirmations' WHEN importance >= 0.7 THEN 'importance' ELSE 'default' END AS reason FROM facts)"""


@on_facts("h11_scope_backfill", f", {SCOPE_SQL} SELECT old, CASE WHEN reason = 'default' THEN 'short_term' ELSE 'long_term' END AS new, reason, count(*) AS n FROM r GROUP BY 1, 2, 3")
def h11(s, d):
    from corpusmill.operators.lifecycle import classify_scope

    return changes.scope_backfill(facts(s, d), classify_scope(facts(s, d)))


@on_facts(
    "h13_memory_class",
    """SELECT CASE WHEN kind IN ('rule', 'decision', 'user_preference') THEN 'mental_model' WHEN kind IN ('success_pattern', 'failure_pattern', 'lesson') THEN 'experience'
    WHEN starts_with(ltrim(content), '[observation]') THEN 'observation' ELSE 'world_fact' END AS memory_class, kind, count(*) AS n FROM facts GROUP BY 1, 2""",
)
def h13(s, d):
    return facts(s, d).groupBy(changes.memory_class(F.col("kind"), F.col("content")).alias("memory_class"), "kind").agg(F.count("*").alias("n"))


@on_log(
    "h15_daily_audit",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, intent AS event, CASE intent WHEN 'error' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM recall_log GROUP BY 1, 2, 3",
)
def h15(s, d):
    severity = F.when(F.col("intent") == "error", "warning").otherwise("info")
    return recall_log(s, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("intent").alias("event"), severity.alias("severity")).agg(F.count("*").alias("n"))


@on_facts(
    "h16_cascade_forget",
    """, x AS (SELECT f.fact_id % 5 = 0 AS self, p.fact_id IS NOT NULL AND p.fact_id % 5 = 0 AS up FROM facts f LEFT JOIN facts p ON f.parent_id = p.fact_id WHERE f.parent_id IS NOT NULL)
    SELECT 'ended' AS part, count(*) AS n FROM facts WHERE fact_id % 5 = 0 UNION ALL SELECT 'edges_removed', count(*) FROM x WHERE self OR up UNION ALL SELECT 'orphaned', count(*) FROM x WHERE up AND NOT self""",
)
def h16(s, d):
    f = facts(s, d)
    return changes.cascade_forget(f, f.where("fact_id % 5 = 0"))


@on_facts("h19_tombstoned_at", "SELECT fact_id, coalesce(confirmed_days, age_days) AS tombstoned_days FROM facts WHERE tombstoned")
def h19(s, d):
    return facts(s, d).where("tombstoned").select("fact_id", F.coalesce("confirmed_days", "age_days").alias("tombstoned_days"))


@on_log("h20_retry_queue", "SELECT intent AS status, count(*) AS n, count(*) FILTER (intent = 'error' AND event_id % 7 < 5) AS eligible, min(event_id) AS oldest FROM recall_log GROUP BY 1")
def h20(s, d):
    return changes.retry_queue(recall_log(s, d).select(F.col("event_id").alias("item_id"), F.col("intent").alias("status"), (F.col("event_id") % 7).alias("attempts")))


@on_log(
    "h21_trust_decay",
    """, p AS (SELECT user_id AS peer_id, user_id % 101 AS trust, date_diff('day', max(ts)::DATE, DATE '2024-02-20') AS age FROM recall_log GROUP BY 1)
    SELECT peer_id, CASE WHEN trust > 30 AND age >= 30 THEN greatest(30, trust - 5) ELSE trust END AS trust FROM p""",
)
def h21(s, d):
    peers = recall_log(s, d).groupBy(F.col("user_id").alias("peer_id")).agg(F.max("ts").alias("last"))
    return changes.trust_decay(peers.select("peer_id", (F.col("peer_id") % 101).alias("trust"), F.date_diff(F.lit("2024-02-20").cast("date"), F.col("last").cast("date")).alias("age_days")))


@on_facts("h22_current_versions", "SELECT stable_id, arg_max(fact_id, (-age_days, fact_id)) AS fact_id, count(*) AS versions FROM facts GROUP BY 1")
def h22(s, d):
    return changes.current_versions(facts(s, d), "stable_id")


@on_facts(
    "i3_provenance_depth",
    """, w AS (WITH RECURSIVE t AS (SELECT fact_id, 0 AS depth FROM facts WHERE parent_id IS NULL UNION ALL SELECT f.fact_id, depth + 1 FROM t JOIN facts f ON f.parent_id = t.fact_id) SELECT * FROM t)
    SELECT fact_id, max(depth) AS depth FROM w GROUP BY 1""",
)
def i3(s, d):
    f = facts(s, d)
    return changes.provenance_depth(f.where("parent_id IS NOT NULL").select(F.col("fact_id").alias("child"), F.col("parent_id").alias("parent")), f)


@register(
    "i5_episode_links",
    f"WITH {FACTS_SQL} SELECT fact_id, count(*) AS episodes, min(conv_id) AS first_episode FROM (SELECT DISTINCT conv_id, unnest([conv_id, conv_id * 2]) AS fact_id FROM conversations) JOIN facts USING (fact_id) GROUP BY 1",
)
def i5(s, d):
    links = table(s, d, "conversations").select("conv_id", F.explode(F.array("conv_id", F.col("conv_id") * 2)).alias("fact_id")).distinct()
    return links.join(facts(s, d).select("fact_id"), "fact_id").groupBy("fact_id").agg(F.count("*").alias("episodes"), F.min("conv_id").alias("first_episode"))


_COUNTS = " UNION ALL ".join(f"SELECT fact_id, '{n}' AS name, len(regexp_extract_all(content, {text_sql(p)})) AS n FROM facts" for n, p in screening.PRIVATE)


@on_facts("j1_pii_scan", f"SELECT * FROM ({_COUNTS}) WHERE n > 0")
def j1(s, d):
    return screening.private_counts(facts(s, d))


_REDACT = "content"
for _n, _p in screening.PRIVATE:
    _REDACT = f"regexp_replace({_REDACT}, {text_sql(_p)}, '[REDACTED:{_n}]', 'g')"


@on_facts("j2_pii_redact", f"SELECT fact_id, md5({_REDACT}) AS digest, length({_REDACT})::INT AS n FROM facts")
def j2(s, d):
    out = facts(s, d).select("fact_id", screening.redact(F.col("content")).alias("t"))
    return out.select("fact_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@on_facts(
    "j4_card_numbers",
    """, x AS (SELECT fact_id, list_transform(regexp_extract_all(content, '[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{1,7}'), lambda r: regexp_replace(r, '[- ]', '', 'g')) AS runs FROM facts),
    y AS (SELECT fact_id, row_number() OVER () AS k, unnest(runs) AS run FROM x WHERE len(runs) > 0), z AS (SELECT fact_id, run, reverse(run) AS b FROM y),
    v AS (SELECT fact_id, list_sum(list_transform(range(1, length(b) + 1), lambda i: CASE WHEN i % 2 = 1 THEN b[i]::INT WHEN b[i]::INT > 4 THEN 2 * b[i]::INT - 9 ELSE 2 * b[i]::INT END)) AS total FROM z)
    SELECT fact_id, count(*) AS runs, count(*) FILTER (total % 10 = 0) AS valid FROM v GROUP BY 1""",
)
def j4(s, d):
    return screening.card_numbers(facts(s, d))


@on_facts(
    "j6_visibility",
    f""", x AS (SELECT fact_id, {case_sql('content', [*((p, n) for n, p in screening.PRIVATE), (screening.FIRST_PERSON, 'first_person')])} AS r FROM facts)
    SELECT fact_id, CASE WHEN r IS NULL THEN 'commons' ELSE 'personal' END AS visibility, coalesce(r, 'none') AS reason FROM x""",
)
def j6(s, d):
    return screening.visibility(facts(s, d))


SCORE_SQL = f"""CASE WHEN {OUTCOME_SQL} IN ('failure', 'lesson') THEN 0.85 WHEN {OUTCOME_SQL} = 'success' THEN CASE WHEN contains(lower(content), 'remember') THEN 0.8 WHEN length(content) > 200 THEN 0.6 ELSE 0.4 END
  WHEN length(content) > 200 THEN 0.6 WHEN length(content) >= 60 THEN 0.5 ELSE 0.3 END::DOUBLE"""


@on_facts("j12_importance_score", f", x AS (SELECT fact_id, {OUTCOME_SQL} AS o, {SCORE_SQL} AS score FROM facts) SELECT fact_id, score, CASE WHEN o IN ('failure', 'lesson') OR score >= 0.5 THEN 'public' END AS tier FROM x")
def j12(s, d):
    o = screening.outcome_of_kind(F.col("kind"))
    x = facts(s, d).select("fact_id", o.alias("o"), screening.importance_score(o, F.col("content")).alias("score"))
    return x.select("fact_id", "score", F.when(F.col("o").isin("failure", "lesson") | (F.col("score") >= 0.5), "public").alias("tier"))


@on_facts("j13_keywords", f", {KEYWORDS_SQL} SELECT fact_id, coalesce(array_to_string(k, ' '), '') AS keywords FROM facts LEFT JOIN k5 USING (fact_id)")
def j13(s, d):
    return facts(s, d).select("fact_id", F.array_join(screening.keywords(F.col("content")), " ").alias("keywords"))


@register(
    "j20_grounding_ratio",
    """WITH x AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(lower(coalesce(a.text, '')), '[a-z]+')) AS w, regexp_extract_all(lower(coalesce(b.text, '')), '[a-z]+') AS src
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
    SELECT conv_id, turn, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, src)) / len(w)::DOUBLE ELSE 0 END, 6) AS ratio FROM x""",
)
def j20(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return screening.grounding_ratio(c.join(before, ["conv_id", "turn"])).select("conv_id", "turn", "ratio")


@register("m8_observe_gate", f"SELECT gate, count(*) AS n FROM (SELECT {GATE_SQL} AS gate FROM conversations) GROUP BY 1")
def m8(s, d):
    return b7(s, d).groupBy("gate").agg(F.count("*").alias("n"))


@on_log(
    "m2_rate_admission",
    """, e AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT, event_id) AS n FROM recall_log),
    w AS (WITH RECURSIVE a AS (SELECT user_id, n, event_id, [s] AS kept, 0::BIGINT AS wait FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN len(list_filter(a.kept, lambda t: t > e.s - 604800)) < 3 THEN list_append(list_filter(a.kept, lambda t: t > e.s - 604800), e.s) ELSE list_filter(a.kept, lambda t: t > e.s - 604800) END,
        CASE WHEN len(list_filter(a.kept, lambda t: t > e.s - 604800)) < 3 THEN 0 ELSE list_filter(a.kept, lambda t: t > e.s - 604800)[1] + 604800 - e.s END FROM a JOIN e ON a.user_id = e.user_id AND e.n = a.n + 1) SELECT * FROM a)
    SELECT user_id, event_id, wait = 0 AS admitted, wait AS retry_after FROM w""",
)
def m2(s, d):
    return changes.rate_admission(recall_log(s, d), cap=3, hours=24 * 7)


@on_log(
    "m3_nonce_dedup",
    """, e AS (SELECT user_id, qhash % 5 AS nonce, event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM recall_log),
    w AS (WITH RECURSIVE a AS (SELECT user_id, nonce, arg_min(event_id, (s, event_id)) AS event_id, min(s) AS s FROM e GROUP BY 1, 2
      UNION ALL SELECT e.user_id, e.nonce, arg_min(e.event_id, (e.s, e.event_id)), min(e.s) FROM a JOIN e ON a.user_id = e.user_id AND a.nonce = e.nonce AND e.s >= a.s + 604800 GROUP BY e.user_id, e.nonce) SELECT * FROM a)
    SELECT e.user_id, e.nonce, e.event_id, w.event_id IS NOT NULL AS accepted FROM e LEFT JOIN w USING (event_id)""",
)
def m3(s, d):
    return changes.nonce_dedup(recall_log(s, d).select("user_id", (F.col("qhash") % 5).alias("nonce"), "event_id", "ts"))


@on_log("k10_failures", "SELECT intent AS event, tier AS error, count(*) AS n, count(DISTINCT user_id) AS users, max(event_id) AS last_id FROM recall_log WHERE top_hit_score < 0.5 GROUP BY 1, 2")
def k10_failures(s, d):
    """Failed reads by event and by kind of error, for which the tier that answered stands."""
    weak = recall_log(s, d).where("top_hit_score < 0.5").groupBy(F.col("intent").alias("event"), F.col("tier").alias("error"))
    return weak.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("event_id").alias("last_id"))


@on_log("k10_warnings", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM recall_log WHERE intent = 'error' GROUP BY 1 ORDER BY day DESC LIMIT 14")
def k10(s, d):
    days = recall_log(s, d).where("intent = 'error'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return days.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).orderBy(F.desc("day")).limit(14)



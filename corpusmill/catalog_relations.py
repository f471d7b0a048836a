"""Queries of pair relations, entity and scenario scores and rescoring of candidate lists, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog_ranking import best, by_fact, on_lists, vector_list
from corpusmill.operators import lexical, relations, screening, vectors
from corpusmill.operators.relations import BRIDGE_TERMS, NEGATIONS, RERANK_STOPWORDS, ROLES
from corpusmill.registry import VEC_SQL, docs, emb, on_facts, query_vectors, register
from corpusmill.sources.views import FACTS_SQL, facts, queries_table, table

EXPERIENCES = ["failure_pattern", "success_pattern", "lesson", "postmortem", "procedure", "experience"]


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def words_sql(col: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({col}, '')), '[a-z0-9]+'))"


def candidates(s, d):
    return by_fact(best(s, d, 20))


def texts(s, d):
    return docs(s, d).select(F.col("doc_id").alias("fact_id"), F.col("text").alias("content"))


def topics(s, d):
    """(fact_id, type, value) of topic and language, without nulls."""
    kinds = [F.struct(F.lit(k).alias("type"), F.col(k).alias("value")) for k in ("topic", "lang")]
    return facts(s, d).select("fact_id", F.inline(F.array(*kinds))).where("value IS NOT NULL")


@on_facts("c4_entity_links", "SELECT a.fact_id, (SELECT count(*) FROM facts b WHERE b.fact_id <> a.fact_id AND (b.topic = a.topic OR b.lang = a.lang)) AS n_links FROM facts a WHERE a.topic IS NOT NULL OR a.lang IS NOT NULL")
def c4(s, d):
    return relations.entity_links(topics(s, d))


@register(
    "c5_cosine_pairs",
    f"""WITH {VEC_SQL.split("cs AS")[0].strip().rstrip(",")}, p AS (SELECT a.fact_id AS a, b.fact_id AS b, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c
    FROM e a JOIN e b ON a.fact_id < b.fact_id) SELECT a, b, round(c, 6) AS cosine FROM p WHERE round(c, 9) >= 0.35""",
)
def c5(s, d):
    return vectors.cosine_pairs(emb(s, d), 0.35)


@on_facts(
    "e6_precedent",
    f""", {VEC_SQL.strip()}, m AS (SELECT query_id, fact_id, round(cosine, 6) AS similarity, kind FROM cs JOIN facts USING (fact_id)
      WHERE tier IN ('public', 'private') AND kind IN ({quoted(EXPERIENCES)}) AND NOT tombstoned AND round(cosine, 6) >= 0.2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fact_id)::INT AS rank FROM m) SELECT query_id, fact_id, kind, similarity, rank FROM r WHERE rank <= 5""",
)
def e6(s, d):
    f = facts(s, d)
    asked = f.where(F.col("tier").isin("public", "private") & F.col("kind").isin(EXPERIENCES) & ~F.col("tombstoned")).select("fact_id")
    near = vectors.cosine_scores(query_vectors(s, d), emb(s, d).join(asked, "fact_id", "left_semi"), least=0.2 - 1e-6, best=5).select("query_id", "fact_id", F.round("cosine", 6).alias("score"))
    public, private = (near.join(f.where(F.col("tier") == t).select("fact_id"), "fact_id") for t in ("public", "private"))
    return relations.precedent(public.unionByName(private), f, EXPERIENCES, least=0.2)


_ASKED = [["2024-01-20"], ["2023-12"], ["2023", "2024-01-20"], ["2023-11-02", "2024"], []]


def _part(c: str, k: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract({c}, '^([0-9]{{4}})(?:-([0-9]{{1,2}}))?(?:-([0-9]{{1,2}}))?', {k}), '') AS INT)"


_Y, _M, _D = (_part("day", k) for k in (1, 2, 3))
_QY, _QM, _QD = (_part("q", k) for k in (1, 2, 3))
_HIT = f"""CASE WHEN {_QD} IS NOT NULL THEN CASE WHEN {_Y} = {_QY} AND {_M} = {_QM} AND {_D} = {_QD} THEN 1.0 WHEN {_Y} = {_QY} AND {_M} = {_QM} THEN 0.6 ELSE -0.5 END
 WHEN {_QM} IS NOT NULL THEN CASE WHEN {_Y} = {_QY} AND {_M} = {_QM} THEN 1.0 WHEN {_Y} = {_QY} THEN 0.5 ELSE -0.5 END WHEN {_Y} = {_QY} THEN 1.0 ELSE -0.5 END::DOUBLE"""


@on_facts(
    "f2_temporal_score",
    f""", x AS (SELECT fact_id, strftime(DATE '2024-01-31' - (age_days::INT), '%Y-%m-%d') AS day, ({_ASKED}::VARCHAR[][])[fact_id % 5 + 1] AS asked FROM facts),
    y AS (SELECT fact_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(asked, lambda q: {_HIT})), lambda b, h: CASE WHEN h < 0 THEN least(b, h) ELSE greatest(b, h) END) AS best FROM x)
    SELECT fact_id, CASE WHEN best = 0 THEN -0.5 ELSE best END::DOUBLE AS score FROM y""",
)
def f2(s, d):
    asked = F.element_at(F.array(*[F.array(*map(F.lit, a)).cast("array<string>") for a in _ASKED]), (F.col("fact_id") % 5 + 1).cast("int"))
    day = F.date_format(F.date_sub(F.lit("2024-01-31").cast("date"), F.col("age_days").cast("int")), "yyyy-MM-dd")
    return facts(s, d).select("fact_id", relations.temporal_score(day, asked).alias("score"))


def _rerank_tokens(col: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[a-z][a-z''-]+'), lambda t: t NOT IN ({quoted(RERANK_STOPWORDS)}))"


@on_lists(
    "f7_lexical_rerank",
    f""", q AS (SELECT query_id, term, 1 + ln(1 + count(*)) AS w FROM (SELECT item_id AS query_id, unnest({_rerank_tokens("text")}) AS term FROM benchmark) GROUP BY 1, 2),
    c AS (SELECT fact_id, term, 1 + ln(1 + count(*)) AS w FROM (SELECT doc_id AS fact_id, unnest({_rerank_tokens("text")}) AS term FROM documents) GROUP BY 1, 2),
    nq AS (SELECT query_id, sqrt(sum(w * w)) AS nq FROM q GROUP BY 1), nc AS (SELECT fact_id, sqrt(sum(w * w)) AS nc FROM c GROUP BY 1),
    dt AS (SELECT query_id, fact_id, sum(q.w * c.w) AS dd FROM lx JOIN q USING (query_id) JOIN c USING (fact_id, term) GROUP BY 1, 2),
    n AS (SELECT query_id, fact_id, score, round(0.85::DOUBLE * coalesce(dd / (nq * nc), 0) + 0.15::DOUBLE * ln(1 + len(list_filter([{quoted(BRIDGE_TERMS)}], lambda t: contains(lower(coalesce(x.text, '')), t))))
      * CASE WHEN len(list_intersect({_rerank_tokens("b.text")}, [{quoted(BRIDGE_TERMS)}])) > 0 THEN 1.0 ELSE 0.5 END, 9) AS nw
      FROM lx JOIN documents x ON fact_id = x.doc_id JOIN benchmark b ON query_id = b.item_id LEFT JOIN dt USING (query_id, fact_id) LEFT JOIN nq USING (query_id) LEFT JOIN nc USING (fact_id)),
    m AS (SELECT *, min(nw) OVER (PARTITION BY query_id) AS lo, max(nw) OVER (PARTITION BY query_id) AS hi FROM n)
    SELECT query_id, fact_id, round(0.65::DOUBLE * CASE WHEN hi > lo THEN (nw - lo) / (hi - lo) ELSE 0 END + 0.35::DOUBLE * score, 6) AS score FROM m""",
)
def f7(s, d):
    return relations.lexical_rerank(candidates(s, d), queries_table(s, d), texts(s, d))


@on_lists(
    "f8_bridge_boost",
    """, en AS (SELECT DISTINCT doc_id AS fact_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{2,}'))) AS entity FROM documents),
    sd AS (SELECT query_id, doc_id AS seed FROM r WHERE rank <= 3),
    sh AS (SELECT l.query_id, l.fact_id, sd.seed, count(*) AS n FROM lx l JOIN sd USING (query_id) JOIN en a ON a.fact_id = l.fact_id JOIN en b ON b.fact_id = sd.seed AND a.entity = b.entity WHERE sd.seed <> l.fact_id GROUP BY 1, 2, 3),
    sm AS (SELECT query_id, fact_id, sum(pow(0.15::DOUBLE, n)) AS s, sum(n)::BIGINT AS bridges FROM sh GROUP BY 1, 2)
    SELECT query_id, fact_id, round(score * (1 + 0.15::DOUBLE * coalesce(s, 0)), 6) AS score, coalesce(bridges, 0)::BIGINT AS bridges FROM lx LEFT JOIN sm USING (query_id, fact_id)""",
)
def f8(s, d):
    named = docs(s, d).select(F.col("doc_id").alias("fact_id"), F.explode(relations.capitalised(F.col("text"))).alias("entity"))
    return relations.bridge_boost(candidates(s, d), named)


_ENTS = f"""list_distinct(list_concat(list_transform(list_filter(regexp_extract_all(coalesce(b.text, ''), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_''-]*'), lambda w: regexp_matches(w, '^[A-Z][a-z][a-zA-Z''-]{{2,}}$')), lambda w: lower(w)),
    list_filter(regexp_extract_all(lower(coalesce(b.text, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({quoted(ROLES)}))))"""


@on_lists(
    "f9_stage_boost",
    f""", n AS (SELECT query_id, fact_id, score, {_ENTS} AS ents, lower(coalesce(x.text, '')) AS low FROM lx JOIN documents x ON fact_id = x.doc_id JOIN benchmark b ON query_id = b.item_id)
    SELECT query_id, fact_id, round(score * (1 + 0.5::DOUBLE * CASE WHEN len(ents) > 0 THEN len(list_filter(ents, lambda e: contains(low, e)))::DOUBLE / len(ents) ELSE 0 END), 10) AS score FROM n""",
)
def f9(s, d):
    return relations.stage_boost(candidates(s, d), queries_table(s, d), texts(s, d))


_KEYS = "list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[a-z]{4,}'))"


@on_lists(
    "f10_node_usefulness",
    f""", w0 AS (SELECT DISTINCT fact_id, regexp_extract_all(lower(coalesce(content, '')), '[a-z]{{4,}}') AS l, content, topic, lang, confidence, access_count FROM facts WHERE fact_id IN (SELECT fact_id FROM lx)),
    w1 AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] AS k FROM w0),
    w2 AS (SELECT query_id, fact_id, {words_sql("b.text")} AS q, {words_sql("content")} AS c, {words_sql("array_to_string(k, ' ')")} AS kw, {words_sql("concat_ws(' ', topic, lang)")} AS en, confidence, access_count
      FROM lx JOIN w1 USING (fact_id) JOIN benchmark b ON query_id = b.item_id),
    w3 AS (SELECT *, len(list_intersect(q, c))::DOUBLE AS m FROM w2)
    SELECT query_id, fact_id, round(CASE WHEN len(q) = 0 OR len(c) = 0 THEN 0.05::DOUBLE ELSE greatest(0.05::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * m / (len(q) + len(c) - m) + 0.25::DOUBLE * len(list_intersect(q, kw)) / len(q)
      + 0.25::DOUBLE * len(list_intersect(q, en)) / len(q) + 0.1::DOUBLE * (greatest(0, least(1, confidence)) + least(1, access_count / 10)) / 2)) END, 6) AS usefulness FROM w3""",
)
def f10(s, d):
    f = facts(s, d).select("fact_id", "content", "topic", "lang", "confidence", "access_count")
    j = candidates(s, d).join(f, "fact_id").join(queries_table(s, d), "query_id")
    c = F.col
    found = relations.usefulness(c("query"), c("content"), screening.keywords(c("content")), F.array("topic", "lang"), c("confidence"), c("access_count"))
    return j.select("query_id", "fact_id", F.round(found, 6).alias("usefulness"))


_NEG = f"len(list_intersect({{}}, [{quoted(NEGATIONS)}])) > 0"


@on_facts(
    "f11_pair_relation",
    f""", p0 AS (SELECT c.fact_id, p.content AS ta, c.content AS tb, {words_sql("p.content")} AS wa, {words_sql("c.content")} AS wb, list_filter([p.topic, p.lang], lambda x: x IS NOT NULL) AS ea, list_filter([c.topic, c.lang], lambda x: x IS NOT NULL) AS eb
      FROM facts c JOIN facts p ON c.parent_id = p.fact_id),
    p1 AS (SELECT *, len(wa)::DOUBLE AS na, len(wb)::DOUBLE AS nb, len(list_intersect(wa, wb))::DOUBLE AS m, len(list_intersect(ea, eb))::DOUBLE AS em, len(list_distinct(ea)) AS xa, len(list_distinct(eb)) AS xb FROM p0),
    p2 AS (SELECT *, CASE WHEN na + nb > 0 THEN m / (na + nb - m) ELSE 0 END AS j, CASE WHEN xa + xb > 0 THEN em / (xa + xb - em) ELSE 0 END AS e, abs(length(ta) - length(tb)) AS gap, ({_NEG.format("wa")}) <> ({_NEG.format("wb")}) AS flip FROM p1),
    p3 AS (SELECT fact_id, CASE WHEN na = 0 OR nb = 0 THEN ('none', 0.0::DOUBLE) WHEN flip AND (j > 0.3 OR e > 0) THEN ('conflict', greatest(j, e)) WHEN j >= 0.6 AND gap < 50 AND abs(na - nb) < 3 THEN ('repeat', j)
      WHEN j >= 0.6 THEN ('corroboration', j) WHEN m / na >= 0.7 AND m / nb < 0.7 AND nb > na THEN ('clarification', m / na) WHEN e >= 0.5 AND j >= 0.2 THEN ('clarification', e) WHEN e >= 0.5 THEN ('new_fact', e)
      WHEN xa > 0 AND xb > 0 AND e = 0 THEN ('new_fact', 0.5::DOUBLE) WHEN j < 0.1 AND e < 0.1 THEN ('none', 0.0::DOUBLE) ELSE ('none', greatest(j, e) * 0.5::DOUBLE) END AS r FROM p2)
    SELECT fact_id, r[1] AS relation, round(r[2], 6) AS confidence FROM p3""",
)
def f11(s, d):
    f = facts(s, d).select("fact_id", "parent_id", "content", F.array_compact(F.array("topic", "lang")).alias("entities"))
    a = f.select(F.col("fact_id").alias("parent_id"), F.col("content").alias("a_text"), F.col("entities").alias("a_entities"))
    pairs = f.select("fact_id", "parent_id", F.col("content").alias("b_text"), F.col("entities").alias("b_entities")).join(a, "parent_id")
    return relations.pair_relation(pairs).select("fact_id", "relation", "confidence")


@on_facts(
    "g9_auto_link",
    f""", {VEC_SQL.strip()}, l AS (SELECT fact_id AS id, kind FROM facts WHERE NOT tombstoned AND confidence >= 0.5),
    m AS (SELECT query_id, fact_id, round(cosine, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 6) DESC, fact_id) AS n FROM cs JOIN l a ON a.id = query_id JOIN l b ON b.id = fact_id AND a.kind = b.kind WHERE round(cosine, 6) >= 0.2)
    SELECT query_id AS fact_id, fact_id AS parent_id, score FROM m WHERE n <= 5 UNION SELECT fact_id, query_id, score FROM m WHERE n <= 5""",
)
def g9(s, d):
    f = facts(s, d)
    of = f.where(~F.col("tombstoned") & (F.col("confidence") >= 0.5)).select("fact_id", F.col("kind").alias("grp")).distinct()
    q = query_vectors(s, d).join(of.withColumnRenamed("fact_id", "query_id"), "query_id")
    near = vectors.cosine_scores(q, emb(s, d).join(of, "fact_id"), least=0.2 - 1e-6, best=5).select("query_id", "fact_id", F.round("cosine", 6).alias("score"))
    return relations.auto_link(near, f, least=0.2)


def scenarios(s, d):
    """Frozen scenarios: the words of each benchmark passage."""
    i = F.col("item_id")
    return table(s, d, "benchmark").select(i.alias("scenario_id"), relations.words(F.col("text")).alias("words"), (i % 40).alias("age_days"), (0.5 + (i % 5) * 0.1).alias("importance"), (i % 7).alias("access_count"))


_SCENES = f"sc AS (SELECT item_id AS scenario_id, {words_sql('text')} AS ws, item_id % 40 AS age_days, 0.5::DOUBLE + (item_id % 5) * 0.1::DOUBLE AS importance, item_id % 7 AS access_count FROM benchmark), sw AS (SELECT scenario_id, len(ws) AS m, unnest(ws) AS t FROM sc)"


def _scores_sql(rows: str, w: float) -> str:
    return f"""mw AS (SELECT id, len(ws) AS n, unnest(ws) AS t FROM ({rows})), ss AS (SELECT id, scenario_id, round({w}::DOUBLE * count(*) / any_value(m) + (1 - {w}::DOUBLE) * count(*) / (any_value(n) + any_value(m) - count(*)), 6) AS score FROM mw JOIN sw USING (t) GROUP BY 1, 2)"""


@on_facts(
    "g15_scenario_assign",
    f""", {_SCENES}, {_scores_sql("SELECT fact_id AS id, " + words_sql("content") + " AS ws FROM facts", 0.6)},
    b AS (SELECT id, arg_max(scenario_id, (score, -scenario_id)) AS scenario_id, max(score) AS score FROM ss GROUP BY 1)
    SELECT fact_id, CASE WHEN score >= 0.12 THEN 'sc_' || scenario_id ELSE 'new_' || md5(content) END AS scenario, CASE WHEN score >= 0.12 THEN score ELSE 0.0 END::DOUBLE AS score FROM facts LEFT JOIN b ON id = fact_id WHERE len({words_sql("content")}) > 0""",
)
def g15(s, d):
    return relations.scenario_assign(facts(s, d), scenarios(s, d))


@register(
    "g16_scenario_rank",
    f"""WITH {_SCENES}, {_scores_sql("SELECT conv_id * 1000 + turn AS id, " + words_sql("text") + " AS ws FROM conversations WHERE role = 'user'", 0.7)},
    x AS (SELECT id AS query_id, scenario_id, round(score * greatest(0.1::DOUBLE, 1 - age_days / 30) * (0.5::DOUBLE + 0.5::DOUBLE * importance) * (1 + 0.1::DOUBLE * access_count), 6) AS score FROM ss JOIN sc USING (scenario_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scenario_id)::INT AS rank FROM x) SELECT * FROM r WHERE rank <= 3""",
)
def g16(s, d):
    turns = table(s, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return relations.scenario_rank(turns, scenarios(s, d))

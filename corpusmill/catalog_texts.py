"""Queries of outcome, kind, dates, procedures, sharing and experience rules, with their DuckDB SQL.

The given texts show few of the phrases these rules look for, so each text is led by one of a list of notes, by its id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog_relations import quoted, words_sql
from corpusmill.catalog_screening import case_sql, text_sql
from corpusmill.operators import distilling, experiences, personal, personal_names, screening, scrubbing, texts, vectors
from corpusmill.operators.texts import CAUSE, FAILURE, LESSON_WORDS, SCRUBS, SEVERE, SUCCESS, TOPIC_SKIP, WEEKDAYS, word
from corpusmill.registry import VEC_SQL, docs, emb, on_facts, query_vectors, register
from corpusmill.sources.views import facts, queries_table, table

NOTES = [
    "we met yesterday at noon.", "3 days ago it broke.", "next friday then.", "on March 5, 2023 it was.", "seen 14/02/2023.", "last weekend it worked", "2 months ago.", "5 years ago.",
    "this works, shipped and verified.", "crash, root cause known, the fix is in.", "that failed, dead end.", "last month.", "this week.", "2024-01-15 was the day.", "[LESSON] look twice.", "老板 went.", "用户决定: x",
    "plain words only.", "past 10 days.", "2 weeks ago.", "analyze it\naction: do it\nverify it.", "C:\\tmp\\a.txt and ~/b and 10.0.0.1.", "[Doc timestamp: 2023-05-06] Red House Party", "my flight leaves soon.", "last tuesday.",
    "not so.", "(red/blue/green) are set.",
]
LIST_SQL = "[" + ", ".join(text_sql(n) for n in NOTES) + "]"
NOTED_SQL = f"nt AS (SELECT doc_id AS fact_id, ({LIST_SQL})[doc_id % {len(NOTES)} + 1] || ' ' || coalesce(text, '') AS t, DATE '2024-01-31' - (doc_id % 120)::INT AS a FROM documents)"
SYNONYMS = [("the", 0, "this"), ("the", 1, "that"), ("der", 0, "dieser"), ("la", 0, "cette"), ("el", 0, "este")]
CONNECTORS = ["based on", "according to", "first time", "in common", "related to", "connection with", "asked about"]


def noted(s, d):
    """(fact_id, t, a): each document's text led by a note, and an anchor date."""
    i = F.col("doc_id")
    note = F.element_at(F.array(*map(F.lit, NOTES)), (i % len(NOTES) + 1).cast("int"))
    return docs(s, d).select(i.alias("fact_id"), F.concat(note, F.lit(" "), F.coalesce("text", F.lit(""))).alias("t"), F.date_sub(F.lit("2024-01-31").cast("date"), (i % 120).cast("int")).alias("a"))


def on_notes(name: str, sql: str):
    return register(name, f"WITH {NOTED_SQL} {sql}")


def has(pattern: str, col: str = "t") -> str:
    return f"regexp_matches({col}, {text_sql(pattern)})"


def number(pattern: str, group: int = 1, col: str = "t") -> str:
    return f"TRY_CAST(nullif(regexp_extract({col}, {text_sql(pattern)}, {group}), '') AS INT)"


def hits_sql(patterns: list[str], col: str = "t") -> str:
    return "(" + " + ".join(f"{has(word(p), col)}::INT" for p in patterns) + ")"


@register(
    "c6_negation_conflicts",
    f"""WITH x AS (SELECT doc_id, list_sort({words_sql("text")}) AS ws, coalesce({has(experiences.NEGATION, "text")}, FALSE) AS neg FROM documents), c AS (SELECT min(doc_id) AS id, ws, neg FROM x WHERE len(ws) > 0 GROUP BY 2, 3),
    p AS (SELECT a.id AS plain_class, b.id AS negated_class, len(list_intersect(a.ws, b.ws))::DOUBLE AS m, len(a.ws) + len(b.ws) AS n FROM c a JOIN c b ON NOT a.neg AND b.neg AND len(a.ws) >= 0.59 * len(b.ws) AND len(b.ws) >= 0.59 * len(a.ws))
    SELECT plain_class, negated_class, round(m / (n - m), 6) AS jaccard FROM p WHERE round(m / (n - m), 6) >= 0.6""",
)
def c6(s, d):
    return experiences.negation_conflicts(docs(s, d).select(F.col("doc_id").alias("fact_id"), F.col("text").alias("content")))[0]


@on_facts(
    "f13_match_experiences",
    f""", w0 AS (SELECT *, regexp_extract_all(lower(coalesce(content, '')), '[a-z]{{4,}}') AS l FROM facts WHERE kind IN ('lesson', 'success_pattern', 'failure_pattern')),
    w1 AS (SELECT *, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5]) AS kw FROM w0), q AS (SELECT item_id AS query_id, {words_sql("text")} AS ws FROM benchmark),
    kq AS (SELECT query_id, kw FROM (SELECT DISTINCT kw FROM w1), q WHERE len(list_filter(ws, lambda w: contains(kw, w))) > 0),
    n AS (SELECT query_id, fact_id, count(*) AS n, any_value(kind) AS kind, any_value(access_count) AS u, any_value(importance) AS i, any_value(age_days) AS d FROM w1 JOIN kq USING (kw) GROUP BY 1, 2),
    sc AS (SELECT query_id, fact_id, u, d, round(n * 0.35::DOUBLE + CASE WHEN u >= 3 OR i >= 0.95 THEN 0.1::DOUBLE ELSE 0 END - least(0.3::DOUBLE, d / 30 * CASE WHEN kind = 'failure_pattern' THEN 0.12::DOUBLE ELSE 0.05::DOUBLE END), 6) AS score FROM n)
    SELECT query_id, fact_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, u DESC, d, fact_id)::INT AS rank FROM sc) WHERE rank <= 5""",
)
def f13(s, d):
    f = facts(s, d).where(F.col("kind").isin("lesson", "success_pattern", "failure_pattern"))
    return experiences.match_experiences(queries_table(s, d), f.select("fact_id", screening.keywords(F.col("content")).alias("keywords"), (F.col("kind") == "failure_pattern").alias("bad"), "access_count", "importance", "age_days"))


_FLAT = "string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')"


@register(
    "f17_expand_query",
    f"""WITH y(w, n, syn) AS (VALUES {", ".join(f"('{w}', {n}, '{x}')" for w, n, x in SYNONYMS)}), q AS (SELECT item_id AS query_id, {_FLAT} AS ws FROM benchmark), p AS (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM q),
    v AS (SELECT query_id, array_to_string(list_transform(ws, lambda x, i: CASE WHEN i = pos THEN syn ELSE x END), ' ') AS variant, row_number() OVER (PARTITION BY query_id ORDER BY pos, n)::INT AS rank FROM p JOIN y ON ws[pos] = w) SELECT query_id, rank, variant FROM v WHERE rank <= 3""",
)
def f17(s, d):
    return texts.expand_query(queries_table(s, d), F.broadcast(s.createDataFrame(SYNONYMS, "word string, n int, synonym string")))


_AFTER = text_sql(rf"(?is)(?:^|[^A-Za-z0-9_])(?:{'|'.join(CONNECTORS)})[^A-Za-z0-9_](.*)$")


@register(
    "f18_decompose_query",
    f"""WITH q AS (SELECT item_id AS query_id, 'Anna asked about "Red Sea" ' || text AS q FROM benchmark), p AS (SELECT query_id, q, regexp_replace(regexp_extract(q, {_AFTER}, 1), '^[ ,?."]+|[ ,?."]+$', '', 'g') AS after,
      regexp_extract_all(q, '"([^"]{{3,}})"', 1) AS quoted, list_distinct(regexp_extract_all(q, '[A-Z][a-z][a-zA-Z''-]+')) AS names FROM q)
    SELECT DISTINCT query_id, unnest(list_concat([q], CASE WHEN length(after) >= 5 THEN [after] ELSE [] END, quoted, CASE WHEN len(names) >= 2 THEN list_transform(names, lambda n: n || ' ' || q) ELSE [] END)) AS part FROM p""",
)
def f18(s, d):
    q = queries_table(s, d).select("query_id", F.concat(F.lit('Anna asked about "Red Sea" '), "query").alias("query"))
    return texts.decompose_query(q, CONNECTORS)


@on_notes("g13_rule_classify", f"SELECT fact_id, {case_sql('t', [(p, k) for p, k, _ in texts.KIND_RULES], text_sql('fact'))} AS kind, {case_sql('t', [(p, c) for p, _, c in texts.KIND_RULES], '0.5')}::DOUBLE AS confidence FROM nt")
def g13(s, d):
    return noted(s, d).select("fact_id", texts.classify_kind(F.col("t")).alias("k")).select("fact_id", "k.kind", "k.confidence")


@on_facts(
    "h4_auto_invalidate",
    f""", {VEC_SQL.strip()}, n AS (SELECT cs.fact_id, query_id, round(cosine, 6) AS score, o.importance AS old, w.importance AS new FROM cs JOIN facts w ON w.fact_id = query_id JOIN facts o ON o.fact_id = cs.fact_id AND o.kind = w.kind AND o.topic = w.topic
      WHERE w.kind IN ('decision', 'user_preference', 'fact', 'lesson') AND NOT o.tombstoned AND o.ended_days IS NULL)
    SELECT fact_id, arg_max(query_id, (score, -query_id)) AS replaced_by, max(score) AS similarity FROM n WHERE score >= 0.1 AND new >= old GROUP BY 1""",
)
def h4(s, d):
    f, kinds = facts(s, d), ["decision", "user_preference", "fact", "lesson"]
    by = F.to_json(F.array("kind", "topic"))
    new = f.where(F.col("kind").isin(kinds) & F.col("topic").isNotNull()).select(F.col("fact_id").alias("query_id"), by.alias("grp"))
    old = f.where(~F.col("tombstoned") & F.col("ended_days").isNull() & F.col("topic").isNotNull()).select("fact_id", by.alias("grp"))
    near = vectors.cosine_scores(query_vectors(s, d).join(new, "query_id"), emb(s, d).join(old, "fact_id"), least=0.1 - 1e-6).select("query_id", "fact_id", F.round("cosine", 6).alias("score"))
    return experiences.auto_invalidate(f, near, f, kinds, least=0.1)


@on_facts("i4_graph_dot", "SELECT parent_id AS parent, '  n' || parent_id || ' -> n' || fact_id || ';' AS line FROM facts WHERE parent_id IS NOT NULL")
def i4(s, d):
    f = facts(s, d).where("parent_id IS NOT NULL")
    return f.select(F.col("parent_id").alias("parent"), F.concat(F.lit("  n"), "parent_id", F.lit(" -> n"), "fact_id", F.lit(";")).alias("line"))


@on_notes("j3_personal_content", "SELECT fact_id, unnest(list_filter([" + ", ".join(f"CASE WHEN {has(p)} THEN '{n}' END" for n, p in texts.PERSONAL) + "], lambda x: x IS NOT NULL)) AS category FROM nt")
def j3(s, d):
    return noted(s, d).select("fact_id", F.explode(texts.personal_content(F.col("t"))).alias("category"))


def scrub_sql(col: str) -> str:
    for pattern, mark in SCRUBS:
        col = f"regexp_replace({col}, {text_sql(pattern)}, '{mark}', 'g')"
    return col


@on_notes("j7_scrub", f"SELECT fact_id, md5({scrub_sql('t')}) AS scrubbed_md5 FROM nt")
def j7(s, d):
    return noted(s, d).select("fact_id", F.md5(texts.scrub(F.col("t"))).alias("scrubbed_md5"))


def curve_sql(n: str) -> str:
    return f"CASE WHEN {n} >= 3 THEN 1.0 WHEN {n} = 2 THEN 0.75 WHEN {n} = 1 THEN 0.5 ELSE 0.0 END::DOUBLE"


@on_notes(
    "j11_outcome",
    f""", h AS (SELECT fact_id, t, {hits_sql(SEVERE)} AS e, {hits_sql(CAUSE[:-1])} + {hits_sql(CAUSE[-1:], "regexp_replace(t, '(?i)the fix', 'the-x', 'g')")} AS c, {hits_sql(SUCCESS)} AS g, {hits_sql(FAILURE)} AS b, regexp_matches(lower(t), '{"|".join(LESSON_WORDS)}') AS y FROM nt),
    o AS (SELECT *, CASE WHEN trim(t) = '' THEN 'neutral' WHEN regexp_matches(t, '(?i)^\\s*R-class(?:[^A-Za-z0-9_]|$)') THEN 'success' WHEN y OR (e > 0 AND c > 0) THEN 'lesson' WHEN b > 0 THEN 'failure' WHEN g > 0 THEN 'success' ELSE 'neutral' END AS outcome FROM h)
    SELECT fact_id, outcome, CASE outcome WHEN 'lesson' THEN CASE WHEN e > 0 AND c > 0 THEN least(1.0::DOUBLE, round(e * 0.4::DOUBLE + c * 0.3::DOUBLE, 6)) ELSE 0.0 END WHEN 'failure' THEN {curve_sql("b")} WHEN 'success' THEN {curve_sql("g")} ELSE 0.0 END::DOUBLE AS strength FROM o""",
)
def j11(s, d):
    return texts.with_outcome(noted(s, d), "t").select("fact_id", "outcome", "strength")


_CLEAN = "regexp_replace(t, '\\[Doc timestamp:[^\\]]+\\]\\s*|(topic|session):\\s*[A-Za-z0-9_-]+', '', 'g')"
_SKIP = quoted(TOPIC_SKIP)


@on_notes(
    "j16_topic_session",
    f""", c AS (SELECT fact_id, t, {_CLEAN} AS c FROM nt), p AS (SELECT *, regexp_extract(c, '[A-Z][A-Za-z0-9]{{2,}}(?:\\s+[A-Z][A-Za-z0-9]{{2,}})*') AS p, list_filter(regexp_extract_all(lower(c), '[a-z]{{3,}}'), lambda w: w NOT IN ({_SKIP})) AS l FROM c)
    SELECT fact_id, CASE WHEN p <> '' AND lower(p) NOT IN ({_SKIP}) THEN p ELSE array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i)[1:4], lambda w: upper(w[1]) || w[2:]), ' ') END AS topic,
    coalesce('doc-' || coalesce(nullif(regexp_extract(t, '\\[Doc timestamp:\\s*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), ''), nullif(regexp_extract(t, '(?:^|[^A-Za-z0-9_])([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:[^A-Za-z0-9_]|$)', 1), '')), '') AS session FROM p""",
)
def j16(s, d):
    return noted(s, d).select("fact_id", texts.topic(F.col("t")).alias("topic"), texts.session_id(F.col("t")).alias("session"))


def _ago_sql(unit: str, col: str = "t") -> str:
    return number(word(f"([0-9]{{1,4}})\\s+{unit}s?\\s+ago"), 1, col)


def _case(arms: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + " END"


def _day(days: str, precision: str = "day") -> str:
    return f"{{'d': (a + ({days})::INT)::DATE, 'p': '{precision}'}}"


_SAT = "((5 - (isodow(a) - 1) + 7) % 7)"
_WD = f"list_position({WEEKDAYS}, regexp_extract(tk, '[a-z]+$')) - 1"
_MON = word(r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+([0-9]{1,2}),?\s+([0-9]{4})")
_DMY = r"(?:^|[^A-Za-z0-9_])([0-9]{1,2})[/.-]([0-9]{1,2})(?:[/.-]([0-9]{4}|[0-9]{2}))?(?:[^A-Za-z0-9_]|$)"
_PHRASES = [("today", 0), ("yesterday", -1), ("tomorrow", 1), ("the other day", -3), ("last night", -1), ("this morning", 0), ("tonight", 0), ("last week", -7), ("this week", 0), ("next week", 7)]
_DATE_SQL = _case(
    [(has(word(p)), _day(str(n))) for p, n in _PHRASES]
    + [(has(word("last weekend")), _day("-(isodow(a) - 1) - 2")), (has(word("this weekend")), _day(_SAT)), (has(word("next weekend")), _day(f"{_SAT} + 7"))]
    + [(f"{_ago_sql('day')} IS NOT NULL", _day(f"-{_ago_sql('day')}")), (f"{_ago_sql('week')} IS NOT NULL", _day(f"-7 * {_ago_sql('week')}"))]
    + [(f"{_ago_sql('month')} IS NOT NULL", f"{{'d': (date_trunc('month', a - to_months({_ago_sql('month')}))::DATE + (least(day(a), 28) - 1)::INT)::DATE, 'p': 'month'}}")]
    + [(f"{_ago_sql('year')} IS NOT NULL", f"{{'d': (a - to_years({_ago_sql('year')}))::DATE, 'p': 'year'}}")]
    + [(has(word(r"a\s+(?:couple\s+of\s+)?weeks?\s+ago")), _day("-14")), (has(word(r"a\s+few\s+days?\s+ago")), _day("-3")), (has(word("now")), _day("0"))]
    + [("starts_with(tk, 'next')", _day(f"(({_WD}) - (isodow(a) - 1) + 6) % 7 + 1")), ("tk <> ''", _day(f"-(((isodow(a) - 1) - ({_WD}) + 7) % 7)"))]
    + [("mn IS NOT NULL", "{'d': mn, 'p': 'day'}"), ("dm IS NOT NULL", "{'d': dm, 'p': 'day'}")]
)


@on_notes(
    "j17_relative_dates",
    f""", k AS (SELECT fact_id, t, a, lower(regexp_extract(t, {text_sql(word("((?:(?:last|next)" + chr(92) + "s+)?(?:" + "|".join(WEEKDAYS) + "))"))}, 1)) AS tk,
      TRY_CAST(printf('%04d-%02d-%02d', {number(_MON, 3)}, list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(regexp_extract(t, {text_sql(_MON)}, 1))), {number(_MON, 2)}) AS DATE) AS mn,
      TRY_CAST(printf('%04d-%02d-%02d', CASE WHEN {number(_DMY, 3)} IS NULL THEN year(a) WHEN {number(_DMY, 3)} < 100 THEN 2000 + {number(_DMY, 3)} ELSE {number(_DMY, 3)} END, {number(_DMY, 2)}, least({number(_DMY, 1)}, 28)) AS DATE) AS dm FROM nt),
    r AS (SELECT fact_id, {_DATE_SQL} AS r FROM k) SELECT fact_id, r.d::VARCHAR AS event_date, r.p AS precision FROM r WHERE r IS NOT NULL""",
)
def j17(s, d):
    found = noted(s, d).select("fact_id", texts.resolve_date(F.col("t"), F.col("a")).alias("r")).where("r IS NOT NULL")
    return found.select("fact_id", F.col("r.event_date").cast("string").alias("event_date"), "r.precision")


_L = "lower(t)"
_MO = "(a - (isodow(a) - 1)::INT)"
_ISO = "(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})"
_PAST = number(word(r"(?:past|last)\s+([0-9]{1,4})\s+days?"), 1, _L)


def _span(lo: str, hi: str) -> str:
    return f"{{'lo': ({lo})::DATE, 'hi': ({hi})::DATE}}"


def _month(n: str) -> str:
    return _span(f"date_trunc('month', a) - to_months({n})", f"last_day((date_trunc('month', a) - to_months({n}))::DATE)")


def _named(which: str) -> str:
    return f"(list_position({WEEKDAYS}, regexp_extract({_L}, {text_sql(word(which + chr(92) + 's+(' + '|'.join(WEEKDAYS) + ')'))}, 1)) - 1)"


_EXACT = f"TRY_CAST(printf('%04d-%02d-%02d', {number(_ISO, 1)}, {number(_ISO, 2)}, {number(_ISO, 3)}) AS DATE)"
_RANGE_SQL = _case(
    [
        (f"{_EXACT} IS NOT NULL", _span(_EXACT, _EXACT)),
        (f"{_PAST} IS NOT NULL", _span(f"a - {_PAST}", "a")),
        (f"{_ago_sql('day', _L)} IS NOT NULL", _span(f"a - {_ago_sql('day', _L)}", f"a - {_ago_sql('day', _L)}")),
        (f"{_ago_sql('week', _L)} IS NOT NULL", _span(f"{_MO} - 7 * {_ago_sql('week', _L)}", f"{_MO} - 7 * {_ago_sql('week', _L)} + 6")),
        (f"{_ago_sql('month', _L)} IS NOT NULL", _month(_ago_sql("month", _L))),
        (has(word(r"last\s+night|yesterday"), _L), _span("a - 1", "a - 1")),
        (has(word("today"), _L), _span("a", "a")),
        (has(word("tomorrow"), _L), _span("a + 1", "a + 1")),
        (f"{_named('last')} >= 0", _span(f"{_MO} + {_named('last')}::INT - 7", f"{_MO} + {_named('last')}::INT - 7")),
        (f"{_named('this')} >= 0", _span(f"{_MO} + {_named('this')}::INT", f"{_MO} + {_named('this')}::INT")),
        (has(word(r"last\s+week"), _L), _span(f"{_MO} - 7", f"{_MO} - 1")),
        (has(word(r"this\s+week"), _L), _span(_MO, "a")),
        (has(word(r"last\s+month"), _L), _month("1")),
        (has(word(r"this\s+month"), _L), _span("date_trunc('month', a)", "a")),
    ]
)


@on_notes("j18_time_range", f", r AS (SELECT fact_id, {_RANGE_SQL} AS r FROM nt) SELECT fact_id, r.lo::VARCHAR AS lo, r.hi::VARCHAR AS hi FROM r WHERE r IS NOT NULL")
def j18(s, d):
    found = noted(s, d).select("fact_id", texts.time_range(F.col("t"), F.col("a")).alias("r")).where("r IS NOT NULL")
    return found.select("fact_id", F.col("r.lo").cast("string").alias("lo"), F.col("r.hi").cast("string").alias("hi"))


@on_notes(
    "j21_grounding_audit",
    r""", f AS (SELECT fact_id, t, list_filter(flatten(list_transform(regexp_extract_all(t, '[(\[【]\s*([^()\[\]【】]{2,16}(?:[/、,;\s]+[^()\[\]【】]{2,16}){2,})\s*[)\]】]', 1), lambda x: regexp_split_to_array(x, '[/、,;\s]+'))), lambda x: length(x) >= 2) AS items FROM nt)
    SELECT c.fact_id, p.fact_id IS NOT NULL AND coalesce(len(list_filter(c.items, lambda i: NOT contains(p.t, i))), 0) = 0 AS grounded FROM f c LEFT JOIN f p ON c.fact_id > 0 AND p.fact_id = c.fact_id // 2""",
)
def j21(s, d):
    f = noted(s, d).select("fact_id", F.col("t").alias("content"))
    edges = f.where("fact_id > 0").select(F.col("fact_id").alias("child"), F.floor(F.col("fact_id") / 2).alias("parent"))
    return texts.grounding_audit(f, edges)


@register("j22_split_procedure", None)
def j22(s, d):
    return noted(s, d).select("fact_id", texts.split_procedure(F.col("t")).alias("p")).select("fact_id", "p.*")


@register("j10_clear_tool_results", None)
def j10(s, d):
    """Turns of every conversation as marked results, in pieces of ten turns, older ones cleared."""
    c = table(s, d, "conversations")
    marked = F.concat(F.lit("__tool_result_"), F.col("turn"), F.lit("__"), F.coalesce("text", F.lit("")), F.lit("__/tool_result__"))
    log = c.groupBy("conv_id", F.floor(F.col("turn") / 10).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("turn", marked.alias("m")))).alias("l"))
    return log.select("conv_id", "piece", texts.clear_tool_results(F.array_join(F.transform("l", lambda x: x["m"]), "\n")).alias("text"))


LEADS = [
    "First open src/api/v2/handler.py:142, then call bus.flush() with MAX_ROWS=50.", "My phone is 13812345678. The method works.", "We moved to Berlin with the kids. Next step: pin v2.1.3.", "I live in Tokyo.",
    "Mail ann@example.org, card 4111111111111111, bot_id=8263b17ef000.", "Ship I is done. The process is on mp.weixin.qq.com since 2024-01-02.", "我们的方法分三步，先打开文件，然后保存。我抑郁了。", "telegram chat id: 123456789 is the operator's.", "Our approach to the scanner is a pattern.", "plain",
]


def led(s, d):
    """(fact_id, kind, confidence, t): each fact's text led by one of a list of phrases, by its id."""
    phrase = F.element_at(F.array(*map(F.lit, LEADS)), (F.col("fact_id") % len(LEADS) + 1).cast("int"))
    kind = F.when(F.col("fact_id") % 3 == 0, "method").otherwise(F.col("kind"))
    return facts(s, d).select("fact_id", kind.alias("kind"), "confidence", F.concat(phrase, F.lit(" "), F.coalesce("content", F.lit(""))).alias("t"))


@register("j4_private_values", None)
def j4_values(s, d):
    """All private values by the full rules, which look around a match; held against plain Python."""
    return led(s, d).select("fact_id", F.inline(personal.values_of(F.col("t")))).groupBy("fact_id", "name", "severity").agg(F.count("*").alias("n"), F.min("sample").alias("first_sample"))


@register("j6_visibility_rules", None)
def j6_rules(s, d):
    """Visibility of facts with and without hints by the full rules."""
    hint = F.when(F.col("fact_id") % 5 == 0, "commons").when(F.col("fact_id") % 5 == 1, "personal")
    seen = led(s, d).select("fact_id", personal.visibility_of(F.col("t"), F.col("kind"), hint, F.col("confidence")).alias("v"))
    return seen.select("fact_id", "v.visibility", "v.reason", F.array_join("v.signals", ",").alias("signals"), "v.override")


@register("j9_distill", None)
def j9(s, d):
    """Distilled texts with their report; a fold over sentences that SQL does not say; held against plain Python and hand rows."""
    done = led(s, d).select("fact_id", distilling.distilled(F.col("t")).alias("x"))
    return done.select("fact_id", F.md5("x.text").alias("text_md5"), F.length("x.text").alias("n_chars"), F.array_join("x.reasons", ",").alias("reasons"), *[f"x.{c}" for c in (*distilling.REPORT, *distilling.FLAGS)])


@register("j7_scrub_names", None)
def j7_names(s, d):
    """Texts led by a path and followed by its owner's name, which the path alone gives away; held against plain Python."""
    owner = F.concat(F.lit("ann"), F.lower(F.substring(F.md5(F.col("fact_id").cast("string")), 1, 4)))
    led = F.concat(F.lit("C:\\Users\\"), owner, F.lit("\\notes\\a.txt and /home/"), owner, F.lit("/b by "), owner, F.lit(", born 1990-01-02; "), F.col("t"))
    found = noted(s, d).select("fact_id", scrubbing.scrubbed(led).alias("x"))
    return found.select("fact_id", F.md5("x.text").alias("text_md5"), F.size("x.changes").alias("n_changes"), F.array_join(F.array_distinct(F.transform("x.changes", lambda c: c["kind"])), ",").alias("kinds"))


def nested_props(s, d):
    """Events whose props are nested by fixed arithmetic: strings with paths, hosts and names under keys, lists and JSON in strings; some are broken."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type", "props")
    i, name = F.col("event_id"), F.concat(F.lit("bob"), F.col("user_id"))
    inner = F.to_json(F.struct(F.concat(F.lit("/home/"), name, F.lit("/x y")).alias("p"), (i % 7).alias("n")))
    body = F.struct(
        F.concat(F.lit("C:\\Users\\"), name, F.lit("\\"), F.col("event_type"), F.lit(".log")).alias("path"), F.array(F.concat(name, F.lit(" met 10.0."), i % 9, F.lit(".1")), F.lit("plain"), inner).alias("list"),
        F.struct((F.col("user_id") / 8).alias("x"), F.lit(True).alias("ok"), F.lit("C:\\tmp\\q").alias("C:\\tmp\\q")).alias("deep"), F.lit("see notes. txt at example. com").alias("said"),
    )
    json = F.to_json(body)
    props = F.when(i % 5 == 0, F.col("props")).when(i % 5 == 1, F.substring(json, 1, 40)).otherwise(json)
    return e.select("event_id", props.alias("props"), F.concat(F.lit("by "), name, F.lit(" on 192.168.1.1")).alias("note"))


@register("j8_scrub_values", None)
def j8(s, d):
    """JSON columns scrubbed string by string together with the text beside them; held against plain json."""
    done = scrubbing.scrub_values(nested_props(s, d), ["props", "note"])
    return done.select("event_id", "props", "note", F.size("changes").alias("n_changes"))


SURNAMES, GIVEN = "李王张刘陈杨黄赵周吴方时", "伟芳娜敏静丽强磊洋艳雷明"
NAMED = [("李雷 主持复盘", True), ("由 王芳 做了周报", True), ("张三负责华东区", True), ("方法要写成步骤", False), ("时间到了就做", False), ("陈静，好", True), ("in 刘洋 out", True), ("方案", False), ("赵强强 x", True), ("周明雷丽", True), ("plain words", False), ("吴, 伟", False), ("方丽", False)]
NAMED_SQL = "[" + ", ".join(f"{{'t': {text_sql(t)}, 'y': {str(y).lower()}}}" for t, y in NAMED) + "]"


@register(
    "j23_name_detection",
    f"""WITH x AS (SELECT ({NAMED_SQL})[doc_id % {len(NAMED)} + 1].t || ' ' || coalesce(text, '') AS t, ({NAMED_SQL})[doc_id % {len(NAMED)} + 1].y AS y FROM documents),
    f AS (SELECT y, regexp_matches(t, '(^|[^一-鿿])[{SURNAMES}][{GIVEN}]{{1,2}}([^一-鿿]|$)') AS f FROM x),
    c AS (SELECT count(*) FILTER (f AND y) AS tp, count(*) FILTER (f AND NOT y) AS fp, count(*) FILTER (NOT f AND y) AS fn, count(*) FILTER (NOT f AND NOT y) AS tn FROM f)
    SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall FROM c""",
)
def j23(s, d):
    """The detector on the documents, each led by one of a list of labelled phrases; the tables of characters are short ones."""
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in NAMED]), (F.col("doc_id") % len(NAMED) + 1).cast("int"))
    rows = docs(s, d).select(F.concat(pick(0), F.lit(" "), F.coalesce("text", F.lit(""))).alias("t"), pick(1).alias("y"))
    return personal_names.measure(rows, "t", "y", SURNAMES, GIVEN)


@register("g17_mine_public", None)
def g17(s, d):
    f = facts(s, d).join(noted(s, d).select("fact_id", "t"), "fact_id").withColumn("content", F.col("t"))
    mined = f.where("fact_id % 10 = 0").select("fact_id")
    return texts.mine_public(f, ["lesson", "success_pattern", "failure_pattern"], mined).select("fact_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))

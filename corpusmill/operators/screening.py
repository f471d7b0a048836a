"""Rules over texts and rows: access, routing, noise, capture gates, privacy patterns. One pass without a shuffle each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.pairing import containing

# Prefixes that mark a turn as small talk.
SMALL_TALK = ["嗯", "ok", "好", "好的", "thanks", "谢谢", "hi", "hello", "👍", "你好"]
# What may follow a program's name at the start of a command, and script runners with their files' ending.
LAUNCHES = {
    "powershell": ["-Command", "-NoProfile", "-File", "-EncodedCommand"],
    "pwsh": ["-Command", "-NoProfile", "-File"],
    "python[0-9.]*": ["-c", "-m"],
}
RUNNERS = {"sh": "sh", "bash": "sh", "zsh": "sh", "node": "js"}


def command_start() -> str:
    """A pattern of texts that begin with a command, after a short tag in square brackets or none."""
    forms = [rf"{program}\s+(?:{'|'.join(flags)})\b" for program, flags in LAUNCHES.items()]
    forms += [rf"{runner}\s+[^\s]*\.{ending}\b" for runner, ending in RUNNERS.items()]
    forms.append(r"python[0-9.]*\s+(?:-?\s?<<|-\")")  # a program given inline
    forms.append(r"(?:[A-Za-z]:)?[/\\][^\s\"']*?\.exe\b")  # a program's path
    return rf"(?i)^\s*(?:\[[A-Za-z_ ]{{0,14}}\])?\s*(?:{'|'.join(forms)})"


# Markers of a fact's first line, in order.
ZONE_MARKERS = [
    (r"(?i)^(\[success_pattern\]|verified|ship 接通|搞定|跑通|worked|R-class\b)", "success_pattern"),
    (r"(?i)^(\[failure_pattern\]|走不通|fail|debug 一晚上)", "failure_pattern"),
    (r"(?i)^(\[lesson\]|重要教训|lesson|教训)", "lesson"),
]
# Signals that raise the importance of a fact, in order.
BOOSTS = [
    (r"(?i)^[\s【]*R-class\s+(canonical|locked)", 0.95),
    (r"\[LESSON\]|\[教训\]", 0.85),
    (r"教训|takeaway", 0.7),
    (r"(?i)Iron\s*Rule\s*[0-9]+", 0.85),
    (r"(?i)\(verified\)\s*$", 0.7),
    (r"\(locked\s+[0-9]{4}-[0-9]{2}-[0-9]{2}", 0.9),
]
# ASCII patterns of personal data and secrets, in the order in which they are redacted.
PRIVATE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("cloud_key", r"AKIA[0-9A-Z]{16}"),
    ("card", r"[0-9]{4}[- ][0-9]{4}[- ][0-9]{4}[- ][0-9]{4}|[0-9]{13,19}"),
    ("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("phone", r"\+?[0-9]{1,3}[- ][0-9]{3}[- ][0-9]{3,4}[- ]?[0-9]{2,4}"),
]
FIRST_PERSON = r"(?i)(^|[^A-Za-z])(my|mine|I|I'm|myself)([^A-Za-z]|$)"
# Marks by which a search question is routed.
MULTIHOP = r"(?i)\b(based on|after that|before that|then|because|therefore|since|following|previously|earlier|later|at that time|afterwards|back then|last week|last month|last year|recently)\b"
FACTOID = r"(?i)(where|who|when|what|which|how many|how much)\b|\b[0-9]{4}\b"
PROPER_NOUN = r"[A-Z][a-z]{2,}|\"[^\"]+\"|'[^']+'"


def first_match(text: Column, rules: list[tuple[str, object]], default: object = None) -> Column:
    """Value of the first rule (pattern, value) that the text matches; a null text matches none."""
    out = F.when(text.rlike(rules[0][0]), rules[0][1])
    for pattern, value in rules[1:]:
        out = out.when(text.rlike(pattern), value)
    return out.otherwise(F.lit(default))


def access(facts: DataFrame, role: str, user: str | None, grants: DataFrame) -> DataFrame:
    """(fact_id, allowed, reason): may this principal read each fact? grants(grantor, grantee, revoked, expires_in_days).

    Public facts are open, source facts need the role admin or system, private ones their owner or, for an admin, a
    grant of the owner that is neither revoked nor expired. The principal's grants are joined by owner.
    """
    live = grants.where((F.col("grantee") == F.lit(f"{role}:{user}")) & ~F.col("revoked") & (F.col("expires_in_days") > 0))
    owned = facts.join(live.select(F.col("grantor").alias("user_id"), F.lit(True).alias("granted")).distinct(), "user_id", "left")
    tier = F.col("tier")
    reason = (
        F.when(tier == "public", "public")
        .when(tier == "source", "role" if role in ("admin", "system") else "denied_role")
        .when(F.col("user_id") == F.lit(user), "own")
        .when(F.coalesce("granted", F.lit(False)) & F.lit(role == "admin"), "granted")
        .otherwise("denied_no_grant")
    )
    return owned.select("fact_id", reason.alias("reason")).select("fact_id", (~F.col("reason").startswith("denied")).alias("allowed"), "reason")


def zone(kind: Column) -> Column:
    return F.when(kind == "failure_pattern", "failure").when(kind == "lesson", "lesson").when(kind == "success_pattern", "success").otherwise("other")


def route_by_rules(facts: DataFrame, rules: list[tuple[str, int, str, str]]) -> DataFrame:
    """(fact_id, rule, action) of the rule (name, priority, pattern, action) that wins: priority, then name; no match, no row."""
    ordered = sorted(rules, key=lambda r: (-r[1], r[0]))
    name = first_match(F.col("content"), [(r[2], r[0]) for r in ordered])
    action = first_match(F.col("content"), [(r[2], r[3]) for r in ordered])
    return facts.select("fact_id", name.alias("rule"), action.alias("action")).where("rule IS NOT NULL")


def capture_gate(text: Column, min_length: int = 30) -> Column:
    """Why a turn is not worth keeping: empty, too_short, noise_prefix or execution_log; else keep."""
    body = F.regexp_replace(text, r"^\s+", "")
    first = F.lower(F.regexp_extract(body, r"^[^\s]+", 0))
    return (
        F.when(text.isNull() | (F.length(body) == 0), "empty")
        .when(F.length(text) < min_length, "too_short")
        .when(first.isin(SMALL_TALK) | F.lower(F.substring(body, 1, 2)).isin(SMALL_TALK), "noise_prefix")
        .when(body.rlike(command_start()), "execution_log")
        .otherwise("keep")
    )


def choose_route(text: Column) -> Column:
    """graph, dense or hybrid retrieval for a question."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return (
        F.when(body == "", "hybrid")
        .when(body.rlike(MULTIHOP), "graph")
        .when(body.rlike(FACTOID), "dense")
        .when((F.size(F.split(body, " ")) <= 4) & ~body.rlike(PROPER_NOUN), "graph")
        .otherwise("hybrid")
    )


def classify_first_line(facts: DataFrame) -> DataFrame:
    """(fact_id, kind): plain facts whose first line carries a marker get the marker's kind."""
    line = F.trim(F.split_part("content", F.lit("\n"), F.lit(1)))
    return facts.where("kind = 'fact'").select("fact_id", first_match(line, ZONE_MARKERS).alias("kind")).where("kind IS NOT NULL")


def importance_audit(facts: DataFrame) -> DataFrame:
    """(fact_id, importance, target): facts whose first matching signal asks for more importance than they have."""
    return facts.select("fact_id", "importance", first_match(F.col("content"), BOOSTS).alias("target")).where("target > importance")


def private_counts(facts: DataFrame) -> DataFrame:
    """(fact_id, name, n): how often each privacy pattern occurs in each text; none, no row."""
    found = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_count("content", F.lit(p)).cast("long").alias("n")) for n, p in PRIVATE])
    return facts.select("fact_id", F.inline(F.filter(found, lambda x: x["n"] > 0)))


def redact(text: Column) -> Column:
    """Replace privacy patterns, in their order, by [REDACTED:name]."""
    for name, pattern in PRIVATE:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{name}]")
    return text


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    back = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("int"))
    parts = F.transform(back, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d) % 10 == 0


def card_numbers(facts: DataFrame) -> DataFrame:
    """(fact_id, runs, valid): digit runs of card length, spaces and hyphens between fours taken out, and those passing Luhn."""
    runs = F.regexp_extract_all("content", F.lit(r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{1,7}"), F.lit(0))
    plain = F.transform(runs, lambda r: F.regexp_replace(r, "[- ]", ""))
    seen = facts.select("fact_id", plain.alias("runs")).where(F.size("runs") > 0)
    return seen.select("fact_id", F.size("runs").cast("long").alias("runs"), F.size(F.filter("runs", luhn)).cast("long").alias("valid"))


def visibility(facts: DataFrame) -> DataFrame:
    """(fact_id, visibility, reason): personal if a text holds personal data or speaks in the first person, else commons."""
    hit = first_match(F.col("content"), [*((p, n) for n, p in PRIVATE), (FIRST_PERSON, "first_person")])
    return facts.select("fact_id", hit.alias("reason")).select(
        "fact_id", F.when(F.col("reason").isNull(), "commons").otherwise("personal").alias("visibility"), F.coalesce("reason", F.lit("none")).alias("reason")
    )


def importance_score(outcome: Column, text: Column) -> Column:
    """Importance of an observed turn by outcome, length and the wish to remember it."""
    n, long_text = F.coalesce(F.length(text), F.lit(0)), F.coalesce(F.length(text), F.lit(0)) > 200
    good = F.when(F.coalesce(F.lower(text).contains("remember"), F.lit(False)), 0.8).when(long_text, 0.6).otherwise(0.4)
    return F.when(outcome.isin("failure", "lesson"), 0.85).when(outcome == "success", good).when(long_text, 0.6).when(n >= 60, 0.5).otherwise(0.3)


def outcome_of_kind(kind: Column) -> Column:
    return F.when(kind == "failure_pattern", "failure").when(kind == "lesson", "lesson").when(kind == "success_pattern", "success").otherwise("neutral")


def keywords(text: Column, n: int = 5, shortest: int = 4) -> Column:
    """The first n distinct ASCII words of at least the given length."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{%d,}" % shortest), F.lit(0))
    return F.slice(F.array_distinct(words), 1, n)


def keyword_oracle(expected: DataFrame, facts: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, fact_id, rank): the k most important facts that contain any keyword of the query as a substring.

    expected(query_id, keywords). Keywords meet the words of the texts, not the texts.
    """
    asked = expected.select("query_id", F.explode(F.array_distinct("keywords")).alias("keyword"))
    found = containing(facts.select("fact_id", F.lower("content").alias("low")), asked)
    hits = asked.join(found, "keyword").select("query_id", "fact_id").distinct().join(facts.select("fact_id", "importance"), "fact_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("importance"), "fact_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "fact_id", "rank")


def consult(queries: DataFrame, facts: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, bucket, fact_id, rank): per zone the k most important facts that contain all words of the query's keywords.

    A query without keywords asks for nothing, so that the most important facts of each zone answer it.
    """
    texts = facts.where((zone(F.col("kind")) != "other") & F.col("content").isNotNull()).select("fact_id", "importance", "age_days", zone(F.col("kind")).alias("bucket"), F.lower("content").alias("low"))
    asked = queries.select("query_id", F.array_distinct("keywords").alias("ks"))
    words = asked.select("query_id", F.size("ks").alias("n"), F.explode("ks").alias("keyword"))
    found = words.join(containing(texts, words), "keyword").groupBy("query_id", "fact_id").agg(F.count("*").alias("m"), F.first("n").alias("n")).where("m = n")
    hits = found.join(texts.drop("low"), "fact_id")
    order = Window.partitionBy("query_id", "bucket").orderBy(F.desc("importance"), "age_days", "fact_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "bucket", "fact_id", "rank")
    best = texts.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("importance"), "age_days", "fact_id"))).where(F.col("rank") <= k)
    every = asked.where("size(ks) = 0").join(F.broadcast(best.select("bucket", "fact_id", "rank")), F.lit(True))  # k rows a zone
    return ranked.unionByName(every.select("query_id", "bucket", "fact_id", "rank"))


def grounding_ratio(pairs: DataFrame) -> DataFrame:
    """Add ratio: the share of the distinct words of text that occur in source (null or wordless text: 0)."""
    a = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    b = F.regexp_extract_all(F.lower(F.coalesce("source", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    share = F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)
    return pairs.withColumn("ratio", F.round(share, 6))

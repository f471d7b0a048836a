"""What a text says: outcome, kind, dates, topic, procedure; and what is taken out of it before it is shared. No shuffles.

English patterns and those of the fixed lists; a word boundary is any character but ASCII letters, digits and underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import records, screening


def word(pattern: str) -> str:
    """The pattern as a whole word, in any case."""
    return f"(?i)(?:^|[^A-Za-z0-9_])(?:{pattern})(?:[^A-Za-z0-9_]|$)"


# Phrases of success, failure, severe errors and their causes.
SUCCESS = [r"this works?", "shipped", "nailed it", "figured out", "got it working", "got that working", "that's the (?:trick|way)", "works for me", "that worked", "this is the way", "done", "verified", "working"]
FAILURE = ["doesn't work", "does not work", "broken", "dead end", "don't do that", "don't try that", "don't go there", "avoid", "wasted (?:time|effort)", "that failed", "this failed", "wrong (?:path|approach)"]
SEVERE = ["critical bug", "data loss", "crash(?:ed)?", "leak(?:ed)?", "security", "severe", "catastrophic"]
CAUSE = ["root cause", "because", "lesson", "don't .* again", "never again", "never .* again", "the fix", "resolved by", "fix"]
LESSON_WORDS = ["r-class", "rclass", "remember to", "next time", "permanent", "always"]
# Categories of personal content.
PERSONAL = [
    ("name_chinese", "[一-鿿]{2,4}(?:家|说|做|去|来|在|到|跟|和|把|给|叫|想|觉得|发生|去世|结婚)"),
    ("location", "[我她在](?:在|去|到|从)[一-鿿]{2,5}(?:市|省|县|区|路|街|公司|学校|医院|餐厅|机场|车站|酒店|家|工作)|[我她](?:住在|在)[一-鿿]{2,5}|(?:来自|出生于)[一-鿿]{2,5}"),
    ("relationship", "女朋友|男朋友|老公|老婆|老师|老板|父母|父亲|母亲|爸爸|妈妈|爷爷|奶奶|同事|朋友|闺蜜"),
    ("financial", "账户|余额|存款|工资|收入|资产|投资|月供|信用卡|贷款"),
]
# Rules that name the kind of a statement, with their confidence, in order.
KIND_RULES = [
    (r"用户(偏好|决定|授权|锁定|选择)是\s+[^\s]", "rule", 0.95),
    (r"用户(偏好|决定|授权|锁定|选择)\s*[:：]\s*[^\s]", "rule", 0.95),
    (r"(?i)^[\s【]*R-class\s*\(", "rule", 0.9),
    (r"(?i)^[\s【]*R-class\s+(canonical|locked)", "rule", 0.9),
    (r"(?i)\(locked\s+[0-9]{4}-[0-9]{2}-[0-9]{2}", "rule", 0.85),
    (r"^(用户决策|用户决定|用户授权|用户偏好|用户选择|用户锁定|用户回复)", "decision", 0.9),
    (r"用户(决定|决策|授权|锁定|选择|chose)", "decision", 0.7),
    ("(?:^|[^\"'`“‘])用户(偏好|喜欢|倾向|允许)(?:[^\"'`”’]|$)", "user_preference", 0.85),
    ("(?:^|[^\"'`“‘])用户(从不|总是|经常|不要|应该)(?:[^\"'`”’]|$)", "user_preference", 0.7),
    (r"(?i)^\s*(失败|错了|误判|bug|err|error)[^A-Za-z0-9_].*(silent|drop|false positive)", "failure_pattern", 0.85),
    (r"^\s*失败模式", "failure_pattern", 0.95),
    (r"^\s*(误判|tombstone|错判)", "failure_pattern", 0.8),
    (r"^(\[LESSON\]|\[教训\])", "lesson", 0.95),
    (r"教训|key takeaway|takeaway\s*:", "lesson", 0.7),
    (r"\[ship log\s+v[0-9]+(\.[0-9]+)+\s+final", "lesson", 0.7),
    (r"(?i)session.*终局|终局 audit|verified\s*$", "lesson", 0.7),
    (word(r"R-class\s+(?:canonical|locked)"), "lesson", 0.65),
]
# What a shared text loses: paths, private addresses.
SCRUBS = [
    (r"[A-Za-z]:\\[^\s\"']+", "<PATH>"),
    (r"\\\\[A-Za-z0-9_.-]+\\[^\s\"']+", "<PATH>"),
    (r"~/[^\s\"']+", "<PATH>"),
    (r"/(?:home|Users|root|[a-z]/Users)/[^\s\"']+", "<PATH>"),
    (r"(?:10\.[0-9]{1,3}|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.[0-9]{1,3}\.[0-9]{1,3}", "<IP>"),
]
# Generic words that are no topic.
TOPIC_SKIP = ["doc", "test", "note", "example", "step", "note timestamp", "doc timestamp"]
# Words at the head of a block that mark its part in a procedure.
PARTS = {
    "analysis": ["分析路径", "分析", "排查", "诊断", "根因", "定位", "查一下", "检查", "读", "step 1", "diagnosis", "analyze"],
    "action": ["操作", "修", "执行", "跑", "设", "改", "重启", "清理", "归档", "fix", "action", "do "],
    "verify": ["验证", "确认", "应该", "预期", "验收", "回滚", "verify", "expect", "confirm"],
}
# Names of weekdays, from Monday.
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns a text shows as whole words."""
    return sum((text.rlike(word(p)).cast("int") for p in patterns), F.lit(0))


def with_outcome(df: DataFrame, text: str) -> DataFrame:
    """Add outcome and strength: lesson before failure before success, else neutral with 0. Each pattern is tried once.

    A text that begins with R-class is a success. A lesson names a severe error and its cause, or says so by a fixed word; its
    strength is min(1, 0.4 errors + 0.3 causes). Strength of the others by phrases found: 0, 0.5, 0.75, 1. "the fix" counts once.
    """
    low = F.lower(text)
    plain = F.regexp_replace(low, "the fix", "the-x")
    counts = df.withColumns({
        "errors_": hits(low, SEVERE), "causes_": hits(low, CAUSE[:-1]) + hits(plain, CAUSE[-1:]), "good_": hits(low, SUCCESS), "bad_": hits(low, FAILURE),
        "says_": low.rlike("|".join(LESSON_WORDS)), "class_": low.rlike(r"^\s*r-class(?:[^a-z0-9_]|$)"), "empty_": F.col(text).isNull() | (F.trim(text) == ""),
    })
    errors, causes, good, bad = (F.col(c) for c in ("errors_", "causes_", "good_", "bad_"))

    def curve(n: Column) -> Column:
        return F.when(n >= 3, 1.0).when(n == 2, 0.75).when(n == 1, 0.5).otherwise(0.0)

    both = F.when((errors > 0) & (causes > 0), F.least(F.lit(1.0), F.round(errors * 0.4 + causes * 0.3, 6))).otherwise(0.0)
    name = F.when(F.col("empty_"), "neutral").when(F.col("class_"), "success").when(F.col("says_") | (both > 0), "lesson").when(bad > 0, "failure").when(good > 0, "success").otherwise("neutral")
    named = counts.withColumn("outcome", name)
    strength = F.when(F.col("outcome") == "lesson", both).when(F.col("outcome") == "failure", curve(bad)).when(F.col("outcome") == "success", curve(good)).otherwise(0.0)
    return named.withColumn("strength", strength).drop("errors_", "causes_", "good_", "bad_", "says_", "class_", "empty_")


def personal_content(text: Column) -> Column:
    """Categories of personal content of a text, in order; null has none."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in PERSONAL]))


def classify_kind(text: Column) -> Column:
    """(kind, confidence) of the first rule that matches; else fact with 0.5."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit(0.0).alias("confidence")))
    for pattern, kind, sure in KIND_RULES:
        out = out.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence")))
    return out.otherwise(F.struct(F.lit("fact").alias("kind"), F.lit(0.5).alias("confidence")))


def _ago(text: Column, unit: str) -> Column:
    """N of "N units ago" (up to four digits), or null."""
    return F.nullif(F.regexp_extract(text, word(f"([0-9]{{1,4}})\\s+{unit}s?\\s+ago"), 1), F.lit("")).cast("int")


def resolve_date(text: Column, anchor: Column) -> Column:
    """(event_date, precision) that a text tells relative to an anchor date; null where it tells none.

    The first matching phrase in a fixed order wins, then a weekday (last: up to the anchor, next: after it), then a month name
    with day and year, then D/M or D/M/Y with days clamped to 28. Impossible dates give null.
    """
    wd = F.weekday(anchor)
    saturday = F.pmod(5 - wd, F.lit(7))

    def at(days: Column, precision: str = "day") -> Column:
        return F.struct(F.date_add(anchor, days.cast("int")).alias("event_date"), F.lit(precision).alias("precision"))

    def on(date: Column, precision: str) -> Column:
        return F.struct(date.alias("event_date"), F.lit(precision).alias("precision"))

    # fixed values: phrases and their days from the anchor, in order
    fixed = [("today", 0), ("yesterday", -1), ("tomorrow", 1), ("the other day", -3), ("last night", -1), ("this morning", 0), ("tonight", 0), ("last week", -7), ("this week", 0), ("next week", 7)]
    out = F.when(text.rlike(word("today")), at(F.lit(0)))
    for phrase, days in fixed[1:]:
        out = out.when(text.rlike(word(phrase)), at(F.lit(days)))
    out = out.when(text.rlike(word("last weekend")), at(-(wd + 2))).when(text.rlike(word("this weekend")), at(saturday)).when(text.rlike(word("next weekend")), at(saturday + 7))
    months = F.trunc(F.add_months(anchor, -_ago(text, "month")), "month")
    out = out.when(_ago(text, "day").isNotNull(), at(-_ago(text, "day"))).when(_ago(text, "week").isNotNull(), at(-7 * _ago(text, "week")))
    out = out.when(months.isNotNull(), on(F.date_add(months, F.least(F.dayofmonth(anchor), F.lit(28)) - 1), "month"))
    out = out.when(_ago(text, "year").isNotNull(), on(F.add_months(anchor, -12 * _ago(text, "year")), "year"))
    out = out.when(text.rlike(word(r"a\s+(?:couple\s+of\s+)?weeks?\s+ago")), at(F.lit(-14))).when(text.rlike(word(r"a\s+few\s+days?\s+ago")), at(F.lit(-3))).when(text.rlike(word("now")), at(F.lit(0)))
    found = word(rf"((?:(?:last|next)\s+)?(?:{'|'.join(WEEKDAYS)}))")
    token = F.lower(F.regexp_extract(text, found, 1))
    target = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.regexp_extract(token, "[a-z]+$", 0)) - 1
    ahead = F.pmod(target - wd, F.lit(7))
    out = out.when(token.startswith("next"), at(F.when(ahead == 0, 7).otherwise(ahead))).when(token != "", at(-F.pmod(wd - target, F.lit(7))))
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    named = word(r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+([0-9]{1,2}),?\s+([0-9]{4})")
    part = [F.regexp_extract(text, named, k) for k in (1, 2, 3)]
    month = F.array_position(F.array(*map(F.lit, names)), F.lower(part[0])).cast("int")
    first = F.when(part[0] != "", F.make_date(part[2].cast("int"), month, F.lit(1)))
    day = F.when(part[0] != "", part[1].cast("int"))
    out = out.when(F.coalesce(first.isNotNull() & day.between(1, F.dayofmonth(F.last_day(first))), F.lit(False)), on(F.date_add(first, day - 1), "day"))
    dmy = r"(?:^|[^A-Za-z0-9_])([0-9]{1,2})[/.-]([0-9]{1,2})(?:[/.-]([0-9]{4}|[0-9]{2}))?(?:[^A-Za-z0-9_]|$)"
    d, m, y = (F.nullif(F.regexp_extract(text, dmy, k), F.lit("")).cast("int") for k in (1, 2, 3))
    year = F.when(y.isNull(), F.year(anchor)).when(y < 100, 2000 + y).otherwise(y)
    fine = F.coalesce(m.between(1, 12) & (d >= 1) & (year >= 1), F.lit(False))
    return out.when(fine, on(F.make_date(F.when(fine, year), F.when(fine, m), F.least(d, F.lit(28))), "day"))


def time_range(text: Column, today: Column) -> Column:
    """(lo, hi) of days that an English time phrase names, both included; the first matching phrase in a fixed order wins, else null."""
    low, monday = F.lower(text), F.date_sub(today, F.weekday(today))

    def span(lo: Column, hi: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    def month(n: Column) -> Column:
        first = F.add_months(F.trunc(today, "month"), -n)
        return span(first, F.last_day(first))

    def day(n: Column) -> Column:
        return span(F.date_sub(today, n), F.date_sub(today, n))

    iso = [F.nullif(F.regexp_extract(text, "(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})", k), F.lit("")).cast("int") for k in (1, 2, 3)]
    first = F.when(iso[1].between(1, 12), F.make_date(iso[0], iso[1], F.lit(1)))
    exact = F.when(iso[2].between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, iso[2] - 1))
    past = F.nullif(F.regexp_extract(low, word(r"(?:past|last)\s+([0-9]{1,4})\s+days?"), 1), F.lit("")).cast("int")
    weeks, names = F.date_sub(monday, 7 * _ago(low, "week")), "|".join(WEEKDAYS)

    def named(which: str) -> Column:
        return (F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.regexp_extract(low, word(rf"{which}\s+({names})"), 1)) - 1).cast("int")

    return (
        F.when(exact.isNotNull(), span(exact, exact))
        .when(past.isNotNull(), span(F.date_sub(today, past), today))
        .when(_ago(low, "day").isNotNull(), day(_ago(low, "day")))
        .when(weeks.isNotNull(), span(weeks, F.date_add(weeks, 6)))
        .when(_ago(low, "month").isNotNull(), month(_ago(low, "month")))
        .when(low.rlike(word(r"last\s+night|yesterday")), day(F.lit(1)))
        .when(low.rlike(word("today")), day(F.lit(0)))
        .when(low.rlike(word("tomorrow")), day(F.lit(-1)))
        .when(named("last") >= 0, span(F.date_add(monday, named("last") - 7), F.date_add(monday, named("last") - 7)))
        .when(named("this") >= 0, span(F.date_add(monday, named("this")), F.date_add(monday, named("this"))))
        .when(low.rlike(word(r"last\s+week")), span(F.date_sub(monday, 7), F.date_sub(monday, 1)))
        .when(low.rlike(word(r"this\s+week")), span(monday, today))
        .when(low.rlike(word(r"last\s+month")), month(F.lit(1)))
        .when(low.rlike(word(r"this\s+month")), span(F.trunc(today, "month"), today))
    )


def topic(text: Column) -> Column:
    """First run of capitalised words, unless it is a generic one; else the first four distinct words of three letters, capitalised."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[Doc timestamp:[^\]]+\]\s*|(topic|session):\s*[A-Za-z0-9_-]+", "")
    proper = F.regexp_extract(clean, r"[A-Z][A-Za-z0-9]{2,}(?:\s+[A-Z][A-Za-z0-9]{2,})*", 0)
    words = F.array_distinct(F.regexp_extract_all(F.lower(clean), F.lit("[a-z]{3,}"), F.lit(0)))
    plain = F.filter(words, lambda w: ~w.isin(TOPIC_SKIP))
    back = F.array_join(F.transform(F.slice(plain, 1, 4), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")
    return F.when((proper != "") & ~F.lower(proper).isin(TOPIC_SKIP), proper).otherwise(back)


def session_id(text: Column) -> Column:
    """doc-YYYY-MM-DD of a document stamp, else of the first ISO date; empty without one."""
    stamp = F.regexp_extract(text, r"\[Doc timestamp:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    any_day = F.regexp_extract(text, r"(?:^|[^A-Za-z0-9_])([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[^A-Za-z0-9_]|$)", 1)
    day = F.coalesce(F.nullif(stamp, F.lit("")), F.nullif(any_day, F.lit("")))
    return F.coalesce(F.concat(F.lit("doc-"), day), F.lit(""))


def grounding_audit(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(fact_id, grounded): every item of a bracketed list of three or more occurs in a parent's text; edges(child, parent).

    A fact without content or without a parent's text is not grounded, one without a list is. Every item is looked up in each
    parent by itself and the findings are combined, so that no parents' texts are collected in a row.
    """
    lists = F.regexp_extract_all("content", F.lit(r"[(\[【]\s*([^()\[\]【】]{2,16}(?:[/、,;\s]+[^()\[\]【】]{2,16}){2,})\s*[)\]】]"), F.lit(1))
    items = F.array_distinct(F.filter(F.flatten(F.transform(lists, lambda x: F.split(x, r"[/、,;\s]+"))), lambda x: F.length(x) >= 2))
    f = facts.select("fact_id", (F.coalesce(F.length("content"), F.lit(0)) > 0).alias("has"), items.alias("items"))
    up = edges.join(facts.where(F.length("content") > 0).select(F.col("fact_id").alias("parent"), F.col("content").alias("up")), "parent")
    j = f.join(up.withColumnRenamed("child", "fact_id"), "fact_id", "left")
    seen = j.select("fact_id", "has", F.col("up").isNotNull().alias("p"), F.explode_outer("items").alias("i"), "up").groupBy("fact_id", "has", "i")
    per = seen.agg(F.bool_or("p").alias("p"), F.bool_or(F.contains("up", "i")).alias("in_"))
    ok = F.first("has") & F.bool_or("p") & F.bool_and(F.col("i").isNull() | F.coalesce("in_", F.lit(False)))
    return per.groupBy("fact_id").agg(ok.alias("grounded"))


def split_procedure(text: Column) -> Column:
    """(trigger, analysis, action, verify): blocks of a text by a word at their head; the first other block is the trigger.

    Blocks are paragraphs, or lines where there is one paragraph. A block goes to the first part that is still empty and that
    its first 40 characters name. Of the trigger the first line is kept, up to 160 characters.
    """

    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+$", ""))), lambda b: b != "")

    paragraphs = parts(r"\n\s*\n")
    blocks = F.when(F.size(paragraphs) == 1, parts("\n")).otherwise(paragraphs)
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("trigger"), none.alias("analysis"), none.alias("action"), none.alias("verify"))

    def step(a: Column, b: Column) -> Column:
        head = F.lower(F.substring(b, 1, 40))
        goes = F.lit("trigger")
        for name in ("verify", "action", "analysis"):
            goes = F.when(a[name].isNull() & head.rlike("|".join(PARTS[name])), name).otherwise(goes)
        return F.struct(*[F.when((goes == n) & a[n].isNull(), b).otherwise(a[n]).alias(n) for n in ("trigger", *PARTS)])

    found = F.aggregate(blocks, start, step)
    line = F.trim(F.split_part(F.coalesce(found["trigger"], F.lit("")), F.lit("\n"), F.lit(1)))
    short = F.when(F.length(line) > 160, F.concat(F.rtrim(F.substring(line, 1, 157)), F.lit("..."))).otherwise(line)
    return F.struct(short.alias("trigger"), *[F.coalesce(found[n], F.lit("")).alias(n) for n in PARTS])


def scrub(text: Column) -> Column:
    """Replace paths and private addresses by placeholders."""
    for pattern, mark in SCRUBS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def clear_tool_results(text: Column, keep: int = 3) -> Column:
    """Replace all but the last `keep` marked tool results of a text by a placeholder with their id."""
    block = r"(?s)__tool_result_([A-Za-z0-9_-]+?)__(.*?)__/tool_result__"
    whole, ids = (F.regexp_extract_all(text, F.lit(block), F.lit(k)) for k in (0, 1))
    parts = F.arrays_zip(F.split(text, block).alias("piece"), whole.alias("whole"), ids.alias("id"))  # the last piece has no result after it

    def step(acc: Column, x: Column) -> Column:
        result = F.when(acc["left"] > 0, F.concat(F.lit("[TOOL_RESULT_CLEARED:"), x["id"], F.lit("]"))).otherwise(x["whole"])
        return F.struct((acc["left"] - 1).alias("left"), F.concat(acc["out"], F.coalesce(x["piece"], F.lit("")), F.coalesce(result, F.lit(""))).alias("out"))

    start = F.struct((F.size(whole) - keep).alias("left"), F.lit("").alias("out"))
    return F.when(F.size(whole) > keep, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(text)


def distill(text: Column) -> Column:
    """A text without the sentences that show a private signal, redacted and scrubbed of paths, one space between sentences."""
    sentences = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    clean = F.filter(sentences, lambda x: ~records.speaks(x))
    return screening.redact(scrub(F.array_join(clean, " ")))


def mine_public(facts: DataFrame, kinds: list[str], mined: DataFrame, shortest: int = 60) -> DataFrame:
    """(fact_id, text): distilled texts of live facts of shareable kinds that are long enough and still show no signal, not mined(fact_id) yet."""
    live = facts.where(F.col("kind").isin(kinds) & ~F.col("tombstoned")).select("fact_id", "content").join(mined.select("fact_id").distinct(), "fact_id", "left_anti")
    # out of a generator each text is distilled once, not once for every condition on it
    cleared = live.select("fact_id", F.explode(F.array(clear_tool_results(F.col("content")))).alias("content"))
    t = cleared.select("fact_id", F.explode(F.array(distill(F.col("content")))).alias("text"))
    return t.where((F.length("text") >= shortest) & (F.size(records.signals(F.col("text"))) == 0))


def expand_query(queries: DataFrame, synonyms: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, rank, variant): up to three variants with one word replaced, by position, then order of synonyms(word, n, synonym)."""
    plain = F.split(F.lower(F.trim(F.regexp_replace("query", r"\s+", " "))), " ")
    w = queries.select("query_id", plain.alias("ws"), F.posexplode(plain).alias("pos", "word"))
    j = w.join(synonyms, "word")
    variant = F.array_join(F.transform("ws", lambda x, i: F.when(i == F.col("pos"), F.col("synonym")).otherwise(x)), " ")
    order = Window.partitionBy("query_id").orderBy("pos", "n")
    return j.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "rank", variant.alias("variant"))


def decompose_query(queries: DataFrame, connectors: list[str]) -> DataFrame:
    """(query_id, part): the query, what follows its first connector, its quoted phrases and, for two names and more, each name with it."""
    q = F.coalesce("query", F.lit(""))
    after = F.regexp_replace(F.regexp_extract(q, rf"(?is)(?:^|[^A-Za-z0-9_])(?:{'|'.join(connectors)})[^A-Za-z0-9_](.*)$", 1), r"^[ ,?.\"]+|[ ,?.\"]+$", "")
    quoted = F.regexp_extract_all(q, F.lit('"([^"]{3,})"'), F.lit(1))
    names = F.array_distinct(F.regexp_extract_all(q, F.lit("[A-Z][a-z][a-zA-Z'-]+"), F.lit(0)))
    more = F.when(F.size(names) >= 2, F.transform(names, lambda n: F.concat(n, F.lit(" "), q))).otherwise(F.array().cast("array<string>"))
    parts = F.array_distinct(F.concat(F.array(q), F.filter(F.array(after), lambda x: F.length(x) >= 5), quoted, more))
    return queries.select("query_id", F.explode(parts).alias("part"))

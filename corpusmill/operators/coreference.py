"""Pronouns replaced by names from the facts before, as Column expressions over a bounded window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pronouns in the order in which they are replaced.
CHINESE = ["她们", "他们", "它们", "该公司", "那家公司", "那个公司", "那个人", "那个人士", "那位", "这次", "那次", "这项", "那项", "这位", "那位", "她", "他", "它"]
ENGLISH = ["they", "them", "their", "theirs", "hers", "she", "her", "him", "his", "he", "it", "its", "this person", "that person", "this thing", "that thing"]
# Beginnings of texts that name nobody.
PRONOUN_STARTS = [
    "她", "他", "它", "这", "那", "该", "她看", "她听", "她说", "她问", "她认", "她决", "他看", "他听", "他说", "他问", "他认", "他决", "它指", "这不", "这是", "这有", "那不",
    "那是", "那有", "我们", "他们", "她们", "它们", "she", "he", "it", "they", "this", "that", "him", "her",
]
# Titles after names, and ideograph runs that are no name.
TITLES = ["总", "经理", "老师", "主任", "总裁", "博士", "医生", "律师", "工程师", "小姐", "女士", "先生", "同学", "队长", "老板", "组长", "经理", "秘书", "助理"]
NO_NAMES = [
    "不是", "可以", "应该", "已经", "这个", "那个", "现在", "我们", "他们", "她们", "它们", "今天", "明天", "昨天", "什么", "怎么", "为什么", "因为", "所以", "觉得", "认为",
    "但是", "然后", "不过", "可能", "或者", "以及", "如果", "没有", "一些", "所有", "不会", "需要", "开始", "结束", "这样", "那样", "一定", "一直", "一起", "于是", "大家",
    "别人", "某人", "一些人", "所有人", "他们决定", "她们决定", "他们说", "她们说", "他决定", "她决定", "我们决定", "他们认为", "她们认为", "我们认为", "推迟项目", "取消会议",
    "结束工作", "开始项目",
]
HELD = 20
# Names that a text can ask for: one for each kind of pronoun.
MOST = len(CHINESE) + len(ENGLISH)


def names(text: Column) -> Column:
    """Names a text brings up, in order: with titles, other ideograph runs, capitalised words; none if it begins with a pronoun."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+", "")
    first_word = F.lower(F.regexp_extract(body, r"(?U)^\S+", 0))
    starts = F.substring(body, 1, 2).isin(PRONOUN_STARTS) | F.lower(F.substring(body, 1, 1)).isin(PRONOUN_STARTS) | first_word.isin(PRONOUN_STARTS)
    none = F.array().cast("array<string>")
    titled = F.regexp_extract_all(body, F.lit(f"[一-鿿]{{0,4}}(?:{'|'.join(TITLES)})"), F.lit(0))
    runs = F.filter(F.regexp_extract_all(body, F.lit("[一-鿿]{2,4}"), F.lit(0)), lambda w: ~w.isin(NO_NAMES))
    proper = F.regexp_extract_all(body, F.lit(r"(?U)[A-Z](?<=\b[A-Z])[a-z]+(?:\s+[A-Z][a-z]+)?\b"), F.lit(0))
    found = F.concat(F.when(body.rlike("[一-鿿]"), F.concat(titled, runs)).otherwise(none), proper)
    return F.when(starts, none).otherwise(F.filter(found, lambda w: F.length(w) >= 2))


def unique(values: Column, most: int = MOST) -> Column:
    """The first values, as many as most, without those that came before in another case or the same."""
    def step(acc: Column, v: Column) -> Column:
        grown = F.struct(F.concat(acc["keys"], F.array(F.lower(v))).alias("keys"), F.concat(acc["out"], F.array(v)).alias("out"))
        return F.when((F.size(acc["out"]) >= most) | F.array_contains(acc["keys"], F.lower(v)), acc).otherwise(grown)

    none = F.array().cast("array<string>")
    return F.aggregate(F.array_distinct(values), F.struct(none.alias("keys"), none.alias("out")), step, lambda acc: acc["out"])


def said(text: Column) -> Column:
    """The English pronouns of a text, each place one, in small letters."""
    heads = sorted({p[0] for p in ENGLISH})
    rests = "|".join(f"(?<=[{h}{h.upper()}])(?:{'|'.join(p[1:] for p in ENGLISH if p[0] == h)})" for h in heads)
    both = "".join(h + h.upper() for h in heads)
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?U)[{both}](?<=\\b[{both}])(?i:{rests})\\b"), F.lit(0)), lambda w: F.lower(w))


def kinds(text: Column, words: Column, pool: Column) -> Column:
    """Pronouns that may occur while a text with these words said is resolved, in order: its own and those that names bring in.

    A name may end or begin a pronoun of two words, a name of ideographs any ideograph one. A word in letters of other
    case rules asks for all.
    """
    english, pairs = F.array(*map(F.lit, ENGLISH)), F.array(*[F.lit(p) for p in ENGLISH if " " in p])
    ends = sorted({w for p in ENGLISH if " " in p for w in p.split()})
    brought = F.split(F.lower(F.array_join(pool, " ")), r"(?U)\s+")
    found = F.concat(words, brought, F.when(F.arrays_overlap(brought, F.array(*map(F.lit, ends))), pairs).otherwise(F.array().cast("array<string>")))
    own = F.when(F.size(F.array_except(words, english)) > 0, english).otherwise(F.array_intersect(english, found))
    ideographs = text.rlike("[一-鿿]") | F.array_join(pool, " ").rlike("[一-鿿]")
    return F.concat(F.when(ideographs, F.array(*map(F.lit, CHINESE))).otherwise(F.array().cast("array<string>")), own)


def resolve(text: Column, pool: Column, asked: Column) -> Column:
    """The text with every pronoun of those asked replaced: each kind that occurs takes the next name of the pool, all its places the same.

    After the last name comes the first again. A capital at a pronoun's head is kept; capitals are replaced
    first, since a name begins with one and is not to be replaced in turn. pool must be a plain column. Patterns
    start at a pronoun's first letter and look back from there.
    """
    def word(heads: Column, k: Column) -> Column:
        return F.concat(F.lit("(?U)["), heads, F.lit("](?<=\\b["), heads, F.lit("])(?i:"), F.substr(k, F.lit(2)), F.lit(")\\b"))

    def step(acc: Column, k: Column) -> Column:
        t, head = acc["text"], F.substring(k, 1, 1)
        chinese = k >= F.lit("一")
        here = F.when(chinese, F.contains(t, k)).otherwise(F.rlike(t, word(F.concat(head, F.upper(head)), k)))
        at = F.when(acc["at"] >= F.size(pool), 0).otherwise(acc["at"])
        name = F.get(pool, at)
        capital = F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))
        changed = F.when(chinese, F.replace(t, k, name)).otherwise(F.regexp_replace(F.regexp_replace(t, word(F.upper(head), k), capital), word(head, k), name))
        return F.when(here, F.struct(changed.alias("text"), (at + 1).alias("at"))).otherwise(acc)

    start = F.struct(text.alias("text"), F.lit(0).alias("at"))
    return F.when(F.size(pool) > 0, F.aggregate(asked, start, step, lambda acc: acc["text"])).otherwise(text)


def resolve_pronouns(facts: DataFrame, by: list[str], order: list[str], last: int = 10) -> DataFrame:
    """(fact_id, resolved, changed): texts with pronouns replaced by names of the facts before in their group.

    facts(fact_id, content, *by, *order). Of the HELD rows before, newest first, those of the same text are left out and the
    first `last` give names. A window holds digests and up to MOST names of HELD rows, whatever the group's size. Blank texts stay.
    """
    rows = facts.select("fact_id", *by, *order, F.coalesce("content", F.lit("")).alias("text"))
    rows = rows.select("fact_id", *by, *order, "text", F.md5(F.trim("text")).alias("same"), unique(names(F.col("text"))).alias("named"))
    before = Window.partitionBy(*by).orderBy(*order, "fact_id").rowsBetween(-HELD, -1)
    w = rows.withColumn("past", F.collect_list(F.struct("same", "named")).over(before))
    others = F.filter(F.reverse("past"), lambda p: p["same"] != F.col("same"))
    spoken = w.select("fact_id", "text", others.alias("others"), said(F.col("text")).alias("said"))
    asks = (F.size("said") > 0) | F.col("text").rlike(f"[{''.join(sorted({p[0] for p in CHINESE}))}]")
    pooled = spoken.select("fact_id", "text", "said", F.when(asks, unique(F.flatten(F.transform(F.slice("others", 1, last), lambda p: p["named"])))).alias("pool"))
    asked = kinds(F.col("text"), F.col("said"), F.col("pool"))
    out = pooled.select("fact_id", "text", F.when(F.col("pool").isNull(), F.col("text")).otherwise(resolve(F.col("text"), F.col("pool"), asked)).alias("resolved"))
    return out.select("fact_id", "resolved", (F.col("resolved") != F.col("text")).alias("changed"))

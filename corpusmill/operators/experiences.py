"""Joins of facts with later facts and of queries with experiences: contradictions, replacement, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.pairing import containing
from corpusmill.operators.relations import words
from corpusmill.operators.similar import may_reach, parities
from corpusmill.plans.runtime import bounded_batches, checkpoint

# English negation words.
NEGATION = r"(?i)(?:^|[^A-Za-z0-9_])(?:not|no|never|without|cannot|can't|don't|doesn't|didn't|isn't|aren't|won't|wouldn't|shouldn't|mustn't)(?:[^A-Za-z0-9_]|$)"
SLOTS = 16


def negation_conflicts(facts: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(pairs(plain_class, negated_class, jaccard), members(fact_id, class_id)): same words by Jaccard, one side negates.

    Facts with equal word sets and equal negation are one class, named by its smallest fact; links run between classes, so
    copies are not multiplied. Candidates share one of a class's rarest n - ceil(least * n) + 1 words, which every pair at
    the threshold does, and are verified on whole word sets. Texts without words are left out.
    """
    w = facts.select("fact_id", F.sort_array(words(F.col("content"))).alias("ws"), F.coalesce(F.col("content").rlike(NEGATION), F.lit(False)).alias("neg")).where(F.size("ws") > 0)
    w = checkpoint(w)
    key = w.withColumn("k", F.sha2(F.concat_ws(" ", "neg", F.array_join("ws", " ")), 256))
    ids = key.groupBy("k").agg(F.min("fact_id").alias("class_id"))
    members = key.select("fact_id", "k").join(ids, "k").select("fact_id", "class_id")
    c = w.join(ids.select(F.col("class_id").alias("fact_id")), "fact_id")
    c = checkpoint(c)
    terms = c.select("fact_id", "neg", F.size("ws").alias("n"), F.explode("ws").alias("t"))
    df = terms.groupBy("t").agg(F.count("*").alias("df"))
    order = Window.partitionBy("fact_id").orderBy("df", "t")
    rare = terms.join(df, "t").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.ceil(F.round(least * F.col("n"), 9)) + 1)
    # a word that one side alone has brings no candidate
    shared = rare.groupBy("t").agg(F.bool_or("neg").alias("some"), F.bool_and("neg").alias("all")).where("some AND NOT all").select("t")
    bounded_batches(facts.sparkSession)
    slots = c.select("fact_id", parities(F.col("ws"), SLOTS).alias("p"))
    probes = checkpoint(rare.join(shared, "t").join(slots, "fact_id").select("fact_id", "neg", "n", "r", "p", F.xxhash64("t").alias("t")))
    a = probes.where("NOT neg").select(F.col("fact_id").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"), F.col("p").alias("pa"), "t")
    b = probes.where("neg").select(F.col("fact_id").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"), F.col("p").alias("pb"), "t")
    cand = a.join(b, "t").where(may_reach(least, SLOTS)).select("a", "b").distinct()
    sets = c.select("fact_id", "ws")
    j = cand.join(sets.toDF("a", "wa"), "a").join(sets.toDF("b", "wb"), "b")
    both = F.size(F.array_intersect("wa", "wb"))
    score = both / (F.size("wa") + F.size("wb") - both)
    pairs = j.select(F.col("a").alias("plain_class"), F.col("b").alias("negated_class"), F.round(score, 6).alias("jaccard")).where(F.col("jaccard") >= least)
    return pairs, members


def auto_invalidate(new: DataFrame, similar: DataFrame, facts: DataFrame, kinds: list[str], least: float = 0.85, most: int | None = None) -> DataFrame:
    """(fact_id, replaced_by, similarity): live facts that a new fact of an update kind replaces.

    Same kind and topic, similarity(query_id, fact_id, score) at the threshold, importance not above the new fact's. All
    candidates are looked at, or if most is given that many of the most important of each new fact, ties by id; the most
    similar new fact replaces.
    """
    f = facts.where(~F.col("tombstoned") & F.col("ended_days").isNull()).select("fact_id", "kind", "topic", F.col("importance").alias("old"))
    n = new.where(F.col("kind").isin(kinds)).select(F.col("fact_id").alias("query_id"), "kind", "topic", "importance")
    j = similar.join(n, "query_id").join(f, ["fact_id", "kind", "topic"])
    if most is not None:
        order = Window.partitionBy("query_id").orderBy(F.desc("old"), "fact_id")
        j = j.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    seen = j.where((F.col("score") >= least) & (F.col("importance") >= F.col("old")))
    best = F.max_by(F.struct("query_id", "score"), F.struct("score", -F.col("query_id")))
    return seen.groupBy("fact_id").agg(best.alias("b")).select("fact_id", F.col("b.query_id").alias("replaced_by"), F.col("b.score").alias("similarity"))


def match_experiences(queries: DataFrame, experiences: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, fact_id, score, rank): experiences whose keywords contain a word of the query.

    0.35 per keyword that does, 0.1 for three uses or importance 0.95, less age: 0.12 (bad outcome) or 0.05 a month, 0.3 at most.
    experiences(fact_id, keywords, bad, access_count, importance, age_days). Words meet distinct keywords, not experiences.
    Ties by use, then age, then id.
    """
    e = experiences.select("fact_id", F.explode(F.array_distinct("keywords")).alias("kw"))
    q = queries.select("query_id", words(F.col("query")).alias("ws"))
    asked = q.select("query_id", F.explode("ws").alias("keyword")).distinct()
    found = containing(e.select(F.col("kw").alias("fact_id"), F.col("kw").alias("low")).distinct(), asked)
    hit = asked.join(found, "keyword").select("query_id", F.col("fact_id").alias("kw")).distinct()
    n = e.join(hit, "kw").groupBy("query_id", "fact_id").agg(F.count("*").alias("n"))
    j = n.join(experiences.drop("keywords"), "fact_id")
    hot = F.when((F.col("access_count") >= 3) | (F.col("importance") >= 0.95), 0.1).otherwise(0.0)
    age = F.least(F.lit(0.3), F.col("age_days") / 30 * F.when(F.col("bad"), 0.12).otherwise(0.05))
    j = j.withColumn("score", F.round(F.col("n") * 0.5 * 0.7 + hot - age, 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("access_count"), "age_days", "fact_id")
    return j.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "fact_id", "score", "rank")

"""How a candidate supports a query, how two facts relate, and rescoring of candidate lists by shared words and entities.

Candidate lists are (query_id, fact_id, score); texts come by a keyed join. ASCII words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.lexical import top_k
from corpusmill.plans.runtime import checkpoint

# Negation words, connector words of chains, and role nouns.
NEGATIONS = ["not", "no", "never"]
BRIDGE_TERMS = [
    "because", "since", "therefore", "so", "thus", "hence", "as a result", "mentioned", "said", "told", "asked", "replied", "according to",
    "works", "worked", "job", "company", "friend", "partner", "colleague", "meeting", "met", "visit", "visited", "together", "helped",
    "married", "relationship", "family", "son", "daughter", "mother", "father",
]
ROLES = [
    "friend", "partner", "spouse", "husband", "wife", "child", "kid", "son", "daughter", "mother", "father", "mom", "dad", "sister", "brother", "boss", "teacher",
    "student", "doctor", "counselor", "therapist", "artist", "mentor", "colleague", "neighbor",
]
# Stop words of the reranker.
RERANK_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "for", "from", "has", "have", "he", "her", "his", "i", "in", "is", "it", "its", "me", "my", "no", "not",
    "of", "on", "or", "our", "she", "so", "the", "their", "them", "they", "this", "to", "us", "was", "we", "were", "what", "when", "where", "which", "who", "why",
    "will", "with", "you", "your",
]
SUBSETS_OF = 6


def words(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits; null gives none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return _share(both, F.size(a) + F.size(b) - both)


def usefulness(query: Column, text: Column, keywords: Column, entities: Column, confidence: Column, access: Column) -> Column:
    """Support of a query by a candidate: 0.4 Jaccard + 0.25 keyword + 0.25 entity share of the query's words + 0.1 quality, in 0.05 to 1.

    keywords and entities are arrays of strings; their words count. An empty query or text gives 0.05.
    """
    q, c = words(query), words(text)
    part = [F.size(F.array_intersect(q, words(F.concat_ws(" ", x)))) / F.size(q) for x in (keywords, entities)]
    quality = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) + F.least(F.lit(1.0), access / 10)) / 2
    score = 0.4 * jaccard(q, c) + 0.25 * part[0] + 0.25 * part[1] + 0.1 * quality
    return F.when((F.size(q) == 0) | (F.size(c) == 0), 0.05).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), score)))


def pair_relation(pairs: DataFrame) -> DataFrame:
    """Add relation and confidence to pairs(a_text, a_entities, b_text, b_entities), b being judged against a.

    conflict: one side negates and words (over 0.3) or entities overlap. repeat or corroboration: Jaccard of 0.6 or more.
    clarification: b holds 0.7 of a's words and adds its own, or shares half the entities and 0.2 of the words.
    new_fact: half the entities with other words, or no entity in common. A text without words relates to nothing.
    """
    p = pairs.withColumns({"wa_": words(F.col("a_text")), "wb_": words(F.col("b_text"))})
    p = p.withColumns({"j_": jaccard(F.col("wa_"), F.col("wb_")), "e_": jaccard(F.array_distinct("a_entities"), F.array_distinct("b_entities")), "m_": F.size(F.array_intersect("wa_", "wb_"))})
    na, nb, j, e = F.size("wa_"), F.size("wb_"), F.col("j_"), F.col("e_")
    negates = [F.exists(w, lambda x: x.isin(NEGATIONS)) for w in ("wa_", "wb_")]
    near = F.abs(F.length("a_text") - F.length("b_text")) < 50
    in_b, in_a = F.col("m_") / na, F.col("m_") / nb
    some = (F.size("a_entities") > 0) & (F.size("b_entities") > 0) & (e == 0)

    def kind(name: str, sure: Column) -> Column:
        return F.struct(F.lit(name).alias("relation"), F.round(sure, 6).alias("confidence"))

    found = (
        F.when((na == 0) | (nb == 0), kind("none", F.lit(0.0)))
        .when((negates[0] != negates[1]) & ((j > 0.3) | (e > 0)), kind("conflict", F.greatest(j, e)))
        .when((j >= 0.6) & near & (F.abs(na - nb) < 3), kind("repeat", j))
        .when(j >= 0.6, kind("corroboration", j))
        .when((in_b >= 0.7) & (in_a < 0.7) & (nb > na), kind("clarification", in_b))
        .when((e >= 0.5) & (j >= 0.2), kind("clarification", e))
        .when(e >= 0.5, kind("new_fact", e))
        .when(some, kind("new_fact", F.lit(0.5)))
        .when((j < 0.1) & (e < 0.1), kind("none", F.lit(0.0)))
        .otherwise(kind("none", F.greatest(j, e) * 0.5))
    )
    return p.withColumn("r_", found).withColumns({"relation": F.col("r_.relation"), "confidence": F.col("r_.confidence")}).drop("wa_", "wb_", "j_", "e_", "m_", "r_")


def _counts(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z'-]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(RERANK_STOPWORDS))


def _log_tf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, w): w = 1 + ln(1 + count)."""
    return df.select(key, F.explode(_counts(F.col(text))).alias("term")).groupBy(key, "term").agg((1 + F.log1p(F.count("*"))).alias("w"))


def lexical_rerank(scored: DataFrame, queries: DataFrame, texts: DataFrame, weight: float = 0.65) -> DataFrame:
    """(query_id, fact_id, score): weight * new + (1 - weight) * old, new being scaled to 0..1 within each query.

    new = 0.85 cosine of log term frequencies + 0.15 bridge bonus, ln(1 + connectors in the text), halved where the query has
    none. queries(query_id, query), texts(fact_id, content). Only candidate texts are split into words.
    """
    q = _log_tf(queries, "query_id", "query")
    c = _log_tf(texts.join(scored.select("fact_id").distinct(), "fact_id", "left_semi"), "fact_id", "content")
    nq = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nq"))
    nc = c.groupBy("fact_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nc"))
    dots = (
        scored.select("query_id", "fact_id").join(q.withColumnRenamed("w", "wq"), "query_id").join(c, ["fact_id", "term"]).groupBy("query_id", "fact_id").agg(F.sum(F.col("wq") * F.col("w")).alias("d"))
    )
    hits = F.size(F.filter(F.array(*map(F.lit, BRIDGE_TERMS)), lambda t: F.contains(F.lower(F.coalesce("content", F.lit(""))), t)))
    asks = F.exists(_counts(F.col("query")), lambda t: t.isin(BRIDGE_TERMS))
    j = scored.join(queries.select("query_id", asks.alias("asks")), "query_id").join(texts.select("fact_id", hits.alias("hits")), "fact_id")
    j = j.join(dots, ["query_id", "fact_id"], "left").join(nq, "query_id", "left").join(nc, "fact_id", "left")
    bonus = F.log1p("hits") * F.when(F.col("asks"), 1.0).otherwise(0.5)
    new = F.round(0.85 * F.coalesce(F.col("d") / (F.col("nq") * F.col("nc")), F.lit(0.0)) + 0.15 * bonus, 9)
    j, per = j.withColumn("new", new), Window.partitionBy("query_id")
    low, high = F.min("new").over(per), F.max("new").over(per)
    scaled = F.when(high > low, (F.col("new") - low) / (high - low)).otherwise(0.0)
    return j.select("query_id", "fact_id", F.round(weight * scaled + (1 - weight) * F.col("score"), 6).alias("score"))


def capitalised(text: Column) -> Column:
    """Distinct capitalised words of three letters or more, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z][a-z]{2,}"), F.lit(0)), lambda w: F.lower(w)))


def bridge_boost(scored: DataFrame, entities: DataFrame, seeds: int = 3, decay: float = 0.15) -> DataFrame:
    """(query_id, fact_id, score, bridges): score * (1 + decay * sum over seeds of decay ^ shared entities).

    Seeds are the best candidates of the query; a fact is no bridge to itself, a seed without a shared entity counts nothing.
    entities(fact_id, entity), distinct.
    """
    first = top_k(scored, seeds, item="fact_id").select("query_id", F.col("fact_id").alias("seed"))
    has = entities.select(F.col("fact_id").alias("seed"), "entity")
    shared = (
        scored.select("query_id", "fact_id").join(entities, "fact_id").join(first.join(has, "seed"), ["query_id", "entity"]).where("seed <> fact_id").groupBy("query_id", "fact_id", "seed").agg(F.count("*").alias("n"))
    )
    sums = shared.groupBy("query_id", "fact_id").agg(F.sum(F.pow(F.lit(decay), F.col("n"))).alias("s"), F.sum("n").alias("bridges"))
    out = scored.join(sums, ["query_id", "fact_id"], "left")
    return out.select("query_id", "fact_id", F.round(F.col("score") * (1 + decay * F.coalesce("s", F.lit(0.0))), 6).alias("score"), F.coalesce("bridges", F.lit(0)).cast("long").alias("bridges"))


def query_entities(query: Column) -> Column:
    """Capitalised words of four letters or more and role nouns of a query, lower-cased, distinct."""
    text = F.coalesce(query, F.lit(""))
    names = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_'-]*"), F.lit(0)), lambda w: w.rlike("^[A-Z][a-z][a-zA-Z'-]{2,}$"))
    roles = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.isin(ROLES))
    return F.array_distinct(F.transform(F.concat(names, roles), lambda w: F.lower(w)))


def stage_boost(scored: DataFrame, queries: DataFrame, texts: DataFrame, strength: float = 0.5) -> DataFrame:
    """(query_id, fact_id, score): score * (1 + strength * share of the query's entities that the text contains); no entity, no change."""
    j = scored.join(queries.select("query_id", query_entities(F.col("query")).alias("ents")), "query_id").join(texts.select("fact_id", F.lower(F.coalesce("content", F.lit(""))).alias("low")), "fact_id")
    cover = _share(F.size(F.filter("ents", lambda e: F.contains(F.col("low"), e))), F.size("ents"))
    return j.select("query_id", "fact_id", F.round(F.col("score") * (1 + strength * cover), 10).alias("score"))


def temporal_score(date: Column, asked: Column) -> Column:
    """Match of a date (Y, Y-M or Y-M-D) with an array of asked dates, taken in order, at the finest level both have.

    A day match counts 1, its month 0.6; a month match 1, its year 0.5; a year match 1; a miss lowers the value to -0.5 at
    most, and a later hit raises it again. Zero at the end becomes -0.5. No date gives 0.
    """

    def parts(d: Column) -> list[Column]:
        return [F.nullif(F.regexp_extract(d, r"^([0-9]{4})(?:-([0-9]{1,2}))?(?:-([0-9]{1,2}))?", k), F.lit("")).cast("int") for k in (1, 2, 3)]

    y, m, d = parts(date)
    dated = F.filter(asked, lambda q: parts(q)[0].isNotNull())

    def step(best: Column, q: Column) -> Column:
        qy, qm, qd = parts(q)
        month = (y == qy) & (F.coalesce(m, F.lit(0)) == F.coalesce(qm, F.lit(0)))
        hit = (
            F.when(qd.isNotNull() & d.isNotNull(), F.when(month & (d == qd), 1.0).when(month, 0.6))
            .when(qm.isNotNull() & m.isNotNull(), F.when(month, 1.0).when(y == qy, 0.5))
            .otherwise(F.when(y == qy, 1.0))
        )
        return F.when(hit.isNull(), F.least(best, F.lit(-0.5))).otherwise(F.greatest(best, hit))

    best = F.aggregate(dated, F.lit(0.0), step)
    return F.when(y.isNull(), 0.0).when(best == 0, -0.5).otherwise(best)


def precedent(hits: DataFrame, facts: DataFrame, kinds: list[str], least: float = 0.87, k: int = 5) -> DataFrame:
    """(query_id, fact_id, kind, similarity, rank): best similarity of each fact over all scopes searched, wanted live kinds only."""
    best = hits.groupBy("query_id", "fact_id").agg(F.max("score").alias("similarity")).where(F.col("similarity") >= least)
    wanted = facts.where(F.col("kind").isin(kinds) & ~F.col("tombstoned")).select("fact_id", "kind")
    return top_k(best.join(wanted, "fact_id"), k, item="fact_id", score="similarity").select("query_id", "fact_id", "kind", "similarity", "rank")


def auto_link(pairs: DataFrame, facts: DataFrame, least: float = 0.85, links: int = 5, confidence: float = 0.5) -> DataFrame:
    """(fact_id, parent_id, score), both directions of each link, from directed pairs(query_id, fact_id, score).

    Both ends have the same kind, are live and hold the confidence; a query fact keeps its best links.
    """
    f = facts.where(~F.col("tombstoned") & (F.col("confidence") >= confidence)).select("fact_id", "kind")
    j = pairs.where(F.col("score") >= least).join(f, "fact_id").join(f.select(F.col("fact_id").alias("query_id"), F.col("kind").alias("k")), "query_id").where("kind = k")
    kept = top_k(j, links, item="fact_id").select("query_id", "fact_id", "score")
    back = kept.select(F.col("fact_id").alias("query_id"), F.col("query_id").alias("fact_id"), "score")
    return kept.union(back).distinct().select(F.col("query_id").alias("fact_id"), F.col("fact_id").alias("parent_id"), "score")


def scenario_scores(rows: DataFrame, key: str, text: str, scenarios: DataFrame, w_overlap: float = 0.6) -> DataFrame:
    """(key, scenario_id, score): w * share of the scenario's words + (1 - w) * Jaccard, for rows that share a word with it.

    scenarios(scenario_id, words) with distinct words. Joined by word, counted with map-side combine.
    """
    mine = rows.select(key, words(F.col(text)).alias("w_")).withColumn("n_", F.size("w_"))
    theirs = scenarios.select("scenario_id", F.size("words").alias("m_"), F.explode("words").alias("t_"))
    shared = mine.select(key, "n_", F.explode("w_").alias("t_")).join(theirs, "t_").groupBy(key, "scenario_id", "n_", "m_").agg(F.count("*").alias("c_"))
    c = F.col("c_")
    return shared.select(key, "scenario_id", F.round(w_overlap * c / F.col("m_") + (1 - w_overlap) * c / (F.col("n_") + F.col("m_") - c), 6).alias("score"))


def scenario_assign(facts: DataFrame, scenarios: DataFrame, least: float = 0.12) -> DataFrame:
    """(fact_id, scenario, score): the best frozen scenario, ties by smallest id; below the least a new one named by the text's hash.

    Scenarios do not grow while facts are assigned, so the result does not depend on order. A text without words gets none.
    """
    best = scenario_scores(facts, "fact_id", "content", scenarios).groupBy("fact_id").agg(F.max_by(F.struct("scenario_id", "score"), F.struct("score", -F.col("scenario_id"))).alias("b"))
    j = facts.where(F.size(words(F.col("content"))) > 0).select("fact_id", "content").join(best, "fact_id", "left")
    good = F.coalesce(F.col("b.score") >= least, F.lit(False))
    name = F.when(good, F.concat(F.lit("sc_"), F.col("b.scenario_id"))).otherwise(F.concat(F.lit("new_"), F.md5("content")))
    return j.select("fact_id", name.alias("scenario"), F.when(good, F.col("b.score")).otherwise(0.0).alias("score"))


def scenario_rank(queries: DataFrame, scenarios: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, scenario_id, score, rank) by relevance, age, importance and use; scenarios also have age_days, importance, access_count."""
    s = scenario_scores(queries, "query_id", "query", scenarios, 0.7).join(scenarios.select("scenario_id", "age_days", "importance", "access_count"), "scenario_id")
    fade = F.greatest(F.lit(0.1), 1 - F.col("age_days") / 30)
    score = F.col("score") * fade * (0.5 + 0.5 * F.col("importance")) * (1 + 0.1 * F.col("access_count"))
    return top_k(s.select("query_id", "scenario_id", F.round(score, 6).alias("score")), k, item="scenario_id")


def entity_links(entities: DataFrame) -> DataFrame:
    """(fact_id, n_links): how many other facts share an exact entity with each.

    entities(fact_id, type, value), distinct. Among facts of up to SUBSETS_OF entities links are counted by inclusion and
    exclusion over the subsets of a fact's entities, without making pairs. Facts with more entities meet their partners by a
    join on the entity, each partner once.
    """
    rows = checkpoint(entities.where(F.col("fact_id").isNotNull() & F.col("value").isNotNull()).select("fact_id", "type", "value").distinct())
    per = rows.groupBy("fact_id").agg(F.count("*").alias("k"))
    many = checkpoint(rows.join(per.where(F.col("k") > SUBSETS_OF).select("fact_id"), "fact_id", "left_semi"))
    few = rows.join(many.select("fact_id").distinct(), "fact_id", "left_anti")
    sets = few.groupBy("fact_id").agg(F.sort_array(F.collect_set(F.struct("type", "value"))).alias("e"))  # at most SUBSETS_OF
    masks = sets.withColumn("mask", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("e")).cast("int") - 1)))
    subset = masks.select("fact_id", F.bit_count("mask").alias("bits"), F.filter("e", lambda x, i: F.col("mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0).alias("part"))
    sizes = subset.groupBy("part").agg(F.count("*").alias("n"))
    signed = F.when(F.col("bits") % 2 == 1, F.col("n")).otherwise(-F.col("n"))
    counted = subset.join(sizes, "part").groupBy("fact_id").agg((F.sum(signed) - 1).alias("n"))
    pairs = many.toDF("a", "type", "value").join(rows.toDF("b", "type", "value"), ["type", "value"]).where("a <> b").select("a", "b").distinct()
    pairs = checkpoint(pairs)
    long = many.select(F.col("fact_id").alias("a")).distinct()
    of_many = pairs.groupBy(F.col("a").alias("fact_id")).agg(F.count("*").alias("n"))
    of_few = pairs.join(long.withColumnRenamed("a", "b"), "b", "left_anti").groupBy(F.col("b").alias("fact_id")).agg(F.count("*").alias("n"))
    zero = long.select(F.col("a").alias("fact_id"), F.lit(0).cast("long").alias("n"))
    every = counted.unionByName(of_many).unionByName(of_few).unionByName(zero)
    return every.groupBy("fact_id").agg(F.sum("n").alias("n_links"))

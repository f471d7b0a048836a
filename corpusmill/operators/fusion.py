"""Fusion and reranking of scored lists (query_id, fact_id, score), each a job over all queries at once."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.lexical import top_k


def hybrid_merge(lexical: DataFrame, vector: DataFrame, facts: DataFrame, k: int = 10, w_lexical: float = 0.6, w_vector: float = 0.4) -> DataFrame:
    """Top k of both lists by weighted sum, lexical scores divided by the query's largest, times a factor by outcome.

    A score missing from a list counts 0. facts(fact_id, outcome_weight): the factor is 1 + 0.3 (outcome_weight - 1).
    """
    top = F.max(F.abs("lex")).over(Window.partitionBy("query_id"))
    a = lexical.select("query_id", "fact_id", F.col("score").alias("lex"))
    a = a.withColumn("lex", F.when(top > 0, F.abs("lex") / top).otherwise(0.0))
    b = vector.select("query_id", "fact_id", F.col("score").alias("vec"))
    both = a.join(b, ["query_id", "fact_id"], "full").join(facts.select("fact_id", "outcome_weight"), "fact_id", "left")
    s = w_lexical * F.coalesce("lex", F.lit(0.0)) + w_vector * F.coalesce("vec", F.lit(0.0))
    s = s * (1 + 0.3 * (F.coalesce("outcome_weight", F.lit(1.0)) - 1))
    return top_k(both.select("query_id", "fact_id", F.round(s, 6).alias("score")), k, item="fact_id")


def anchor_proximity(days: Column) -> Column:
    """Closeness of a date to an anchor, by their distance in days."""
    d = F.abs(days)
    return F.when(d <= 7, 1.0).when(d <= 30, 0.7).when(d <= 90, 0.4).when(d <= 365, 0.2).otherwise(0.0)


def weighted_max(primary: DataFrame, second: DataFrame, weight: float = 0.5) -> DataFrame:
    """The larger of the first list's score and the second's, weighted."""
    every = primary.select("query_id", "fact_id", "score").unionByName(second.select("query_id", "fact_id", (weight * F.col("score")).alias("score")))
    return every.groupBy("query_id", "fact_id").agg(F.round(F.max("score"), 7).alias("score"))


def dedupe_hits(scored: DataFrame, injected: DataFrame) -> DataFrame:
    """One row per (query, fact); a scored copy wins over an injected one, whose score is null."""
    every = scored.select("query_id", "fact_id", "score", F.lit(0).alias("p")).unionByName(injected.select("query_id", "fact_id", F.lit(None).cast("double").alias("score"), F.lit(1).alias("p")))
    best = every.groupBy("query_id", "fact_id").agg(F.max_by(F.struct("score", "p"), F.struct(-F.col("p"), "score")).alias("b"))
    return best.select("query_id", "fact_id", F.col("b.score").alias("score"), (F.col("b.p") == 1).alias("injected"))


def scope_weight(scored: DataFrame, facts: DataFrame, weight: float = 0.85) -> DataFrame:
    """Scores of short-term facts, weighted down."""
    j = scored.join(facts.select("fact_id", "scope_type"), "fact_id")
    s = F.when(F.col("scope_type") == "short_term", weight * F.col("score")).otherwise(F.col("score"))
    return j.select("query_id", "fact_id", F.round(s, 6).alias("score"))


def multi_scope_merge(scored: DataFrame, weights: dict[str, float], k: int = 10) -> DataFrame:
    """Top k after scores were standardised within (query, scope) and weighted by scope; no spread gives 0."""
    per = Window.partitionBy("query_id", "scope")
    sd = F.stddev_pop("score").over(per)
    z = F.when(sd > 1e-12, (F.col("score") - F.avg("score").over(per)) / sd).otherwise(0.0)
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("scope")], F.lit(1.0))
    return top_k(scored.select("query_id", "fact_id", F.round(z * w, 6).alias("score")), k, item="fact_id")


def set_cosine(postings: DataFrame, terms: DataFrame, k: int = 5) -> DataFrame:
    """Top k by shared terms / sqrt(terms of the query * terms of the document); terms(query_id, term) distinct."""
    nq = terms.groupBy("query_id").agg(F.count("*").alias("nq"))
    ns = postings.groupBy("doc_id").agg(F.count("*").alias("ns"))
    shared = terms.join(postings, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("m"))
    j = shared.join(nq, "query_id").join(ns, "doc_id")
    return top_k(j.select("query_id", "doc_id", F.round(F.col("m") / F.sqrt(F.col("nq") * F.col("ns")), 6).alias("score")), k)


def graph_recall(facts: DataFrame, entity: str, k: int = 20) -> DataFrame:
    """(fact_id, type, value): the k newest facts with an entity whose value contains the given text."""
    e = facts.select("fact_id", "age_days", F.inline(F.array(F.struct(F.lit("topic").alias("type"), F.col("topic").alias("value")), F.struct(F.lit("lang").alias("type"), F.col("lang").alias("value")))))
    return e.where(F.contains("value", F.lit(entity))).orderBy("age_days", F.desc("fact_id"), "type").limit(k).select("fact_id", "type", "value")


def greedy_mmr(scores: Sequence[float], terms: Sequence[set[str]], k: int, weight: float) -> list[int]:
    """Positions in the order of maximal marginal relevance; ties keep the given order."""
    left, chosen, worst = list(range(len(scores))), [], [0.0] * len(scores)
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (weight * scores[i] - (1 - weight) * worst[i], -i))
        left.remove(best)
        chosen.append(best)
        for i in left:
            union = len(terms[i] | terms[best])
            worst[i] = max(worst[i], len(terms[i] & terms[best]) / union if union else 0.0)
    return chosen


def mmr(pool: DataFrame, k: int = 5, weight: float = 0.7, limit: int = 50) -> DataFrame:
    """(query_id, doc_id, rank): maximal marginal relevance over each query's best candidates; pool(query_id, doc_id, score, terms).

    The pool of a query is cut to its best `limit` rows first, the feature's own bound, so a group stays small.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        order = greedy_mmr(g["score"].tolist(), [set(t) for t in g["terms"]], k, weight)
        return pd.DataFrame({"query_id": g["query_id"].iloc[order], "doc_id": g["doc_id"].iloc[order], "rank": range(1, len(order) + 1)})

    return top_k(pool, limit).drop("rank").groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, rank long")


def hybrid_full(lexical: DataFrame, vector: DataFrame, facts: DataFrame, queries: DataFrame, k: int = 10, w_lexical: float = 0.6, w_vector: float = 0.4) -> DataFrame:
    """hybrid_merge with 0.15 times the Jaccard of keywords added before the outcome's factor, and a factor of time after it.

    queries(query_id, keywords), facts(fact_id, outcome_weight, keywords, temporal): the last factor is 1 + 0.4 temporal where that
    is above 0, else 1 + 0.15 temporal. Null keywords share nothing.
    """
    top = F.max(F.abs("lex")).over(Window.partitionBy("query_id"))
    a = lexical.select("query_id", "fact_id", F.col("score").alias("lex"))
    a = a.withColumn("lex", F.when(top > 0, F.abs("lex") / top).otherwise(0.0))
    both = a.join(vector.select("query_id", "fact_id", F.col("score").alias("vec")), ["query_id", "fact_id"], "full")
    j = both.join(queries.select("query_id", F.array_distinct("keywords").alias("qk")), "query_id", "left").join(facts, "fact_id", "left")
    shared = F.size(F.array_intersect("qk", F.array_distinct("keywords")))
    union = F.size("qk") + F.size(F.array_distinct("keywords")) - shared
    overlap = F.coalesce(F.when(union > 0, shared / union), F.lit(0.0))
    s = w_lexical * F.coalesce("lex", F.lit(0.0)) + w_vector * F.coalesce("vec", F.lit(0.0)) + 0.15 * overlap
    t = F.coalesce("temporal", F.lit(0.0))
    s = s * (1 + 0.3 * (F.coalesce("outcome_weight", F.lit(1.0)) - 1)) * (1 + F.when(t > 0, 0.4 * t).otherwise(0.15 * t))
    return top_k(j.select("query_id", "fact_id", F.round(s, 6).alias("score")), k, item="fact_id")

"""Clusters of facts that say the same, their merge, and patterns of success that recur."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.contained import inside
from corpusmill.operators.pairing import small
from corpusmill.operators.similar import likeness_totals, sharing
from corpusmill.plans.runtime import bounded_batches, checkpoint, shuffle_partitions

# Kinds that are never merged away, and kinds that no cluster takes.
PROTECTED = ["lock_rule", "rule", "mental_model", "knowledge_page"]
AUTHORED = ["mental_model", "knowledge_page"]


def clusters(facts: DataFrame, shared: int = 3, ratio: float = 2.0) -> DataFrame:
    """(fact_id, cluster): live facts of one kind and scope that are linked, named by the smallest fact of the cluster.

    Two facts link if they share three words of four letters or ideographs and neither is over twice as long as the other;
    links chain. Words are compared by their 64-bit hashes. Facts with equal words, kind, scope and length stand for each
    other.
    """
    live = facts.where(~F.col("tombstoned") & ~F.col("kind").isin(AUTHORED) & (F.length("content") > 0))
    found = F.regexp_extract_all("content", F.lit("[a-zA-Z一-鿿]{4,}"), F.lit(0))
    words = F.array_sort(F.array_distinct(F.transform(found, lambda w: F.xxhash64(F.lower(w)))))
    w = live.select("fact_id", F.xxhash64("kind", "scope_type").alias("g"), F.length("content").cast("long").alias("n"), words.alias("items")).where(F.size("items") >= shared)
    named = checkpoint(w.select("fact_id", F.xxhash64("g", "n", "items").alias("h")))
    same = checkpoint(named.groupBy("h").agg(F.min("fact_id").alias("id")))
    reps = checkpoint(w.join(small(same.select("id")), F.col("fact_id") == F.col("id")).select("id", "g", "n", "items"))
    linked = sharing(reps, shared, ratio)
    named = named.join(same, "h").join(linked, "id").select("fact_id", F.col("component").alias("cluster"))
    sizes = named.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1")
    return named.join(sizes, "cluster").select("fact_id", "cluster")


def merge_numbers(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, cluster, winner, importance, confidence, tombstoned): what a merge makes of every member of a cluster.

    The winner has the largest importance, then the newest age, the largest confidence, the smallest id. It gains 0.1 of
    importance up to 1, and 0.1 of confidence a loser up to 0.99; losers keep 0.7 of their confidence and end, unless their
    kind is protected.
    """
    j = members.join(facts.select("fact_id", "kind", "importance", "age_days", "confidence"), "fact_id")
    best = j.groupBy("cluster").agg(
        F.max_by("fact_id", F.struct("importance", -F.col("age_days"), "confidence", -F.col("fact_id"))).alias("winner"), F.max("importance").alias("top"), F.count("*").alias("n")
    )
    won = F.col("fact_id") == F.col("winner")
    return j.join(best, "cluster").select(
        "fact_id",
        "cluster",
        "winner",
        F.round(F.when(won, F.least(F.lit(1.0), F.col("top") + 0.1)).otherwise(F.col("importance")), 6).alias("importance"),
        F.round(F.when(won, F.least(F.lit(0.99), F.col("confidence") + 0.1 * (F.col("n") - 1))).otherwise(F.col("confidence") * 0.7), 6).alias("confidence"),
        (~won & ~F.col("kind").isin(PROTECTED)).alias("tombstoned"),
    )


def merged_parts(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(cluster, part, fact_id): whose texts, in order, make the merged text: the winner's, then each that adds something.

    members(fact_id, cluster, winner). A text adds nothing if it is contained in a text taken before or contains one. Which
    texts lie inside others is found first; then these pairs alone stream in order through a task, which holds the ids that one
    cluster has left out so far, no texts.
    """
    # the pattern also takes white space before a last line end that is none, which trimming alone does not
    odd = reduce(or_, [F.col("content").endswith(c) for c in "\u0085\u2028\u2029"])
    body = F.when(odd, F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))).otherwise(F.btrim("content", F.lit(" \t\n\x0b\f\r")))
    texts = facts.select("fact_id", body.alias("body")).where("body <> ''")
    rows = members.join(texts.select("fact_id", F.sha2("body", 256).alias("digest")), "fact_id")
    once = rows.groupBy("cluster", "digest").agg(F.min(F.struct((F.col("fact_id") != F.col("winner")).cast("int").alias("later"), "fact_id")).alias("at"))
    once = checkpoint(once.select("cluster", "at.later", "at.fact_id"))
    pairs = checkpoint(inside(texts.select(F.col("fact_id").alias("id"), "body"), once.select(F.col("fact_id").alias("id"), F.col("cluster").alias("group"))))
    at = once.select("fact_id", "cluster", F.struct("later", "fact_id").alias("at"))
    both = pairs.join(at.toDF("a", "cluster", "x"), "a").join(at.select("fact_id", "at").toDF("b", "y"), "b")
    met = both.select("cluster", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).select("cluster", F.col("u.fact_id").alias("before"), "v.later", "v.fact_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cluster, left = None, set()
        for b in batches:
            out = []
            for c, before, i in zip(b["cluster"].tolist(), b["before"].tolist(), b["fact_id"].tolist()):
                if c != cluster:
                    cluster, left = c, set()
                if before not in left and i not in left:
                    left.add(i)
                    out.append(i)
            yield pd.DataFrame({"fact_id": out}, dtype="int64")

    dealt = met.repartition(shuffle_partitions(facts.sparkSession), "cluster").sortWithinPartitions("cluster", "later", "fact_id")
    left = checkpoint(dealt.mapInPandas(run, "fact_id long"))
    taken = once.select("cluster", "later", "fact_id").join(left, "fact_id", "left_anti")
    part = F.row_number().over(Window.partitionBy("cluster").orderBy("later", "fact_id")) - 1
    return taken.select("cluster", part.alias("part"), "fact_id")


def recurring_success(facts: DataFrame, threshold: int = 3, least: float = 0.3) -> DataFrame:
    """(fact_id, similar, promoted): live successes of the same tier that share least of their words by Jaccard, itself included.

    A fact outside the public tier with enough of them is promoted. Words keep their case; ideographs are words. They are
    compared by their 64-bit hashes. Facts of equal words are one class with a count; classes of a tier meet in tiles.
    """
    found = F.regexp_extract_all("content", F.lit("[A-Za-z0-9_]+|[一-鿿]"), F.lit(0))
    words = F.array_sort(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w))))
    s = facts.where(~F.col("tombstoned") & (F.col("kind") == "success_pattern")).select("fact_id", "tier", words.alias("ws")).where(F.size("ws") > 0)
    s = checkpoint(s.withColumn("h", F.xxhash64("tier", "ws")))
    classes = checkpoint(s.groupBy("h").agg(F.min("fact_id").alias("id"), F.first("tier").alias("g"), F.first("ws").alias("items"), F.count("*").alias("weight")))
    bounded_batches(facts.sparkSession)
    others = likeness_totals(classes, least)
    totals = classes.join(others, "id", "left").select("h", (F.col("weight") + F.coalesce("total", F.lit(0))).alias("similar"))
    return s.select("fact_id", "tier", "h").join(totals, "h").select("fact_id", "similar", ((F.col("tier") != "public") & (F.col("similar") >= threshold)).alias("promoted"))


def path_scores(scored: DataFrame, pairs: DataFrame, direct: DataFrame, cap: float = 0.3, longest: int = 6) -> DataFrame:
    """(query_id, fact_id, direct, boost, path, chain): support of a candidate by the other candidates of its query, in their order.

    pairs(query_id, fact_id, other, rank, relation, confidence): every other candidate, by rank, and how it relates to this
    one; direct(query_id, fact_id, direct). A relation that supports adds its fact to the chain, a conflict empties it, and
    the walk ends with a chain of the given length; the boost is the strongest support met, up to the cap, and chain holds the
    facts up to it. The candidate list bounds a row's array.
    """
    weight = F.when(F.col("relation") == "corroboration", 1.0).when(F.col("relation") == "clarification", 0.7).when(F.col("relation") == "new_fact", 0.5).when(F.col("relation") == "repeat", 0.3).when(F.col("relation") == "conflict", -0.3).otherwise(0.0)
    steps = pairs.groupBy("query_id", "fact_id").agg(F.sort_array(F.collect_list(F.struct("rank", "other", F.round(weight * F.col("confidence"), 6).alias("s")))).alias("steps"))
    none = F.array().cast("array<bigint>")

    def walk(acc: Column, x: Column) -> Column:
        grown = F.concat(acc["chain"], F.array(x["other"]))
        up = F.struct(grown.alias("chain"), F.greatest(acc["best"], x["s"]).alias("best"), F.when(x["s"] > acc["best"], grown).otherwise(acc["kept"]).alias("kept"))
        down = F.struct(none.alias("chain"), acc["best"].alias("best"), acc["kept"].alias("kept"))
        return F.when(F.size(acc["chain"]) >= longest, acc).when(x["s"] > 0, up).when(x["s"] < 0, down).otherwise(acc)

    end = F.aggregate("steps", F.struct(none.alias("chain"), F.lit(0.0).alias("best"), none.alias("kept")), walk)
    j = scored.select("query_id", "fact_id").join(direct, ["query_id", "fact_id"]).join(steps.select("query_id", "fact_id", end.alias("e")), ["query_id", "fact_id"], "left")
    boost = F.least(F.lit(cap), F.coalesce("e.best", F.lit(0.0)))
    chain = F.coalesce(F.array_join("e.kept", ","), F.lit(""))
    return j.select("query_id", "fact_id", F.round("direct", 6).alias("direct"), F.round(boost, 6).alias("boost"), F.round(F.least(F.lit(1.0), F.col("direct") + boost), 6).alias("path"), chain.alias("chain"))

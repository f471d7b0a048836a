"""Aggregations over facts, logs and evaluation results; each is one grouping with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.pairing import containing

#: Buckets of a sketch, as a power of two: a relative error of about 1.6 %.
SKETCH_BITS = 12


def ratio(flag: Column) -> Column:
    return F.round(F.avg(flag.cast("double")), 6)


def daily_sketches(reads: DataFrame, item: str, what: str, ts: str = "ts") -> DataFrame:
    """(item, day, sketch): a mergeable sketch of the different values of `what` that met each item on each day.

    About 1,600 bytes a row whatever the number of values; a day's rows are written once and never read again in full.
    """
    known = reads.where(F.col(item).isNotNull() & F.col(what).isNotNull() & F.col(ts).isNotNull())
    return known.groupBy(F.col(item).alias("item"), F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(what, F.lit(SKETCH_BITS)).alias("sketch"))


def distinct_of(sketches: DataFrame) -> DataFrame:
    """(item, days, estimate): how many different values an item met over any set of days, by union of their sketches."""
    return sketches.groupBy("item").agg(F.count("*").alias("days"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def usage_stats(log: DataFrame) -> DataFrame:
    """Reads, distinct queries, averages and hint ratio per tier."""
    return log.groupBy("tier").agg(
        F.count("*").alias("reads"), F.countDistinct("qhash").alias("queries"), F.countDistinct("user_id").alias("users"),
        F.round(F.avg("n_results"), 6).alias("avg_results"), ratio(F.col("used_hint")).alias("hint_ratio"),
    )


def self_eval(log: DataFrame) -> DataFrame:
    """Events, hits (top score >= .5), empty results, hit rate and mean top score per intent."""
    hit = F.col("top_hit_score") >= 0.5
    return log.groupBy("intent").agg(
        F.count("*").alias("events"), F.count_if(hit).alias("hits"), F.count_if(F.col("n_results") == 0).alias("empty"),
        ratio(hit).alias("hit_rate"), F.round(F.avg("top_hit_score"), 4).alias("avg_top"),
    )


def llm_spend(calls: DataFrame) -> DataFrame:
    """Calls, failures and input length by provider, by tier, and in total."""
    return calls.groupingSets([["tier"], ["provider"], []], "tier", "provider").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures"), F.sum("input_length").alias("input_length")
    )


def importance_histogram(facts: DataFrame) -> DataFrame:
    i = F.col("importance")
    band = F.when(i < 0.25, "0-25").when(i < 0.5, "25-50").when(i < 0.75, "50-75").otherwise("75-100")
    return facts.where(~F.col("tombstoned")).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def growth(facts: DataFrame) -> DataFrame:
    return facts.groupBy("age_days").agg(F.count("*").alias("n"), F.count_if(F.col("tombstoned")).alias("gone"))


def top_keywords(facts: DataFrame, n: int = 20, longest: int = 4) -> DataFrame:
    """The n most frequent words of at least the given length among each fact's distinct words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{%d,}" % longest), F.lit(0)))
    return facts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def class_distribution(facts: DataFrame) -> DataFrame:
    return facts.groupBy("tier", "kind").agg(F.count("*").alias("n"), ratio(F.col("tombstoned")).alias("gone_ratio"))


def tombstone_age_buckets(facts: DataFrame) -> DataFrame:
    gone = facts.where("tombstoned")
    return gone.agg(
        F.count("*").alias("total"), F.count_if(F.col("confirmed_days") <= 30).alias("recent_30d"),
        F.count_if(F.col("confirmed_days") > 30).alias("old"), F.count_if(F.col("confirmed_days").isNull()).alias("no_timestamp"),
    )


def recent_capture(facts: DataFrame, axis: str, n: int = 3) -> DataFrame:
    order = Window.partitionBy(axis).orderBy("age_days", "fact_id")
    return facts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(axis, "fact_id", "rank")


def entity_index(facts: DataFrame) -> DataFrame:
    """(type, value) with the sorted fact ids folded into a digest, their number and smallest."""
    e = facts.select("fact_id", F.explode(F.array(F.struct(F.lit("topic").alias("type"), F.col("topic").alias("value")), F.struct(F.lit("lang").alias("type"), F.col("lang").alias("value")))).alias("e"))
    return e.groupBy("e.type", "e.value").agg(F.countDistinct("fact_id").alias("fact_count"), F.min("fact_id").alias("first_id"), F.sum("fact_id").alias("id_sum"))


def governance(facts: DataFrame) -> DataFrame:
    """Rows, missing confirmations, exact duplicates and 60-character prefix duplicates."""
    per = facts.groupBy(F.substring("content", 1, 60).alias("head"), F.md5("content").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("confirmed_days").isNull()).alias("m"))
    heads = per.groupBy("head").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(F.col("n") - 1).alias("exact"))
    return heads.agg(F.sum("n").alias("rows"), F.sum("m").alias("unconfirmed"), F.sum("exact").alias("exact_dups"), F.sum(F.col("n") - 1).alias("prefix_dups"))


def hit_mrr(results: DataFrame, expected: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, hit, mrr): a ranked result hits if its text contains any expected keyword."""
    j = results.join(expected, "query_id").join(docs.select("doc_id", F.lower("text").alias("t")), "doc_id")
    ok = j.where(F.exists("keywords", lambda k: F.contains(F.col("t"), k))).groupBy("query_id").agg(F.min("rank").alias("first"), F.count("*").alias("matched"))
    return expected.join(ok, "query_id", "left").select(
        "query_id", F.coalesce("matched", F.lit(0)).alias("matched"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr")
    )


def rate_snapshot(log: DataFrame, hours: int = 24) -> DataFrame:
    """Per user, the most reads within any window of the given hours that ends in a read."""
    s = F.col("ts").cast("long")
    w = Window.partitionBy("user_id").orderBy(s).rangeBetween(-3600 * hours + 1, 0)
    return log.select("user_id", F.count("*").over(w).alias("n")).groupBy("user_id").agg(F.max("n").alias("most"), F.count("*").alias("reads"))


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n"
    )


def per_user(facts: DataFrame) -> DataFrame:
    return facts.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("tombstoned")).alias("gone"), F.round(F.avg("importance"), 6).alias("avg_importance"), F.countDistinct("kind").alias("kinds")
    )


def entity_frequency(facts: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent entities by distinct facts, ties by type and value."""
    return entity_index(facts).select("type", "value", "fact_count").orderBy(F.desc("fact_count"), "type", "value").limit(n)


def gate_calibration(scores: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, passed, rate): how many queries pass a gate at each threshold, in one pass over the scores."""
    gates = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    return scores.select(score, gates).groupBy("threshold").agg(
        F.count_if(F.col(score) >= F.col("threshold")).alias("passed"), ratio(F.col(score) >= F.col("threshold")).alias("rate")
    )


def gap_class(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """(query_id, gap): hit, retrieval_gap (stored but not retrieved) or storage_gap."""
    j = hits.join(stored.select("query_id", F.lit(True).alias("stored")).distinct(), "query_id", "left")
    return j.select("query_id", F.when(F.col("matched") > 0, "hit").when(F.col("stored"), "retrieval_gap").otherwise("storage_gap").alias("gap"))


def entity_coverage(facts: DataFrame) -> DataFrame:
    """Rows and the share that has an entity, per tier."""
    return facts.groupBy("tier").agg(F.count("*").alias("n"), ratio(F.col("topic").isNotNull() | F.col("lang").isNotNull()).alias("covered"))


def initial_report(facts: DataFrame) -> DataFrame:
    """(axis, value, n): live facts by kind, by tier and in total, in one grouping."""
    live = facts.where(~F.col("tombstoned")).groupBy("kind", "tier").agg(F.count("*").alias("n"))
    parts = F.array(F.struct(F.lit("kind").alias("axis"), F.col("kind").alias("value")), F.struct(F.lit("tier").alias("axis"), F.col("tier").alias("value")), F.struct(F.lit("total").alias("axis"), F.lit("").alias("value")))
    return live.select("n", F.inline(parts)).groupBy("axis", "value").agg(F.sum("n").alias("n"))


def token_savings(results: DataFrame, docs: DataFrame, shown: int = 240, chars_per_token: float = 1.6) -> DataFrame:
    """Mean and median share of tokens saved by sending the first characters of each result instead of its text."""
    n = F.length("text")
    per = results.join(docs, "doc_id").groupBy("query_id").agg(
        (F.sum(F.least(n, F.lit(shown))) / chars_per_token).alias("sent"), (F.sum(n) / chars_per_token).alias("source")
    )
    saving = 1 - F.col("sent") / F.col("source")
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(saving), 6).alias("mean_saving"), F.round(F.median(saving), 6).alias("median_saving"))


def topic_index(facts: DataFrame, min_weight: float = 0.5) -> DataFrame:
    """Peers, mean and largest weight per topic."""
    return facts.where(F.col("importance") >= min_weight).groupBy("topic").agg(
        F.countDistinct("user_id").alias("peers"), F.round(F.avg("importance"), 6).alias("avg_weight"), F.max("importance").alias("max_weight")
    )


def lexical_gold(expected: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, gold, matched): the fact with the most keywords of the query, ties by importance, then the smallest id."""
    asked = expected.select("query_id", F.explode("keywords").alias("keyword"))
    hits = asked.join(containing(facts.select("fact_id", F.lower("content").alias("low")), asked), "keyword")
    found = hits.groupBy("query_id", "fact_id").agg(F.count("*").alias("m")).join(facts.select("fact_id", "importance"), "fact_id")
    best = found.where("m > 0").groupBy("query_id").agg(F.max_by("fact_id", F.struct("m", "importance", -F.col("fact_id"))).alias("gold"), F.max("m").alias("matched"))
    return best.withColumn("matched", F.col("matched").cast("long"))


def golden_mrr(results: DataFrame, golden: DataFrame) -> DataFrame:
    """(query_id, hit, mrr): where the golden document stands among the ranked results."""
    j = golden.join(results.select("query_id", F.col("doc_id").alias("gold"), "rank"), ["query_id", "gold"], "left")
    return j.select("query_id", F.col("rank").isNotNull().alias("hit"), F.round(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)), 6).alias("mrr"))


def keyword_coverage(results: DataFrame, expected: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, n, covered, complete): how many expected keywords occur in any of the query's results."""
    texts = results.select("query_id", "doc_id").join(docs.select("doc_id", F.lower("text").alias("low")), "doc_id")
    j = expected.select("query_id", F.explode("keywords").alias("word")).join(texts, "query_id", "left")
    ok = j.groupBy("query_id", "word").agg(F.bool_or(F.coalesce(F.contains("low", "word"), F.lit(False))).alias("ok"))
    return ok.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("ok")).alias("covered"), F.bool_and("ok").alias("complete"))


def gate(coverage: DataFrame, share: float) -> DataFrame:
    """(query_id, passed): at least the given share of the keywords, and one at least, is covered."""
    return coverage.select("query_id", (F.col("covered") >= F.greatest(F.lit(1), F.ceil(share * F.col("n")))).alias("passed"))


def retirement_impact(results: DataFrame, expected: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, before, after): reciprocal rank in the first k before and after the top result is removed; results go to rank k + 1."""
    j = results.join(expected, "query_id").join(docs.select("doc_id", F.lower("text").alias("low")), "doc_id")
    ok = F.exists("keywords", lambda w: F.contains(F.col("low"), w))
    best = j.groupBy("query_id").agg(
        F.min(F.when(ok & (F.col("rank") <= k), F.col("rank"))).alias("b"), F.min(F.when(ok & (F.col("rank") > 1), F.col("rank") - 1)).alias("a")
    )
    return best.select("query_id", *[F.round(F.coalesce(1.0 / F.col(c), F.lit(0.0)), 6).alias(n) for c, n in (("b", "before"), ("a", "after"))])


def eval_trend(runs: DataFrame) -> DataFrame:
    """(variant, last, median3, delta) over runs(variant, run, score): the last score, the median of the last 3, the last change."""
    order = Window.partitionBy("variant").orderBy("run")
    back = Window.partitionBy("variant").orderBy(F.desc("run"))
    r = runs.withColumn("change", F.col("score") - F.lag("score").over(order)).withColumn("back", F.row_number().over(back))
    return r.groupBy("variant").agg(
        F.round(F.max(F.when(F.col("back") == 1, F.col("score"))), 6).alias("last"), F.round(F.median(F.when(F.col("back") <= 3, F.col("score"))), 6).alias("median3"),
        F.round(F.max(F.when(F.col("back") == 1, F.col("change"))), 6).alias("delta"),
    )


def manifest(facts: DataFrame, key: str) -> DataFrame:
    """(key, n, first_id, last_id, checksum): rows, id range and an order-free sum of content hashes, to verify a restored copy."""
    h = F.conv(F.substring(F.md5(F.coalesce("content", F.lit(""))), 1, 8), 16, 10).cast("long")
    return facts.groupBy(key).agg(F.count("*").alias("n"), F.min("fact_id").alias("first_id"), F.max("fact_id").alias("last_id"), F.sum(h).alias("checksum"))

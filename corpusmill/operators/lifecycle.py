"""Facts: selection, promotion, decay, validity, deduplication and provenance as planned changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.ordered import prefix_sums, with_previous
from corpusmill.operators.components import connected_components, stars
from corpusmill.operators.pairing import small
from corpusmill.operators.similar import overlaps
from corpusmill.plans.runtime import bounded_batches, checkpoint, opaque

SMALL_BLOCK, TILE_TEXTS, TILE_CHARS = 64, 2048, 8 << 20


def active_facts(facts: DataFrame, min_age_days: int = 7) -> DataFrame:
    """Live rows of age min_age_days or unknown age, rules excluded."""
    return facts.where(~F.col("tombstoned") & (F.col("age_days").isNull() | (F.col("age_days") >= min_age_days)) & ~F.col("kind").isin("lock_rule", "rule"))


def is_active() -> Column:
    return ~F.col("tombstoned") & F.col("ended_days").isNull()


def export_by_kind(facts: DataFrame) -> DataFrame:
    """Per kind: live rows after collapsing equal whitespace-normalised content, copies dropped, and tombstoned rows."""
    body = F.trim(F.regexp_replace("content", r"\s+", " "))
    groups = facts.withColumn("body", body).groupBy("kind", F.md5("body").alias("digest")).agg(
        F.count_if(~F.col("tombstoned")).alias("live"), F.count_if(F.col("tombstoned")).alias("gone")
    )
    return groups.groupBy("kind").agg(
        F.count_if(F.col("live") > 0).alias("entries"), F.sum(F.greatest(F.col("live") - 1, F.lit(0))).alias("collapsed"), F.sum("gone").alias("tombstoned")
    )


def integrity_scan(facts: DataFrame, emb: DataFrame) -> DataFrame:
    """One row per check: rows, missing required values, facts without embedding, embeddings without fact."""
    base = facts.agg(F.count("*").alias("rows"), F.count_if(F.col("content").isNull()).alias("null_content"))
    no_vec = facts.join(emb, "fact_id", "left_anti").agg(F.count("*").alias("n"))
    no_fact = emb.join(facts, "fact_id", "left_anti").agg(F.count("*").alias("n"))
    return (
        base.select(F.lit("rows").alias("name"), F.col("rows").alias("n"))
        .union(base.select(F.lit("null_content"), "null_content"))
        .union(no_vec.select(F.lit("facts_without_embedding"), "n"))
        .union(no_fact.select(F.lit("embeddings_without_fact"), "n"))
    )


def upgrade(facts: DataFrame) -> DataFrame:
    return facts.where((F.col("importance") == 0.5) & (F.col("access_count") >= 5) & ~F.col("tombstoned")).select("fact_id", F.lit(0.7).alias("importance"))


def promote_private(facts: DataFrame) -> DataFrame:
    """Private commons facts of importance >= .85, 10 accesses, 3 distinct queries, whose stable_id is not public yet."""
    public = facts.where("tier = 'public'").select("stable_id").distinct()
    good = (F.col("importance") >= 0.85) & (F.col("access_count") >= 10) & (F.col("distinct_queries_hit") >= 3) & (F.col("visibility") == "commons")
    return facts.where((F.col("tier") == "private") & good & ~F.col("tombstoned")).join(public, "stable_id", "left_anti").select("fact_id", "stable_id")


def recall_decay(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """(fact_id, importance, access_count): recalled facts gain 5 % up to 1; facts unconfirmed for over 90 days lose 5 % above .1."""
    h = hits.select("fact_id").distinct().withColumn("hit", F.lit(True))
    j = facts.join(h, "fact_id", "left")
    down = F.col("importance") * 0.95
    old = (F.col("confirmed_days") > 90) & (F.col("importance") > 0.1) & (down >= 0.1)
    new = F.when(F.col("hit"), F.least(F.lit(1.0), F.col("importance") * 1.05)).when(old, down).otherwise(F.col("importance"))
    return j.select("fact_id", F.round(new, 6).alias("importance"), (F.col("access_count") + F.coalesce(F.col("hit").cast("int"), F.lit(0))).alias("access_count"))


def decay_sweep(facts: DataFrame, since: int = -1) -> DataFrame:
    """Ids above the watermark to tombstone: importance <= .5, never accessed, unconfirmed or not for 30 days."""
    stale = F.col("confirmed_days").isNull() | (F.col("confirmed_days") > 30)
    return facts.where((F.col("fact_id") > since) & (F.col("importance") <= 0.5) & (F.col("access_count") <= 0) & stale & ~F.col("tombstoned")).select("fact_id")


def classify_scope(facts: DataFrame) -> DataFrame:
    """long_term by kind, 3 confirmations or importance >= .7, else short_term with 30 days to live (0: none)."""
    why = (
        F.when(F.col("kind").isin("rule", "user_preference", "decision"), "kind")
        .when(F.col("access_count") >= 3, "confirmations")
        .when(F.col("importance") >= 0.7, "importance")
        .otherwise("default")
    )
    return facts.select("fact_id", why.alias("reason")).select(
        "fact_id", F.when(F.col("reason") == "default", "short_term").otherwise("long_term").alias("scope"), "reason", F.when(F.col("reason") == "default", 30).otherwise(0).alias("ttl_days")
    )


def as_of_view(facts: DataFrame, days_before: int) -> DataFrame:
    """Facts valid at as_of - days_before."""
    return facts.where((F.col("age_days") >= days_before) & (F.col("ended_days").isNull() | (F.col("ended_days") < days_before)))


def _grams(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if len(c) < 3:
        c = np.r_[c, [0x1FFFFF] * (3 - len(c))]
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def trigrams(text: Column) -> Column:
    """How many distinct character trigrams a text has, three code points of 21 bits each; a shorter text is one gram, none has null."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else len(_grams(t)) for t in texts], dtype="Int64")

    return run(text)


def _near_texts(ids: np.ndarray, bodies: list[str], side: np.ndarray, threshold: float) -> pd.DataFrame:
    """(a, b): links of two tiles, or of one with itself where no text has side 1, that connect all pairs at the threshold."""
    sets = [_grams(t) for t in bodies]
    n = np.array([len(s) for s in sets])
    x = np.flatnonzero(side == 0)
    y = np.flatnonzero(side == 1) if (side == 1).any() else x
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k, both in overlaps([sets[i] for i in x], [sets[j] for j in y]) if len(x) else ():
        z = y[k : k + len(both)]
        j, i = np.nonzero((both >= threshold * (n[x][None, :] + n[z][:, None] - both)) & (x[None, :] != z[:, None]))
        a, b = stars(np.concatenate([a, ids[x[i]]]), np.concatenate([b, ids[z[j]]]))
    return pd.DataFrame({"a": a, "b": b})


def near_dup_prefix(facts: DataFrame, prefix: int = 30, threshold: float = 0.7) -> DataFrame:
    """(fact_id, winner): facts that share a trimmed prefix and whose trigram Jaccard is at least the threshold.

    Classes are connected components; the winner has the largest importance, then the smallest id. Equal contents are
    compared once, by their smallest id. The texts of a prefix lie in classes by their number of trigrams, of which only equal
    and neighbouring ones can reach the threshold, and in tiles of bounded size; every two tiles that can hold a pair meet in
    one task, which counts the trigrams that each pair shares and hands on the links that connect as all do.
    """
    f = facts.where(~F.col("tombstoned") & F.col("content").isNotNull()).select("fact_id", "importance", F.trim("content").alias("body"))
    f = f.withColumn("digest", F.md5("body"))
    bounded_batches(facts.sparkSession)
    reps = checkpoint(f.groupBy("digest").agg(F.min("fact_id").alias("rep"), F.substring(F.first("body"), 1, prefix).alias("block")))
    crowded = reps.join(reps.groupBy("block").agg(F.count("*").alias("m")).where("m > 1"), "block").select("rep", "block", "m")
    # only texts that share their prefix with another are cut into trigrams
    bodies = f.select(F.col("fact_id").alias("rep"), "body").join(small(checkpoint(crowded)), "rep")
    crowd = trigrams(F.when(F.col("m") > SMALL_BLOCK, F.col("body")))
    size = F.coalesce(F.floor(F.log(crowd) / float(-np.log(threshold) * (1 + 1e-9))), F.lit(0))
    placed = checkpoint(bodies.select(F.col("rep").alias("id"), "block", size.cast("int").alias("o"), "body"))
    tiles = F.greatest(F.ceil(F.count("*") / TILE_TEXTS), F.ceil(F.sum(F.length("body")) / TILE_CHARS), F.lit(1))
    cells = checkpoint(placed.groupBy("block", "o").agg(tiles.cast("int").alias("tiles")))
    tiles = placed.join(small(cells), ["block", "o"]).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).drop("tiles")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    upper = cells.select("block", F.explode(F.array("o", F.col("o") - 1)).alias("under"), F.col("o").alias("p"), F.col("tiles").alias("others")).toDF("block", "o", "p", "others")
    met = cells.join(upper, ["block", "o"]).withColumn("t", each("tiles")).withColumn("u", each("others")).where("o < p OR t <= u")
    met = checkpoint(met.select("block", "o", "t", "p", "u"))
    first = tiles.join(small(met), ["block", "o", "t"]).select("block", "o", "t", "p", "u", "id", "body", F.lit(0).alias("side"))
    second = tiles.select("block", F.col("o").alias("p"), F.col("t").alias("u"), "id", "body")
    second = second.join(small(met.where("o < p OR t < u")), ["block", "p", "u"]).select("block", "o", "t", "p", "u", "id", "body", F.lit(1).alias("side"))

    def near(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return _near_texts(b["id"].to_numpy(), b["body"].tolist(), b["side"].to_numpy(), threshold)

    cc = connected_components(first.unionByName(second).groupBy("block", "o", "t", "p", "u").applyInPandas(near, "a long, b long"))
    cls = f.join(reps.select("digest", "rep"), "digest").join(cc, F.col("rep") == F.col("id"), "left").withColumn("cls", F.coalesce("component", "rep"))
    best = cls.groupBy("cls").agg(F.max_by("fact_id", F.struct("importance", -F.col("fact_id"))).alias("winner"), F.count("*").alias("n"))
    return cls.join(best, "cls").where("n > 1").select("fact_id", "winner")


def ancestors(edges: DataFrame, seeds: DataFrame, max_depth: int = 8) -> DataFrame:
    """(seed, node, depth) over edges(child, parent), the smallest depth of each; one join per level, cycles visited once."""
    edges = opaque(edges.select("child", "parent"))
    front = checkpoint(seeds.select(F.col("fact_id").alias("seed"), F.col("fact_id").alias("node")).distinct())
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        step = front.join(edges, F.col("node") == F.col("child")).select("seed", F.col("parent").alias("node")).distinct()
        front = checkpoint(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = checkpoint(seen.unionByName(front.withColumn("depth", F.lit(depth))))
    return seen.where("depth > 0")


def session_clusters(chunks: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Consecutive chunks of a user; a new cluster opens when the gap exceeds the limit. One row per cluster.

    Users are not bound to tasks: rows lie in ranges of (user, time), and sums over ranges number the clusters.
    """
    order = ["user_id", "ts", "event_id"]
    rows = with_previous(chunks.select(*order), order, ["user_id", "ts"])
    same = F.col("prev_user_id").eqNullSafe(F.col("user_id")) & F.col("prev_ts").isNotNull()
    gap = F.col("ts").cast("long") - F.col("prev_ts").cast("long")
    opens = F.when(same & F.coalesce(gap <= 60 * gap_minutes, F.lit(False)), 0).otherwise(1)
    summed = prefix_sums(rows.select(*order, opens.alias("opens")), order, {"before": F.col("opens")})
    placed = summed.select(*order, (F.col("before") + F.col("opens")).alias("number"))
    grouped = placed.groupBy("user_id", "number").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"),
        (F.max("ts").cast("long") - F.min("ts").cast("long")).alias("seconds"),
    )
    grouped = checkpoint(grouped)
    first = grouped.groupBy(F.col("user_id").alias("u_")).agg(F.min("number").alias("low_"))
    joined = grouped.join(first, F.col("user_id").eqNullSafe(F.col("u_")))
    return joined.select("user_id", (F.col("number") - F.col("low_") + 1).alias("cluster"), "n", "first_id", "last_id", "seconds")


def lifecycle(facts: DataFrame) -> DataFrame:
    """(fact_id, lifetime_days, active): days from start to end, negative where the end lies before the start; null while valid."""
    return facts.select("fact_id", (F.col("age_days") - F.col("ended_days")).cast("double").alias("lifetime_days"), is_active().alias("active"))


def staleness(facts: DataFrame, threshold_days: int = 30) -> DataFrame:
    return facts.where(~F.col("tombstoned")).select("fact_id", "age_days", (F.col("age_days") > threshold_days).alias("stale"))


def promotion_gate(facts: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """(fact_id, reason): why a candidate is refused, or accepted."""
    reason = F.when(F.round("confidence", 6) < min_confidence, "low_confidence").when((F.col("tier") == "public") & (F.col("visibility") != "commons"), "not_commons")
    return facts.select("fact_id", reason.otherwise("accepted").alias("reason"))


def scope_stats(facts: DataFrame, soon: int = 7) -> DataFrame:
    """Rows, expired rows and rows that expire soon, by scope."""
    e = F.col("expires_in_days")
    return facts.where(~F.col("tombstoned")).groupBy("scope_type").agg(
        F.count("*").alias("n"), F.count_if(e < 0).alias("expired"), F.count_if((e >= 0) & (e <= soon)).alias("expiring")
    )


def descendants(edges: DataFrame, seeds: DataFrame, max_depth: int = 8) -> DataFrame:
    """(seed, node, depth) over edges(child, parent), towards the children."""
    return ancestors(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")), seeds, max_depth)


def overview(facts: DataFrame, first: int = 320, chars: int = 240) -> DataFrame:
    """(fact_id, abstract, overview): the first line up to a bound, and the first characters."""
    return facts.select("fact_id", F.substring(F.split_part("content", F.lit("\n"), F.lit(1)), 1, first).alias("abstract"), F.substring("content", 1, chars).alias("overview"))

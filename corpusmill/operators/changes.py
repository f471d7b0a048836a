"""Planned changes to facts, and the logs beside them: invalidation, decay, versions, merges, moves, retries."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.components import connected_components
from corpusmill.operators.screening import keywords
from corpusmill.plans.runtime import checkpoint, opaque, shuffle_partitions


def invalidate(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """(fact_id, status) per distinct request(fact_id): invalidated, already_invalid or missing. Asking twice changes nothing."""
    state = facts.select("fact_id", F.lit(True).alias("known"), F.col("ended_days").isNotNull().alias("ended"))
    j = requests.select("fact_id").distinct().join(state, "fact_id", "left")
    return j.select("fact_id", F.when(F.col("known").isNull(), "missing").when(F.col("ended"), "already_invalid").otherwise("invalidated").alias("status"))


def halve_and_expire(facts: DataFrame) -> DataFrame:
    """(fact_id, access_count, tombstoned): idle for 30 days halves the accesses down to 1, for 90 days ends the fact."""
    idle = F.coalesce("confirmed_days", "age_days")
    halved = F.greatest(F.lit(1), F.floor(F.col("access_count") / 2))
    live = facts.where(~F.col("tombstoned"))
    return live.select("fact_id", F.when(idle >= 30, halved).otherwise(F.col("access_count")).cast("long").alias("access_count"), (idle >= 90).alias("tombstoned"))


def memory_class(kind: Column, content: Column) -> Column:
    k = F.lower(F.trim(kind))
    return (
        F.when(k.isin("rule", "decision", "user_preference"), "mental_model")
        .when(k.isin("success_pattern", "failure_pattern", "lesson", "experience", "procedure"), "experience")
        .when((k == "observation") | F.coalesce(F.startswith(F.ltrim(content), F.lit("[observation]")), F.lit(False)), "observation")
        .otherwise("world_fact")
    )


def scope_backfill(facts: DataFrame, plan: DataFrame) -> DataFrame:
    """(old, new, reason, n): how many facts a plan(fact_id, scope, reason) moves between scopes."""
    return facts.select("fact_id", F.col("scope_type").alias("old")).join(plan, "fact_id").groupBy("old", F.col("scope").alias("new"), "reason").agg(F.count("*").alias("n"))


def cascade_forget(facts: DataFrame, forget: DataFrame) -> DataFrame:
    """(part, n): facts ended, edges to a parent removed because either end is forgotten, and children left without a parent."""
    gone = forget.select("fact_id").distinct()
    edges = facts.where("parent_id IS NOT NULL").select("fact_id", "parent_id")
    ended = facts.join(gone, "fact_id", "left_semi")
    down = edges.join(gone.withColumnRenamed("fact_id", "parent_id").withColumn("up", F.lit(True)), "parent_id", "left")
    both = down.join(gone.withColumn("self", F.lit(True)), "fact_id", "left")
    cut = both.agg(F.count_if(F.col("up") | F.col("self")).alias("removed"), F.count_if(F.col("up") & F.col("self").isNull()).alias("orphans"))
    return (
        ended.agg(F.count("*").alias("n")).select(F.lit("ended").alias("part"), "n")
        .union(cut.select(F.lit("edges_removed"), "removed"))
        .union(cut.select(F.lit("orphaned"), "orphans"))
    )


def retry_queue(items: DataFrame, max_attempts: int = 5) -> DataFrame:
    """(status, n, eligible, oldest): items of each status, and failed ones with attempts left."""
    ok = (F.col("status") == "error") & (F.col("attempts") < max_attempts)
    return items.groupBy("status").agg(F.count("*").alias("n"), F.count_if(ok).alias("eligible"), F.min("item_id").alias("oldest"))


def trust_decay(peers: DataFrame, floor: int = 30, step: int = 5, days: int = 30) -> DataFrame:
    """(peer_id, trust): trust above the floor that was not renewed for 30 days loses a step, down to the floor."""
    old = (F.col("trust") > floor) & (F.col("age_days") >= days)
    return peers.select("peer_id", F.when(old, F.greatest(F.lit(floor), F.col("trust") - step)).otherwise(F.col("trust")).alias("trust"))


def current_versions(facts: DataFrame, key: str) -> DataFrame:
    """(key, fact_id, versions): the newest row of each natural key, ties by larger id; the others are superseded."""
    return facts.groupBy(key).agg(F.max_by("fact_id", F.struct(-F.col("age_days"), "fact_id")).alias("fact_id"), F.count("*").alias("versions"))


def relocate(facts: DataFrame, move: DataFrame, tier: str) -> DataFrame:
    """(part, fact_id, tier, tombstoned): a live copy in the new tier, the ended source row and an audit row for each moved fact."""
    moved = facts.where(F.col("tier") != tier).join(move.select("fact_id").distinct(), "fact_id", "left_semi")
    parts = F.array(
        F.struct(F.lit("copy").alias("part"), F.lit(tier).alias("tier"), F.lit(False).alias("tombstoned")),
        F.struct(F.lit("source").alias("part"), "tier", F.lit(True).alias("tombstoned")),
        F.struct(F.lit("audit").alias("part"), F.lit(tier).alias("tier"), F.lit(False).alias("tombstoned")),
    )
    return moved.select("fact_id", F.inline(parts)).select("part", "fact_id", "tier", "tombstoned")


def semantic_groups(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, winner): connected components of pairs(a, b); the winner has the largest importance, then length, then the smallest id."""
    cc = connected_components(pairs.select("a", "b"))
    members = cc.join(facts.select(F.col("fact_id").alias("id"), "importance", F.length("content").alias("n")), "id")
    best = members.groupBy("component").agg(F.max_by("id", F.struct("importance", "n", -F.col("id"))).alias("winner"))
    return members.join(best, "component").select(F.col("id").alias("fact_id"), "winner")


def apply_merges(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """(winner, importance, merged, topics): the winner's new row: largest importance, members merged in, distinct topics."""
    j = groups.join(facts, "fact_id")
    return j.groupBy("winner").agg(
        F.max("importance").alias("importance"), F.count_if(F.col("fact_id") != F.col("winner")).alias("merged"), F.countDistinct("topic").alias("topics")
    )


def merge_rows(groups: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, audit) of merging groups(fact_id, winner) of facts (fact_id, importance, tags, content, ...).

    rows(fact_id, tombstoned, importance, tags, merged, merged_into) replaces every fact of a group: the winner takes the largest
    importance and, after its own tags, those of the others in order of their ids, each once; the others are
    tombstoned and name the winner. audit(target_id, loser_id, severity, loser_content, importance, n_tags) has a row for each
    fact merged in, with what the winner has in the end. A winner gathers its different tags only, not its members.
    """
    j = checkpoint(groups.where("fact_id IS NOT NULL AND winner IS NOT NULL").distinct().join(facts.select("fact_id", "importance", "tags", "content"), "fact_id"))
    whole = j.groupBy("winner").agg(F.max("importance").alias("most"), F.count_if(F.col("fact_id") != F.col("winner")).alias("merged"), F.bool_or(F.col("fact_id") == F.col("winner")).alias("there"))
    whole = whole.where("there AND merged > 0").drop("there")
    each = j.select("winner", F.struct((F.col("fact_id") != F.col("winner")).alias("late"), "fact_id").alias("at"), F.posexplode("tags").alias("pos", "tag"))
    first = each.where("tag IS NOT NULL").groupBy("winner", "tag").agg(F.min(F.struct("at", "pos")).alias("first"))
    tags = first.groupBy("winner").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "tag"))), lambda x: x["tag"]).alias("union"))
    none = F.array().cast("array<string>")
    done = j.join(whole.join(tags, "winner", "left"), "winner").withColumn("union", F.coalesce("union", none))
    won = F.col("fact_id") == F.col("winner")
    rows = done.select(
        "fact_id", (~won).alias("tombstoned"), F.when(won, F.col("most")).otherwise(F.col("importance")).alias("importance"), F.when(won, F.col("union")).otherwise(F.coalesce("tags", none)).alias("tags"),
        F.when(won, F.col("merged")).otherwise(0).alias("merged"), F.when(~won, F.col("winner")).alias("merged_into"),
    )
    audit = done.where(~won).select(
        F.col("winner").alias("target_id"), F.col("fact_id").alias("loser_id"), F.lit("warning").alias("severity"), F.substring(F.coalesce("content", F.lit("")), 1, 120).alias("loser_content"),
        F.col("most").alias("importance"), F.size("union").alias("n_tags"),
    )
    return rows, audit


def hygiene_scan(facts: DataFrame, smallest: int = 3) -> DataFrame:
    """(fact_id, first_id): rows whose shape (digits as #, first 600 characters) at least three live rows share, but for the first."""
    live = facts.where(~F.col("tombstoned") & F.col("content").isNotNull())
    shaped = live.select("fact_id", F.md5(F.substring(F.regexp_replace("content", "[0-9]+", "#"), 1, 600)).alias("shape"))
    groups = shaped.groupBy("shape").agg(F.count("*").alias("n"), F.min("fact_id").alias("first_id")).where(F.col("n") >= smallest)
    return shaped.join(groups, "shape").where("fact_id <> first_id").select("fact_id", "first_id")


def keyword_pairs(facts: DataFrame, smallest: int = 3, confidence: float = 0.7) -> DataFrame:
    """(a, b, n, confidence): facts grouped by the first two, in order, of their first five keywords."""
    two = F.slice(F.sort_array(keywords(F.col("content"))), 1, 2)
    pairs = facts.select(two.alias("k"), "confidence").where(F.size("k") == 2)
    grouped = pairs.groupBy(F.col("k")[0].alias("a"), F.col("k")[1].alias("b")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return grouped.where((F.col("n") >= smallest) & (F.col("confidence") >= confidence))


def provenance_depth(edges: DataFrame, facts: DataFrame, max_depth: int = 64) -> DataFrame:
    """(fact_id, depth): the longest way up to a root over edges(child, parent); roots have 0. One join per level, cycles end at max_depth."""
    edges = opaque(edges.select("child", "parent"))
    roots = facts.select("fact_id").join(edges.select(F.col("child").alias("fact_id")), "fact_id", "left_anti").distinct()
    front = checkpoint(roots.withColumnRenamed("fact_id", "node"))
    levels = front.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        front = checkpoint(front.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct())
        if front.isEmpty():
            break
        levels = levels.unionByName(front.withColumn("depth", F.lit(depth)))
    return levels.groupBy(F.col("node").alias("fact_id")).agg(F.max("depth").alias("depth"))


def rate_admission(log: DataFrame, cap: int = 1000, hours: int = 24) -> DataFrame:
    """(user_id, event_id, admitted, retry_after): a sliding limit that counts admitted requests only.

    Sequential per user by (ts, event_id), so rows stream through their partition in order; a task holds the times of at
    most cap admitted requests, however many rows a user has. retry_after: seconds until a refused request would pass.
    """
    span = 3600 * hours

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, recent = None, deque()
        for b in batches:
            wait = np.zeros(len(b), dtype=np.int64)
            for k, (u, t) in enumerate(zip(b["user_id"].tolist(), b["s"].tolist())):
                if u != user:
                    user, recent = u, deque()
                while recent and recent[0] <= t - span:
                    recent.popleft()
                if len(recent) < cap:
                    recent.append(t)
                else:
                    wait[k] = recent[0] + span - t
            yield pd.DataFrame({"user_id": b["user_id"], "event_id": b["event_id"], "admitted": wait == 0, "retry_after": wait})

    rows = log.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "event_id", F.col("ts").cast("long").alias("s"))
    dealt = rows.repartition(shuffle_partitions(log.sparkSession), "user_id").sortWithinPartitions("user_id", "s", "event_id")
    return dealt.mapInPandas(run, "user_id long, event_id long, admitted boolean, retry_after long")


def nonce_dedup(log: DataFrame, days: int = 7) -> DataFrame:
    """(user_id, nonce, event_id, accepted): a nonce is refused until the given days have passed since its last accepted use.

    Rows stream in order of (user, nonce, ts, event_id); a task holds one time.
    """
    ttl = 86400 * days

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for b in batches:
            ok = np.zeros(len(b), dtype=bool)
            for k, (u, n, t) in enumerate(zip(b["user_id"].tolist(), b["nonce"].tolist(), b["s"].tolist())):
                if (u, n) != key or t - last >= ttl:
                    key, last, ok[k] = (u, n), t, True
            yield pd.DataFrame({"user_id": b["user_id"], "nonce": b["nonce"], "event_id": b["event_id"], "accepted": ok})

    rows = log.where("user_id IS NOT NULL AND nonce IS NOT NULL AND ts IS NOT NULL").select("user_id", "nonce", "event_id", F.col("ts").cast("long").alias("s"))
    dealt = rows.repartition(shuffle_partitions(log.sparkSession), "user_id", "nonce").sortWithinPartitions("user_id", "nonce", "s", "event_id")
    return dealt.mapInPandas(run, "user_id long, nonce long, event_id long, accepted boolean")


def renewals(facts: DataFrame, hits: DataFrame, ttl: int = 30, least: int = 3) -> DataFrame:
    """(fact_id, scope, expires_in_days, reason): scope changes of live short-term facts.

    One recalled in hits(fact_id) is renewed for ttl days; one with enough accesses becomes long-term and never ends; else one
    past its end is demoted to the end itself, today.
    """
    short = facts.where(~F.col("tombstoned") & (F.col("scope_type") == "short_term"))
    j = short.join(hits.select("fact_id").distinct().withColumn("hit", F.lit(True)), "fact_id", "left")
    reason = F.when(F.col("access_count") >= least, "promoted").when(F.coalesce("hit", F.lit(False)), "renewed").when(F.col("expires_in_days") < 0, "demoted")
    days = F.when(reason == "renewed", ttl).when(reason == "demoted", 0)
    scope = F.when(reason == "promoted", "long_term").otherwise("short_term")
    return j.select("fact_id", scope.alias("scope"), days.alias("expires_in_days"), reason.alias("reason")).where("reason IS NOT NULL")


def retry_actions(items: DataFrame, max_attempts: int = 5, keep_days: int = 30, lease_minutes: int = 15) -> DataFrame:
    """(item_id, action) over items(item_id, status, attempts, age_days, lease_minutes): purge, give_up, requeue or reclaim.

    Done items past keep_days go; failed ones are queued again while attempts are left; a running one whose lease is over is
    taken back. All others need nothing.
    """
    action = (
        F.when((F.col("status") == "done") & (F.col("age_days") > keep_days), "purge")
        .when((F.col("status") == "error") & (F.col("attempts") >= max_attempts), "give_up")
        .when(F.col("status") == "error", "requeue")
        .when((F.col("status") == "running") & (F.col("lease_minutes") > lease_minutes), "reclaim")
    )
    return items.select("item_id", action.alias("action")).where("action IS NOT NULL")


def trust_changes(peers: DataFrame, outcomes: DataFrame, lowest: int = 10) -> DataFrame:
    """(peer_id, trust, quarantined, original): trust after bumps, held in 0..100; below the lowest a peer is set aside.

    outcomes(peer_id, bump) are summed per peer. original is the trust a peer set aside had, to give back later.
    """
    total = outcomes.groupBy("peer_id").agg(F.sum("bump").alias("bump"))
    new = F.greatest(F.lit(0), F.least(F.lit(100), F.col("trust") + F.coalesce("bump", F.lit(0))))
    j = peers.join(total, "peer_id", "left").select("peer_id", F.col("trust").alias("was"), new.cast("long").alias("trust"))
    low = F.col("trust") < lowest
    return j.select("peer_id", "trust", low.alias("quarantined"), F.when(low, F.col("was")).cast("long").alias("original"))


def invalidate_requests(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """(fact_id, status, ended_days, ended_by, reason) of requests(fact_id, at_days, by, reason): what each does, none done twice.

    Of several requests for a fact the earliest by at_days (days before now, largest first), then by and reason, counts. invalidated sets
    the end; an ended fact keeps its own (already); a removed one gives gone; an unknown one missing.
    """
    first = requests.groupBy("fact_id").agg(F.max_by(F.struct("at_days", "by", "reason"), F.struct("at_days", "by", "reason")).alias("r"))
    j = first.join(facts.select("fact_id", "tombstoned", "ended_days"), "fact_id", "left")
    status = F.when(F.col("tombstoned").isNull(), "missing").when(F.col("tombstoned"), "gone").when(F.col("ended_days").isNotNull(), "already").otherwise("invalidated")
    done = status == "invalidated"
    return j.select("fact_id", status.alias("status"), F.when(done, F.col("r.at_days")).otherwise(F.col("ended_days")).cast("long").alias("ended_days"), F.when(done, F.col("r.by")).alias("ended_by"), F.when(done, F.col("r.reason")).alias("reason"))


def export_rows(facts: DataFrame) -> DataFrame:
    """(kind, fact_id, part, copies): rows of an export by kind: a live entry for each content, its copies counted, and ended rows.

    Live rows of one kind and content, white space aside, collapse to the one of most importance, ties by smallest id. Removed
    rows that a live row of the same content replaces are moved, others removed.
    """
    body = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))
    f = facts.select("kind", "fact_id", "importance", "tombstoned", F.md5(body).alias("h"))
    live = f.where("NOT tombstoned").groupBy("kind", "h").agg(F.max_by("fact_id", F.struct("importance", -F.col("fact_id"))).alias("fact_id"), F.count("*").alias("copies"))
    entries = live.select("kind", "fact_id", F.lit("entry").alias("part"), "copies")
    gone = f.where("tombstoned").join(live.select("kind", "h", F.lit(True).alias("has")), ["kind", "h"], "left")
    part = F.when(F.coalesce("has", F.lit(False)), "moved").otherwise("removed")
    return entries.unionByName(gone.select("kind", "fact_id", part.alias("part"), F.lit(1).cast("long").alias("copies")))

"""Records of the system around the facts: logs, exports, peers, versions, invariants and audits. One job per whole table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.runtime import shuffle_partitions

# English discourse words that a recall query loses, and words that say nothing about an error.
DISCOURSE = [
    "i", "we", "you", "he", "she", "it", "they", "the", "a", "an", "do", "does", "did", "what", "when", "where", "how", "which", "last", "next", "this", "that", "these",
    "those", "about", "just", "really", "very", "actually",
]
ERROR_NOISE = ["the", "and", "for", "with", "from", "this", "that", "have", "into", "your", "file", "line", "value", "error", "errors"]
# Kinds that may supersede or gate older facts of the gated kinds.
UPDATE_KINDS = ["user_correction", "correction", "pushback", "fact_update", "user_preference", "decision", "success_pattern"]
GATED_KINDS = ["user_preference", "decision", "user_correction", "success_pattern"]
# Intents of a read query by their English patterns, in order.
INTENTS = [
    (r"workflow|rule|pattern|architecture|framework", "method"),
    (r"prefer\b|like\b|dislike|hate|favor|favorite", "preference"),
    (r"my\s+|i\s+(?:am|was|will|did|have)\b|mine\b", "personal"),
    (r"last\s+(?:week|month|day|year|time)|yesterday|today|ago", "temporal"),
    (r"how\s+to|how\s+(?:do|can|should)|step\s*by\s*step", "procedural"),
]
# ASCII signals of private speech.
SIGNALS = [
    ("singular", r"(?:^|[^A-Za-z0-9_])(?:my|mine|me|I)(?:[^A-Za-z0-9_]|$)"),
    ("plural", r"(?:^|[^A-Za-z0-9_])(?:our|us|we)(?:[^A-Za-z0-9_]|$)"),
    ("marker", r"family|(?:^|[^A-Za-z0-9_])(?:address|password|account|salary|income|wife|husband|daughter|son)(?:[^A-Za-z0-9_]|$)"),
    ("emotion", r"(?:^|[^A-Za-z0-9_])(?:suicidal|suicide|depression|depressed|anxiety)(?:[^A-Za-z0-9_]|$)"),
    ("travel", r"(?:^|[^A-Za-z0-9_])(?:travel|trip|vacation|flight|itinerary|tickets?)(?:[^A-Za-z0-9_]|$)"),
    ("contact", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
]


def whole_word(words: list[str]) -> str:
    """A pattern of any of these words alone, for an engine that walks: it starts at a word's first letter and looks back from there."""
    heads = "".join(sorted({w[0] for w in words}))
    rests = "|".join(f"(?<={h})(?:{'|'.join(w[1:] for w in words if w[0] == h)})" for h in heads)
    return f"[{heads}](?<![A-Za-z0-9_][{heads}])(?:{rests})(?![A-Za-z0-9_])"


# Patterns that are found in the same texts as those above, without a try at every character.
SOUGHT = {
    "singular": whole_word(["my", "mine", "me", "I"]),
    "plural": whole_word(["our", "us", "we"]),
    "marker": whole_word(["address", "password", "account", "salary", "income", "wife", "husband", "daughter", "son"]),
    "emotion": whole_word(["suicidal", "suicide", "depression", "depressed", "anxiety"]),
    "travel": whole_word(["travel", "trip", "vacation", "flight", "itinerary", "ticket", "tickets"]),
    "contact": r"@(?<=[A-Za-z0-9._%+-]@)[A-Za-z0-9.-]+?\.[A-Za-z]{2}",
}


def union_stores(stores: dict[str, DataFrame]) -> DataFrame:
    """All stores in one table with their origin; a column that a store lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("origin", F.lit(name)) for name, df in stores.items()])


def log_quality(lines: DataFrame, first: str, last: str) -> DataFrame:
    """(status, n) of JSON lines(line): malformed (no object or no readable ts), out_of_window or ok; the window is half open."""
    row = F.from_json("line", "ts timestamp, qhash long, n_results long", {"mode": "PERMISSIVE"})
    ts = row["ts"]
    status = F.when(ts.isNull(), "malformed").when((ts < F.lit(first).cast("timestamp")) | (ts >= F.lit(last).cast("timestamp")), "out_of_window").otherwise("ok")
    return lines.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def ingest_log(texts: DataFrame, known: DataFrame, pattern: str) -> DataFrame:
    """(source, pos, name, value) of each match (two groups) in texts(source, text) whose source is not in known(source)."""
    new = texts.join(known.select("source").distinct(), "source", "left_anti")
    pairs = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "value"))])
    return new.select("source", F.posexplode(pairs).alias("pos", "m")).select("source", "pos", F.col("m.name").alias("name"), F.col("m.value").alias("value"))


def render(facts: DataFrame) -> DataFrame:
    """(fact_id, prompt, document): a one-line prompt entry and a small Markdown document of each live fact."""
    body = F.coalesce("content", F.lit(""))
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    doc = F.concat(F.lit("# "), "kind", F.lit(" "), "fact_id", F.lit("\n\n- tier: "), "tier", F.lit("\n- user: "), "user_id", F.lit("\n\n"), body, F.lit("\n"))
    return facts.where(~F.col("tombstoned")).select("fact_id", F.concat(F.lit("- ["), "kind", F.lit("] "), flat).alias("prompt"), doc.alias("document"))


def export(facts: DataFrame, path: str, form: str) -> None:
    """Write rows as json, csv or text (its one column) below path, one file per partition; an existing path is an error."""
    writer = facts.write.option("header", True) if form == "csv" else facts.write
    writer.format(form).save(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append events to a Parquet table that is partitioned by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_intent(text: Column) -> Column:
    """method, preference, personal, temporal, procedural or factual; the first pattern wins, an empty text is factual."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(low.rlike(INTENTS[0][0]), INTENTS[0][1])
    for pattern, name in INTENTS[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("factual")


def peer_targets(peers: DataFrame, topics: DataFrame, topic: str, least: float = 0.5) -> DataFrame:
    """Peers that may be searched for a topic: weight, trust 50, outbound allowed, an endpoint, neither blacklisted nor in quarantine."""
    fit = topics.where((F.col("topic") == topic) & (F.col("weight") >= least)).select("peer_id").distinct()
    ok = (F.col("trust") >= 50) & F.coalesce("outbound", F.lit(True)) & ~F.coalesce("kind", F.lit("friend")).isin("blacklist", "quarantine") & (F.coalesce("endpoint", F.lit("")) != "")
    return peers.where(ok).join(fit, "peer_id", "left_semi").select("peer_id")


def peer_health() -> Column:
    """quarantined, unknown, unreachable, degraded or healthy."""
    return (
        F.when(F.col("kind") == "quarantine", "quarantined")
        .when(F.coalesce("endpoint", F.lit("")) == "", "unknown")
        .when(~F.col("online"), "unreachable")
        .when((F.col("trust") < 30) | ~F.col("allow_search"), "degraded")
        .otherwise("healthy")
    )


def merge_peer_results(results: DataFrame, k: int = 10) -> DataFrame:
    """The k most relevant results of all peers per query, ties by item, then peer."""
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "item", "peer_id")
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stale_derived(derived: DataFrame, sources: DataFrame) -> DataFrame:
    """(derived_id, reason): missing or tombstoned source, or a changed text, by the hash taken when derived(derived_id, source_id, hash)."""
    s = sources.select(F.col("fact_id").alias("source_id"), "tombstoned", F.sha2(F.coalesce("content", F.lit("")), 256).alias("now"), F.lit(True).alias("here"))
    j = derived.join(s, "source_id", "left")
    reason = F.when(F.col("here").isNull(), "missing").when(F.col("tombstoned"), "tombstoned").when(F.col("now") != F.col("hash"), "changed")
    return j.select("derived_id", reason.alias("reason")).where("reason IS NOT NULL")


def duplicate_keys(df: DataFrame, rule: str, *key: str) -> DataFrame:
    """(rule, key, n): values of a key that more than one row has; null keys are left out."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in key])
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), text.alias("key"), "n")


def dangling(df: DataFrame, rule: str, column: str, parents: DataFrame, key: str) -> DataFrame:
    """(rule, key, n): values without a parent and the rows that hold them; a null value is a violation under the key 'null'."""
    lost = df.select(F.col(column).alias("k")).join(parents.select(F.col(key).alias("k")).distinct(), "k", "left_anti")
    return lost.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), F.coalesce(F.col("k").cast("string"), F.lit("null")).alias("key"), "n")


def empty_values(df: DataFrame, rule: str, column: str) -> DataFrame:
    """(rule, key, n): how many rows have a null or empty value, under the column's name; none, no row."""
    return df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) == "").groupBy().agg(F.count("*").alias("n")).where("n > 0").select(F.lit(rule).alias("rule"), F.lit(column).alias("key"), "n")


def strip_discourse(text: Column) -> Column:
    """Words without discourse markers; the text itself where too little is left (under 4 characters or a quarter of it)."""
    kept = F.array_join(F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: ~F.lower(F.regexp_replace(w, r"^[,.?!;:()\[\]{}]+|[,.?!;:()\[\]{}]+$", "")).isin(DISCOURSE)), " ")
    return F.when(F.length(kept) < F.greatest(F.lit(4), F.floor(F.length(text) / 4)), text).otherwise(kept)


def error_query(text: Column, n: int = 12) -> Column:
    """The first n distinct identifiers of an error text without paths, hexadecimal numbers and empty words."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[A-Za-z]:\\[^\s]+|[^\s]*[/\\][^\s]+\.[A-Za-z0-9_]{1,5}", " "), "0x[0-9a-fA-F]+", " ")
    found = F.filter(F.regexp_extract_all(bare, F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)), lambda w: ~F.lower(w).isin(ERROR_NOISE))
    return F.array_join(F.slice(F.array_distinct(found), 1, n), " ")


def zone_fallback(scored: DataFrame, facts: DataFrame, zones: list[tuple[str, list[str]]], k: int = 3) -> DataFrame:
    """(query_id, zone, fact_id, rank): the k best hits of the first zone, in order, that has any; an empty list of kinds takes all."""
    j = scored.join(facts.select("fact_id", "kind"), "fact_id")
    of = [F.when(F.col("kind").isin(kinds) if kinds else F.lit(True), F.lit(n)) for n, (_, kinds) in enumerate(zones)]
    j = j.withColumn("z", F.explode(F.array_compact(F.array(*of))))
    first = j.join(j.groupBy("query_id").agg(F.min("z").alias("z")), ["query_id", "z"], "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")
    name = F.element_at(F.array(*[F.lit(z) for z, _ in zones]), F.col("z") + 1)
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", name.alias("zone"), "fact_id", "rank")


def conversation_graph(queries: DataFrame, snippets: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, snippet_id, rank): the first k snippets of the same scope that share a capitalised word with the query.

    queries(query_id, scope, query), snippets(snippet_id, scope, text); more shared words come first, then the smaller id.
    """

    def names(c: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Z][a-z]{2,}"), F.lit(0))
        return F.explode(F.array_distinct(F.transform(found, lambda w: F.lower(w)))).alias("entity")

    q, s = queries.select("query_id", "scope", names("query")), snippets.select("snippet_id", "scope", names("text"))
    shared = q.join(s, ["scope", "entity"]).groupBy("query_id", "snippet_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "snippet_id")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "snippet_id", "rank")


def explore(ranked: DataFrame, facts: DataFrame, share: int = 10, k: int = 5, extra: int = 2) -> DataFrame:
    """(query_id, fact_id, rank, explored): the first k results, and for each query whose id `share` divides the least read deeper ones after them."""
    j = ranked.join(facts.select("fact_id", "access_count"), "fact_id")
    deep = j.where((F.col("rank") > k) & (F.pmod("query_id", F.lit(share)) == 0))
    order = Window.partitionBy("query_id").orderBy("access_count", "rank")
    more = deep.withColumn("n", F.row_number().over(order)).where(F.col("n") <= extra)
    top = j.where(F.col("rank") <= k).select("query_id", "fact_id", F.col("rank").cast("int").alias("rank"), F.lit(False).alias("explored"))
    return top.union(more.select("query_id", "fact_id", (k + F.col("n")).cast("int"), F.lit(True)))


def resolve_conflicts(new: DataFrame, facts: DataFrame, factor: float = 0.5) -> DataFrame:
    """(fact_id, gated_by, importance): older live facts that share an exact entity with a new fact of the same or no user.

    Both are (fact_id, kind, user_id, importance, topic, lang, ...); an old fact is gated by its smallest new fact, once. New
    facts are reduced to the two smallest of each (type, value, user) first, so a hot entity joins as two rows per user.
    """

    def entities(df: DataFrame) -> DataFrame:
        both = [F.struct(F.lit(k).alias("type"), F.col(k).alias("value")) for k in ("topic", "lang")]
        return df.select("fact_id", "user_id", "importance", F.inline(F.array(*both))).where("value IS NOT NULL")

    n = entities(new.where(F.col("kind").isin(UPDATE_KINDS)))
    o = entities(facts.where(F.col("kind").isin(GATED_KINDS) & ~F.col("tombstoned") & F.col("ended_days").isNull()))

    def two(keys: list[str]) -> DataFrame:
        # the two smallest ids by two aggregations, so that no group is collected
        one = n.groupBy(*keys).agg(F.min("fact_id").alias("first"))
        rest = n.join(one, keys).where("fact_id > first").groupBy(*keys).agg(F.min("fact_id").alias("second"))
        return one.join(rest, keys, "left")

    mine = o.where("user_id IS NOT NULL").join(two(["type", "value", "user_id"]), ["type", "value", "user_id"])
    free = o.where("user_id IS NULL").join(two(["type", "value"]), ["type", "value"])
    both = mine.select("fact_id", "importance", "first", "second").union(free.select("fact_id", "importance", "first", "second"))
    by = F.when(F.col("first") != F.col("fact_id"), F.col("first")).otherwise(F.col("second"))
    hit = both.withColumn("by", by).where("by IS NOT NULL").groupBy("fact_id").agg(F.min("by").alias("gated_by"), F.first("importance").alias("i"))
    return hit.select("fact_id", "gated_by", F.round(F.col("i") * factor, 4).alias("importance"))


def stagnation(sweeps: DataFrame, dims: list[str], window: int = 5, least: int = 4) -> DataFrame:
    """(dim, value, runs, stagnant): the value that dominates most of the newest runs in each dimension of sweeps(run, ...).

    A run's dominant value is its most frequent one, ties by the smaller value; a null value does not count.
    """
    newest = sweeps.select("run").distinct().orderBy(F.desc("run")).limit(window)
    long = sweeps.join(F.broadcast(newest), "run").select("run", F.inline(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in dims]))).where("value IS NOT NULL")
    counts = long.groupBy("run", "dim", "value").agg(F.count("*").alias("n"))

    def best(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "value"))).where("r = 1").drop("r")

    runs = best(counts, ["run", "dim"]).groupBy("dim", "value").agg(F.count("*").alias("n"))
    return best(runs, ["dim"]).select("dim", "value", F.col("n").alias("runs"), (F.col("n") >= least).alias("stagnant"))


def restore(log: DataFrame, schema: str) -> DataFrame:
    """(fact_id, versions, state): the newest readable old state of each fact in log(fact_id, version, old_state), as a struct."""
    state = F.from_json("old_state", schema)
    j = log.withColumn("state", F.when(F.col("old_state").startswith("{"), state))
    return j.groupBy("fact_id").agg(F.count("*").alias("versions"), F.max_by("state", F.when(F.col("state").isNotNull(), F.col("version"))).alias("state"))


def _shown(text: Column) -> dict[str, Column]:
    return {n: text.rlike(p) | text.contains("family") if n == "marker" else text.rlike(p) for n, p in SOUGHT.items()}


def signals(text: Column) -> Column:
    """Names of the signals of private speech that a text shows; plural pronouns count only beside a personal marker or travel."""
    has = _shown(text)
    shown = [has["singular"], has["plural"] & (has["marker"] | has["travel"]), has["emotion"], has["contact"]]
    return F.array_compact(F.array(*[F.when(c, n) for c, n in zip(shown, ["singular", "plural", "emotion", "contact"])]))


def speaks(text: Column) -> Column:
    """Whether a text shows a signal of private speech other than a contact."""
    has = _shown(text)
    return has["singular"] | (has["plural"] & (has["marker"] | has["travel"])) | has["emotion"]


def metadata_entities(parents: Column, keywords: Column, topic: Column, text: Column, most: int = 32) -> Column:
    """Distinct prefixed entities of metadata; where there are none, up to 12 capitalised words of the text."""
    meta = F.concat(
        F.transform(F.coalesce(parents, F.array().cast("array<bigint>")), lambda p: F.concat(F.lit("evidence:"), p.cast("string"))),
        F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.concat(F.lit("keyword:"), k)),
        F.array_compact(F.array(F.when(topic != "", F.concat(F.lit("topic:"), topic)))),
    )
    caps = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z][a-zA-Z]{2,}"), F.lit(0))
    words = F.transform(F.slice(caps, 1, 12), lambda w: F.concat(F.lit("keyword:"), F.lower(w)))
    return F.slice(F.array_distinct(F.when(F.size(meta) > 0, meta).otherwise(words)), 1, most)


def reflection_summary(facts: DataFrame, days: int = 30, n: int = 10) -> DataFrame:
    """(part, name, n, importance): recent live facts by kind and topic and their n most frequent words by facts; one table."""
    f = facts.where(~F.col("tombstoned") & (F.col("age_days") <= days))
    by = [F.struct(F.lit(p).alias("part"), F.col(c).alias("name")) for p, c in (("kind", "kind"), ("topic", "topic"))]
    groups = f.select("importance", F.inline(F.array(*by))).where("name IS NOT NULL").groupBy("part", "name").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("importance"))
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))
    hot = f.select("importance", F.explode(found).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("importance"))
    return groups.unionByName(hot.orderBy(F.desc("n"), "name").limit(n).withColumn("part", F.lit("word")))


def tier_audit(facts: DataFrame) -> DataFrame:
    """(part, name, n): live facts by tier, visibility and kind, and the private signals that public texts show."""
    f = facts.where(~F.col("tombstoned"))
    by = [F.struct(F.lit(c).alias("part"), F.coalesce(c, F.lit("null")).alias("name")) for c in ("tier", "visibility", "kind")]
    leak = F.when(F.col("tier") == "public", F.transform(signals(F.col("content")), lambda s: F.struct(F.lit("leak").alias("part"), s.alias("name"))))
    rows = f.select(F.inline(F.concat(F.array(*by), F.coalesce(leak, F.array().cast("array<struct<part:string,name:string>>")))))
    return rows.groupBy("part", "name").agg(F.count("*").alias("n"))


def signal_matrix(labelled: DataFrame) -> DataFrame:
    """(signal, leaks, false_blocks, caught): per signal and for any, the private texts missed, clean ones hit and private ones hit.

    labelled(text, private). A signal's share in one scan of the texts; null texts show no signal.
    """
    names = ["singular", "plural", "emotion", "contact"]
    seen = labelled.select("private", F.coalesce(signals(F.col("text")), F.array().cast("array<string>")).alias("s"))
    flags = [F.struct(F.lit(n).alias("signal"), F.array_contains("s", n).alias("hit")) for n in names] + [F.struct(F.lit("any").alias("signal"), (F.size("s") > 0).alias("hit"))]
    rows = seen.select("private", F.inline(F.array(*flags)))

    p, h = F.col("private"), F.col("hit")
    return rows.groupBy("signal").agg(F.count_if(p & ~h).alias("leaks"), F.count_if(~p & h).alias("false_blocks"), F.count_if(p & h).alias("caught"))


def usage_rate(results: DataFrame, expected: DataFrame, facts: DataFrame, cite: int = 5, shortest: int = 24) -> DataFrame:
    """(queries, found, cited, usable, gap): how often evidence is retrieved, is in the first results, and its first hit can be used.

    A hit contains any expected keyword; usable: at least 24 characters, not ended, live. gap is the found share that is not usable, in percent.
    """
    t = facts.select("fact_id", F.lower("content").alias("low"), (F.col("ended_days").isNull() & ~F.col("tombstoned") & (F.length(F.trim("content")) >= shortest)).alias("ok"))
    j = results.join(expected, "query_id").join(t, "fact_id").where(F.exists("keywords", lambda w: F.contains(F.col("low"), w)))
    first = j.groupBy("query_id").agg(F.min("rank").alias("r"), F.min_by("ok", "rank").alias("ok"))
    every = expected.select("query_id").join(first, "query_id", "left")
    n, found, usable = F.count("*"), F.count("r"), F.count_if(F.coalesce("ok", F.lit(False)))
    gap = F.round(F.when(found > 0, 100.0 * (found - usable) / found).otherwise(0.0), 4)
    return every.agg(n.alias("queries"), found.alias("found"), F.count_if(F.col("r") <= cite).alias("cited"), usable.alias("usable"), gap.alias("gap"))


def snapshot_ratchet(runs: DataFrame, least: float = 0.005, window: int = 3) -> DataFrame:
    """(variant, run, median, snapshot) over runs(variant, run, score): the snapshot rises to the median of the last runs if that is at least `least` above it, never falls.

    Rows stream in order of variant and run; a task holds one number.
    """
    order = Window.partitionBy("variant").orderBy("run")
    last = F.sort_array(F.collect_list("score").over(order.rowsBetween(1 - window, 0)))
    med = F.element_at(last, (F.floor(F.size(last) / 2) + 1).cast("int"))
    rows = runs.select("variant", "run", med.cast("double").alias("median"))
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        variant, high = None, None
        for b in batches:
            out = []
            for v, m in zip(b["variant"].tolist(), b["median"].tolist()):
                if v != variant or high is None:
                    variant, high = v, m
                elif m >= high + least:
                    high = m
                out.append(high)
            yield b.assign(snapshot=np.array(out, dtype=float))

    dealt = rows.repartition(shuffle_partitions(runs.sparkSession), "variant").sortWithinPartitions("variant", "run")
    risen = dealt.mapInPandas(run, f"variant {kind['variant']}, run {kind['run']}, median double, snapshot double")
    return risen.select("variant", "run", F.round("median", 6).alias("median"), F.round("snapshot", 6).alias("snapshot"))


def build_holdout(facts: DataFrame, tuning: DataFrame, share: float = 0.5) -> DataFrame:
    """(fact_id, n_words, covered): live, important facts without noise or identity whose distinct words the tuning set covers by at most `share`.

    tuning(query). Words have four characters or more; covered words come by an equi join, a fact without words is no candidate.
    """
    token = F.lit("[a-z0-9_-]{4,}")
    known = tuning.select(F.explode(F.regexp_extract_all(F.lower("query"), token, F.lit(0))).alias("w")).distinct().withColumn("hit", F.lit(1))
    f = facts.where(~F.col("tombstoned") & (F.col("importance") >= 0.85) & ~F.col("kind").isin("lock_rule", "rule", "mental_model", "knowledge_page"))
    f = f.where(~F.col("content").rlike(r"^(cd |cp |powershell|python |git |mkdir |ls |cat )") & ~F.col("content").rlike(SIGNALS[-1][1]))
    toks = f.select("fact_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), token, F.lit(0)))).alias("w"))
    g = toks.join(known, "w", "left").groupBy("fact_id").agg(F.count("*").alias("n_words"), F.count("hit").alias("covered"))
    return g.where(F.col("covered") <= share * F.col("n_words"))

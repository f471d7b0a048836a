"""Source divergence audit: how the sources of each language differ in their words, in exact integer arithmetic.

Every language keeps the terms of enough of its documents. A group (lang, source) and the language as a whole give each kept
term a smoothed share in billionths; two shares p and q differ by f = floor((p - q)^2 / (p + q)). Pairs of sources are told
apart by f summed over all kept terms, a group by the terms it uses most beyond its language.

The leading terms come from dominance skybands: f grows with the group's count and falls with the language's, ties go to the
earlier term. So a term that k others match in all three (count in the group no lower, count in the language no higher,
earlier in UTF-8) is not among the first k. Partitions keep terms dominated by fewer than k others, whatever the formula
does between; the bands are merged and only they are ranked.

The sum over all kept terms of a pair needs no dense table: terms that both groups lack add the same f of the two lowest
shares, a term that one group has is counted through the histogram of that group's counts, and only terms that both have meet
in a join on the term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.runtime import bounded_batches, checkpoint

MIN_DOCS, TOP = 10, 10
#: Cells of counts, and rows of bands, that a task holds before it hands them on.
HELD_COUNTS, HELD_ROWS, RUN = 200_000, 100_000, 8192
SALTS = 16
BROADCAST_GROUPS = 100_000
#: ASCII letters fold to lower case, bytes of other characters stay, all else parts terms.
_FOLD = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, with A-Z alone in lower case."""
    return text.translate(_FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed over as many documents as fit in the bound."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            found = list(n)
            for at in range(0, len(found), RUN):
                some = found[at : at + RUN]
                same = lambda x: pa.array([x] * len(some), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [same(lang), same(source), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            words = terms(text)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > HELD_COUNTS:
                yield from flush()
                size = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences in each group, and documents of it that hold the term.

    All rows of a (lang, term) end in one partition, at most one for each group and map task.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total, first): counts of terms in at least min_docs documents of the language; first marks one row of each."""
    same = Window.partitionBy("lang", "term")
    found = counts.withColumns({"total": F.sum("n").over(same), "in_docs": F.sum("docs").over(same), "first": F.col("source") == F.min("source").over(same)})
    return found.where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "total", "first")


def share(count: str, mass: str) -> Column:
    """1 + floor(10^9 (count + 2) / mass), exactly: a long division by steps of 1000 that stays in 64 bits up to a mass of 9 * 10^15."""
    rest, value = f"({count} + 2)", "1"
    for step in (1_000_000, 1000, 1):
        value = f"{value} + ({rest} * 1000 div {mass}) * {step}"
        rest = f"({rest} * 1000 % {mass})"
    return F.expr(value)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of positive shares, exactly."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def skyband(gain: np.ndarray, cost: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows that fewer than k others dominate: gain no lower, cost no higher, name earlier.

    Dominance is transitive, so that a row with k dominators has k of them in the band: rows are swept by gain, cost and name
    and compared with the band so far.
    """
    place = np.empty(len(names), dtype=np.int64)
    place[np.argsort(names, kind="stable")] = np.arange(len(names))
    order = np.lexsort((place, cost, -gain))
    g, c = gain[order], cost[order]
    start = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    order = order[run < k]  # within equal counts only the first k names can be in the band
    costs, places, band, size = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64), [], 0
    for i in order.tolist():
        if size < k or np.count_nonzero((costs[:size] <= cost[i]) & (places[:size] < place[i])) < k:
            costs[size], places[size] = cost[i], place[i]
            band.append(i)
            size += 1
    return np.array(band, dtype=np.int64)


_BAND = "lang string, source string, term binary, n long, total long"


def _banded(k: int):
    """Narrow the rows of each group in a task to their skyband whenever HELD_ROWS have come together."""

    def narrow(held: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(held, ignore_index=True)
        gain, cost, names = whole["n"].to_numpy(), whole["total"].to_numpy(), whole["term"].to_numpy()
        groups = whole.groupby(["lang", "source"], sort=False).indices.values()
        return whole.iloc[np.concatenate([at[skyband(gain[at], cost[at], names[at], k)] for at in groups])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for b in batches:
            if len(b):
                held.append(b)
                rows += len(b)
            if rows > HELD_ROWS:
                held = [narrow(held)]
                rows = len(held[0])
                if rows > HELD_ROWS // 2:  # bands of very many groups: hand on what there is
                    yield held.pop()
                    rows = 0
        if held:
            yield narrow(held)

    return run


def leading_terms(cells: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the first terms of each group by f against its language, of those used beyond it.

    Two rounds of skybands, within the tasks that hold the counts and within SALTS parts of each group, go before the rank.
    """
    beyond = cells.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").cast("binary").alias("term"), "n", "total")
    band = beyond.mapInPandas(_banded(top), _BAND)
    band = band.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(SALTS))).mapInPandas(_banded(top), _BAND)
    band = band.withColumn("item", F.col("term").cast("string"))
    masses = cells.select("lang", "source", "mass", "lang_mass").distinct()
    scored = band.join(masses, ["lang", "source"]).withColumn("value", distance(share("n", "mass"), share("total", "lang_mass")))
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return scored.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top).select("lang", "source", "item", "value", "rank")


def source_pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language by f summed over all kept terms.

    Each pair of sources is an output row; the sum is the same in both directions and made once.
    """
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    one = groups.select("lang", F.col("source").alias("a"), F.col("low").alias("low_a"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("low").alias("low_b"))
    lows = distance(F.col("low_a"), F.col("low_b"))
    base = one.join(two, "lang").where("a < b").select("lang", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("v") * lows).alias("part"))
    # terms of one group, as if the other had none: a row for each different count
    counts = cells.groupBy("lang", F.col("source").alias("a"), "p", F.col("low").alias("low_a")).agg(F.count("*").alias("times"))
    single = counts.join(two, "lang").where("a <> b").select("lang", lo, hi, (F.col("times") * (distance(F.col("p"), F.col("low_b")) - lows)).alias("part"))
    # terms of both groups: put right what the two histograms said of them
    left = cells.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("low").alias("low_a"))
    right = cells.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("low").alias("low_b"))
    p_a, p_b, low_a, low_b = (F.col(c) for c in ("p_a", "p_b", "low_a", "low_b"))
    both = distance(p_a, p_b) - distance(p_a, low_b) - distance(low_a, p_b) + distance(low_a, low_b)
    shared = left.join(right, ["lang", "term"]).where("a < b").select("lang", F.col("a").alias("lo"), F.col("b").alias("hi"), both.alias("part"))
    sums = base.unionByName(single).unionByName(shared).groupBy("lang", "lo", "hi").agg(F.sum("part").alias("value"))
    ways = F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("source"), F.col("lo").alias("item")))
    rows = sums.select("lang", "value", F.explode(ways).alias("way")).select("lang", "way.source", "way.item", "value")
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(ordered)).select("lang", "source", "item", "value", "rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source, ...); further columns are not read.

    Part `pair` ranks the other sources of a language by divergence, part `term` the group's terms, first `top` only, that it
    uses beyond its language; values descending, then item by UTF-8. Null text, lang and source count as ''; repeated rows each
    count as a document; a text without terms makes its group occur; a language without kept terms has pair values 0 and no
    term rows; a source alone in its language has no pairs; texts of any length are counted whole; no rows give no rows.
    """
    kept = checkpoint(kept_terms(term_counts(docs), min_docs))
    seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    none = F.lit(0).cast("long")
    groups = seen.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("v", "lang_n", "group_n")])
    groups = groups.withColumns({"mass": F.col("group_n") + 2 * F.col("v"), "lang_mass": F.col("lang_n") + 2 * F.col("v")})
    groups = checkpoint(groups.withColumn("low", F.when(F.col("mass") > 0, share("0", "mass")).otherwise(F.lit(1).cast("long"))))
    known = groups.select("lang", "source", "mass", "lang_mass", "low")
    if groups.count() <= BROADCAST_GROUPS:
        known = F.broadcast(known)  # checked: at most 100,000 rows of two names and three numbers
    cells = checkpoint(kept.join(known, ["lang", "source"]).withColumns({"p": share("n", "mass"), "q": share("total", "lang_mass")}).drop("first"))
    pairs, leading = source_pairs(cells, groups), leading_terms(cells, top)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(leading.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tok AS (SELECT row_, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row_) AS docs FROM tok GROUP BY ALL),
lt AS (SELECT lang, term, sum(n)::BIGINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS lang_n FROM lt GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, lt.term, coalesce(c.n, 0) AS n, lt.total FROM g JOIN lt ON g.lang = lt.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = lt.term),
m AS (SELECT cell.*, sum(n) OVER (PARTITION BY cell.lang, source) + 2 * v AS mass, lang_n + 2 * v AS lang_mass FROM cell JOIN v ON cell.lang = v.lang),
s AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // mass)::BIGINT AS p, (1 + 1000000000::HUGEINT * (total + 2) // lang_mass)::BIGINT AS q FROM m),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM s WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM term)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""

"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate from its target share of the output. A uniform number hashed from the seed and
the document's id is inverted through the Poisson distribution of that mean, the document is repeated that often, and
the repetitions are dealt out and sorted by another hash: a global shuffle that any rerun reproduces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.runtime import checkpoint, shuffle_partitions

TEMPERATURE = 0.5
EPOCHS = 1.0
TERMS = 64
BROADCAST_TERMS = 640_000


def hashed_bits(*parts: Column) -> Column:
    """52 hashed bits as a long, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, max_rate: float | None = None) -> DataFrame:
    """(source, rate): mean repetitions so that sources share the output by weight.

    Weights default to size ** temperature (size: code points); explicit weights name sources, others get 0. The output
    is epochs times the input in size. max_rate, if given, is the most repetitions wanted of a source; what it takes from
    small sources goes to the others by weight, as far as they are under it too. Sums over sources are one-row aggregates.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        w = F.pow("size", F.lit(temperature))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        w = F.coalesce(table[F.col("source")], F.lit(0.0))
    weighed = checkpoint(sizes.withColumn("w", w))
    total = weighed.agg(F.sum("w").alias("w"), F.sum("size").alias("size")).first()
    if max_rate is None:
        rate = F.lit(epochs) * (F.col("w") / F.lit(total["w"])) * F.lit(total["size"]) / F.col("size") if total["w"] else F.lit(0.0)
        return weighed.select("source", F.coalesce(F.when(F.col("size") > 0, rate), F.lit(0.0)).alias("rate"))
    # scale the weight a size of the sources that are not cut until no further one is above the limit
    live = weighed.where("size > 0 AND w > 0").withColumn("dense", F.col("w") / F.col("size"))
    scale, cut = 0.0, None
    while True:
        over = F.lit(False) if cut is None else F.col("dense") >= cut
        s = live.agg(F.sum(F.when(over, F.col("size"))).alias("full"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if not s["w"]:
            break
        scale = max(0.0, epochs * total["size"] - max_rate * (s["full"] or 0.0)) / s["w"]
        least = live.where(~over & (F.col("dense") * scale > max_rate)).agg(F.min("dense").alias("d")).first()["d"]
        if least is None:
            break
        cut = least
    over = F.lit(False) if cut is None else F.col("dense") >= cut
    rate = live.select("source", F.when(over, float(max_rate)).otherwise(F.col("dense") * scale).alias("rate"))
    return weighed.select("source").join(rate, "source", "left").select("source", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def thresholds(rate: DataFrame) -> DataFrame:
    """(source, rate, cdf): the Poisson distribution function at 0, 1, ...; its terms, 64 at least, reach below 2^-52."""
    last = F.greatest(F.lit(TERMS - 1), F.ceil(F.col("rate") + 9 * F.sqrt("rate")).cast("int") + 40)
    terms = rate.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("rate") > 8, last).otherwise(TERMS - 1))))
    upto = Window.partitionBy("source").orderBy("k")
    ln_fact = F.sum(F.ln(F.greatest("k", F.lit(1)).cast("double"))).over(upto)
    terms = terms.withColumn("p", F.when(F.col("rate") > 0, F.exp(-F.col("rate") + F.col("k") * F.ln("rate") - ln_fact)).otherwise((F.col("k") == 0).cast("double")))
    terms = terms.withColumn("c", F.sum("p").over(upto))
    return terms.groupBy("source", "rate").agg(F.sort_array(F.collect_list("c")).alias("cdf"))


#: Columns that mix adds to those of docs.
ADDED = ("rate", "n_copies", "replica", "shuffle_key")


def _repeated(docs: DataFrame, seed: int, weights: dict[str, float] | None, temperature: float, epochs: float, max_rate: float | None) -> DataFrame:
    """(row_, rate, n_copies, replica, shuffle_key) in shuffled order: row_ holds all columns of docs untouched."""
    spark = docs.sparkSession
    table = checkpoint(thresholds(rates(docs, weights, temperature, epochs, max_rate)))
    if (table.agg(F.sum(F.size("cdf"))).first()[0] or 0) <= BROADCAST_TERMS:
        table = F.broadcast(table)  # checked: at most 640,000 numbers
    nameless = F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit(""))))
    whole = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("doc_id").cast("string"), nameless).alias("ident"), F.struct("*").alias("row_"))
    u = hashed_bits(F.lit(str(seed)), F.col("ident")) / F.lit(float(1 << 52))
    drawn = whole.join(table, "source").withColumn("u", u).withColumn("n_copies", F.size(F.filter("cdf", lambda c: c <= F.col("u")))).where("n_copies > 0")
    copies = drawn.select("row_", "rate", "n_copies", "ident", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("replica"))
    key = hashed_bits(F.lit(f"{seed}:order"), F.col("ident"), F.col("replica").cast("string"))
    # rows of one id share a key: the task that they come from spreads them
    keyed = copies.withColumn("shuffle_key", key).withColumn("from_", F.spark_partition_id())
    return keyed.repartition(shuffle_partitions(spark), "shuffle_key", "from_").sortWithinPartitions("shuffle_key", "ident", "replica").drop("ident", "from_")


def mix(docs: DataFrame, seed: int = 1, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, max_rate: float | None = None) -> DataFrame:
    """Repeat documents (doc_id, text, source, ...) to target weights and shuffle them globally.

    Adds rate, n_copies, replica (from 0) and shuffle_key; columns of docs with these names are left out (replicate keeps
    them). A null source counts as the source ''; null texts have size 0; rows with equal doc_id draw the
    same number, rows without one draw by their text; a document drawn 0 times is absent; very long texts move like any
    other; no rows give no rows.
    """
    out = _repeated(docs, seed, weights, temperature, epochs, max_rate)
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    return out.select(*[F.col("row_").getField(c).alias(c) for c in kept], *ADDED)


def replicate(docs: DataFrame, seed: int = 1, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, max_rate: float | None = None) -> DataFrame:
    """The same repeated and shuffled documents with the columns of docs alone, whatever their names."""
    return _repeated(docs, seed, weights, temperature, epochs, max_rate).select("row_.*")


ORACLE_SQL = """
WITH size AS (SELECT coalesce(source, '') AS source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY 1),
w AS (SELECT source, size, pow(size, 0.5) AS w FROM size),
rate AS (SELECT source, coalesce(CASE WHEN size > 0 THEN (1.0 * (w / sum(w) OVER ())) * sum(size) OVER () / size END, 0.0) AS rate FROM w),
k AS (SELECT source, rate, unnest(range(CASE WHEN rate > 8 THEN greatest(63, ceil(rate + 9 * sqrt(rate))::INT + 40) + 1 ELSE 64 END))::INT AS k FROM rate),
p AS (SELECT source, rate, k, CASE WHEN rate > 0 THEN exp(-rate + k * ln(rate) - sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k))
      ELSE (k = 0)::INT::DOUBLE END AS p FROM k),
c AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
i AS (SELECT *, row_number() OVER () AS row_, coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS ident FROM documents),
u AS (SELECT d.*, ('0x' || substr(md5('1|' || ident), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM i d),
n AS (SELECT u.row_, u.ident, u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*)::INT AS n_copies
      FROM u JOIN c ON coalesce(u.source, '') = c.source AND c.c <= u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, n_copies, r::INT AS replica,
       ('0x' || substr(md5('1:order|' || ident || '|' || r::VARCHAR), 1, 13))::BIGINT AS shuffle_key
FROM n, unnest(range(n_copies)) t(r)
"""

"""Meeting of a table with a smaller one: broadcasts of checked size, a stated set of queries, keywords inside texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.runtime import checkpoint, shuffle_partitions

BROADCAST_BYTES = 16 << 20
GRAM = 3


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, marked for broadcast only if the bytes of its values, counted now, are at most the bound (BROADCAST_BYTES).

    Strings count their bytes, arrays 16 a value and those of their strings, all else 16.
    """
    def weight(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "string":
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if kind == "array<string>":
            return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(16), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
        if kind.startswith("array"):
            return F.greatest(F.size(c), F.lit(0)) * 16 + 16
        return F.lit(16)

    total = F.lit(0)
    for name, kind in df.dtypes:
        total = total + weight(name, kind)
    return F.broadcast(df) if (df.agg(F.sum(total).alias("b")).first()["b"] or 0) <= (BROADCAST_BYTES if most is None else most) else df


def against(rows: DataFrame, queries: DataFrame, query_id: str) -> DataFrame:
    """Every row with every query of a stated set: a broadcast of checked size, else blocks.

    A larger query table is dealt into blocks by its id, as many as keep a block within the bound, and met through a keyed
    join, so that no side must fit in memory.
    """
    held = small(queries)
    if held is not queries:
        return rows.join(held, F.lit(True))
    blocks = 4 * shuffle_partitions(rows.sparkSession)
    left = rows.withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block_", F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int"))
    return left.join(right, "block_").drop("block_")


def containing(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(fact_id, keyword): which texts (fact_id, low) contain which keywords (keyword) as substrings; no pair is tried blindly.

    A keyword's longest run of letters and digits lies inside one word of any text that contains it. The distinct words of
    all texts meet these runs through a gram of theirs, words lead back to texts, and keywords that are more than their run are
    verified in the text. Keywords without such a run are a stated set of queries against all texts; empty ones match none.
    """
    runs = F.regexp_extract_all("keyword", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))), -1)["r"]
    asked = checkpoint(keywords.select("keyword").distinct().where("keyword <> ''").withColumn("run", F.when(F.size(runs) > 0, longest)))
    words = texts.select("fact_id", F.explode(F.array_distinct(F.split("low", r"[^\p{L}\p{N}]+"))).alias("word"))
    # grams of one to three characters: a run is probed by its first, a word shows all of its own
    starts = F.sequence(F.lit(1), F.length("word"))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("word") - i + 1)), lambda n: F.substr(F.col("word"), i, n))))
    vocabulary = words.select("word").where("word <> ''").distinct().select("word", F.explode(F.array_distinct(grams)).alias("gram"))
    probes = asked.where("run IS NOT NULL").select("keyword", "run", F.substring("run", 1, GRAM).alias("gram"))
    matched = vocabulary.join(small(probes), "gram").where(F.contains("word", "run")).select("word", "keyword", "run")
    hits = words.join(small(checkpoint(matched)), "word").select("fact_id", "keyword", "run").distinct()
    whole = hits.where("keyword = run").select("fact_id", "keyword")
    partial = hits.where("keyword <> run").select("fact_id", "keyword").join(texts.select("fact_id", "low"), "fact_id").where(F.contains("low", "keyword")).select("fact_id", "keyword")
    rest = asked.where("run IS NULL").select("keyword")
    out = whole.unionByName(partial.distinct())
    if not rest.isEmpty():
        out = out.unionByName(against(texts.select("fact_id", "low"), rest, "keyword").where(F.contains("low", "keyword")).select("fact_id", "keyword").distinct())
    return out

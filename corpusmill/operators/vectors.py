"""Vector retrieval over supplied embeddings: cosine search of a query table, centroids, two-level search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusmill.operators.components import stars
from corpusmill.operators.lexical import top_k
from corpusmill.operators.pairing import small
from corpusmill.plans.runtime import bounded_batches, checkpoint, shuffle_partitions

BROADCAST_BYTES = 16 << 20
BLOCK_ROWS = 4096
PAIR_ROWS = 2048
TILE_BYTES, LEAST_TILES = 4 << 20, 8
MAX_PIVOTS = 1024
SLACK = 2e-6
MEET_CELLS = 1 << 20


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_norm(df: DataFrame, v: str = "embedding") -> DataFrame:
    """Drop null and zero vectors and add their length as nrm."""
    return df.withColumn("nrm", norm(F.col(v))).where(F.col("nrm") > 0)


def unit(rows) -> np.ndarray:
    """Vectors as rows of a double matrix, each of length 1."""
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _chunks(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, least: float, best: int | None = None, tops: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """(query_id, fact_id, cosine) of unit vectors x named a against y named b, at most MEET_CELLS products at a time.

    With best, tops(len(a), best) holds the best cosines that each query met so far, ascending, and is kept up; pairs under a
    query's lowest by more than SLACK, and so by more than rounding, are left out.
    """
    step = max(1, MEET_CELLS // max(len(b), 1))
    for k in range(0, len(a), step):
        sims = x[k : k + step] @ y.T
        keep = (sims >= least) & (a[k : k + step, None] != b[None, :])
        if best is not None:
            both = np.concatenate([tops[k : k + step], np.where(keep, sims, -2.0)], axis=1)
            tops[k : k + step] = np.sort(np.partition(both, both.shape[1] - best, axis=1)[:, -best:], axis=1)
            keep &= sims >= tops[k : k + step, :1] - SLACK
        i, j = np.nonzero(keep)
        yield pd.DataFrame({"query_id": a[k + i], "fact_id": b[j], "cosine": sims[i, j]})


def _alike(rows: pd.DataFrame, name: str) -> dict:
    """Unit vectors and ids of rows (name, embedding, grp) by length and group: only these meet."""
    width = rows["embedding"].map(len)
    grp = rows["grp"] if "grp" in rows else pd.Series("", index=rows.index)
    return {k: (unit(g["embedding"]), g[name].to_numpy()) for k, g in rows.groupby([width, grp])} if len(rows) else {}


def _meet(q: pd.DataFrame, e: pd.DataFrame, least: float, best: int | None) -> pd.DataFrame:
    """(query_id, fact_id, cosine) of a block of queries and a block of vectors, for each length and group."""
    left, right, out = _alike(q, "query_id"), _alike(e, "fact_id"), []
    for k in left.keys() & right.keys():
        (x, a), (y, b) = left[k], right[k]
        out += _chunks(x, a, y, b, least, best, None if best is None else np.full((len(a), best), -2.0))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "fact_id": [], "cosine": []})


def cosine_scores(queries: DataFrame, emb: DataFrame, least: float = -2.0, best: int | None = None) -> DataFrame:
    """(query_id, fact_id, cosine): every query against every vector of its length, a query never meeting itself.

    queries(query_id, embedding), emb(fact_id, embedding), both with whole ids; null and zero vectors are left out. Where both
    have a column grp only rows of equal groups meet. Only pairs of at least the given cosine; with best, only pairs that can be
    among that many best of a query, also by cosines rounded to six digits. Queries up to BROADCAST_BYTES, measured, are held
    by every executor while vectors stream past; a larger query table is dealt into blocks that each meet all vectors, so that
    no side must fit in memory. Blocks are compared by matrix products of bounded size.
    """
    spark = emb.sparkSession
    bounded_batches(spark, BLOCK_ROWS)
    grp = [F.col("grp").cast("string").alias("grp")] if "grp" in queries.columns and "grp" in emb.columns else []
    q = with_norm(queries).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), *grp)
    e = with_norm(emb).select(F.col("fact_id").cast("long").alias("fact_id"), F.col("embedding").cast("array<double>").alias("embedding"), *grp)
    if grp:
        q, e = q.where("grp IS NOT NULL"), e.where("grp IS NOT NULL")
    size = q.agg(F.sum(F.size("embedding") * 8 + 16).alias("b"), F.count("*").alias("n")).first()
    schema = "query_id long, fact_id long, cosine double"
    if (size["b"] or 0) <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast(_alike(q.toPandas(), "query_id"))  # checked: at most 16 MB

        def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tops = {} if best is None else {k: np.full((len(a), best), -2.0) for k, (_, a) in held.value.items()}
            for rows in batches:
                for k, (y, b) in _alike(rows, "fact_id").items():
                    if k in held.value:
                        yield from _chunks(*held.value[k], y, b, least, best, tops.get(k))

        return e.mapInPandas(stream, schema)
    blocks = -(-size["b"] // BROADCAST_BYTES)
    slices = shuffle_partitions(spark)
    slices = max(slices, -(-e.count() // BLOCK_ROWS))
    left = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = e.withColumn("slice", F.pmod(F.xxhash64("fact_id"), F.lit(slices)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _meet(a, b, least, best) if len(a) and len(b) else pd.DataFrame({"query_id": [], "fact_id": [], "cosine": []})

    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInPandas(pair, schema)


def vector_topk(queries: DataFrame, emb: DataFrame, k: int, recency_weight: float = 0.2, half_life: float = 30.0) -> DataFrame:
    """Top k by (1 - w) cosine + w 0.5^(age / half_life) among the max(4k, 32) nearest; emb also has age_days."""
    pool = max(4 * k, 32)
    near = top_k(cosine_scores(queries, emb, best=pool), pool, item="fact_id", score="cosine").drop("rank")
    blended = near.join(emb.select("fact_id", "age_days"), "fact_id")
    score = (1 - recency_weight) * F.col("cosine") + recency_weight * F.pow(F.lit(0.5), F.col("age_days") / half_life)
    return top_k(blended.select("query_id", "fact_id", F.round(score, 6).alias("score")), k, item="fact_id")


def centroids(emb: DataFrame, key: str) -> DataFrame:
    """(key, members, centroid): mean of unit-free vectors, normalised, for keys with two members or more."""
    sizes = emb.groupBy(key).agg(F.count("*").alias("members")).where("members >= 2")
    parts = emb.select(key, F.posexplode("embedding").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("m"))
    rows = parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    return rows.join(sizes, key).select(key, "members", F.transform("v", lambda x: x / norm(F.col("v"))).alias("centroid"))


def two_level_topk(queries: DataFrame, emb: DataFrame, key: str, l1: int = 3, l2: int = 10) -> DataFrame:
    """(query_id, fact_id, score, rank): the l2 nearest vectors inside each query's l1 nearest clusters.

    Queries meet the clusters' centroids; then each cluster's queries, in blocks, meet its vectors, dealt into slices, and no
    others. A vector whose cluster has one member only is in no cluster.
    """
    c = centroids(emb, key).select(F.col(key).cast("long").alias("fact_id"), F.col("centroid").alias("embedding"))
    q = queries.select((-1 - F.col("query_id")).alias("query_id"), "embedding")  # never the number of a cluster
    near = top_k(cosine_scores(q, c, best=l1), l1, item="fact_id", score="cosine")
    near = checkpoint(near.select((-1 - F.col("query_id")).alias("query_id"), F.col("fact_id").alias("cluster")))
    asked = near.join(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "query_id")
    sizes = checkpoint(emb.groupBy(F.col(key).cast("long").alias("cluster")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("slices")))
    blocks = near.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    cut = checkpoint(sizes.join(blocks, "cluster"))
    left = asked.join(cut, "cluster").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    members = with_norm(emb).select("fact_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col(key).cast("long").alias("cluster"))
    right = members.join(cut, "cluster").withColumn("slice", F.pmod(F.xxhash64("fact_id"), F.col("slices")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("cluster", "block", "slice", "query_id", "embedding").toDF("cluster", "block", "slice", "query_id", "embedding")
    right = right.select("cluster", "block", "slice", "fact_id", "embedding").toDF("cluster", "block", "slice", "fact_id", "embedding")

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _meet(a, b, -2.0, l2) if len(a) and len(b) else pd.DataFrame({"query_id": [], "fact_id": [], "cosine": []})

    keys = ["cluster", "block", "slice"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "query_id long, fact_id long, cosine double")
    return top_k(scored.select("query_id", "fact_id", F.round("cosine", 6).alias("score")), l2, item="fact_id")


def _cells(e: DataFrame, n: int) -> DataFrame:
    """(fact_id, embedding, block): rows by their nearest pivot, cells of more than PAIR_ROWS rows cut at random.

    Pivots are rows by hash, about one for each half block and MAX_PIVOTS at most; they shape the blocks and nothing else.
    """
    spark = e.sparkSession
    wanted = min(MAX_PIVOTS, -(-2 * n // PAIR_ROWS))
    drawn = e.where(F.pmod(F.xxhash64("fact_id", F.lit("pivot")), F.lit(1 << 20)) < F.lit(2.0 * wanted / max(n, 1) * (1 << 20))).limit(4 * wanted).toPandas()
    pivots = {d: (k, unit(rows["embedding"])) for k, (d, rows) in enumerate(drawn.groupby(drawn["embedding"].map(len)))} if len(drawn) else {}
    held = spark.sparkContext.broadcast(pivots)  # bounded: at most 4 MAX_PIVOTS vectors

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, width = np.zeros(len(b), dtype=np.int64), b["embedding"].map(len).to_numpy()
            for d in np.unique(width):
                at = np.flatnonzero(width == d)
                near = 0
                if d in held.value:
                    near = (unit(b["embedding"].iloc[at]) @ held.value[d][1].T).argmax(axis=1)
                cell[at] = d * 8 * MAX_PIVOTS + near
            yield b.assign(cell=cell)

    placed = checkpoint(e.mapInPandas(place, f"fact_id long, embedding {e.schema['embedding'].dataType.simpleString()}, cell long"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("slices"))
    rows = placed.join(small(checkpoint(sizes)), "cell")
    return checkpoint(rows.select("fact_id", "embedding", F.xxhash64("cell", F.pmod(F.xxhash64("fact_id"), F.col("slices"))).alias("block")))


def _near_blocks(blocks: DataFrame, angle: float) -> DataFrame:
    """(i, j), i <= j: pairs of blocks (block, d, center, radius) whose balls come within the angle of each other, each once.

    By the triangle inequality on the sphere no vector of one block is nearer to one of the other than the centres' angle less
    both radii.
    """
    n = max(1, -(-blocks.count() // PAIR_ROWS))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = blocks.withColumn("own", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")).withColumn("other", other)
    dealt = dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})

    def meet(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        x = b[b["own"] == key[0]]
        y = x if key[0] == key[1] else b[b["own"] == key[1]]
        out = []
        for d in np.intersect1d(x["d"].unique(), y["d"].unique()):
            u, v = x[x["d"] == d], y[y["d"] == d]
            apart = np.arccos(np.clip(unit(u["center"]) @ unit(v["center"]).T, -1, 1)) - u["radius"].to_numpy()[:, None] - v["radius"].to_numpy()[None, :]
            r, c = np.nonzero(apart <= angle)
            out.append(np.stack([u["block"].to_numpy()[r], v["block"].to_numpy()[c]], axis=1))
        ids = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
        if key[0] == key[1]:
            ids = ids[ids[:, 0] <= ids[:, 1]]
        return pd.DataFrame(np.sort(ids, axis=1), columns=["i", "j"])

    return dealt.groupBy("p", "q").applyInPandas(meet, "i long, j long")


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean direction of unit vectors, and the largest angle of one to it."""
    mean = x.mean(axis=0)
    center = x[0] if np.linalg.norm(mean) < 1e-9 else mean / np.linalg.norm(mean)
    return center, float(np.arccos(np.clip(x @ center, -1, 1)).max()) + SLACK


def _balls(rows: DataFrame) -> DataFrame:
    """(block, d, center, radius) of placed rows: a block's mean direction, and the largest angle of a row to it."""
    def ball(b: pd.DataFrame) -> pd.DataFrame:
        x = unit(b["embedding"])
        center, radius = _ball(x)
        return pd.DataFrame({"block": b["block"].iloc[:1], "d": [x.shape[1]], "center": [center], "radius": [radius]})

    return checkpoint(rows.groupBy("block").applyInPandas(ball, "block long, d int, center array<double>, radius double"))


def _compared(emb: DataFrame, threshold: float, links: bool) -> DataFrame:
    """(a, b, cosine) of all pairs from a little under the threshold on; with links, only (a, b) that connect what they connect.

    Blocks lie in tiles of bounded bytes; two tiles with blocks whose balls come within the threshold's angle meet in one task,
    which compares such blocks only. A vector is sent once for each tile, not for each block, that it may meet.
    """
    kind = "array<float>" if emb.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    e = with_norm(emb).select(F.col("fact_id").cast("long").alias("fact_id"), F.col("embedding").cast(kind).alias("embedding"))
    size = e.agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 8).alias("b")).first()
    rows = _cells(e, size["n"])
    angle = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK
    tiles = max(-(-(size["b"] or 0) // TILE_BYTES), min(LEAST_TILES, -(-size["n"] // PAIR_ROWS)), 1)
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles)).cast("int")
    met = _near_blocks(_balls(rows), angle).select(F.least(tile("i"), tile("j")).alias("p"), F.greatest(tile("i"), tile("j")).alias("q"))
    met = small(checkpoint(met.distinct()))
    placed = rows.withColumn("own", tile("block"))
    columns = ["p", "q", "own", "block", "fact_id", "embedding"]
    first = placed.join(met, F.col("own") == F.col("p")).select(columns)
    second = placed.join(met.where("p < q"), F.col("own") == F.col("q")).select(columns)

    def pair(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], [(np.zeros((0, 2), np.int64), np.zeros(0))]
        for (width, own, _), g in b.groupby([b["embedding"].map(len), "own", "block"]):
            x = unit(g["embedding"])
            kept.append((width, own, x, g["fact_id"].to_numpy(), *_ball(x)))
        for k, (width, own, x, a, center, radius) in enumerate(kept):
            for other, (w, o, y, c, middle, reach) in enumerate(kept[k:], k):
                if w != width or (o == own) != (key[0] == key[1]) or np.arccos(np.clip(center @ middle, -1, 1)) - radius - reach > angle:
                    continue
                for f in _chunks(x, a, y, c, threshold - 1e-9):
                    f = f[f["query_id"] < f["fact_id"]] if other == k else f
                    if links:
                        f = f[np.round(f["cosine"], 9) >= threshold]
                        u, v = stars(f["query_id"].to_numpy(), f["fact_id"].to_numpy())
                        out.append((np.stack([v, u], axis=1), np.zeros(len(u))))
                    else:
                        out.append((np.sort(f[["query_id", "fact_id"]].to_numpy(np.int64), axis=1), f["cosine"].to_numpy()))
        ids, cosine = (np.concatenate(c) for c in zip(*out))
        if links:
            u, v = stars(ids[:, 0], ids[:, 1])
            return pd.DataFrame({"a": v, "b": u})
        return pd.DataFrame({"a": ids[:, 0], "b": ids[:, 1], "cosine": cosine})

    return first.unionByName(second).groupBy("p", "q").applyInPandas(pair, "a long, b long" + ("" if links else ", cosine double"))


def cosine_pairs(emb: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine) with a < b for all pairs at or above the threshold, exactly; null and zero vectors pair with nothing.

    Vectors lie in blocks about pivots, each block in a ball; only pairs of blocks whose balls come within the threshold's angle
    are compared, by matrix products. How many that are depends on the data: hardly any are left out at thresholds under 0.5,
    where pairs are frequent themselves; of tight groups nearly all are at 0.9.
    """
    found = _compared(emb, threshold, False)
    return found.where(F.round("cosine", 9) >= threshold).select("a", "b", F.round("cosine", 6).alias("cosine"))


def cosine_links(emb: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b that connect the same vectors as cosine_pairs: at most one for each vector of the tiles that meet."""
    return _compared(emb, threshold, True)


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, rank)."""
    every = lists[0].select("query_id", "doc_id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("query_id", "doc_id", "rank"))
    return every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def min_max(scored: DataFrame, score: str) -> DataFrame:
    """Divide by the query's largest absolute score."""
    top = F.max(F.abs(score)).over(Window.partitionBy("query_id"))
    return scored.withColumn(score, F.when(top > 0, F.abs(score) / top).otherwise(0.0))

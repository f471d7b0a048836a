"""Walks along links between facts, upward to ancestors or downward to what was derived, with how each walk ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.runtime import checkpoint, opaque

ANCESTORS, DESCENDANTS, DEPTH = 64, 256, 8


def walk(links: DataFrame, nodes: DataFrame, seeds: DataFrame, most: int, max_depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(found(seed, node, depth), ends(seed, n, depth, chain_broken, truncated)) of walks over links(source, target).

    Breadth first, a node at its smallest depth, a cycle walked once. chain_broken: a link leads to what is not in
    nodes(node), or a node at max_depth has links. truncated: there is more than `most`; then the first by depth and node are kept,
    and what lies beyond the level where that shows is not looked at. A seed that is no node has no walk of its own but a row
    in ends, with its links broken or not; null seeds and links with a null end are left out. One level is one join for all
    seeds, and of a level no seed carries on more than most + 1 nodes.
    """
    links = links.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()
    links = opaque(links.join(nodes.select(F.col("node").alias("target")).distinct().withColumn("there", F.lit(True)), "target", "left"))
    front = checkpoint(seeds.where("seed IS NOT NULL").select("seed", F.col("seed").alias("node")).distinct())
    started, seen, broken = front.select("seed"), front.withColumn("depth", F.lit(0)), front.select("seed").limit(0)
    for depth in range(1, max_depth + 1):
        step = checkpoint(front.join(links, F.col("node") == F.col("source")).select("seed", F.col("target").alias("node"), "there").distinct())
        broken = checkpoint(broken.union(step.where("there IS NULL").select("seed")).distinct())
        new = step.where("there").select("seed", "node").join(seen, ["seed", "node"], "left_anti")
        order = Window.partitionBy("seed").orderBy("node")
        new = checkpoint(new.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most + 1).drop("r"))
        if new.isEmpty():
            front = new
            break
        seen = checkpoint(seen.unionByName(new.withColumn("depth", F.lit(depth))))
        full = seen.where("depth > 0").groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > most).select("seed")
        front = checkpoint(new.join(full, "seed", "left_anti"))
    broken = broken.union(front.join(links, F.col("node") == F.col("source"), "left_semi").select("seed")).distinct()
    reached = seen.where("depth > 0")
    ranked = reached.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))).where(F.col("r") <= most + 1)
    found = ranked.where(F.col("r") <= most).select("seed", "node", "depth")
    per = ranked.groupBy("seed").agg(F.count_if(F.col("r") <= most).alias("n"), F.max(F.when(F.col("r") <= most, F.col("depth"))).alias("depth"), F.bool_or(F.col("r") > most).alias("truncated"))
    ends = started.join(per, "seed", "left").join(broken.withColumn("chain_broken", F.lit(True)), "seed", "left")
    none = F.lit(0)
    return found, ends.select("seed", F.coalesce("n", none.cast("long")).alias("n"), F.coalesce("depth", none).alias("depth"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("chain_broken", "truncated")])


def provenance(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ancestors over edges(child, parent): at most 64 of a seed, up to depth 8."""
    return walk(edges.select(F.col("child").alias("source"), F.col("parent").alias("target")), nodes, seeds, ANCESTORS)


def lineage(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Descendants over edges(child, parent): at most 256 of a seed, up to depth 8."""
    return walk(edges.select(F.col("parent").alias("source"), F.col("child").alias("target")), nodes, seeds, DESCENDANTS)

"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid out in tiles by the population counts of their four quarters (eight parts for very many).
If two fingerprints differ in r bits, the counts of their parts differ by r in sum at most, so a tile is compared only with
tiles within that distance and all other pairs of tiles are skipped without loss. Inside a pair of tiles numpy compares
all pairs by exclusive-or and bit counts. Large tiles are cut into sub-tiles, whose members are held while the probes of
other tiles stream past; every task hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.components import connected_components
from corpusmill.plans.runtime import bounded_batches, checkpoint, free_names, shuffle_partitions

SEED = 42
SUB_TILE = 4096
PAIRS = 1 << 20
EIGHT_FROM = 50_000_000
BROADCAST_TILES = 250_000


def simhash(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over word shingles with repeats, as a signed integer; a text without words has 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens) - words + 1
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if n <= 1:
        spans = [joined]
        n = 1
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        spans = [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist())]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        part = spans[k : k + (1 << 16)]
        h = np.fromiter((digest(s, SEED) for s in part), np.uint64, len(part))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column) -> Column:
    """SimHash of each text as a long."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([simhash(t) for t in s], dtype="int64")

    return run(text)


def tile_of(fp: Column, parts: int) -> Column:
    """Tile number from the population counts of equal parts of the fingerprint."""
    bits = 64 // parts
    out = F.lit(0)
    for k in reversed(range(parts)):
        out = out * (bits + 1) + F.bit_count(F.shiftrightunsigned(fp, bits * k).bitwiseAND(F.lit((1 << bits) - 1)))
    return out.cast("int")


def _offsets(radius: int, parts: int) -> list[tuple[int, ...]]:
    """Differences of part counts within the radius, towards the tile itself and later tiles only."""
    steps: list[tuple[int, ...]] = [()]
    for _ in range(parts):
        steps = [(*d, x) for d in steps for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    return [d for d in steps if d[::-1] >= (0,) * parts]


def _targets(tile: Column, radius: int, parts: int) -> Column:
    """Tiles at which a fingerprint of this tile must be compared, each pair of tiles once."""
    base = 64 // parts + 1
    counts = [F.floor(tile / (base**k)).cast("int") % base for k in range(parts)]
    cells = []
    for d in _offsets(radius, parts):
        inside = [(c + x).between(0, base - 1) for c, x in zip(counts, d) if x]
        cell = tile + F.lit(sum(x * base**k for k, x in enumerate(d)))
        cells.append(F.when(reduce(and_, inside), cell) if inside else cell)
    return F.array_compact(F.array(*cells))


class Forest:
    """Union-find over positions, path halving."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def join(self, a: int, b: int) -> bool:
        p = self.parent
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        while p[b] != b:
            p[b] = p[p[b]]
            b = p[b]
        if a == b:
            return False
        p[max(a, b)] = min(a, b)
        return True


class Tile:
    """The members of one sub-tile, and the probes that stream past them."""

    def __init__(self, radius: int):
        self.radius, self.parts, self.fp, self.forest = radius, [], None, None

    def add(self, fp: np.ndarray) -> None:
        self.parts.append(fp)

    def close(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links among the members, once all have come."""
        self.fp = np.concatenate(self.parts)
        self.parts, self.forest = [], Forest(len(self.fp))
        return self._links(self.fp, True)

    def probe(self, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links of probes to members; only members of different trees so far are linked again."""
        return self._links(fp, False)

    def _links(self, fp: np.ndarray, own: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        out, rows = [], max(1, PAIRS // max(len(self.fp), 1))
        for k in range(0, len(fp), rows):
            part = fp[k : k + rows]
            a, b = np.nonzero(np.bitwise_count(part[:, None] ^ self.fp[None, :]) <= self.radius)
            if own:
                a = a + k
                keep = b < a
                a, b = a[keep], b[keep]
                joined = [self.forest.join(x, y) for x, y in zip(a.tolist(), b.tolist())]
                out.append((fp[a[joined]], fp[b[joined]]))
            elif len(a):
                first = np.r_[True, a[1:] != a[:-1]]
                lead = b[np.flatnonzero(first)[np.cumsum(first) - 1]]
                again = [f or self.forest.join(x, y) for f, x, y in zip(first.tolist(), lead.tolist(), b.tolist())]
                out.append((part[a[again]], self.fp[b[again]]))
        return out


def links(fps: DataFrame, radius: int = 2, parts: int | None = None) -> DataFrame:
    """Edges (a, b) over distinct fingerprints fp (long) that span their link graph.

    parts is the number of equal parts whose population counts make a tile, 4 or 8: 4 send a fingerprint to 21 tiles, of
    which 1.6 % of all pairs are compared; 8 to 73 tiles and 0.02 %. By default 8 beyond EIGHT_FROM fingerprints. Either
    way no link is lost.
    """
    spark = fps.sparkSession
    parts = parts or (8 if fps.count() > EIGHT_FROM else 4)
    tiles = fps.select("fp", tile_of(F.col("fp"), parts).alias("tile"))
    # tiles of one sub-tile need no entry: at most one row for every SUB_TILE fingerprints
    sizes = tiles.groupBy("tile").agg(F.ceil(F.count("*") / SUB_TILE).cast("int").alias("subs")).where("subs > 1")
    sizes = checkpoint(sizes)
    if sizes.count() <= BROADCAST_TILES:
        sizes = F.broadcast(sizes)  # checked: two integers each
    own = tiles.join(sizes, "tile", "left").select("fp", "tile", F.coalesce("subs", F.lit(1)).alias("subs"))
    own = own.withColumn("sub", F.pmod(F.xxhash64("fp", F.lit("sub")), F.col("subs")).cast("int")).drop("subs")
    members = own.select("tile", "sub", F.lit(0).alias("role"), "fp")
    probes = (
        own.select(F.explode(_targets(F.col("tile"), radius, parts)).alias("to"), "tile", "sub", "fp")
        .join(sizes.select(F.col("tile").alias("to"), "subs"), "to", "left")
        .withColumn("to_sub", F.explode(F.sequence(F.lit(0), F.coalesce("subs", F.lit(1)) - 1)))
        .where((F.col("to") != F.col("tile")) | (F.col("to_sub") > F.col("sub")))
        .select(F.col("to").alias("tile"), F.col("to_sub").alias("sub"), F.lit(1).alias("role"), "fp")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tile = None, None
        for b in batches:
            if not len(b):
                continue
            code = (b["tile"].to_numpy(np.int64) << 32 | b["sub"].to_numpy(np.int64)) << 1 | b["role"].to_numpy(np.int64)
            fp = b["fp"].to_numpy().view(np.uint64)
            edges: list[tuple[np.ndarray, np.ndarray]] = []
            cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
            for x, y in zip(cuts[:-1], cuts[1:]):
                at, role = divmod(int(code[x]), 2)
                if at != key:
                    if tile is not None and tile.fp is None:
                        edges += tile.close()
                    key, tile = at, None if role else Tile(radius)
                if tile is None:  # no member here
                    continue
                if role:
                    if tile.fp is None:
                        edges += tile.close()
                    edges += tile.probe(fp[x:y])
                else:
                    tile.add(fp[x:y])
            for a, c in edges:
                if len(a):
                    yield pd.DataFrame({"a": a.view(np.int64), "b": c.view(np.int64)})
        if tile is not None and tile.fp is None:
            for a, c in tile.close():
                if len(a):
                    yield pd.DataFrame({"a": a.view(np.int64), "b": c.view(np.int64)})

    dealt = members.union(probes).repartition(shuffle_partitions(spark), "tile", "sub").sortWithinPartitions("tile", "sub", "role")
    return dealt.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 2) -> DataFrame:
    """Return (doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id reachable by links of at most radius differing bits. Null and empty texts have
    fingerprint 0 and are linked like any other; very long texts are fingerprinted whole; repeated rows get the same class; a
    row with a null doc_id joins a class but never names one unless all its class is null, whose component_id is then null.
    No rows give no rows. Only the two named columns of docs are read.
    """
    return _classes(docs, text, doc_id, radius).select("doc_id", "fp", "component_id")


def _classes(docs: DataFrame, text: str, doc_id: str, radius: int) -> DataFrame:
    """(doc_id, fp, component_id, c) of every row; c is the smallest fingerprint of the class."""
    bounded_batches(docs.sparkSession)
    prints = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    fps = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    component = connected_components(links(fps.select("fp"), radius))
    classes = fps.join(component, fps["fp"] == component["id"], "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    lows = classes.groupBy("c").agg(F.min("low").alias("component_id"))
    named = classes.join(lows, "c").select("fp", "c", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "c")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 2) -> DataFrame:
    """Keep one row of each near-duplicate class: that with the smallest doc_id (of repeated rows, one).

    Rows with a null doc_id are kept only if their whole class has none, as they can't be told apart otherwise. All
    columns of docs stay, whatever their names.
    """
    found = checkpoint(_classes(docs, text, doc_id, radius))
    n = found.agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("d"), F.count("*").alias("all")).first()
    keep = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    out = docs.join(keep, doc_id, "left_semi")
    if n["n"] != n["d"]:  # repeated ids: one of the rows stays
        out = out.dropDuplicates([doc_id])
    if n["all"] != n["n"]:
        (name,) = free_names(docs, "fp_")
        nulls = docs.where(F.col(doc_id).isNull()).withColumn(name, fingerprint(F.col(text)))
        lone = found.where("component_id IS NULL AND fp = c").select(F.col("fp").alias(name)).distinct()
        out = out.unionByName(nulls.join(lone, name, "left_semi").dropDuplicates([name]).drop(name))
    return out.select(docs.columns)

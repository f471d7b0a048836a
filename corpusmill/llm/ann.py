"""Embedding near-duplicates with a robust-pruned flat graph over overlapping shards.

Distinct vectors are assigned to the nearest of a bounded set of centroids, so shards overlap. Centroids are one level while
they fit a bounded table; a larger corpus has a second level, fitted and searched inside each cluster of the first, so that
shards keep their size. Every shard builds a robust-pruned neighbour graph; adjacency lists of a vector from all its shards
are united. Each vector then searches every shard that may hold a row it links with: the clusters whose centroid is within
a margin of its nearest or within link range. In a dense group that many centroids cut, these are all clusters of the group.
The search walks the shard's part of the united graph: greedily from the vector's own row, the shard's medoid, rows spread
over the shard and one row of each connected part, expanding further while nodes within the link range (and a margin) remain
unexpanded. A pair is counted in the home cluster of the row found and nowhere else, verified in double precision; where a
row has few links in a task, its pairs are handed on, so that a pair that one end has found counts for both. A shard above the row bound is cut at random into sub-shards with a graph each, and its seekers, dealt into parts, search all of
them. Tasks return counts and a spanning forest, never all pairs. Recall is audited against brute force, and where it is too
low the search is widened, at last to all clusters and all of their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.simhash import Forest
from corpusmill.operators.components import connected_components
from corpusmill.plans.runtime import bounded_batches, checkpoint, shuffle_partitions

THRESHOLD = 0.9
MARGIN = 0.15
OVERLAP = 2
REACH = 1.0
NEAR = 0.05
SEEKERS = 8192
SHARD_ROWS = 1024
MAX_CENTROIDS = 4096
SAMPLE_ROWS = 16_384
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
BEAM = 24
ENTRIES = 64
RECALL = 0.9
WIDENING = ((REACH, BEAM), (2 * REACH, 4 * BEAM), (float("inf"), 1 << 30))
QUERY_ROWS = 128
ASSIGN_ROWS = 65_536
AUDIT_ROWS = 4096
AUDIT_SLICE = 1 << 15
PAIR_ROWS = 1 << 14
PAIRS_OF = 64


def valid(embedding: Column) -> Column:
    """True for a vector with a direction: not null, no null or non-finite component, not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(rows) -> np.ndarray:
    """Vectors as rows of a double matrix, each of length 1."""
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(7)
    c = sample[rng.permutation(len(sample))[:k]]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of every row: nearest first, a candidate being dropped once a kept neighbour is alpha times nearer to it."""
    n, out = len(x), []
    c = min(candidates, n - 1)
    if c < 1:
        return [np.zeros(0, dtype=np.int64)] * n
    for k in range(0, n, 512):
        sims = x[k : k + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(k, k + len(sims))] = -2
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1), axis=1)
        dist = 1 - np.take_along_axis(sims, near, axis=1)
        among = 1 - np.einsum("qcd,qed->qce", x[near], x[near])
        dropped, chosen = np.zeros(near.shape, dtype=bool), np.zeros(near.shape, dtype=bool)
        for j in range(c):
            take = ~dropped[:, j] & (chosen.sum(axis=1) < degree)
            chosen[:, j] = take
            dropped |= take[:, None] & (alpha * among[:, j] <= dist)
        out += [row[keep] for row, keep in zip(near, chosen)]
    return out


def entry_points(x: np.ndarray, links: np.ndarray, most: int = ENTRIES) -> np.ndarray:
    """Rows where walks start: the medoid, rows each farthest from those before, and a row of every connected part left."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(most, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    a, slot = np.nonzero(links >= 0)
    b, root, last = links[a, slot], np.arange(len(x)), None
    while last is None or (root != last).any():
        last, least = root, np.minimum(root[a], root[b])
        root = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
    return np.union1d(chosen, np.setdiff1d(root, root[chosen]))


def search(queries: np.ndarray, x: np.ndarray, links: np.ndarray, entries: np.ndarray, own: np.ndarray, reach: float, beam: int = BEAM) -> np.ndarray:
    """Similarity of each query to the rows its walk visited, -2 elsewhere.

    links is a padded adjacency matrix (-1: none); own is the row of each query itself, -1 if it has none, where its walk
    starts besides at the entries. A query expands its best unexpanded row while that is among the beam best visited, and
    all unexpanded rows of at least reach at once.
    """
    q, n = len(queries), len(x)
    if n <= beam:  # every row is among the best
        return queries @ x.T
    sims, opened = np.full((q, n), -2.0), np.zeros((q, n), dtype=bool)
    sims[:, entries] = queries @ x[entries].T
    here = np.flatnonzero(own >= 0)
    sims[here, own[here]] = np.einsum("ij,ij->i", queries[here], x[own[here]])
    active = np.arange(q)
    while len(active):
        s = sims[active]
        rest = np.where(opened[active], -2.0, s)
        best = rest.argmax(axis=1)
        value = rest[np.arange(len(active)), best]
        bar = np.partition(s, n - beam, axis=1)[:, n - beam]
        greedy = (value > -2) & (value < reach) & (value >= bar)
        row, col = np.nonzero(rest >= reach)  # the range expands as one wave
        who, what = np.concatenate([active[greedy], active[row]]), np.concatenate([best[greedy], col])
        active = active[greedy | (value >= reach)]
        opened[who, what] = True
        for k in range(0, len(who), PAIR_ROWS):
            near = links[what[k : k + PAIR_ROWS]]
            at, slot = np.nonzero(near >= 0)
            code = who[k + at] * n + near[at, slot]
            code = np.unique(code[sims.reshape(-1)[code] == -2])
            for c in range(0, len(code), PAIR_ROWS):
                a, b = np.divmod(code[c : c + PAIR_ROWS], n)
                sims[a, b] = np.einsum("ij,ij->i", queries[a], x[b])
    return sims


def _seeks(sims: np.ndarray, centers: np.ndarray, threshold: float, reach: float) -> np.ndarray:
    """Which clusters each row searches, from its similarities to all centroids.

    A row linked with this one may be nearest to another centroid only if the plane halfway to that is within the link
    range: (best - sim) / |centroid - best centroid| <= sin(range). A link in a random direction crosses about reach /
    sqrt(dimension) of its length, the share that is asked for; an infinite reach takes every cluster. Centroids within
    link range (less NEAR) are always searched, and so are the OVERLAP nearest.
    """
    best = sims.argmax(axis=1)
    gap = sims[np.arange(len(sims)), best][:, None] - sims
    apart = np.sqrt(np.maximum(0, 2 - 2 * centers[best] @ centers.T))
    share = min(1.0, reach / np.sqrt(centers.shape[1])) * np.sqrt(max(0.0, 1 - threshold**2))
    wanted = (gap <= share * apart) | (sims >= threshold - NEAR) | np.isinf(reach)
    np.put_along_axis(wanted, np.argsort(-sims, axis=1, kind="stable")[:, :OVERLAP], True, axis=1)
    return wanted


def _places(x: np.ndarray, centers: np.ndarray, threshold: float, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The OVERLAP nearest centroids of each row, nearest first, and those whose clusters it searches."""
    c = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    sims = x @ c.T
    return np.argsort(-sims, axis=1, kind="stable")[:, : min(OVERLAP, len(c))], [np.flatnonzero(w) for w in _seeks(sims, c, threshold, reach)]


#: A vector in one cluster: searched there (member), from there (seeker) or both; home is the cluster where it is counted.
PLACED = "id long, copies long, embedding array<double>, cluster long, member boolean, seeker boolean, home boolean"


def _rows(b: pd.DataFrame, x: np.ndarray, centers: np.ndarray, base: int, threshold: float, reach: float, member, seeker, home) -> pd.DataFrame:
    """A row for each cluster base + centroid that a vector of b is in or searches, where the flags allow it."""
    top, seeks = _places(x, centers, threshold, reach)
    at, cluster, flags = [], [], []
    for k in range(len(b)):
        for c in np.union1d(top[k], seeks[k]).tolist():
            m, s = bool(member[k]) and c in top[k], bool(seeker[k]) and c in seeks[k]
            if m or s:
                at.append(k)
                cluster.append(base + c)
                flags.append((m, s, bool(home[k]) and c == top[k][0]))
    out = b[["id", "copies", "embedding"]].iloc[at].reset_index(drop=True)
    out["cluster"] = np.array(cluster, dtype=np.int64)
    for name, column in zip(("member", "seeker", "home"), zip(*flags) if flags else ([], [], [])):
        out[name] = np.array(column, dtype=bool)
    return out


def _assign(vectors: DataFrame, centers, threshold: float, reach: float) -> DataFrame:
    """Vectors with their clusters of the first level; centers maps a vector length to (first cluster number, centroids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            width = b["embedding"].map(len)
            for d in sorted(width.unique()):
                part = b[width == d]
                base, c = centers.value[d]
                yes = np.ones(len(part), dtype=bool)
                yield _rows(part, unit(part["embedding"]), c, base, threshold, reach, yes, yes, yes)

    return vectors.mapInPandas(run, PLACED)


def _refine(placed: DataFrame, threshold: float, reach: float) -> DataFrame:
    """Clusters of the first level cut by centroids of their own, so that each is about a shard large.

    A cluster's centroids are fitted on a bounded sample of its members; then its rows, in blocks of about ASSIGN_ROWS, meet
    them. The new cluster number holds the old one.
    """
    sizes = checkpoint(placed.groupBy("cluster").agg(F.count_if("member").alias("n"), F.ceil(F.count("*") / ASSIGN_ROWS).cast("int").alias("blocks")))
    share = F.least(F.lit(1.0), SAMPLE_ROWS / F.col("n"))
    sample = placed.where("member").join(sizes.where(F.col("n") > 2 * SHARD_ROWS), "cluster")
    sample = sample.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)).select("cluster", "n", "embedding")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = unit(group["embedding"])
        k = int(min(MAX_CENTROIDS, len(x), max(1, group["n"].iloc[0] // SHARD_ROWS)))
        return pd.DataFrame({"cluster": group["cluster"].iloc[:1], "centers": [centroids(x, k).ravel()], "k": [k]})

    fitted = checkpoint(sample.groupBy("cluster").applyInPandas(fit, "cluster long, centers array<double>, k int"))
    blocks = sizes.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(fitted, "cluster", "left")
    blocks = blocks.toDF("cluster", "block", "centers", "k")  # columns of its own for the cogroup
    dealt = placed.join(sizes.select("cluster", "blocks"), "cluster").withColumn("block", F.pmod(F.xxhash64("id", F.lit(11)), F.col("blocks")).cast("int")).drop("blocks")

    def place(b: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        base = int(c["cluster"].iloc[0]) * (MAX_CENTROIDS + 1)
        if not len(b) or c["centers"].iloc[0] is None:
            return b.assign(cluster=base).drop(columns="block")
        x = unit(b["embedding"])
        return _rows(b, x, np.reshape(c["centers"].iloc[0], (int(c["k"].iloc[0]), -1)), base, threshold, reach, b["member"].to_numpy(), b["seeker"].to_numpy(), b["home"].to_numpy())

    return dealt.groupBy("cluster", "block").cogroup(blocks.groupBy("cluster", "block")).applyInPandas(place, PLACED)


def _graphs(placed: DataFrame) -> DataFrame:
    """(id, near): robust-pruned adjacency united over the shards of a vector."""

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        ids = shard["id"].to_numpy()
        near = robust_prune(unit(shard["embedding"]))
        return pd.DataFrame({"id": ids, "near": [ids[n] for n in near]})

    built = placed.groupBy("cluster", "sub").applyInPandas(build, "id long, near array<long>")
    return built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _find(shard: pd.DataFrame, threshold: float, beam: int) -> pd.DataFrame:
    """Links of one shard's seekers to its members: (kind, a, b, n, m).

    Kind 2: a found b, of n copies, itself being m; kind 0: a has more than PAIRS_OF links to rows at home here, and was therefore
    compared with all of these: n rows link; kind 1: an edge of a spanning forest.
    """
    members = shard[shard["role"] == 0]
    ids = members["id"].to_numpy()
    copies = members["copies"].to_numpy()
    out: list[tuple[int, int, int, int, int]] = []
    if not len(ids):
        return pd.DataFrame(out, columns=["kind", "a", "b", "n", "m"])
    home = members["home"].to_numpy(dtype=bool)
    x = unit(members["embedding"])
    place = {v: k for k, v in enumerate(ids.tolist())}
    lists = [[place[v] for v in near if v in place] for near in members["near"]]
    back: list[list[int]] = [[] for _ in lists]
    for k, near in enumerate(lists):
        for v in near:
            back[v].append(k)
    # links are walked both ways
    both = [list(dict.fromkeys(a + b)) for a, b in zip(lists, back)]
    width = max(map(len, both), default=0) or 1
    links = np.full((len(ids), width), -1, dtype=np.int64)
    for k, near in enumerate(both):
        links[k, : len(near)] = near
    entries = entry_points(x, links)
    seekers = shard[shard["role"] == 1]
    their, own_copies = seekers["id"].to_numpy(), seekers["copies"].to_numpy()
    nodes = np.union1d(ids, their)
    forest = Forest(len(nodes))
    place_of = partial(np.searchsorted, nodes)
    for k in range(0, len(seekers), QUERY_ROWS):
        part = unit(seekers["embedding"].iloc[k : k + QUERY_ROWS])
        itself = np.array([place.get(v, -1) for v in their[k : k + QUERY_ROWS].tolist()])
        sims = search(part, x, links, entries, itself, threshold - MARGIN, beam)
        crowd = np.flatnonzero(((sims >= threshold) & home).sum(axis=1) > PAIRS_OF)
        sims[crowd] = part[crowd] @ x.T  # whole lists are not handed on, so that nothing may be missing here
        row, col = np.nonzero(sims >= threshold)
        other = their[k + row] != ids[col]
        row, col = row[other], col[other]
        # a row is counted in its home cluster only; elsewhere it is a way point and joins components
        counted = home[col]
        links_of, n = np.bincount(row[counted], minlength=len(part)), np.bincount(row[counted], copies[col[counted]], len(part)).astype(np.int64)
        for r in np.flatnonzero(links_of > PAIRS_OF):
            out.append((0, int(their[k + r]), 0, int(n[r]), 0))
        few = counted & (links_of[row] <= PAIRS_OF)
        out += [(2, int(their[k + r]), int(ids[c]), int(copies[c]), int(own_copies[k + r])) for r, c in zip(row[few].tolist(), col[few].tolist())]
        # a spanning forest of the links: only pairs in different trees so far are looked at one by one
        a, b = place_of(their[k + row]), place_of(ids[col])
        root = np.array(forest.parent)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        out += [(1, int(nodes[i]), int(nodes[j]), 0, 0) for i, j in zip(a[apart].tolist(), b[apart].tolist()) if forest.join(i, j)]
    return pd.DataFrame(out, columns=["kind", "a", "b", "n", "m"])


def _counts(asked: pd.DataFrame, rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(id, n): how many of rows each asked vector links to, itself apart."""
    total = np.zeros(len(asked), dtype=np.int64)
    left, right = asked["embedding"].map(len).to_numpy(), rows["embedding"].map(len).to_numpy()
    for d in np.intersect1d(left, right):
        q, e = np.flatnonzero(left == d), np.flatnonzero(right == d)
        near = unit(asked["embedding"].iloc[q]) @ unit(rows["embedding"].iloc[e]).T >= threshold
        total[q] += (near & (asked["id"].to_numpy()[q][:, None] != rows["id"].to_numpy()[e][None, :])).sum(axis=1)
    return pd.DataFrame({"id": asked["id"].to_numpy(), "n": total})


def audit(vectors: DataFrame, found: DataFrame, threshold: float = THRESHOLD, every: int = 100, most: int = AUDIT_ROWS) -> float | None:
    """Share of the links of all vectors whose id divides by every that found.n_links holds against brute force; None without any.

    Up to most of them are held by every executor while all vectors stream past; more are dealt into blocks of about so many,
    each of which meets the vectors in slices. Only counts leave the tasks.
    """
    spark = vectors.sparkSession
    ready = vectors.where(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ready = ready.dropDuplicates(["id", "embedding"])
    asked = ready.where(F.col("id") % every == 0).dropDuplicates(["id"])
    n = asked.count()
    if n <= most:
        held = spark.sparkContext.broadcast(asked.toPandas())  # checked: at most `most` rows

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and len(held.value):
                    yield _counts(held.value, b, threshold)

        true = ready.mapInPandas(run, "id long, n long")
    else:
        blocks, slices = -(-n // most), max(shuffle_partitions(spark), -(-ready.count() // AUDIT_SLICE))
        part = lambda k: F.pmod(F.xxhash64("id", F.lit(13)), F.lit(k)).cast("int")
        every_one = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        left = asked.select("id", "embedding", part(blocks).alias("block"), every_one(slices).alias("slice"))
        right = ready.select("id", "embedding", every_one(blocks).alias("block"), part(slices).alias("slice"))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return _counts(a, b, threshold)

        true = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(meet, "id long, n long")
    true = true.groupBy("id").agg(F.sum("n").alias("true"))
    row = true.join(found.groupBy("vec_id").agg(F.max("n_links").alias("n_links")), F.col("id") == F.col("vec_id")).agg(F.sum(F.least("true", "n_links")).alias("hit"), F.sum("true").alias("all")).first()
    return row["hit"] / row["all"] if row["all"] else None


def _centers(groups: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Centroids of the first level for each vector length, fitted on a bounded sample, and the number of its first cluster."""
    counts = {r["d"]: r["n"] for r in groups.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row per length
    share = min(1.0, SAMPLE_ROWS / max(1, sum(counts.values())))
    drawn = groups.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * SAMPLE_ROWS).select("embedding").toPandas()["embedding"]
    width, out, base = drawn.map(len), {}, 0
    for d, n in sorted(counts.items()):
        sample = drawn[width == d]
        k = int(min(MAX_CENTROIDS, max(1, n * OVERLAP // SHARD_ROWS), max(1, len(sample))))
        out[d] = base, centroids(unit(sample), k) if len(sample) else np.eye(1, d)
        base += k
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, beam: int = BEAM, reach: float = REACH) -> DataFrame:
    """Return (vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding).

    Vectors link at cosine >= threshold, pairs verified in double precision. Null, empty, zero, null-holding and non-finite
    vectors link with nothing; vectors of different lengths, however long, never link. Equal vectors are searched once and all
    link; repeated rows (equal vec_id and vector) are one vector and each gets its result; rows with equal vec_id and other
    vectors are vectors of their own, of one name. A null vec_id takes no part in links and keeps component_id null. No rows
    give no rows; other columns of vectors are not read. reach sets how many clusters a vector searches, infinity means all.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = valid(F.col("embedding")) & F.col("vec_id").isNotNull()
    keyed = rows.where(good).select("vec_id", F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("g"), "embedding")
    first = keyed.groupBy("h", "g").agg(F.min("vec_id").alias("low"), F.first("embedding").alias("embedding"))
    copies = keyed.groupBy("h", "g", "vec_id").agg(F.lit(1).alias("one")).groupBy("h", "g").agg(F.count("*").alias("copies"))
    # a number of its own for each distinct vector: vec_id may repeat
    groups = checkpoint(first.join(copies, ["h", "g"]).withColumn("id", F.xxhash64("h", "g")))
    distinct = groups.select("id", "copies", "embedding")
    centers = _centers(distinct)
    placed = checkpoint(_assign(distinct, spark.sparkContext.broadcast(centers), threshold, reach))
    if any(len(c) >= MAX_CENTROIDS for _, c in centers.values()):
        placed = checkpoint(_refine(placed, threshold, reach))
    # a cluster's members in sub-shards, its seekers in parts, each of bounded size
    cut = placed.groupBy("cluster").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("member") / (2 * SHARD_ROWS))).cast("int").alias("subs"), F.greatest(F.lit(1), F.ceil(F.count_if("seeker") / SEEKERS)).cast("int").alias("parts")
    )
    placed = placed.join(checkpoint(cut), "cluster")
    member = placed.where("member").withColumn("sub", F.pmod(F.xxhash64("id", F.lit(5)), F.col("subs")).cast("int"))
    graph = checkpoint(_graphs(member))
    member = member.join(graph, "id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.select("cluster", "sub", "part", F.lit(0).alias("role"), "id", "copies", "embedding", "home", "near")
    seeker = placed.where("seeker").withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")).cast("int"))
    seeker = seeker.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    seeker = seeker.select("cluster", "sub", "part", F.lit(1).alias("role"), "id", "copies", "embedding", F.lit(False).alias("home"), F.array().cast("array<long>").alias("near"))
    found = member.union(seeker).groupBy("cluster", "sub", "part").applyInPandas(lambda key, s: _find(s, threshold, beam).assign(cluster=key[0], sub=key[1]), "kind int, a long, b long, n long, m long, cluster long, sub int")
    found = checkpoint(found)
    # a pair counts for both ends, whichever found it; but where a row was compared with all of a shard, the shard's count holds
    crowded = checkpoint(found.where("kind = 0").select(F.col("a").alias("id"), "cluster", "sub", "n"))
    pairs = found.where("kind = 2")
    told = pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), F.col("m").alias("n"))
    if not crowded.isEmpty():
        at = placed.where("home").select(F.col("id").alias("other"), "cluster", F.pmod(F.xxhash64("id", F.lit(5)), F.col("subs")).cast("int").alias("sub"))
        told = told.join(at, "other").join(crowded.select("id", "cluster", "sub"), ["id", "cluster", "sub"], "left_anti").select("id", "other", "n")
    each = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "n").unionByName(told).groupBy("id", "other").agg(F.max("n").alias("n"))
    linked = each.groupBy("id").agg(F.sum("n").alias("n")).unionByName(crowded.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    component = connected_components(found.where("kind = 1").select("a", "b"))
    classes = (
        groups.select("h", "g", "id", "copies", "low")
        .join(linked, "id", "left")
        .join(component, "id", "left")
        .select("h", "g", "low", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("c"))
    )
    named = classes.groupBy("c").agg(F.min("low").alias("component_id"))
    classes = classes.join(named, "c").select("h", "g", "n_links", "component_id")
    out = keyed.select("vec_id", "h", "g").join(classes, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audited(vectors: DataFrame, threshold: float = THRESHOLD, least: float = RECALL) -> DataFrame:
    """near_duplicates with audit_recall, searched ever wider until the audit is at least the given recall.

    audit_recall is null where the audited vectors have no link, so that nothing can be measured. The last step compares
    every vector with all rows, so that only a fault is left to raise an error.
    """
    for reach, beam in WIDENING:
        found = checkpoint(near_duplicates(vectors, threshold, beam, reach))
        recall = audit(vectors, found, threshold)
        if recall is None or recall >= least:
            return found.withColumn("audit_recall", F.lit(recall).cast("double"))
    raise RuntimeError(f"audited recall {recall} is under {least}")

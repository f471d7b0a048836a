"""Quality classifier by Bradley-Terry pairwise ranking.

A text is described by shares of its words and characters. Documents labelled 1 are preferred to documents labelled 0; the
probability that one is preferred is the logistic function of the difference of their scores, a score is linear in the
description, and the weights minimise the logistic loss on feature differences of preference pairs (Newton steps, whose
gradient and curvature tasks sum). The threshold is a quantile of the scores of all labelled documents that may teach: the
share of them that is labelled 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.language_id import held_out
from corpusmill.plans.runtime import bounded_batches, checkpoint, free_names

#: Labelled documents of each class that the weights are fitted on, about.
TEACH_DOCS = 65_536
#: Rows of a block, in which pairs are made; partners of a row; strength of the ridge, a pair; Newton steps at most.
BLOCK_ROWS, PARTNERS, RIDGE, STEPS = 512, 8, 1e-3, 25
#: The score at the threshold; the threshold lies midway between the quantiles EPS below and above the share of label 0.
AT, EPS = 0.7, 0.002
CHUNK, RUN_BYTES = 1 << 20, 4 << 20
SHAPE_BITS = 6
SHAPES = 1 << SHAPE_BITS
#: Runs of one kind of character that tell the shapes of words apart.
TURNS = 7
# kinds of bytes: space, lower case, upper case, digit, other ASCII sign, control, first byte of a longer character, its other bytes
SPACE, LOWER, UPPER, DIGIT, SIGN, CONTROL, WIDE, REST = range(8)
_KIND = np.full(256, SIGN, dtype=np.uint8)
_KIND[:32], _KIND[127] = CONTROL, CONTROL
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
_KIND[0x80:0xC0], _KIND[0xC0:] = REST, WIDE
#: Signs that are counted one by one.
SIGNS = np.flatnonzero(_KIND == SIGN)
_MIX = np.uint64(0x9E3779B97F4A7C15)
FEATURES = 7 + len(SIGNS) + 12 + SHAPES


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.uint64(0x100000001B3)
    return np.multiply.accumulate(out)


class Sums:
    """Counts of a run of texts, gathered over chunks that end between words, so that one long text needs little memory at a time."""

    def __init__(self, n: int):
        self.bytes = np.zeros((n, 256), dtype=np.int64)
        self.words: list[tuple[np.ndarray, ...]] = []

    def add(self, flat: np.ndarray, doc: np.ndarray) -> None:
        """flat: bytes with a space before each text and chunk; doc: the text that each byte belongs to, ascending."""
        low, n = int(doc[0]), int(doc[-1] - doc[0]) + 1
        self.bytes[low : low + n] += np.bincount((doc - low) * 256 + flat, minlength=n * 256).reshape(n, 256)
        kind = _KIND[flat]
        at = np.flatnonzero(kind != SPACE)
        if not len(at):
            return
        head = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        size = np.diff(np.r_[head, len(at)])
        start, kind, place = at[head], kind[at], np.arange(len(at)) - np.repeat(head, size)
        power = _powers(max(int(size.max()), TURNS))
        alike = np.where(kind >= WIDE, LOWER, kind)
        turn = np.r_[True, alike[1:] != alike[:-1]]
        turn[head] = True
        turns = np.cumsum(turn)
        nth = np.minimum(turns - np.repeat(turns[head], size), TURNS - 1)
        with np.errstate(over="ignore"):
            key = np.add.reduceat((flat[at].astype(np.uint64) + np.uint64(1)) * power[place], head) * _MIX
            shape = np.add.reduceat(turn * (alike.astype(np.uint64) + np.uint64(1)) * power[nth], head) * _MIX
        count = lambda found: np.add.reduceat(found.astype(np.int64), head)
        lines = np.cumsum(flat == 10)[start]
        self.words.append((doc[start], key, (shape >> np.uint64(64 - SHAPE_BITS)).astype(np.int64), count(kind != REST), count(kind == UPPER), count((kind == LOWER) | (kind == UPPER) | (kind == WIDE)), np.r_[True, np.diff(lines) > 0]))

    def features(self) -> np.ndarray:
        """A row for each text; shares enter as square roots, which spread out small ones."""
        n = len(self.bytes)
        signs = self.bytes[:, SIGNS].astype(float)
        kinds = np.stack([self.bytes[:, _KIND == k].sum(axis=1) for k in (LOWER, UPPER, DIGIT, SIGN, CONTROL, WIDE)], axis=1).astype(float)
        chars = np.maximum(kinds.sum(axis=1), 1.0)
        out = np.zeros((n, FEATURES))
        out[:, :6] = np.sqrt(kinds / chars[:, None])
        out[:, 6] = np.log1p(chars)
        out[:, 7 : 7 + len(SIGNS)] = np.sqrt(signs / chars[:, None])
        if not self.words:
            return out
        doc, key, shape, size, upper, letters, breaks = (np.concatenate(x) for x in zip(*self.words))
        per = lambda x: np.bincount(doc, x, n)
        words = np.maximum(per(None), 1.0)
        again = np.r_[False, (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])]
        order = np.lexsort((key, doc))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])]
        heads = np.flatnonzero(new)
        times = np.diff(np.r_[heads, len(order)])
        owner = doc[order][heads]
        distinct, top = np.bincount(owner, minlength=n), np.zeros(n)
        np.maximum.at(top, owner, times)
        broken = breaks | np.r_[True, doc[1:] != doc[:-1]]
        own = [per(again) / words, distinct / words, np.log1p(distinct) / np.log1p(words), top / words, per(upper == letters) / words, per(letters == 0) / words,
               per((upper > 0) & (upper < letters)) / words, per(letters == size) / words, per(size) / words / 8, per(size > 20) / words, per(size == 1) / words, per(broken) / words]
        k = 7 + len(SIGNS)
        out[:, k : k + 12] = np.sqrt(np.stack(own, axis=1))
        out[:, k + 12 :] = np.sqrt(np.bincount(doc * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES) / words[:, None])
        return out


def describe(texts: list[bytes]) -> np.ndarray:
    """Features of texts of any length: kinds of characters, each ASCII sign, repetition, case and shapes of words."""
    sums, held, size = Sums(len(texts)), [], 0

    def flush() -> None:
        if held:
            sums.add(np.frombuffer(b"".join(x for _, x in held), dtype=np.uint8), np.repeat([k for k, _ in held], [len(x) for _, x in held]))
            held.clear()

    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(at + CHUNK, len(text))
            if end < len(text):
                cut = max(text.rfind(s, at, end) for s in (b" ", b"\n", b"\t"))
                end = cut if cut > at else end
            held.append((k, b" " + text[at:end]))
            size += end - at
            at = end
            if size > CHUNK:
                flush()
                size = 0
    flush()
    return sums.features()


def features(text: Column) -> Column:
    """array<float> of a text's features; a null text counts as empty."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        rows, out, at = texts.tolist(), [], 0
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and (end == at or size + len(rows[end]) <= RUN_BYTES):
                size += len(rows[end])
                end += 1
            out += list(describe(rows[at:end]).astype(np.float32))
            at = end
        return pd.Series(out, dtype=object)

    return run(F.coalesce(text, F.lit("")).cast("binary"))


class Model:
    """Weights of standardised features and the raw score at the threshold; a raw score is in log odds of being preferred."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, threshold: float = 0.0):
        self.mean, self.spread, self.weights, self.threshold = mean, spread, weights, threshold

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, growing with the raw score, AT at the threshold."""
        z = np.clip(np.log(AT / (1 - AT)) + self.raw(x) - self.threshold, -700, 700)
        return 1 / (1 + np.exp(-z))


def differences(good: np.ndarray, bad: np.ndarray, partners: int = PARTNERS) -> np.ndarray:
    """Feature differences of preference pairs: every row meets `partners` rows of the other class, or all if there are fewer."""
    n = max(len(good), len(bad))
    rounds = min(partners, min(len(good), len(bad)))
    k = np.arange(n)
    hop = max(1, min(len(good), len(bad)) // max(1, rounds))
    wide, narrow = (good, bad) if len(good) >= len(bad) else (bad, good)
    meet = [wide[k] - narrow[(k + r * hop) % len(narrow)] for r in range(rounds)]
    return np.concatenate(meet) * (1 if wide is good else -1)


def _blocks(taught: DataFrame, blocks: int) -> DataFrame:
    """(good, bad): the features of a block's rows by class, as float32 bytes; blocks hold about BLOCK_ROWS rows."""

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mix", kind="stable")
        pack = lambda q: b"".join(np.asarray(x, dtype=np.float32).tobytes() for x in rows.loc[rows["quality"] == q, "x"])
        return pd.DataFrame({"good": [pack(1)], "bad": [pack(0)]})

    return taught.withColumn("block", F.pmod("mix", F.lit(blocks))).groupBy("block").applyInPandas(gather, "good binary, bad binary")


def _unpack(row: bytes) -> np.ndarray:
    return np.frombuffer(row, dtype=np.float32).reshape(-1, FEATURES).astype(float)


def _summed(blocks: DataFrame, values) -> np.ndarray:
    """Sum over all blocks of the vector values(good, bad); one vector from each task comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for good, bad in zip(b["good"], b["bad"]):
                v = values(_unpack(good), _unpack(bad))
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"v": [total.tobytes()]})

    return sum((np.frombuffer(r["v"]) for r in blocks.mapInPandas(run, "v binary").collect()), np.zeros(1))


def fit(blocks: DataFrame) -> Model | None:
    """Bradley-Terry weights over the pairs of all blocks by damped Newton steps; None where no block has both classes."""
    d = FEATURES

    def moments(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        x = np.concatenate([good, bad])
        return np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0), min(len(good), len(bad))]

    m = _summed(blocks, moments)
    if len(m) == 1 or not m[-1]:
        return None
    mean = m[1 : d + 1] / m[0]
    spread = np.sqrt(np.maximum(m[d + 1 : 2 * d + 1] / m[0] - mean * mean, 0.0))
    spread[spread < 1e-4] = 1.0

    def slopes(w: np.ndarray):
        def values(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
            if not len(good) or not len(bad):
                return np.zeros(2 + d + d * d)
            x = differences(good, bad) / spread
            z = x @ w
            p = 1 / (1 + np.exp(np.clip(z, -500, 500)))  # probability of the wrong order
            return np.r_[len(x), np.logaddexp(0, -z).sum(), -(p @ x), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]

        v = _summed(blocks, values)
        n = v[0]
        return v[1] / n + RIDGE / 2 * w @ w, v[2 : d + 2] / n + RIDGE * w, v[d + 2 :].reshape(d, d) / n + RIDGE * np.eye(d)

    w = np.zeros(d)
    loss, gradient, curve = slopes(w)
    for _ in range(STEPS):
        step, scale = np.linalg.solve(curve, gradient), 1.0
        if gradient @ step < 1e-6:
            break
        while True:
            trial = slopes(w - scale * step)
            if trial[0] <= loss or scale < 1e-3:
                break
            scale /= 2
        w = w - scale * step
        loss, gradient, curve = trial
    return Model(mean, spread, w)


def _scored(x: Column, model: Model, raw: bool = False) -> Column:
    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=float)
        found = np.stack(rows.to_numpy()).astype(float)
        return pd.Series(model.raw(found) if raw else model.score(found))

    return run(x)


def learn(described: DataFrame, labels: DataFrame, teach_docs: int = TEACH_DOCS) -> Model | None:
    """Weights and threshold from described (doc_id, x, held) and labels (doc_id, quality).

    An id teaches if all its labels agree on 0 or 1 and it is not held out; equal rows teach once. The weights are fitted on a
    bounded sample, about teach_docs rows of each class by hash; the threshold is a quantile over all teaching rows.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    marks = marks.where("quality = most").select("doc_id", F.col("quality").cast("int").alias("quality"))
    taught = described.where("NOT held").select("doc_id", "x").join(marks, "doc_id").groupBy("doc_id", "x").agg(F.min("quality").alias("quality"))
    taught = checkpoint(taught.select("quality", "x", F.xxhash64("doc_id", "x").alias("mix")))
    counts = {r["quality"]: r["n"] for r in taught.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(counts) < 2:
        return None
    u = F.pmod(F.xxhash64("mix", F.lit("teach")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = taught.where(u < F.when(F.col("quality") == 1, min(1.0, teach_docs / counts[1])).otherwise(min(1.0, teach_docs / counts[0])))
    rows = sum(min(teach_docs, n) for n in counts.values())
    # a block needs rows of both classes: the rarer one sets how many there are
    blocks = max(1, min(rows // BLOCK_ROWS, min(min(teach_docs, n) for n in counts.values()) // PARTNERS))
    model = fit(checkpoint(_blocks(sample, blocks)))
    if model is None:
        return None
    share = counts[0] / (counts[0] + counts[1])
    at = [min(max(share + e, 0.0), 1.0) for e in (-EPS, EPS)]
    raw = taught.select(_scored(F.col("x"), model, raw=True).alias("raw"))
    model.threshold = sum(raw.agg(F.percentile_approx("raw", at, 10_000).alias("q")).first()["q"]) / 2
    return model


ADDED = ("held_out", "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, teach_docs: int = TEACH_DOCS, keep: list[str] | None = None) -> DataFrame:
    """Add held_out, score and predicted to docs (doc_id, text, ...); labels (doc_id, quality) teach, but for held-out ids.

    Only the text makes a score. Null and empty texts have a score like any other; a null id is never held out and meets no
    label; rows, repeated ones too, are kept as they are; very long texts are described whole, a word of over a million
    characters in parts; no rows give no rows. Without labels of both classes every score is 0.5. keep names the columns of docs
    that are wanted, by default all; those with the added names are left out. Texts are described once, in a checkpoint.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row_"), held_out().alias("held"), features(F.col("text")).alias("x"))
    described = checkpoint(rows)
    model = learn(described, labels, teach_docs)
    score = F.lit(0.5) if model is None else _scored(F.col("x"), model)
    scored = described.withColumn("score", score)
    return scored.select(*[F.col("row_").getField(c).alias(c) for c in kept], F.col("held").alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))

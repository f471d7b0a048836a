"""Token counts under a unigram model, with one dynamic programme shared by all words of a trie.

Distinct pre-tokens go into a trie (those that a task has not met before, batch by batch; a table of all pre-tokens would
have to be shuffled and joined back). Each node gets the forward score of the characters on its path, the summed probability
of all their segmentations, and the probability and piece count of the best one, computed once from its ancestors, so words
with a common prefix share the work; terminal nodes' counts are stored by word. The vocabulary is fixed and public, with
case; its piece probabilities are estimated here by expectation maximisation on all words of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.language_id import SMOOTHING, _lattice, _runs
from corpusmill.llm.pieces import EMPTY, PieceTrie, codes_of, read_pieces
from corpusmill.plans.runtime import bounded_batches, checkpoint, free_names

MAX_WORDS = 250_000
ROUNDS = 2


def estimate(docs: DataFrame, text: str, pieces, sample_docs: int | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, the last one for a character outside the vocabulary.

    Fitted on all texts, or if sample_docs is given on about that many, chosen by a hash of the text. Their words are counted once; every round sums
    their expected piece counts over all segmentations in Spark, from equal probabilities at first, and smooths them. Only
    a number for each piece comes to the driver. Without words all pieces stay equally likely.
    """
    spark = docs.sparkSession
    share = 1.0 if sample_docs is None else min(1.0, sample_docs / max(docs.count(), 1))
    u = F.pmod(F.xxhash64(F.col(text), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.where(F.col(text).isNotNull() & (u < share))
    words = checkpoint(sample.select(F.explode(F.split(text, WHITE)).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")))
    log_p = np.full(len(pieces.value) + 1, -np.log(len(pieces.value) + 1))
    for _ in range(rounds):
        given = spark.sparkContext.broadcast(log_p)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lattice, total = _lattice(pieces), np.zeros(len(pieces.value) + 1)
            for b in batches:
                weight = dict(zip(b["word"], b["n"]))
                for run in _runs(list(weight)):
                    total += lattice.expected(run, np.array([weight[w] for w in run], dtype=float), given.value)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"piece": at, "n": total[at]})

        rows = words.mapInPandas(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        count = np.full(len(log_p), SMOOTHING)
        count[rows["piece"].to_numpy(dtype=int)] += rows["n"].to_numpy(dtype=float)
        log_p = np.log(count / count.sum())
    return log_p


#: Python's white space, as a pattern of the JVM: both sides must see the same words.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


class TrieCounter:
    """Counts pieces of words; terminal counts are kept between batches up to a bound."""

    def __init__(self, pieces: list[str], log_p: np.ndarray):
        self.vocabulary, self.log_p = PieceTrie(pieces), log_p
        self.terminal: dict[str, tuple[int, float]] = {}

    def insert(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """(pieces of the best segmentation, log of the forward score) of distinct words.

        The trie of all words is built and scored level by level: a level's nodes are the runs of equal prefixes of the
        sorted words. Active pieces are those begun at an ancestor that the vocabulary can still continue; a node's scores
        come from the pieces that end in it. A character outside the vocabulary is one unknown piece, counted as its UTF-8
        bytes.
        """
        words = sorted(words)
        codes, lengths = codes_of(words)
        first, unknown = np.cumsum(lengths) - lengths, self.vocabulary.unknown
        terminal, forward = np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
        alive, parent_of_word = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
        # of the last level's nodes: best score, its pieces, forward score
        best, pieces, summed = np.zeros(1), np.zeros(1, dtype=np.int64), np.zeros(1)
        # of active pieces: the node they reached, the three values where they begun, their vocabulary node
        holder, vocab = np.zeros(0, np.int64), np.zeros(0, np.int64)
        begun, counted, before = np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        depth = 0
        while len(alive):
            code = codes[first[alive] + depth]
            new = np.r_[True, (parent_of_word[1:] != parent_of_word[:-1]) | (code[1:] != code[:-1])]
            node_of_word, parent, node_code = np.cumsum(new) - 1, parent_of_word[new], code[new]
            # every parent also begins a piece itself
            n = len(best)
            fresh = np.r_[np.zeros(len(vocab), bool), np.ones(n, bool)]
            holder, vocab = np.concatenate([holder, np.arange(n)]), np.concatenate([vocab, np.zeros(n, np.int64)])
            begun, counted, before = np.concatenate([begun, best]), np.concatenate([counted, pieces]), np.concatenate([before, summed])
            order = np.argsort(holder, kind="stable")
            many = np.bincount(holder, minlength=n)
            take = many[parent]
            offset = np.repeat(np.cumsum(many)[parent] - many[parent] - (np.cumsum(take) - take), take)
            row = order[offset + np.arange(int(take.sum()))]
            child = np.repeat(np.arange(len(parent)), take)
            reached = self.vocabulary.step(vocab[row], node_code[child])
            piece = np.where(reached == EMPTY, EMPTY, self.vocabulary.piece[reached])
            piece = np.where((piece == EMPTY) & fresh[row], unknown, piece)
            ends = np.flatnonzero(piece != EMPTY)
            owner, gain = child[ends], self.log_p[piece[ends]]
            size = np.where(piece[ends] == unknown, utf8_bytes(node_code[owner]), 1)
            total, count, ways = begun[row[ends]] + gain, counted[row[ends]] + size, before[row[ends]] + gain
            at = np.lexsort((count, -total, owner))
            heads = np.flatnonzero(np.r_[True, owner[at][1:] != owner[at][:-1]])
            best, pieces = total[at[heads]], count[at[heads]]
            top = np.maximum.reduceat(ways[at], heads)
            summed = top + np.log(np.add.reduceat(np.exp(ways[at] - np.repeat(top, np.diff(np.r_[heads, len(at)]))), heads))
            on = reached != EMPTY
            holder, vocab = child[on], reached[on].astype(np.int64)
            begun, counted, before = begun[row[on]], counted[row[on]], before[row[on]]
            depth += 1
            done = lengths[alive] == depth
            terminal[alive[done]], forward[alive[done]] = pieces[node_of_word[done]], summed[node_of_word[done]]
            alive, parent_of_word = alive[~done], node_of_word[~done]
        return dict(zip(words, zip(terminal.tolist(), forward.tolist())))

    def counts(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, log probability) of each text."""
        if len(self.terminal) > MAX_WORDS:
            self.terminal = {}
        split = [t.split() for t in texts]
        fresh = {w for ws in split for w in ws} - self.terminal.keys()
        if fresh:
            self.terminal.update(self.insert(list(fresh)))
        out = []
        for ws in split:
            found = [self.terminal[w] for w in ws]
            out.append((len(ws), sum(n for n, _ in found), math.fsum(p for _, p in found)))
        return out


def utf8_bytes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def count_tokens(docs: DataFrame, piece_path: str, text: str = "text", log_p: np.ndarray | None = None, sample_docs: int | None = None) -> DataFrame:
    """Add n_pretokens, n_tokens (long) and log_p (double, of all segmentations of its words) to docs.

    Piece probabilities are estimated on all these texts, so that a text's counts depend on its table, unless log_p gives them
    (a number for each piece in order of id, then one for other characters, as estimate returns) or sample_docs asks for a
    sample.

    Null, empty and wordless texts have 0 of each; very long texts are counted whole; rows, repeated ones too, are kept; no
    rows give no rows. Columns of docs with these three names are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = spark.sparkContext.broadcast(read_pieces(piece_path, lower=False))
    model = spark.sparkContext.broadcast(estimate(docs, text, pieces, sample_docs) if log_p is None else log_p)
    added = {"n_pretokens": "long", "n_tokens": "long", "log_p": "double"}

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in added.items()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = TrieCounter(pieces.value, model.value)
        for s in batches:
            yield pd.DataFrame(counter.counts(s.fillna("").tolist()), columns=list(added))

    (name,) = free_names(docs, "count_")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    return docs.withColumn(name, run(F.col(text))).select(*kept, *[F.col(name).getField(k).alias(k) for k in added])

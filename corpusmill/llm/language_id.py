"""Language identification by unigrams marginalised over all segmentations.

Words are cut only into pieces of a fixed public vocabulary. One E-step with equal piece probabilities gives every
language expected piece counts; smoothed, they are its piece probabilities. A forward pass then sums the probability
of a word over all segmentations, for all languages at once, and a text scores the sum over its words. No language at all
is a word of characters drawn evenly from an alphabet: the share of a text's words that its language explains better than
that tells whether the text is in a learned language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.pieces import EMPTY, PieceTrie, codes_of, read_pieces
from corpusmill.plans.runtime import bounded_batches, free_names

TRAIN_DOCS = 4096
SMOOTHING = 0.1
CACHE_WORDS = 250_000
CACHE_CELLS = 4_000_000
FIT, ALPHABET = 0.2, 100
DP_CHARS = 200_000
SHORT, SCALE = 40, 3.0


class Lattice:
    """All occurrences of vocabulary pieces in words, and sums over their segmentations."""

    def __init__(self, pieces: list[str]):
        self.trie = PieceTrie(pieces)
        self.unknown = len(pieces)

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of each occurrence as positions in one flat array, and each word's first and last position.

        A word is marked with its start; a character outside the vocabulary is the unknown piece.
        """
        codes, lengths = codes_of(words)
        word = np.repeat(np.arange(len(words)), lengths)
        at, stop = np.arange(len(codes)), np.cumsum(lengths)[word]
        node = self.trie.step(np.zeros(len(codes), dtype=np.int64), codes)
        piece = np.where(node == EMPTY, EMPTY, self.trie.piece[node])
        starts, ends, pieces, end = [at], [at + 1], [np.where(piece == EMPTY, self.unknown, piece)], at + 1
        keep = (node != EMPTY) & (end < stop)
        while keep.any():
            at, end, stop, node = at[keep], end[keep], stop[keep], node[keep]
            node = self.trie.step(node, codes[end])
            end = end + 1
            piece = np.where(node == EMPTY, EMPTY, self.trie.piece[node])
            found = piece != EMPTY
            starts.append(at[found])
            ends.append(end[found])
            pieces.append(piece[found])
            keep = (node != EMPTY) & (end < stop)
        start, end = np.concatenate(starts), np.concatenate(ends)
        last = np.cumsum(lengths) + np.arange(len(words))
        return start + word[start], end + word[start], np.concatenate(pieces), last - lengths, last

    @staticmethod
    def _sweep(src: np.ndarray, dst: np.ndarray, step: np.ndarray, log_p: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
        """log of the summed path probability to each position; step orders the occurrences.

        Up to SHORT steps the sums are plain, each character scaled by e^SCALE, which keeps them within range; longer
        words are summed in logarithms.
        """
        order = np.lexsort((dst, step))
        src, dst, step, log_p = src[order], dst[order], step[order], log_p[order]
        cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True])
        new = np.r_[True, (dst[1:] != dst[:-1]) | (step[1:] != step[:-1])]
        short = int(step[-1]) <= SHORT
        if short:
            p = np.exp(log_p + SCALE * np.abs(dst - src)[:, None])
            alpha = np.zeros((size, p.shape[1]))
            alpha[begin] = 1.0
        else:
            alpha = np.full((size, log_p.shape[1]), -np.inf)
            alpha[begin] = 0.0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            heads = np.flatnonzero(new[a:b])
            if short:
                alpha[dst[a:b][heads]] = np.add.reduceat(alpha[src[a:b]] * p[a:b], heads, axis=0)
                continue
            x = alpha[src[a:b]] + log_p[a:b]
            top = np.maximum.reduceat(x, heads, axis=0)
            runs = np.diff(np.r_[heads, b - a])
            total = np.add.reduceat(np.exp(x - np.repeat(top, runs, axis=0)), heads, axis=0)
            alpha[dst[a:b][heads]] = top + np.log(total)
        if short:
            depth = np.zeros(size)
            depth[dst] = step
            alpha = np.log(alpha) - SCALE * depth[:, None]
        return alpha

    def forward(self, words: list[str], log_p: np.ndarray) -> np.ndarray:
        """log P(word) for each word and each column of log_p (pieces and the unknown piece, by language)."""
        start, end, piece, first, last = self.edges(words)
        base = np.repeat(first, last - first + 1)
        return self._sweep(start, end, end - base[end], log_p[piece], first, int(last[-1]) + 1)[last]

    def expected(self, words: list[str], weights: np.ndarray, log_p: np.ndarray | None = None) -> np.ndarray:
        """Expected piece counts, each word counting with its weight; without log_p all pieces are equally likely."""
        start, end, piece, first, last = self.edges(words)
        size = int(last[-1]) + 1
        base, stop = np.repeat(first, last - first + 1), np.repeat(last, last - first + 1)
        given = np.full((len(piece), 1), -np.log(self.unknown + 1)) if log_p is None else log_p[piece][:, None]
        ahead = self._sweep(start, end, end - base[end], given, first, size)[:, 0]
        behind = self._sweep(end, start, stop[start] - start, given, last, size)[:, 0]
        word = np.repeat(np.arange(len(words)), last - first + 1)
        share = np.exp(ahead[start] + given[:, 0] + behind[end] - ahead[last][word[start]])
        return np.bincount(piece, share * weights[word[start]], self.unknown + 1)


def _runs(words: list[str]) -> Iterator[list[str]]:
    """Words in runs of bounded length, similar lengths together, so that a long word does not slow the others."""
    words = sorted(words, key=len)
    at = 0
    while at < len(words):
        end, chars = at, 0
        while end < len(words) and (end == at or (chars + len(words[end]) < DP_CHARS and len(words[end]) < 2 * len(words[at]) + 16)):
            chars += len(words[end]) + 2
            end += 1
        yield words[at:end]
        at = end


_LATTICES: dict = {}


def _lattice(pieces) -> Lattice:
    key = hash(tuple(pieces.value))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(pieces.value)
    return _LATTICES[key]


def train(labelled: DataFrame, pieces, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log piece probabilities) from columns text, lang, doc_id.

    Fitted on a bounded sample: about train_docs texts of each language, those whose hash of doc_id and text is
    smallest against a threshold set from the language's count (equal rows are in it together). The model is a column of
    doubles per language and a row per piece; it is what executors hold.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, 0))
    spark = labelled.sparkSession
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_docs / counts[k]))])
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(u < share[F.col("lang")]).select("lang", "text")

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, total, words = _lattice(pieces), {}, {}

        def flush() -> None:
            for lang, counter in words.items():
                acc = total.setdefault(lang, np.zeros(lattice.unknown + 1))
                for run in _runs(list(counter)):
                    acc += lattice.expected(run, np.array([counter[w] for w in run], dtype=float))
            words.clear()

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                words.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, words.values())) > CACHE_WORDS:
                flush()
        flush()
        for lang, acc in total.items():
            at = np.flatnonzero(acc)
            yield pd.DataFrame({"lang": lang, "piece": at, "n": acc[at]})

    bounded_batches(spark)
    rows = sample.mapInPandas(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    count = np.full((len(pieces.value) + 1, len(langs)), SMOOTHING)
    column = {k: i for i, k in enumerate(langs)}
    np.add.at(count, (rows["piece"].to_numpy(), rows["lang"].map(column).to_numpy(dtype=int)), rows["n"].to_numpy())
    return langs, np.log(count / count.sum(axis=0))


class Scorer:
    """Bounded cache of word scores: a row for each word, a column for each language and one for none of them."""

    def __init__(self, lattice: Lattice, log_p: np.ndarray):
        self.lattice, self.log_p = lattice, log_p
        self.most = max(1000, min(CACHE_WORDS, CACHE_CELLS // (log_p.shape[1] + 1)))
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, log_p.shape[1] + 1))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probability of each text's words by language, and the share of its words with a letter that the best one fits."""
        split = [t.lower().split() for t in texts]
        if len(self.index) > self.most:
            self.index.clear()
            self.rows = self.rows[:0]
        fresh = list({w for ws in split for w in ws} - self.index.keys())
        parts = [self.rows]
        for run in _runs(fresh):
            self.index.update(zip(run, range(len(self.index), len(self.index) + len(run))))
            parts.append(np.c_[self.lattice.forward(run, self.log_p), [-np.log(ALPHABET) * (len(w) + 1) if any(map(str.isalpha, w)) else np.nan for w in run]])
        self.rows = np.concatenate(parts)
        out, fit = np.zeros((len(texts), self.rows.shape[1] - 1)), np.zeros(len(texts))
        for k, ws in enumerate(split):
            if ws:
                x = self.rows[np.fromiter(map(self.index.__getitem__, ws), np.int64, len(ws))]
                out[k] = x[:, :-1].sum(axis=0)
                fit[k] = (x[:, out[k].argmax()] > x[:, -1]).sum() / max(1, (~np.isnan(x[:, -1])).sum())
        return out, fit


def predict(text: Column, pieces, model) -> Column:
    """struct<lang_pred, score, fit>: the likeliest learned language, its posterior under equal priors, and its share of words.

    A null text or one without a letter is `und` with score and fit 0, as is every text if nothing was learned.
    """

    @F.pandas_udf("lang_pred string, score double, fit double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        langs, log_p = model.value
        scorer = Scorer(_lattice(pieces), log_p) if langs else None
        for s, known in batches:
            lang, score, fit = np.full(len(s), "und", dtype=object), np.zeros(len(s)), np.zeros(len(s))
            at = np.flatnonzero(known.to_numpy(dtype=bool)) if langs else []
            for k in range(0, len(at), 256):
                rows = at[k : k + 256]
                x, fit[rows] = scorer.scores(s.iloc[rows].tolist())
                best = x.argmax(axis=1)
                lang[rows] = np.array(langs, dtype=object)[best]
                score[rows] = 1 / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": lang, "score": score, "fit": fit})

    return run(text, has_letter(text))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of documents that the model may not learn from; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def _model(docs: DataFrame, piece_path: str, labelled: DataFrame | None, train_docs: int) -> tuple:
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    pieces = spark.sparkContext.broadcast(read_pieces(piece_path))
    source = (docs if labelled is None else labelled).where(~held_out()).select("doc_id", "text", "lang")
    return pieces, spark.sparkContext.broadcast(train(source, pieces, train_docs))


def identify(docs: DataFrame, piece_path: str, labelled: DataFrame | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Add held_out, lang_pred, score and fit to docs (doc_id, text, lang, ...); learns from labelled, by default docs itself.

    Only rows outside the held-out quarter teach. Rows, repeated ones too, are kept as they are; a null doc_id is never held
    out; null, empty and letterless texts are `und`; very long texts are scored whole; no rows give no rows. Columns of docs
    with these four names are left out.
    """
    pieces, model = _model(docs, piece_path, labelled, train_docs)
    (name,) = free_names(docs, "lang_")
    added = ["lang_pred", "score", "fit"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("held_out", *added)]
    return docs.withColumn(name, predict(F.col("text"), pieces, model)).select(*kept, held_out().alias("held_out"), *[F.col(name).getField(a).alias(a) for a in added])


def keep_known(docs: DataFrame, piece_path: str, labelled: DataFrame | None = None, train_docs: int = TRAIN_DOCS, fit: float = FIT) -> DataFrame:
    """The rows of docs, columns untouched, whose text is in a learned language.

    Out go texts that are null or without a letter and those of whose words with a letter less than the share fit is likelier in the
    predicted language than as characters of an alphabet of ALPHABET. If no row teaches a language, every text with a letter stays.
    """
    pieces, model = _model(docs, piece_path, labelled, train_docs)
    if not model.value[0]:
        return docs.where(has_letter(F.col("text")))
    (name,) = free_names(docs, "lang_")
    scored = docs.withColumn(name, predict(F.col("text"), pieces, model))
    found = F.col(name)
    return scored.where((found["lang_pred"] != "und") & (found["fit"] >= fit)).select(*[F.col(f"`{c}`") for c in docs.columns])

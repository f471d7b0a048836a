"""Tokens of texts and queries, and the best of each query; retrieval itself is in lex_index."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
# English stop words.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were",
    "will", "with", "i", "you", "we", "they", "he", "she", "his", "her", "their", "our", "my", "me", "him", "them", "us", "do", "does", "did", "but", "not", "no",
    "so", "if", "then", "than", "into", "about", "over", "under", "out",
]
STOPPED = frozenset(STOPWORDS)
CJK = re.compile("[\u4e00-\u9fff]")
WORD = re.compile("[a-z0-9]+|[\u4e00-\u9fff]")
#: ASCII letters and digits stay, letters in lower case; all other bytes part words.
_FOLD = bytes(ord(chr(c).lower()) if c < 0x80 and chr(c).isalnum() else 0x20 for c in range(256))


def tokenize(text: str) -> list[str]:
    """Lower-case words of two ASCII letters and digits or more, without stop words, and ideographs, of the NFKC form.

    Each ideograph is a token; after one that follows another, with nothing but other characters between, comes their pair.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
    if text.isascii() or not CJK.search(text):
        return [t for t in text.encode("utf-8", "replace").translate(_FOLD).decode().split() if len(t) > 1 and t not in STOPPED]
    out, before = [], ""
    for t in WORD.findall(text):
        if CJK.match(t):
            out += [t, before + t] if before else [t]
            before = t
        else:
            before = ""
            if len(t) > 1 and t not in STOPPED:
                out.append(t)
    return out


def tokens(text: Column) -> Column:
    """array<string> of the tokens of a text, in order; null gives none."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(tokenize)

    return run(F.coalesce(text, F.lit("")))


def counted(text: Column) -> Column:
    """struct<length, terms, tfs>: how many tokens a text has, and each different one with its count."""

    @F.pandas_udf("length int, terms array<string>, tfs array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [Counter(tokenize(t)) for t in texts]
        return pd.DataFrame({"length": [c.total() for c in found], "terms": [list(c) for c in found], "tfs": [list(c.values()) for c in found]})

    return run(F.coalesce(text, F.lit("")))


def query_terms(queries: DataFrame, repeats: bool = False) -> DataFrame:
    found = tokens(F.col("query"))
    return queries.select("query_id", F.explode(found if repeats else F.array_distinct(found)).alias("term"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best items of each query, ties by item."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

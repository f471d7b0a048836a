"""Operators under names of their own in SQL: functions of a text, and a table function of its private spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import distilling, lexical, personal, private, scrubbing


class PrivateSpans:
    """(start, end, name, severity) of the private spans of a text, in the order in which they win."""

    def __init__(self):
        self.finder = private.Finder(private.PATTERNS)

    def eval(self, text: str):
        for start, _, end, name, severity, _ in self.finder.find(text or ""):
            yield start, end, name, severity


def register(spark: SparkSession) -> list[str]:
    """Register lex_tokens, scrub_text, distill_text, private_signals and, for FROM or LATERAL, private_spans; gives the names.

    A null text has no tokens, signals and spans, distils to '' and stays null when scrubbed.
    """

    @F.pandas_udf("array<string>")
    def lex_tokens(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lexical.tokenize)

    @F.pandas_udf("string")
    def scrub_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else scrubbing.scrub(t)[0])

    @F.pandas_udf("string")
    def distill_text(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: distilling.distill(t)[0])

    @F.pandas_udf("array<string>")
    def private_signals(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(personal.signals)

    functions = {f.__name__: f for f in (lex_tokens, scrub_text, distill_text, private_signals)}
    for name, function in functions.items():
        spark.udf.register(name, function)
    spark.udtf.register("private_spans", F.udtf(PrivateSpans, returnType="start int, end int, name string, severity string"))
    return [*functions, "private_spans"]

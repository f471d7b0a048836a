"""Chinese personal names by two given tables: characters that open a surname and characters of given names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDEOGRAPHS = "[一-鿿]+"


def first_name(text: Column, surnames: str, given: str) -> Column:
    """The first run of two or three ideographs that starts with one of surnames and goes on with given alone, or null.

    A run is maximal: the same characters inside a longer run are no name. Each table is a string of its characters.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDEOGRAPHS), F.lit(0))
    fits = lambda r: F.length(r).between(2, 3) & F.contains(F.lit(surnames), F.substring(r, 1, 1)) & (F.translate(F.substring(r, 2, 2), given, "") == "")
    return F.try_element_at(F.filter(runs, fits), F.lit(1))


def measure(rows: DataFrame, text: str, is_name: str, surnames: str, given: str) -> DataFrame:
    """One row (tp, fp, fn, tn, precision, recall) of the detector against a boolean column; a null label counts as false.

    precision is null where nothing was found, recall where nothing is a name.
    """
    found, truth = first_name(F.col(text), surnames, given).isNotNull(), F.coalesce(F.col(is_name), F.lit(False))
    c = rows.select(found.alias("f"), truth.alias("t")).agg(*[F.count_if(x).alias(n) for n, x in (("tp", F.col("f") & F.col("t")), ("fp", F.col("f") & ~F.col("t")), ("fn", ~F.col("f") & F.col("t")), ("tn", ~F.col("f") & ~F.col("t")))])
    share = lambda other: F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), 6)
    return c.select("tp", "fp", "fn", "tn", share("fp").alias("precision"), share("fn").alias("recall"))

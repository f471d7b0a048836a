"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes, computed for all positions by doubling, marks cut points: a stricter mask below the
normal chunk size and a looser one above it keep sizes near the normal. Every text is cut twice, into coarse chunks of about
64 bytes and into fine ones of about 16. A fingerprint holds both sets of chunk digests with lengths; equal passages give
equal chunks wherever they stand. Likeness is the shared length over the smaller set's, at the scale where it is larger: fine
chunks follow edits of short texts, coarse ones are rarely alike by chance.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.ordered import bucket_of, quantile_bounds
from corpusmill.plans.runtime import bounded_batches, shuffle_partitions

#: (least, normal, most bytes, mask bits) of a chunk
COARSE, FINE = (16, 64, 256, 6), (4, 16, 64, 4)
WINDOW = 32
LENGTH = np.uint64(0x1FF)
GEAR = np.array([xxhash.xxh64_intdigest(bytes([i]), 0x6EA8) & 0xFFFFFFFF for i in range(256)], dtype=np.uint32)


def gear_hashes(raw: bytes) -> np.ndarray:
    """The gear hash that ends at each byte: the sum of table entries shifted by their distance, modulo 2^32."""
    h = GEAR[np.frombuffer(raw, dtype=np.uint8)]
    k = 1
    while k < WINDOW:
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h, k = longer, 2 * k
    return h


def cuts(h: np.ndarray, scale: tuple[int, int, int, int]) -> list[int]:
    """Ends of the chunks of a text whose bytes have these gear hashes."""
    n, (least, normal, most, bits) = len(h), scale
    if n <= least:
        return [n] if n else []
    loose = (np.flatnonzero(h < np.uint32(1 << (32 - bits + 1))) + 1).tolist()
    strict = (np.flatnonzero(h < np.uint32(1 << (32 - bits - 1))) + 1).tolist()
    out, start, a, b = [], 0, 0, 0
    loose.append(n)
    strict.append(n)
    while start < n:
        a = bisect_left(strict, min(start + least, n), a)
        end = strict[a]
        if end > start + normal:
            b = bisect_left(loose, min(start + normal, n), b)
            end = min(loose[b], start + most)
        out.append(end)
        start = end
    return out


def records(raw: bytes, h: np.ndarray, scale: tuple[int, int, int, int]) -> np.ndarray:
    """Distinct chunks in order as 64-bit numbers: 55 bits of the digest, then 9 of the length."""
    ends = cuts(h, scale)
    digest, starts = xxhash.xxh64_intdigest, [0, *ends[:-1]]
    found = np.fromiter((digest(raw[a:b]) for a, b in zip(starts, ends)), np.uint64, len(ends))
    sizes = np.diff(np.array([0, *ends])).astype(np.uint64)
    return np.unique(found & ~LENGTH | sizes)


def chunk_set(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(coarse, fine) chunks of a text of any length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    h = gear_hashes(raw)
    return records(raw, h, COARSE), records(raw, h, FINE)


def pack(chunks: tuple[np.ndarray, np.ndarray]) -> str:
    """Base 64 of both sets with a dot between; a text without bytes has the dot alone."""
    return ".".join(base64.b64encode(c.astype("<u8").tobytes()).decode() for c in chunks)


def unpack(fingerprint: str | None) -> tuple[np.ndarray, np.ndarray]:
    coarse, _, fine = (fingerprint or ".").partition(".")
    return np.frombuffer(base64.b64decode(coarse), dtype="<u8"), np.frombuffer(base64.b64decode(fine), dtype="<u8")


def containment(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Length of shared chunks over the smaller set's length, the larger of both scales; two empty texts are alike, one is like no other."""
    return max(map(shared_length, x, y))


def shared_length(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller set's length that lies in chunks of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = (a[b[at] == a] & LENGTH).sum(dtype=np.int64)
    return float(shared / min((a & LENGTH).sum(dtype=np.int64), (b & LENGTH).sum(dtype=np.int64)))


def fingerprint(text: Column) -> Column:
    """The packed chunk sets of each text; null and empty texts have '.'."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([pack(chunk_set(t)) for t in s], dtype=object)

    return run(text)


def likeness(a: Column, b: Column) -> Column:
    """Containment of two packed fingerprints, 0 to 1."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([containment(unpack(p), unpack(q)) for p, q in zip(x, y)], dtype=float)

    return run(a, b)


def compare(text: Column, edited: Column, following: Column) -> Column:
    """struct of both fingerprints and the likeness of the first text's to the other two's, each text chunked once."""

    @F.pandas_udf("fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows, seen = [], (None, None)
            for t, e, f in zip(*columns):
                own = seen[1] if seen[0] == t and seen[1] is not None else chunk_set(t)
                seen = f, chunk_set(f)
                other = chunk_set(e)
                rows.append((pack(own), pack(other), containment(own, other), containment(own, seen[1])))
            yield pd.DataFrame(rows, columns=["fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return run(text, edited, following)


def with_next(docs: DataFrame) -> DataFrame:
    """Add next_text, the text of the following row by descending doc_id; the first row follows the last.

    Null ids come last, repeated ids are ordered by text (null first). Texts move once, into buckets of neighbouring
    ids; the first row of a bucket also visits the bucket before it in this order.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    bounds = quantile_bounds(docs, "doc_id", 4 * n)
    placed = docs.select("doc_id", "text", bucket_of(F.col("doc_id"), bounds).alias("bucket_"))
    tops = sorted((r["bucket_"], r["top"]) for r in placed.groupBy("bucket_").agg(F.max("doc_id").alias("top")).collect())  # a row per bucket
    if not tops:
        return docs.select("doc_id", "text").withColumn("next_text", F.col("text"))
    host = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]
    hosts = F.broadcast(spark.createDataFrame(host, "top_ long, host_ int"))  # a row per bucket
    visits = placed.join(hosts, F.col("doc_id").eqNullSafe(F.col("top_")), "left")
    stay = F.struct(F.col("bucket_").alias("b"), F.lit(0).alias("guest"))
    visit = F.struct(F.col("host_").alias("b"), F.lit(1).alias("guest"))
    dealt = visits.withColumn("to_", F.explode(F.array_compact(F.array(stay, F.when(F.col("host_").isNotNull(), visit)))))
    dealt = dealt.select("doc_id", "text", F.col("to_.b").alias("b"), F.col("to_.guest").alias("guest")).repartition(n, "b")
    order = Window.partitionBy("b").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def edit_test(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited form, whose last third comes from the next document, and compare.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next; null texts count
    as empty; texts of any length are chunked whole; every row of docs, repeated ones too, has one row; no rows give no
    rows. Other columns of docs are not read, so that no name can clash.
    """
    bounded_batches(docs.sparkSession, 256)
    pairs = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    size, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - third), F.substr("next_text", F.lit(1), third))
    pairs = pairs.select("doc_id", size.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    found = pairs.withColumn("c", compare(F.col("text"), F.col("edited"), F.col("next_text")))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "c.*")

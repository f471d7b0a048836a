"""A kept inverted index: written once, read by the buckets of a query's terms, updated by the buckets that a change touches.

Three tables under one path. documents holds each document's length, terms and counts, in parts by id; postings holds what
documents have of each term, in buckets by term and sorted by term and group of documents; headers holds, in the same buckets, a
row for each term and group (a block of postings): how many there are, the largest count and the smallest length. From these
follow document frequencies and the most that any posting of the block can add to a score, whatever the average length, so
that neither needs a posting.

Texts are read when the index is written. A query table is joined with the buckets of its terms, never looped over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import lexical
from corpusmill.operators.pairing import small
from corpusmill.plans.runtime import bounded_batches, checkpoint, delete

BUCKETS, PARTS = 32, 16
GROUP_DOCS = 64
DYNAMIC = {"partitionOverwriteMode": "dynamic"}


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _forward(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, length, terms, tfs) with one row for each id: rows of one id add up, those without an id are left out."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    several = checkpoint(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    found = lambda df: df.select("doc_id", lexical.counted(F.col("text")).alias("c")).select("doc_id", "c.*")
    if several.isEmpty():
        return found(rows)
    split = found(rows.join(several, "doc_id")).select("doc_id", F.inline_outer(F.arrays_zip("terms", "tfs")))
    summed = split.groupBy("doc_id", "terms").agg(F.sum("tfs").cast("int").alias("tfs")).withColumn("one", F.when(F.col("terms").isNotNull(), F.struct("terms", "tfs")))
    whole = summed.groupBy("doc_id").agg(F.coalesce(F.sum("tfs"), F.lit(0)).cast("int").alias("length"), F.collect_list("one").alias("c"))
    return found(rows.join(several, "doc_id", "left_anti")).unionByName(whole.select("doc_id", "length", F.col("c.terms").alias("terms"), F.col("c.tfs").alias("tfs")))


@dataclass(frozen=True)
class LexIndex:
    """An index at a path that all of the cluster sees. kind is the type of its ids; groups, buckets and parts are fixed when it is written."""

    spark: SparkSession
    path: str
    groups: int
    kind: str
    buckets: int = BUCKETS
    parts: int = PARTS

    def _documents(self) -> DataFrame:
        schema = f"doc_id {self.kind}, length int, terms array<string>, tfs array<int>, part int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/documents")

    def _postings(self) -> DataFrame:
        schema = f"term string, grp int, doc_id {self.kind}, tf int, length int, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings")

    def _headers(self) -> DataFrame:
        return self.spark.read.schema("term string, grp int, n int, max_tf int, min_length int, bucket int").parquet(f"{self.path}/headers")

    def documents(self) -> DataFrame:
        """(doc_id, length, terms, tfs) of all documents; length counts terms with repeats."""
        return self._documents().drop("part")

    def stats(self) -> DataFrame:
        """(n, avgdl) of one row: documents that have a term, and their mean length."""
        return self.spark.read.parquet(f"{self.path}/stats")

    def buckets_of(self, terms: DataFrame) -> list[int]:
        """The buckets where terms (term) lie, at most as many numbers as there are buckets."""
        return sorted(r["b"] for r in terms.select(_bucket("term", self.buckets).alias("b")).distinct().collect())

    def headers(self, buckets: list[int]) -> DataFrame:
        """(term, grp, n, max_tf, min_length) of all blocks in some buckets; no other bucket is read."""
        return self._headers().where(F.col("bucket").isin(buckets) if buckets else F.lit(False)).drop("bucket")

    def hits(self, buckets: list[int]) -> DataFrame:
        """(term, grp, doc_id, tf, length) of all postings in some buckets; no other bucket is read."""
        return self._postings().where(F.col("bucket").isin(buckets) if buckets else F.lit(False)).drop("bucket")

    def postings(self) -> DataFrame:
        """(doc_id, term, tf) of all terms."""
        return self.documents().select("doc_id", F.inline(F.arrays_zip("terms", "tfs"))).select("doc_id", F.col("terms").alias("term"), F.col("tfs").alias("tf"))

    def _write_stats(self) -> None:
        some = self.documents().where("length > 0")
        checkpoint(some.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats")

    def _write_documents(self, rows: DataFrame) -> None:
        placed = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int"))
        placed.hint("rebalance", "part").write.partitionBy("part").mode("overwrite").options(**DYNAMIC).parquet(f"{self.path}/documents")

    def _write_postings(self, rows: DataFrame, buckets: list[int] | None = None) -> None:
        """rows (bucket, term, grp, doc_id, tf, length), and their headers; buckets, if given, are all that rows can be in.

        Every task writes its rows in order into a file of each bucket, so that postings are not shuffled. Blocks are counted
        from what was written.
        """
        ordered = rows.sortWithinPartitions("bucket", "term", "grp")
        ordered.write.partitionBy("bucket").mode("overwrite").options(**DYNAMIC).parquet(f"{self.path}/postings")
        back = self._postings() if buckets is None else self._postings().where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        heads = back.groupBy("bucket", "term", "grp").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))
        heads.sortWithinPartitions("bucket", "term", "grp").write.partitionBy("bucket").mode("overwrite").options(**DYNAMIC).parquet(f"{self.path}/headers")

    def _spread(self, rows: DataFrame) -> DataFrame:
        """A row for each term of a document, with the bucket and the group where its posting lies."""
        flat = rows.select("doc_id", "length", F.inline(F.arrays_zip("terms", "tfs")))
        grp = F.pmod(F.xxhash64("doc_id", F.lit("group")), F.lit(self.groups)).cast("int")
        return flat.select(_bucket("terms", self.buckets).alias("bucket"), F.col("terms").alias("term"), grp.alias("grp"), "doc_id", F.col("tfs").alias("tf"), "length")

    def update(self, changed: DataFrame, removed: DataFrame, doc_id: str, text: str) -> list[int]:
        """Put in documents that were changed or added (doc_id, text) and take out others (doc_id); gives the buckets rewritten.

        Only buckets of terms that an affected document had or has now are read and written again, and only its parts of
        documents. What is written is checkpointed first, so that a lost executor never reads a half-replaced bucket; a driver
        that dies between the two tables leaves an index to be written anew.
        """
        bounded_batches(self.spark)
        new = checkpoint(_forward(changed, doc_id, text))
        gone = new.select("doc_id").union(removed.select(F.col(doc_id).alias("doc_id"))).where("doc_id IS NOT NULL").distinct()
        part = F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int")
        parts = [r["p"] for r in gone.select(part.alias("p")).distinct().collect()]  # as many as there are parts at most
        before = self._documents().where(F.col("part").isin(parts) if parts else F.lit(False)).drop("part")
        old = checkpoint(before.join(gone, "doc_id", "left_semi"))
        touched = self._spread(old.unionByName(new)).select("bucket").distinct()
        buckets = sorted(r["bucket"] for r in touched.collect())  # as many as there are buckets at most
        kept = self._postings().where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        kept = kept.join(gone, "doc_id", "left_anti").select("bucket", "term", "grp", "doc_id", "tf", "length")
        rows = checkpoint(kept.unionByName(self._spread(new)))
        documents = checkpoint(before.join(gone, "doc_id", "left_anti").unionByName(new))
        for name, column, numbers, left in (("postings", "bucket", buckets, rows), ("headers", "bucket", buckets, rows), ("documents", "part", parts, documents.withColumn("part", part))):
            still = {r[0] for r in left.select(column).distinct().collect()}
            for number in set(numbers) - still:  # an emptied folder is not overwritten by a dynamic write
                delete(self.spark, f"{self.path}/{name}/{column}={number}")
        self._write_postings(rows, buckets)
        self._write_documents(documents)
        self._write_stats()
        return buckets


def write_index(docs: DataFrame, doc_id: str, text: str, path: str, buckets: int = BUCKETS, parts: int = PARTS) -> LexIndex:
    """Index documents under a path that did not exist. Rows of one id add up; null texts have no terms; rows without id are left out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    index = LexIndex(spark, path, 1, kind, buckets, parts)
    index._write_documents(_forward(docs, doc_id, text))
    index._write_stats()
    n = index.stats().first()["n"]
    index = LexIndex(spark, path, max(1, -(-n // GROUP_DOCS)), kind, buckets, parts)
    index._write_postings(index._spread(index.documents()))
    return index


def impact(tf: Column, length: Column, avgdl: Column) -> Column:
    """What a term of weight one adds to a document's score; grows with tf and falls with length."""
    k1, b = lexical.K1, lexical.B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


@dataclass(frozen=True)
class Asked:
    """A query table met with an index: its terms (query_id, term, df, idf), df null for unknown ones, and their buckets."""

    index: LexIndex
    terms: DataFrame
    buckets: list[int]
    avgdl: float

    def known(self) -> DataFrame:
        """(query_id, term, idf) of the terms that some document has, for broadcast if they are few."""
        return small(self.terms.where("df IS NOT NULL").select("query_id", "term", "idf"))

    def scores(self, groups: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score, matched, part); given (query_id, grp), of these groups alone. part is the idf mass matched."""
        hits = self.index.hits(self.buckets).join(self.known(), "term")
        hits = hits if groups is None else hits.join(small(groups), ["query_id", "grp"])
        add = F.col("idf") * impact(F.col("tf"), F.col("length"), F.lit(self.avgdl))
        return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(add), 6).alias("score"), F.count("*").alias("matched"), F.sum("idf").alias("part"))


def ask(queries: DataFrame, index: LexIndex, repeats: bool = False) -> Asked:
    """Meet queries (query_id, query) with the index; with repeats a term counts as often as its query has it."""
    bounded_batches(queries.sparkSession)
    asked = checkpoint(lexical.query_terms(queries, repeats))
    buckets = index.buckets_of(asked)
    df = index.headers(buckets).groupBy("term").agg(F.sum("n").alias("df"))
    stats = index.stats().first()
    n, known = F.lit(stats["n"]), F.coalesce("df", F.lit(0))
    idf = F.ln((n - known + 0.5) / (known + 0.5) + 1)
    terms = checkpoint(df.join(small(asked), "term", "right").select("query_id", "term", "df", idf.alias("idf")))
    return Asked(index, terms, buckets, stats["avgdl"] or 1.0)


FIRST_GROUPS = 4
MARGIN = 1e-5


def bounds(asked: Asked) -> DataFrame:
    """(query_id, grp, bound): the most that a document of the group can score, from headers alone."""
    most = F.col("idf") * impact(F.col("max_tf"), F.col("min_length"), F.lit(asked.avgdl))
    return asked.index.headers(asked.buckets).join(asked.known(), "term").groupBy("query_id", "grp").agg(F.sum(most).alias("bound"))


def open_groups(asked: Asked, k: int) -> tuple[DataFrame, DataFrame]:
    """(scores of the first groups, (query_id, grp) of the others that can still hold one of the k best).

    The FIRST_GROUPS groups of highest bound are scored; the k-th best score among them is the query's bar, and groups whose
    bound is under it (by more than rounding) are left out.
    """
    all_bounds = checkpoint(bounds(asked))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "grp")
    first = checkpoint(all_bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST_GROUPS).select("query_id", "grp"))
    scored = checkpoint(asked.scores(first))
    bar = lexical.top_k(scored, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    rest = all_bounds.join(first, ["query_id", "grp"], "left_anti").join(bar, "query_id", "left")
    return scored, checkpoint(rest.where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - MARGIN)).select("query_id", "grp"))


def best(queries: DataFrame, index: LexIndex, k: int, repeats: bool = False, skip: bool = True) -> DataFrame:
    """(query_id, doc_id, score, matched, part, rank): the k best documents of each query, equal to ranking all scores.

    Ties by doc_id. With skip, blocks under a query's bar are not scored, which pays for queries of few terms; the bar of a
    long query is hardly ever above a bound, and ranking all scores at once is then the cheaper way to the same rows.
    """
    asked = ask(queries, index, repeats)
    if not skip:
        return lexical.top_k(asked.scores(), k)
    scored, still = open_groups(asked, k)
    return lexical.top_k(scored.unionByName(asked.scores(still)), k)


def bm25(queries: DataFrame, index: LexIndex, repeats: bool = False, least: int = 1) -> DataFrame:
    """(query_id, doc_id, score, matched) for every document that shares least terms with a query; score to 6 digits.

    With repeats a query term counts as often as the query has it, otherwise once.
    """
    asked = ask(queries, index, repeats)
    scored = asked.scores().drop("part")
    return scored.where(F.col("matched") >= least) if least > 1 else scored


def known_term_ratio(queries: DataFrame, index: LexIndex) -> DataFrame:
    """(query_id, n_known, ratio): the idf-weighted share of query terms that the corpus has; an unknown term weighs most."""
    terms = ask(queries, index).terms
    known = F.sum(F.when(F.col("df").isNotNull(), F.col("idf")).otherwise(0.0))
    return terms.groupBy("query_id").agg(F.count("df").alias("n_known"), F.round(known / F.sum("idf"), 6).alias("ratio"))


def idf_coverage(queries: DataFrame, index: LexIndex) -> DataFrame:
    """(query_id, coverage, matched): the best single document's share of the query's idf mass, and most terms matched."""
    asked = ask(queries, index)
    mass = asked.terms.where("df IS NOT NULL").groupBy("query_id").agg(F.sum("idf").alias("mass"))
    found = asked.scores().groupBy("query_id").agg(F.max("part").alias("part"), F.max("matched").alias("matched"))
    return found.join(mass, "query_id").select("query_id", F.round(F.col("part") / F.col("mass"), 6).alias("coverage"), "matched")

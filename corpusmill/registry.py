"""Register of queries and of their DuckDB SQL, and the inputs that many of them share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import lex_index, lexical
from corpusmill.plans.runtime import ensure_checkpoint_dir
from corpusmill.sources.views import FACTS_SQL, LOG_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STOP_SQL = ", ".join(f"'{w}'" for w in lexical.STOPWORDS)


def tok_sql(col: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({STOP_SQL}))"


INDEX_SQL = f"""
tok AS (SELECT doc_id, unnest({tok_sql('text')}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT doc_id, sum(tf) AS length FROM post GROUP BY 1),
st AS (SELECT count(*) AS n, avg(length) AS avgdl FROM len),
idf AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM post, st GROUP BY 1),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({tok_sql('text')}) AS term FROM benchmark),
bm AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))), 6) AS score, count(*) AS matched
  FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2)
"""
VEC_SQL = """
e AS (SELECT vec_id AS fact_id, embedding::DOUBLE[] AS v, label, vec_id % 90 AS age_days FROM embeddings),
cs AS (SELECT q.fact_id AS query_id, e.fact_id, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS cosine
  FROM e q JOIN e ON q.fact_id % 50 = 0 AND q.fact_id <> e.fact_id)
"""


def on_facts(name: str, sql: str):
    return register(name, f"WITH {FACTS_SQL} {sql}")


def on_log(name: str, sql: str):
    return register(name, f"WITH {LOG_SQL} {sql}")


def on_index(name: str, sql: str):
    return register(name, f"WITH {INDEX_SQL} {sql}")


def register(name: str, sql: str | None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


_KEPT: dict[tuple, lex_index.LexIndex] = {}


def kept_index(s: SparkSession, d: str, name: str = "documents") -> lex_index.LexIndex:
    """The index of a corpus, written once for a session and for the files that its table has now.

    documents are texts by doc_id; conversations are turns by number, of which the first 200 characters count.
    """
    rows = table(s, d, name)
    f = F.col("_metadata")
    files = rows.select(f["file_path"].alias("p"), f["file_size"].alias("n"), f["file_modification_time"].cast("long").alias("t")).distinct()
    state = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("p", "n", "t")).alias("h")).first()
    key = s.sparkContext.applicationId, name, state["n"], state["h"]
    if key not in _KEPT:
        if name == "conversations":
            rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.substring("text", 1, 200).alias("text"))
        ensure_checkpoint_dir(s)
        _KEPT[key] = lex_index.write_index(rows, "doc_id", "text", f"{s.sparkContext.getCheckpointDir()}/lex-{uuid.uuid4().hex}")
    return _KEPT[key]


def emb(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding", "label", (F.col("vec_id") % 90).alias("age_days"))


def query_vectors(s: SparkSession, d: str) -> DataFrame:
    return emb(s, d).where(F.col("fact_id") % 50 == 0).select(F.col("fact_id").alias("query_id"), "embedding")

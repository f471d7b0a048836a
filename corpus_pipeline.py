"""Corpus pipeline: language ID, SimHash near-dedup, mixing sources to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever further columns these have. The first stage
rejects a text that is null, has no letter or is in no learned language (language_id.keep_known; where nothing is labelled,
every text with a letter stays); the second keeps the smallest doc_id of each near-duplicate class; the third repeats
documents by source (a document drawn 0 times goes, one drawn twice appears twice); the last returns a row of token
digests per document. Empty tables pass all stages; nulls, repeated rows and very long texts are as the operators say.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import language_id, mixing, simhash
from corpusmill.llm.queries import PIECE_FILE, bpe_digest
from corpusmill.plans.runtime import delete, ensure_checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose text is in a learned language."""
    return language_id.keep_known(docs, public_tokenizers.path(PIECE_FILE))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash class."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents by source to the target weights, in a global random order."""
    return mixing.replicate(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe_digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: No stage but mixing can be put in SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared checkpoint folder and read again.

    A stage's table goes once the next one is written; the last one stays, since the result reads it.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs

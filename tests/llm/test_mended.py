"""Cases that operators once treated by size, by order or by chance of a name."""

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ann, bpe, cdc, language_id, mixing, token_counts
from corpusmill.llm import queries as Q


def test_mixing_sql_holds_for_rare_sources_and_rows_without_ids(spark):
    rows = [(k if k % 3 else None, f"text {k % 700} " + "x" * (k % 50), "large") for k in range(4000)] + [(10_000, "x" * 10, "small"), (10_001, None, "small"), (None, None, None), (7, "again", "large"), (7, "again", "large")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.lit(1).cast("long")}).select("doc_id", "text", "lang", "source", "n_chars")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    columns = "doc_id, text, source, n_copies, replica, shuffle_key"
    assert mixing.rates(docs).agg(F.max("rate")).first()[0] > 20
    got = mixing.mix(docs).selectExpr(*columns.split(", ")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(f"select {columns} from ({mixing.ORACLE_SQL})").fetchall()))


def test_mixing_spreads_rows_of_one_id(spark):
    rows = spark.range(0, 20_000, 1, 16).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text"), F.lit("a").alias("source"))
    sizes = [r["n"] for r in mixing.mix(rows, epochs=3.0).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) % 20_000 == 0 and (not sizes or max(sizes) < 0.6 * sum(sizes))


def near_group(rng, n, cosine=0.97):
    base, noise = ann.unit(rng.normal(size=(1, 64))), ann.unit(rng.normal(size=(n, 64)))
    return ann.unit(np.sqrt(cosine) * base + np.sqrt(1 - cosine) * noise)


@pytest.mark.parametrize("size", [65, 66, 67, 300])
def test_flat_graph_counts_crowded_rows_from_both_ends(spark, monkeypatch, size):
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    rng = np.random.default_rng(size)
    x = np.concatenate([near_group(rng, size), ann.unit(rng.normal(size=(300, 64)))])
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in ann.near_duplicates(table).collect()}
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert sum(min(got[k], n) for k, n in enumerate(true)) >= 0.99 * true.sum() and all(got[k] <= n for k, n in enumerate(true))


def test_flat_graph_audit_in_blocks_asks_for_all(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([near_group(rng, 200), ann.unit(rng.normal(size=(600, 64)))])
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(3, x[3].tolist()), (5000, [1.0, 0.0]), (5010, [1.0, 0.0]), (5020, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = spark.createDataFrame([(k, int(n)) for k, n in enumerate(((x @ x.T >= 0.9).sum(axis=1) - 1) // 2)] + [(5000, 1), (5010, 0), (5020, 0)], "vec_id long, n_links long")
    whole = ann.audit(table, found, every=10)
    assert 0.4 < whole < 0.6 and ann.audit(table, found, every=10, most=7) == whole


def test_chunks_have_one_rule_at_every_size():
    words = np.random.default_rng(2).integers(97, 123, 4000).astype(np.uint8).tobytes().decode()
    for n in (0, 1, 15, 1023, 1024, 1025, 4000):
        coarse, fine = cdc.chunk_set(words[:n])
        assert (len(coarse) > 0) == (len(fine) > 0) == (n > 0)
    near = [cdc.containment(cdc.chunk_set(words[:n]), cdc.chunk_set(words[: n - n // 3] + "#" * (n // 3))) for n in range(900, 1150, 5)]
    assert max(abs(a - b) for a, b in zip(near, near[1:])) < 0.1 and min(near) > 0.5


def test_token_counts_with_given_probabilities_do_not_depend_on_the_table(spark):
    path = P.path(Q.PIECE_FILE)
    docs = spark.createDataFrame([(k, f"some words of text {k} and more") for k in range(50)], "doc_id long, text string")
    pieces = spark.sparkContext.broadcast(token_counts.read_pieces(path, lower=False))
    log_p = token_counts.estimate(docs, "text", pieces, None)
    key = lambda d: {r["doc_id"]: (r["n_tokens"], r["log_p"]) for r in d.collect()}
    whole, one = key(token_counts.count_tokens(docs, path, log_p=log_p)), key(token_counts.count_tokens(docs.where("doc_id = 7"), path, log_p=log_p))
    assert one[7] == pytest.approx(whole[7]) and key(token_counts.count_tokens(docs, path, sample_docs=None))[7] == pytest.approx(whole[7])


def test_bpe_keeps_a_column_of_the_name_it_works_under(spark):
    docs = spark.createDataFrame([(1, "a text", 5), (2, None, 6)], "doc_id long, text string, bpe_ int")
    out = bpe.encode_decode(docs, P.path(Q.BPE_FILE))
    assert out.columns == ["doc_id", "text", "bpe_", "bpe_ids", "bpe_ends", "bpe_decoded"] and sorted(r["bpe_"] for r in out.collect()) == [5, 6]
    assert bpe.encode_decode(docs.limit(0), P.path(Q.BPE_FILE)).count() == 0


def test_lattices_of_vocabularies_with_a_common_start():
    class Held:
        def __init__(self, value):
            self.value = value

    a, b = [f"p{k}" for k in range(60)], [f"p{k}" for k in range(59)] + ["zz"]
    assert language_id._lattice(Held(a)).trie.piece.shape == language_id.Lattice(a).trie.piece.shape
    assert len(language_id._lattice(Held(b)).trie.piece) == len(language_id.Lattice(b).trie.piece) != len(language_id.Lattice(a).trie.piece)

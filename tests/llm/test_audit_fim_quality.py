"""Divergence audit, fill-in-middle and quality ranking: plain versions, odd rows, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import divergence, fim, quality
from corpusmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_audit(rows, min_docs, top):
    """The audit from its definition, with dense tables."""
    groups, counts, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    share = lambda count, n, v: 1 + 1_000_000_000 * (count + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        own = sorted(s for g, s in groups if g == lang)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in own}
        p = {s: [share(counts[lang, s][t], n[s], len(kept)) for t in kept] for s in own}
        total = [sum(counts[lang, s][t] for s in own) for t in kept]
        q = [share(c, sum(total), len(kept)) for c in total]
        for s in own:
            pairs = sorted(((-sum(map(f, p[s], p[o])), o) for o in own if o != s), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, o) in enumerate(pairs)]
            best = sorted((-f(a, b), t) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] and a > b)
            best.sort(key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "term", t, -v, r + 1) for r, (v, t) in enumerate(best[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "Été", "straße", "漢字", "ЖЖ", "a", "I", "zeta"] + [f"w{chr(97 + k)}x" for k in range(20)]
    rows = []
    for k in range(300):
        lang, source = rnd.choice(["en", "de", "", None]), rnd.choice(["a", "b", "é", "zz", None])
        size = 0 if k % 50 == 0 else rnd.randrange(12)
        rows.append((k, " ".join(rnd.choice(words[: 30 if source == "a" else 12]) + rnd.choice(["", ".", "-7", "@x"]) for _ in range(size)), lang, source, 0))
    rows += [(900, None, "en", "only", 0), (901, "", "xx", "lonely", 0), (902, "one text alone", "yy", "q", 0), (903, "Beta beta BETA " * 20_000, "en", "a", 0)]
    return rows + [(904, "the same row", "en", "b", 0)] * 12


def test_audit_equals_plain_version(spark, texts):
    df = spark.createDataFrame(texts, DOCS).withColumns({c: F.lit(7) for c in ("term", "n", "docs", "total", "value", "rank", "item", "part", "v", "mass", "low")})
    for min_docs, top in ((10, 10), (3, 2)):
        found = sorted(tuple(r) for r in divergence.audit(df, min_docs, top).collect())
        assert found == plain_audit([r[1:4] for r in texts], min_docs, top)
    assert divergence.audit(df.limit(0)).count() == 0


def test_audit_sums_do_not_depend_on_what_a_task_holds(spark, texts, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", 5)
    rows = [("en", "a", b) for b in ("x y z x", "x q", "", "漢 q")]
    batch = divergence.pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["lang", "source", "text"]).assign(text=lambda d: d["text"].str.encode("utf-8")), preserve_index=False)
    got = Counter()
    for b in divergence._counted(iter([batch])):
        for t, n, d in zip(*(b.column(c).to_pylist() for c in ("term", "n", "docs"))):
            got[t] += n * 100 + d
    assert got == {b"x": 302, b"y": 101, b"z": 101, b"q": 202, "漢".encode(): 101}


def test_skyband_keeps_what_fewer_than_k_dominate():
    rnd = np.random.default_rng(2)
    for size, k in ((1, 1), (40, 1), (300, 3), (300, 10)):
        gain, cost = rnd.integers(1, 8, size), rnd.integers(1, 8, size)
        names = np.array([f"t{x:04}".encode() for x in rnd.permutation(size)] + [None], dtype=object)[:-1]
        dominators = [sum(gain[j] >= gain[i] and cost[j] <= cost[i] and names[j] < names[i] for j in range(size)) for i in range(size)]
        assert sorted(divergence.skyband(gain, cost, names, k)) == [i for i in range(size) if dominators[i] < k]


def test_bands_in_small_runs_give_the_same_terms(spark, texts, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ROWS", 6)
    rows = pd.DataFrame({"lang": "en", "source": [("a", "b", "c")[k % 3] for k in range(200)], "term": [f"t{(k * 37) % 200:03}".encode() for k in range(200)], "n": [k * 7 % 31 for k in range(200)], "total": [k * 11 % 17 for k in range(200)]})
    band = pd.concat(divergence._banded(3)(iter([rows[:50], rows[50:120], rows[:0], rows[120:]])))
    for key, own in rows.groupby("source"):
        best = own.iloc[divergence.skyband(own["n"].to_numpy(), own["total"].to_numpy(), own["term"].to_numpy(), 3)]
        assert set(best["term"]) <= set(band.loc[band["source"] == key, "term"])


def test_share_is_exact_for_large_counts(spark):
    rows = [(0, 1), (7, 20), (10**12, 3 * 10**15), (9 * 10**14, 9 * 10**14 + 2), (123456789012345, 8999999999999999)]
    df = spark.createDataFrame(rows, "c long, m long").select("c", "m", divergence.share("c", "m").alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 2) // r["m"] for r in df.where("m > 2").collect())


def test_fim_sql_and_odd_rows(spark):
    odd = ["", None, "x", "é漢🙂", "a<P>b", "<S>", "no <M> here", "< P>", "<P", "M>" * 5, "<" * 50, "line\n" * 9, "\x00\x01", "word " * 100_000, "🙂" * 999]
    rows = [(k, odd[k % len(odd)], "en", "a", 0) for k in range(600)] + [(None, "no id", None, None, None)] * 2 + [(5, "twice", "en", "a", 0)] * 2
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, fim.digests(df.select("doc_id", "text")).drop("text").collect()), key=str)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    assert got == sorted(con.sql(fim.ORACLE_SQL).fetchall(), key=str)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}
    assert all(r[6] == hashlib.sha256((t or "").encode()).hexdigest() for r, t in ((r, dict((x[0], x[1]) for x in rows)[r[0]]) for r in got if r[0] not in (None, 5)))
    assert fim.digests(df.limit(0)).count() == 0


def test_fim_output_goes_back_to_the_text(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"form": F.lit("mine"), "fim_text": F.lit(1), "fim_": F.lit(2), "restored": F.lit(3)})
    out = fim.restore(fim.transform(df, seed="9", fim_share=50, spm_share=50))
    assert out.where("NOT (restored <=> coalesce(text, ''))").count() == 0 and out.where("fim_ = 2").count() == df.count()
    forms = {r["form"]: r for r in out.collect()}
    assert set(forms) == {"plain", "psm", "spm"} and forms["psm"]["fim_text"].startswith("<P>") and forms["spm"]["fim_text"].startswith("<S>")
    r = forms["psm"]
    a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
    assert r["fim_text"] == f"<P>{r['text'][:a]}<S>{r['text'][b:]}<M>{r['text'][a:b]}"


def test_piece_table_cuts_and_permutes():
    text = "aé漢bc".encode()
    whole = [fim.Piece(fim.TEXT, 0, 3), fim.Piece(fim.TEXT, 3, len(text) - 3)]
    for at in range(len(text) + 1):
        before, after = fim.cut(whole, at)
        assert b"".join(fim.slices(before, text)) == text[:at] and b"".join(fim.slices(after, text)) == text[at:]
    assert fim.digest(whole, text) == hashlib.sha256(text).hexdigest()


def plain_features(text: str) -> dict:
    words = text.split(" ")
    return {"again": sum(a == b for a, b in zip(words, words[1:])) / len(words), "distinct": len(set(words)) / len(words), "top": max(Counter(words).values()) / len(words)}


def test_features_of_words_and_of_long_texts(monkeypatch):
    rnd = random.Random(1)
    for _ in range(20):
        text = " ".join(rnd.choice(["the", "the", "Cat", "DOG!!", "é", "x|", "9"]) for _ in range(rnd.randrange(1, 60)))
        x, k = quality.describe([b"", text.encode(), b"other"])[1], 7 + len(quality.SIGNS)
        p = plain_features(text)
        assert np.allclose(x[[k, k + 1, k + 3]] ** 2, [p["again"], p["distinct"], p["top"]])
        assert np.isclose(x[k + 12 :] @ x[k + 12 :], 1) and np.isclose(x[:6] @ x[:6], (len(text) - text.count(" ")) / max(1, len(text) - text.count(" ")))
    long = ("the Cat and é 漢 the the\n" * 4000).encode()
    want = quality.describe([long, b"x"])
    monkeypatch.setattr(quality, "CHUNK", 1000)
    got = quality.describe([long, b"x"])
    assert np.allclose(np.delete(got, 7 + len(quality.SIGNS) + 11, axis=1), np.delete(want, 7 + len(quality.SIGNS) + 11, axis=1)) and np.allclose(got, want, atol=0.05)


def test_newton_finds_the_least_loss():
    rnd = np.random.default_rng(4)
    good, bad = rnd.normal(0.5, 1, (30, 3)), rnd.normal(0, 1, (12, 3))
    pairs = quality.differences(good, bad)
    assert len(pairs) == 30 * 8 and {tuple(p) for p in pairs} <= {tuple(g - b) for g in good for b in bad}
    assert np.array_equal(quality.differences(bad, good), -pairs)
    assert len({tuple(p) for p in pairs}) == len(pairs)
    assert len(quality.differences(good[:2], bad[:1])) == 2


def test_quality_separates_held_out_rows(spark):
    rows = Q.op13_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum((r["quality"] == 1) == (r["score"] >= 0.7) == (r["predicted"] == 1) for r in rows) >= 0.95 * len(rows)
    assert {r["held_out"] for r in rows} == {True, False}


def test_quality_reads_text_and_permitted_labels_only(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0)})
    a = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, keep=["doc_id"]).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.classify(other, turned, keep=["doc_id"]).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_quality_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    odd = spark.createDataFrame([(None, "no id", "en", "a", 1), (70_001, None, None, None, None), (70_002, "", "en", "a", 0), (70_003, "word " * 300_000, "en", "a", 1), (70_003, "word " * 300_000, "en", "a", 1), (70_004, "x" * 3_000_000, "en", "a", 1)], DOCS)
    both = docs.unionByName(odd).withColumns({c: F.lit(777.0) for c in ("score", "x", "held", "row_", "mix", "quality", "label")})
    more = labels.unionByName(spark.createDataFrame([(None, 1), (70_002, None), (70_003, 1), (70_003, 0), (70_001, 5)], "doc_id long, quality int"))
    out = quality.classify(both, more)
    assert out.columns == [c for c in both.columns if c != "score"] + ["held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == docs.count() + 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["mix"] == 777.0 for r in rows)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {(r["score"], r["predicted"]) for r in quality.classify(odd, labels.where("quality = 1")).collect()} == {(0.5, 0)}
    assert quality.classify(docs, labels.limit(0)).where("score <> 0.5").count() == 0

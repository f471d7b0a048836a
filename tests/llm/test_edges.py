"""Skewed, odd and clashing inputs of the training-data operators, each with the values it must give."""

import glob
import random

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import ann, cdc, language_id, licenses, mixing, sharding, simhash, token_counts, wrappers
from corpusmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
PIECES = P.path(Q.PIECE_FILE)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use themselves
CLASH = "cdf source_ ident row_ u rate n_copies replica shuffle_key score fit lang_pred held_out lang_ fp fp_ c component_id shard slot at rank count_ n_tokens log_p bpe_ids id low".split()


@pytest.fixture(scope="module")
def few(spark):
    rows = [(k, f"the of and to in word{k} of the and that is was number {k} " + "x" * (k % 7), "en", "ab"[k % 2], 0) for k in range(40)]
    rows += [(100 + k, None if k % 2 else "", None, None, None) for k in range(4)] + [(None, "the of and without an id", "en", "a", 1)] * 2
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(777.0) for c in CLASH})


def untouched(df):
    return df.where(" OR ".join(f"`{c}` <> 777.0 OR `{c}` IS NULL" for c in CLASH)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:3], ids=lambda x: x if isinstance(x, str) else "")
def test_stages_keep_columns(spark, few, name, stage):
    out = stage(spark, few, SF)
    assert out.columns == few.columns and untouched(out) and out.count() > 0
    assert stage(spark, few.limit(0), SF).count() == 0


def test_last_stage_has_a_row_for_each_document(spark, few):
    out = corpus_pipeline.STAGES[3][1](spark, few, SF).collect()
    assert len(out) == few.count() and {r["n_tokens"] for r in out if r["doc_id"] in (100, 101, 102, 103)} == {0}


def test_language_stage_keeps_texts_when_nothing_is_labelled(spark):
    rows = [(k, f"some good text {k}", None, "a", 1) for k in range(5)] + [(5, "!!! 123", None, "a", 1), (6, None, None, "a", 1)]
    out = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, DOCS), SF)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3, 4]


def test_language_stage_rejects_what_is_in_no_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, "xqzkv wwqj qqzx vvkq jjqz zzxq kqvz wqxj", None, "a", 1), (10_002, "漢字 記号 文章 漢字", None, "a", 1)], DOCS)
    out = corpus_pipeline.identify_language(spark, docs.unionByName(odd), SF)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}


def test_languages_of_repeated_and_null_ids_stay_bounded(spark):
    rows = [(None, f"the text number {k} of no id", "en", "a", 1) for k in range(400)]
    pieces = spark.sparkContext.broadcast(["▁the", "▁text", "t", "e"])
    langs, model = language_id.train(spark.createDataFrame(rows, DOCS), pieces, 40)
    assert langs == ["en"] and np.allclose(np.exp(model).sum(axis=0), 1)


def test_mixing_counts_do_not_depend_on_other_columns(few):
    plain = few.select("doc_id", "text", "lang", "source", "n_chars")
    key = lambda df: sorted(str(tuple(r)) for r in df.select("doc_id", "text").collect())
    assert key(mixing.replicate(few)) == key(mixing.mix(plain))
    assert mixing.mix(few).columns[-4:] == list(mixing.ADDED)


def test_mixing_max_rate_fills_other_sources(spark):
    rows = [(k, "x" * 10, "large") for k in range(1000)] + [(2000 + k, "x" * 10, "mid") for k in range(100)] + [(3000 + k, "x" * 10, "small") for k in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rate = {r["source"]: r["rate"] for r in mixing.rates(d, {"small": 1.0, "mid": 1.0, "large": 1.0}, max_rate=2).collect()}
    assert rate["small"] == rate["mid"] == 2 and rate["large"] == pytest.approx((11_100 - 2 * 1100) / 10_000)


def test_write_shards_keeps_every_row_and_prunes(spark, few, tmp_path):
    # null and repeated ids, and texts of one source next to each other
    rnd = random.Random(2)
    rows = [(None if k % 5 == 0 else k // 2, f"{k} " + "w" * rnd.randrange(1, 2000), rnd.choice(["de", "en", "fr"]), f"s{rnd.randrange(8)}", None) for k in range(1600)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit(1)).withColumn("row_", F.lit(2))
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, files=64)
    back = spark.read.parquet(path)
    key = lambda df: sorted(str(tuple(r)) for r in df.select(docs.columns).collect())
    assert key(back) == key(docs)
    files = [pq.ParquetFile(f).metadata.row_group(0) for f in glob.glob(f"{path}/*/*.parquet")]
    column = {files[0].column(i).path_in_schema: i for i in range(files[0].num_columns)}
    ranges = [(g.column(column["source"]).statistics.min, g.column(column["source"]).statistics.max) for g in files]
    hit = sum(a <= "s3" <= b for a, b in ranges)
    assert len(files) >= 40 and hit <= len(files) / 2, (hit, len(files))  # a filter on one of eight sources


def test_shards_of_a_giant_group_with_null_ids(spark):
    rows = [(None if k % 2 else k, "the same text " * 20, "en", "a", 1) for k in range(400)] + [(1000 + k, f"other text {k} " * 20, "en", "a", 1) for k in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS)).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == 800 and len(size) == 8 and size.max() - size.min() <= 4 * got["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])


def test_shard_order_follows_the_curve(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard(docs).join(docs, "doc_id").orderBy("shard", "slot").collect()
    groups: dict = {}
    for r in docs.collect():
        k = r["text"]
        groups[k] = min(groups.get(k, (r["doc_id"], r["source"], r["lang"])), (r["doc_id"], r["source"], r["lang"]))
    rank = [{v: i * 256 // len(vs) for i, v in enumerate(vs)} for vs in (sorted({r[c] for r in got}) for c in ("source", "lang"))]
    for r in got:
        _, source, lang = groups[r["text"]]
        point = [rank[0][source], rank[1][lang], min(255, int(np.floor(np.log2(len(r["text"]) + 1) * 8)))]
        assert r["curve"] == plain_hilbert(point, 8)
    curve = [r["curve"] for r in got]
    assert curve == sorted(curve)


def plain_hilbert(point, bits):
    """The curve index bit by bit, from the rotated and reflected cube of each level."""
    x, n = list(point), len(point)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            if x[i] >> b & 1:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0], x[i] = x[0] ^ t, x[i] ^ t
    gray = []
    for i in range(n):
        gray.append(x[i] ^ (gray[i - 1] if i else 0))
    turn = 0
    for b in range(bits - 1, 0, -1):
        if gray[-1] >> b & 1:
            turn ^= (1 << b) - 1
    return int("".join(str((g ^ turn) >> b & 1) for b in range(bits - 1, -1, -1) for g in gray), 2)


def test_simhash_by_eight_parts_loses_no_link(spark):
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 1 << 63, 30, dtype=np.int64)
    fps = np.unique(np.concatenate([base, base ^ 3, base ^ (1 << 40), base ^ (1 << 17 | 1 << 62), base ^ 7]))
    from corpusmill.operators.components import connected_components

    table = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    want = {r["id"]: r["component"] for r in connected_components(simhash.links(table, parts=4)).collect()}
    assert {r["id"]: r["component"] for r in connected_components(simhash.links(table, parts=8)).collect()} == want and len(want) >= 120


def test_simhash_streams_probes_past_sub_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUB_TILE", 8)
    rnd = np.random.default_rng(6)
    fps = np.unique(np.array([0x0F0F0F0F0F0F0F0F ^ (1 << a) ^ (1 << b) for a, b in rnd.integers(0, 62, (200, 2)).tolist()], dtype=np.int64))
    u = fps.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    label = np.array(fps)
    while not ((new := np.array([label[row].min() for row in near])) == label).all():
        label = new
    from corpusmill.operators.components import connected_components

    got = {r["id"]: r["component"] for r in connected_components(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"))).collect()}
    assert [got.get(int(x), int(x)) for x in fps] == label.tolist()


def test_dedup_keeps_one_row_of_a_class_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(300))
    rows = [(None, text, "en", "a", 1), (None, text + " tail", "en", "a", 1), (None, text, "en", "b", 1), (7, "another text of its own", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    fps = {r["fp"] for r in simhash.near_duplicates(docs).where("doc_id IS NULL").collect()}
    linked = len(fps) == 1 or bin((min(fps) ^ max(fps)) & (2**64 - 1)).count("1") <= 2
    assert simhash.deduplicate(docs).count() == (2 if linked else 3)


def test_flat_graph_two_levels_of_centroids(spark, monkeypatch):
    monkeypatch.setattr(ann, "MAX_CENTROIDS", 8)
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    rng = np.random.default_rng(3)
    a = ann.unit(rng.normal(size=(400, 64)))
    w = rng.normal(size=a.shape)
    w -= (w * a).sum(axis=1, keepdims=True) * a
    group = ann.unit(np.sqrt(0.95) * ann.unit(rng.normal(size=(1, 64))) + np.sqrt(0.05) * ann.unit(rng.normal(size=(300, 64))))
    x = np.concatenate([a, 0.905 * a + np.sqrt(1 - 0.905**2) * ann.unit(w), group])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in ann.near_duplicates(table).collect()}
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[k] for k in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()


def test_flat_graph_repeated_rows_and_names(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0] * 5000), (5, [1.0] * 5000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "h", "cluster", "copies")})
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in ann.audited(table).drop("audit_recall").collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False)]


def test_flat_graph_audit_is_null_where_nothing_links(spark):
    x = np.eye(64)
    table = spark.createDataFrame([(100 * k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {r["audit_recall"] for r in ann.audited(table).collect()} == {None}


def test_license_scan_finds_edited_copies(spark):
    rnd = random.Random(1)
    rows, want = [], set()
    for name, body in licenses.TEMPLATES.items():
        n = len(body.split())
        for k in range(3 if n >= 60 else 0):
            words = body.split()
            for at in rnd.sample(range(n), max(1, n // 80)):
                words[at] = f"edit{k}"
            rows.append((len(rows), " ".join([*(f"before{i}" for i in range(k)), *words, "after"])))
            want.add((rows[-1][0], name))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("words", "h", "p0", "template_id", "n_shared")})
    got = {(r["doc_id"], r["template_id"]): r["containment"] for r in licenses.scan(docs).collect()}

    def contained(name, text):
        cut = lambda t: [w for w in "".join(c.lower() if c.isalnum() else " " for c in t).split()]
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        a, b = grams(cut(licenses.TEMPLATES[name])), grams(cut(text))
        return len(a & b) / len(a)

    true = {(k, name) for k, text in rows for name in licenses.TEMPLATES if contained(name, text) >= 0.8}
    assert set(got) <= true and len(set(got) & true) >= 0.9 * len(true) and len(want & true) >= 10
    assert all(v == pytest.approx(contained(name, rows[k][1])) for (k, name), v in got.items())


def test_wrapper_keeps_article_parts_with_soft_words(spark):
    page = ("<body><div id='legal'>Same legal line <a>terms</a></div><article><h1>Title {k}</h1><div id='legal'>The law {k} says</div><p class='related-work'>Earlier work {k}</p>"
            "<div class='related-posts'><a>One {k}</a> <a>Two</a></div><div class='comment-list'>nice {k}</div><div class='notice'>We use cookies {k}</div></article></body>")  # fmt: skip
    rows = [(k, "http://a/", page.replace("{k}", str(k))) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\nThe law {k} says\nEarlier work {k}" for k in range(6))


def test_wrapper_matches_long_and_deep_pages_in_seconds(spark):
    import time

    def blocks(n):
        return "<body>" + "".join(f"<h3>head {i}</h3><p>text {i}</p>" if i % 7 else f"<ul><li>item {i}</ul><p>text {i}</p>" for i in range(n)) + "</body>"

    rows = [(k, "http://a/", blocks(5000 + 7 * k)) for k in range(6)] + [(10, "http://a/", "<div>" * 50_000 + "deep" + "</x>" * 50_000)]
    began = time.time()
    got = {r["page_id"]: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert time.time() - began < 180 and got[10]["text"] == "deep"
    assert all(len(got[k]["text"].split("\n")) == 2 * (5000 + 7 * k) for k in range(6))


def plain_matching(a, b):
    if a.key != b.key:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, p in enumerate(a.children):
        for j, q in enumerate(b.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain_matching(p, q))
    return 1 + m[-1][-1]


def test_matching_equals_the_plain_table(monkeypatch):
    rnd = random.Random(8)

    def grow(depth):
        inner = [grow(depth - 1) for _ in range(rnd.randrange(5))] if depth else []
        return rnd.choice("abc") + ("(" + "\t".join(inner) + ")" if inner else "")

    for cells in (4_000_000, 4):
        monkeypatch.setattr(wrappers, "CELLS", cells)
        for _ in range(60):
            a, b = wrappers.load("r(" + grow(3) + "\t" + grow(2) + ")"), wrappers.load("r(" + grow(2) + "\t" + grow(3) + ")")
            total, pairs = wrappers.matching(a, b, {})
            assert total == plain_matching(a, b) == 1 + sum(plain_matching(a.children[i], b.children[j]) for i, j in pairs)
            assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_wrapper_of_a_host_with_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 4)
    rnd = random.Random(3)
    rows, want = [], {}
    for k in range(120):
        body = [f"<{t}>{t} {k} {i}</{t}>" for i, t in enumerate(rnd.choices(["p", "h2", "blockquote", "pre"], k=rnd.randrange(1, 9)))]
        text = "\n".join(b.split(">")[1].split("<")[0] for b in body)
        rows.append((k, "http://hot/", f"<body><div class='top'>Always here</div><div class='text'>{''.join(body)}</div><div class='low{k % 3}'>Also {k % 3}</div><p>End of page</p></body>"))
        want[k] = f"{text}\nAlso {k % 3}"
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want  # what under half of the pages share is no template


def test_wrapper_odd_pages(spark):
    rows = [(None, None, None), (1, "", ""), (1, "", ""), (2, "http://x", "<p>a"), (3, "no url", "plain &amp; text")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "template", "constant", "salt", "text")})
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in wrappers.extract(table).collect()) == [("1", "", 0), ("1", "", 0), ("2", "a", 1), ("3", "plain & text", 12), ("None", "", 0)]
    assert wrappers.extract(table.limit(0)).count() == 0


def test_values_of_odd_texts(spark):
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, "x" * 200_000, None, None, None), (4, "!!! 123", None, None, None), (None, "no id", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in CLASH})
    lang = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, PIECES).collect()}
    assert lang[1] == lang[2] == lang[4] == ("und", 0.0) and lang[3] == lang[None] == ("en", 1.0)
    count = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.count_tokens(docs, PIECES).collect()}
    assert count[1] == count[2] == (0, 0) and count[3][0] == 1 and count[4][0] == 2
    prints = {r["doc_id"]: (r["n_chars"], r["fingerprint"], r["near_edited"]) for r in cdc.edit_test(docs).collect()}
    assert prints[1] == prints[2] == (0, ".", 1.0) and prints[3][0] == 200_000
    assert {r["doc_id"]: r["fp"] for r in simhash.near_duplicates(docs).collect()}[1] == 0
    size = {r["doc_id"]: r["size"] for r in sharding.shard(docs).collect()}
    assert size == {1: 1, 2: 1, 3: 200_001, 4: 8, None: 6}
    assert licenses.scan(docs).count() == 0 and licenses.scan(docs.limit(0)).count() == 0

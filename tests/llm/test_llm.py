"""The ten dealt operators against plain Python on small fixtures, with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import ann, bpe, cdc, language_id, licenses, mixing, pieces, sharding, simhash, token_counts, wrappers
from corpusmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
PIECES = P.path(Q.PIECE_FILE)
BPE = P.path(Q.BPE_FILE)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids, a very long text, repeated rows and columns whose names operators use themselves."""
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "x" * 300_000, None, None, 300_000), (4, "word " * 60_000, "de", "b", 1),
            (5, "the cat sat on the mat", "en", "a", 22), (5, "the cat sat on the mat", "en", "a", 22), (6, "!!! 123", "en", "b", 7), (None, "no id here at all", "fr", "a", 17),
            (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(7) for c in ("score", "fp", "rate", "replica", "bpe_ids", "n_tokens", "shard", "id", "component", "tile", "key", "h", "bucket_", "words", "cdf", "source_", "lang_", "fit", "row_")}
    return df.withColumns(extra)


def test_bpe_equals_tiktoken(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in Q.bpe_digest(docs).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_scanner_equals_pattern():
    import random

    rnd = random.Random(3)
    alphabet = "aésdmtlrve'' \n\t12²!.é漢\x1c\x85　🙂"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(400))) for _ in range(300)]
    import regex

    assert list(bpe.pretokenize(texts)) == [regex.findall(P.PATTERN, t) for t in texts]


def test_language_accuracy_and_rejects(spark, docs):
    rows = language_id.identify(docs, PIECES).where("held_out").select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_lattice_sums_all_segmentations():
    vocabulary = ["▁a", "a", "b", "ab", "▁ab", "bb"]
    lattice = language_id.Lattice(vocabulary)
    log_p = np.log(np.arange(1, 8, dtype=float)[:, None] / 28)
    p = {w: (i + 1) / 28 for i, w in enumerate(vocabulary)}

    def total(w):
        if not w:
            return 1.0
        return sum((p[w[:k]] if w[:k] in p else (1 / 4 if k == 1 else 0)) * total(w[k:]) for k in range(1, len(w) + 1))

    words = ["ab", "abb", "bbb", "zab", "a" * 50]
    assert np.allclose(np.exp(lattice.forward(words, log_p)[:4, 0]), [total("▁" + w) for w in words[:4]])


def test_expected_counts_equal_enumeration():
    vocabulary = ["▁a", "a", "b", "ab", "▁ab", "bb"]
    lattice = language_id.Lattice(vocabulary)
    p = np.arange(1, 8, dtype=float) / 28

    def ways(w):
        """Every segmentation as piece numbers; a character outside the vocabulary is piece 6."""
        if not w:
            return [[]]
        out = []
        for k in range(1, len(w) + 1):
            if w[:k] in vocabulary or k == 1:
                head = vocabulary.index(w[:k]) if w[:k] in vocabulary else 6
                out += [[head, *rest] for rest in ways(w[k:])]
        return out

    for log_p, prob in ((np.log(p), p), (None, np.full(7, 1 / 7))):
        want = np.zeros(7)
        for word, weight in (("ab", 1.0), ("abbab", 3.0), ("zab", 2.0)):
            all_ways = ways("▁" + word)
            total = sum(np.prod(prob[w]) for w in all_ways)
            for w in all_ways:
                np.add.at(want, w, weight * np.prod(prob[w]) / total)
        assert np.allclose(lattice.expected(["ab", "abbab", "zab"], np.array([1.0, 3.0, 2.0]), log_p), want)


def test_token_counts_equal_plain_dynamic_programme(spark, docs):
    vocabulary = pieces.read_pieces(PIECES, lower=False)
    model = token_counts.estimate(docs, "text", spark.sparkContext.broadcast(vocabulary))
    assert np.isclose(np.exp(model).sum(), 1)
    log_p, unknown = dict(zip(vocabulary, model)), model[-1]

    def scores(w):
        best, ahead = [(0.0, 0)], [0.0]
        for j in range(1, len(w) + 1):
            spans = [(i, log_p.get(w[i:j], unknown if j - i == 1 else -np.inf)) for i in range(max(0, j - 20), j)]
            size = {i: 1 if w[i:j] in log_p else len(w[i:j].encode()) for i, _ in spans}
            best.append(min((best[i][0] - p, best[i][1] + size[i]) for i, p in spans))
            ahead.append(np.logaddexp.reduce([ahead[i] + p for i, p in spans]))
        return best[-1][1], ahead[-1]

    texts = {r["doc_id"]: r["text"] for r in docs.where("n_chars < 1500").limit(60).collect()} | {-1: "Case MATTERS 漢字 \u00a0x\u2003y Ωmega", -2: "", -3: None}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    counter = token_counts.TrieCounter(vocabulary, model)
    for (k, t), got in zip(texts.items(), counter.counts([t or "" for t in texts.values()])):
        want = [scores("▁" + w) for w in (t or "").split()]
        assert got[:2] == (len(want), sum(n for n, _ in want)), k
        assert np.isclose(got[2], sum(p for _, p in want))
    assert token_counts.count_tokens(table, PIECES).count() == len(texts)


def test_token_counts_and_estimate_split_words_alike(spark):
    text = "a\u00a0b\u2003c\u1680d\x1ce\x85f\u200bg\u180eh"
    got = [r[0] for r in spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", token_counts.WHITE))).collect()]
    assert got == text.split()


def reference_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, near):
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return new
        label = new


def test_simhash_classes_equal_brute_force(spark, docs):
    rows = docs.collect()
    fp = np.array([reference_simhash(r["text"]) for r in rows], dtype=np.uint64)
    label = classes([r["doc_id"] for r in rows], np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2)
    want = {r["doc_id"]: (int(f), int(c)) for r, f, c in zip(rows, fp, label)}
    got = {r["doc_id"]: (r["fp"] & 0xFFFFFFFFFFFFFFFF, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_simhash_tiles_lose_no_link(spark):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = np.unique(np.concatenate([base, *[base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rnd.integers(0, 62, (20, 2))]]))
    nodes = spark.createDataFrame([(int(x), int(x)) for x in fps], "fp long, rep long")
    u = fps.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    from corpusmill.operators.components import connected_components

    got = {r["id"]: r["component"] for r in connected_components(simhash.links(nodes)).collect()}
    want = classes(fps, near)
    assert all(got.get(int(x), int(x)) == int(c) for x, c in zip(fps, want))


def test_flat_graph_equals_brute_force(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = v.collect()
    x = ann.unit([r["embedding"] for r in rows])
    near = x @ x.T >= 0.35
    label = classes([r["vec_id"] for r in rows], near)
    got = {r["vec_id"]: r for r in ann.near_duplicates(v, 0.35).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.9 * (near.sum() - len(rows)) and found <= near.sum() - len(rows)
    assert np.mean([got[r["vec_id"]]["component_id"] == c for r, c in zip(rows, label)]) >= 0.9


def test_flat_graph_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ann.near_duplicates(v).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9))
    assert ann.near_duplicates(v.limit(0)).count() == 0


def vector_table(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")


def true_links(x, threshold=0.9):
    near = x @ x.T >= threshold
    return near.sum(axis=1) - 1


def near_copies(rng, n, dim=64, cosine=0.95):
    return ann.unit(np.sqrt(cosine) * ann.unit(rng.normal(size=(1, dim))) + np.sqrt(1 - cosine) * ann.unit(rng.normal(size=(n, dim))))


def link_recall(spark, x, **kw):
    got = {r["vec_id"]: r["n_links"] for r in ann.near_duplicates(vector_table(spark, x), **kw).collect()}
    want = true_links(x)
    found = np.array([got[k] for k in range(len(x))])
    assert (found <= want).all()
    return found.sum() / want.sum()


def test_flat_graph_finds_links_between_clusters(spark, monkeypatch):
    # many centroids: a third of the rows is one group of near copies, the rest are isolated pairs at cosine 0.905
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    rng = np.random.default_rng(3)
    a = ann.unit(rng.normal(size=(800, 64)))
    w = rng.normal(size=a.shape)
    w -= (w * a).sum(axis=1, keepdims=True) * a
    pairs = np.concatenate([a, 0.905 * a + np.sqrt(1 - 0.905**2) * ann.unit(w)])
    assert link_recall(spark, pairs) >= 0.95
    assert link_recall(spark, np.concatenate([pairs, near_copies(rng, 800)])) >= 0.98


def test_flat_graph_walks_reach_every_group_of_a_shard(spark):
    # groups larger than a row's candidates: no list leaves a group, or few paths do
    rng = np.random.default_rng(5)
    parts = [near_copies(rng, 200) for _ in range(4)] + [ann.unit(rng.normal(size=(20, 64)))]
    assert link_recall(spark, np.concatenate(parts)) >= 0.99


def test_flat_graph_entry_points_cover_parts_and_strangers():
    rng = np.random.default_rng(5)
    x = np.concatenate([near_copies(rng, 300) for _ in range(3)])
    near = ann.robust_prune(x)
    links = np.full((len(x), ann.DEGREE), -1, dtype=np.int64)
    for k, v in enumerate(near):
        links[k, : len(v)] = v
    strangers = near_copies(np.random.default_rng(5), 301)[300:]  # of the first group's kind, but no member
    entries = ann.entry_points(x, links)
    assert {int(e) // 300 for e in entries} == {0, 1, 2}
    q = np.concatenate([x[[10, 310, 610]], strangers])
    sims = ann.search(q, x, links, entries, np.array([-1, -1, -1, -1]), 0.75)
    assert ((sims >= 0.9).sum(axis=1) == (q @ x.T >= 0.9).sum(axis=1)).all()


def test_flat_graph_audit_holds_and_widens(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    rng = np.random.default_rng(3)
    many = np.concatenate([ann.unit(rng.normal(size=(800, 64))), near_copies(rng, 400)])
    assert ann.audited(vector_table(spark, many)).first()["audit_recall"] >= 0.9
    # a first step that is too narrow must not be what is returned
    x = ann.unit(rng.normal(size=(600, 64)))
    v = vector_table(spark, x)
    monkeypatch.setattr(ann, "WIDENING", ((0.0, 1), (float("inf"), 1 << 30)))
    assert ann.audit(v, ann.near_duplicates(v, 0.35, 1, 0.0), 0.35) < 0.9
    got = {r["vec_id"]: (r["n_links"], r["audit_recall"]) for r in ann.audited(v, 0.35).collect()}
    assert [got[k] for k in range(len(x))] == [(n, 1.0) for n in true_links(x, 0.35)]


def test_mixing_equals_sql_and_hits_targets(spark, docs):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    key = lambda rows: sorted((r[0], r[1], r[2], r[3]) for r in rows)
    got = mixing.mix(docs).select("doc_id", "n_copies", "replica", "shuffle_key").collect()
    want = con.sql(f"select doc_id, n_copies, replica, shuffle_key from ({mixing.ORACLE_SQL})").fetchall()
    assert key(got) == key(want)


def test_mixing_meets_targets_of_small_sources(spark):
    # one large source and a small one that wants 40 repetitions for its weight
    rows = [(k, "x" * 10, "large") for k in range(4000)] + [(10_000 + k, "x" * 10, "small") for k in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rate = {r["source"]: r["rate"] for r in mixing.rates(d, {"small": 0.5, "large": 0.5}).collect()}
    assert rate["small"] == pytest.approx(40.5) and rate["large"] == pytest.approx(0.50625)
    got = {r["source"]: r["count"] for r in mixing.mix(d, weights={"small": 0.5, "large": 0.5}).groupBy("source").count().collect()}
    assert abs(got["small"] - 2025) < 200 and abs(got["large"] - 2025) < 200
    cut = {r["source"]: r["rate"] for r in mixing.rates(d, {"small": 0.5, "large": 0.5}, max_rate=8).collect()}
    assert cut["small"] == 8 and cut["large"] == pytest.approx((40_500 - 8 * 500) / 40_000)


def test_license_scan_equals_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    long = licenses.TEMPLATES["mit-permission"]
    extra = spark.createDataFrame([(10_001, f"some words before {long} and more"), (10_002, long[:60])], "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan(docs.select("doc_id", "text")).collect())
    assert got == sorted(con.sql(f"select doc_id, template_id, n_shared, n_template, containment from ({licenses.ORACLE_SQL})").fetchall())
    assert [(r["doc_id"], r["template_id"], r["containment"]) for r in licenses.scan(extra).collect()] == [(10_001, "mit-permission", 1.0)]


def plain_chunks(text, least, normal, most, bits):
    """Byte by byte: a chunk ends where the hash of the last 32 bytes is small, by a bound that depends on the chunk's size."""
    raw, out, chunk = text.encode(), [], b""
    for k in range(len(raw)):
        chunk += raw[k : k + 1]
        h = sum(int(cdc.GEAR[b]) << i for i, b in enumerate(reversed(raw[max(0, k - 31) : k + 1]))) % 2**32
        strict, loose = 2 ** (32 - bits - 1), 2 ** (32 - bits + 1)
        if (least <= len(chunk) <= normal and h < strict) or (len(chunk) >= normal and h < loose) or len(chunk) == most:
            out.append(chunk)
            chunk = b""
    return out + [chunk] * bool(chunk)


def plain_containment(a, b):
    out = []
    for scale in ((4, 16, 64, 4), (16, 64, 256, 6)):
        x, y = (set(plain_chunks(t, *scale)) for t in (a, b))
        out.append(sum(map(len, x & y)) / min(sum(map(len, x)), sum(map(len, y))) if x and y else float(not x and not y))
    return max(out)


def test_cdc_equals_plain_chunking(spark, docs):
    rows = sorted(docs.where("n_chars < 6000").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in cdc.edit_test(docs.where("n_chars < 6000")).collect()}
    for k, r in enumerate(rows):
        t, following, g = r["text"], rows[(k + 1) % len(rows)]["text"], got[r["doc_id"]]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and g["n_chars"] == len(t)
        if k < 60:
            digests = sorted({xxhash.xxh64_intdigest(c) & ~511 | len(c) for c in plain_chunks(t, 16, 64, 256, 6)})
            assert g["fingerprint"].partition(".")[0] == base64.b64encode(np.array(digests, dtype="<u8").tobytes()).decode()
            assert g["near_edited"] == pytest.approx(plain_containment(t, edited)) and g["near_next"] == pytest.approx(plain_containment(t, following))
    text = max((r["text"] for r in rows), key=len)
    assert cdc.containment(cdc.chunk_set(text), cdc.chunk_set("moved " + text)) > 0.9
    assert sum(g["near_edited"] for g in got.values()) / len(got) > 0.5


def test_shards_are_even_gapless_and_keep_groups(spark, docs):
    got = sharding.shard(docs).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() <= 4 * got["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert got.groupby("text")["shard"].nunique().max() == 1


def test_hilbert_neighbours_are_adjacent():
    points = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    index = sharding.hilbert_index(points, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header class="site"><a href=/>Home</a></header>
<nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div><div id="text"><h1>Title {k} &amp; more</h1><p>First <b>bold
 {k}<p>Second&nbsp;line {k}<br>goes on<div class=ad>Buy</div></div><div class="note">Same line everywhere</div><form>Search</form><div class="comments">nice</div><footer>F</footer>"""


def test_wrapper_drops_furniture_and_constant_nodes(spark):
    rows = [(k, f"https://www.host.example/{k}", PAGE.replace("{k}", str(k))) for k in range(6)] + [(90, None, None), (91, "x", ""), (92, "http://b/", "<p>a &lt; b <i>c"), (92, "http://b/", "<p>a &lt; b <i>c")]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert all(text[k] == f"Title {k} & more\nFirst bold {k}\nSecond line {k} goes on" for k in range(6))
    assert (text[90], text[91], text[92]) == ("", "", "a < b c")
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_wrapper_keeps_copied_articles(spark):
    page = "<body><div class='date'>{k}</div>{open}<h2>Summary</h2><p>{text}</p>{list}{close}<div class='note'>Same line everywhere</div></body>"

    def make(k, text, mark, extra=""):
        return page.format(k=k, text=text, list=extra, open=f"<{mark}>" if mark else "", close=f"</{mark}>" if mark else "")

    rows = [(k, "http://a/", make(k, f"text {k}", "article")) for k in range(6)]
    rows += [(10 + k, "http://a/", make(k, "copied", "article", "<ul><li>only here</ul>")) for k in range(6)]  # six copies of one article
    rows += [(20 + k, "http://b/", make(k, "the whole host", "main")) for k in range(6)]  # a host of copies that differ by date
    advert = "<body><div class='ad'>{k}</div><h1>One</h1><p>the same text</p></body>"
    rows += [(30 + k, "http://c/", advert.format(k=k)) for k in range(6)]  # no mark, and an advert that varies
    # no mark: six copies among other pages of the host
    rows += [(40 + k, "http://d/", f"<body><p>text {k}</p><div class='note'>Same</div></body>") for k in range(8)]
    rows += [(50 + k, "http://d/", f"<body><div class='ad'>{k}</div><p>copied</p><ul><li>only here</ul><div class='note'>Same</div></body>") for k in range(6)]
    text = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[k] == f"Summary\ntext {k}" for k in range(6))
    assert all(text[10 + k] == "Summary\ncopied\nonly here" for k in range(6))
    assert all(text[20 + k] == "Summary\nthe whole host" for k in range(6))
    assert all(text[30 + k] == "One\nthe same text" for k in range(6))
    assert all(text[40 + k] == f"text {k}" for k in range(8))
    assert all(text[50 + k] == "copied\nonly here" for k in range(6))


def test_simple_tree_matching_unites_shapes():
    a, b = wrappers.load("body(h1\tp\tul(li)\tp)"), wrappers.load("body(h1\tp\tdiv)")
    assert wrappers.matching(a, b, {})[0] == 3
    whole = wrappers.load(wrappers.write(wrappers.unite(a, b)))
    assert whole.weight == 2
    assert len(wrappers.align(whole, a)) == 6 and len(wrappers.align(whole, b)) == 4


OPERATORS = {
    "mixing": lambda d: mixing.mix(d),
    "cdc": lambda d: cdc.edit_test(d),
    "sharding": lambda d: sharding.shard(d),
    "licenses": lambda d: licenses.scan(d),
    "language": lambda d: language_id.identify(d, PIECES),
    "simhash": lambda d: simhash.near_duplicates(d),
    "dedup": lambda d: simhash.deduplicate(d),
    "counts": lambda d: token_counts.count_tokens(d, PIECES),
    "bpe": lambda d: bpe.encode_decode(d, BPE),
}
KEEP_ROWS = {"cdc", "sharding", "language", "simhash", "counts", "bpe"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd, name):
    rows = OPERATORS[name](odd).collect()
    if name in KEEP_ROWS:
        assert len(rows) == odd.count()
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_dedup_of_odd_rows(odd):
    got = simhash.deduplicate(odd).select("doc_id", "text").collect()
    # null, empty: one class; the repeated row once; the text without id has a class of its own
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "4", "5", "6", "None"]


def test_pipeline_equals_plain_python(spark, docs):
    ids = {r["doc_id"]: r for r in docs.collect()}
    fp = {i: reference_simhash(r["text"]) for i, r in ids.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    order = sorted(fp)
    u = np.array([fp[i] for i in order], dtype=np.uint64)
    label = classes(order, np.bitwise_count(u[:, None] ^ u[None, :]) <= 2)
    kept = [i for i, c in zip(order, label) if i == c]
    copies = mixing.mix(docs.where(F.col("doc_id").isin(kept))).select("doc_id").collect()
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in copies)
    assert all(r["decoded_sha256"] == hashlib.sha256(ids[r["doc_id"]]["text"].encode()).hexdigest() for r in got)

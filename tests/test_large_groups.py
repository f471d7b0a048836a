"""Groups of similar texts and vectors whose links are met in blocks, against plain Python."""

import random
import time

import numpy as np
import pytest

from corpusmill.operators import components, similar


def plain(ids, linked):
    label = {k: k for k in ids}
    for _ in ids:
        for a in ids:
            label[a] = min(label[b] for b in ids if a == b or linked(a, b))
    return label


def test_stars_keep_what_pairs_connect():
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 400, 300) * 7, rnd.integers(0, 400, 300) * 7
    got = dict(zip(*(x.tolist() for x in components.stars(a, b))))
    near = {k: set() for k in [*a.tolist(), *b.tolist()]}
    for u, v in zip(a.tolist(), b.tolist()):
        near[u].add(v), near[v].add(u)
    label = plain(sorted(near), lambda u, v: v in near[u])
    assert got == {k: v for k, v in label.items() if k != v}
    assert [len(x) for x in components.stars(a[:0], b[:0])] == [0, 0]


@pytest.mark.parametrize("shared", [3, 6])
def test_sets_that_share_items_in_small_blocks(spark, monkeypatch, shared):
    for name, least in (("TOP_ITEMS", 12), ("BLOCK_SETS", 8), ("SLICE_SETS", 16), ("MEET_CELLS", 50)):
        monkeypatch.setattr(similar, name, least)
    rnd = random.Random(5)
    rows = [(k, k % 2, rnd.choice([8, 15, 16, 17, 31, 32, 64, 100]), sorted(rnd.sample(range(30 + 50 * (k % 3)), rnd.randrange(shared, shared + 5)))) for k in range(90)]
    got = {r["id"]: r["component"] for r in similar.sharing(spark.createDataFrame(rows, "id long, g long, n long, items array<long>"), shared, 2.0).collect()}
    by = {r[0]: r for r in rows}
    want = plain(list(by), lambda a, b: by[a][1] == by[b][1] and max(by[a][2], by[b][2]) <= 2 * min(by[a][2], by[b][2]) and len({*by[a][3]} & {*by[b][3]}) >= shared)
    assert got == want and len(set(want.values())) not in (1, 90)


def test_sets_of_one_item_in_common_stay_apart(spark):
    rows = [(k, 0, 10, [1, 2, 100 + k]) for k in range(9)]
    got = similar.sharing(spark.createDataFrame(rows, "id long, g long, n long, items array<long>"), 3, 2.0)
    assert sorted(map(tuple, got.collect())) == [(k, k) for k in range(9)]


def test_prefix_groups_in_small_tiles_send_no_trigrams(spark, monkeypatch):
    from corpusmill.operators import lifecycle

    for name, least in (("SMALL_BLOCK", 4), ("TILE_TEXTS", 6), ("TILE_CHARS", 2000)):
        monkeypatch.setattr(lifecycle, name, least)
    monkeypatch.setattr(similar, "rare_items", None)
    rnd = random.Random(9)
    head = "a head of thirty characters ok "
    base = ["".join(rnd.choice("abcdefghijk ") for _ in range(n)) for n in (40, 60, 90, 130)]
    texts = {k: head + base[k % 4][: rnd.randrange(20, 130)] + "xyz"[: k % 3] for k in range(70)} | {70: "ab", 71: "ab ", 72: "c", 73: ""}
    rows = spark.createDataFrame([(k, 0.5, t, False) for k, t in texts.items()], "fact_id long, importance double, content string, tombstoned boolean")
    got = {r["fact_id"]: r["winner"] for r in lifecycle.near_dup_prefix(rows).collect()}
    body = {k: t.strip(" ") for k, t in texts.items()}
    grams = {k: {t[i : i + 3] for i in range(len(t) - 2)} or {t} for k, t in body.items()}
    label = plain(list(texts), lambda a, b: body[a][:30] == body[b][:30] and len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b]))
    assert got == {k: c for k, c in label.items() if list(label.values()).count(c) > 1} and len(set(got.values())) > 2


def test_cosine_links_of_small_tiles_connect_what_pairs_connect(spark, monkeypatch):
    from corpusmill.operators import vectors

    monkeypatch.setattr(vectors, "PAIR_ROWS", 16)
    monkeypatch.setattr(vectors, "TILE_BYTES", 4096)
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.25 * rng.normal(size=(20, 8)) for c in rng.normal(size=(6, 8))])
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(500, [1.0, 2.0]), (501, [2.0, 4.0]), (502, None)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"fact_id long, embedding array<{kind}>")
        u = vectors.unit([r["embedding"] for r in df.where("fact_id < 500").orderBy("fact_id").collect()])
        near = {tuple(map(int, p)) for p in zip(*np.nonzero(np.triu(np.round(u @ u.T, 9) >= 0.9, 1)))} | {(500, 501)}
        pairs = [(r["a"], r["b"]) for r in vectors.cosine_pairs(df, 0.9).collect()]
        links = {(r["a"], r["b"]) for r in vectors.cosine_links(df, 0.9).collect()}
        assert len(pairs) == len(set(pairs)) and set(pairs) == near and all(a < b for a, b in links)
        groups = [dict(zip(*(c.tolist() for c in components.stars(*np.array(sorted(e)).T)))) for e in (near, links)]
        assert groups[0] == groups[1] and len(links) < len(near)


def test_postings_are_written_where_they_arise(spark, tmp_path):
    from corpusmill.operators import lex_index

    frame, dealt = type(spark.range(1)), []
    hint = frame.hint
    with pytest.MonkeyPatch.context() as m:
        m.setattr(frame, "hint", lambda df, *a: dealt.append(df.columns) or hint(df, *a))
        docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} x") for k in range(60)], "doc_id long, text string").repartition(4)
        index = lex_index.write_index(docs, "doc_id", "text", str(tmp_path / "i"))
    assert dealt and not any("tf" in columns for columns in dealt)
    every = list(range(32))
    assert index.hits(every).count() == index.headers(every).selectExpr("sum(n)").first()[0] == index.postings().count()


def test_likeness_is_summed_in_small_tiles_without_pairs(spark, monkeypatch):
    from corpusmill.operators import reflection

    for name, least in (("MEET_SETS", 8), ("MEET_ITEMS", 200), ("MEET_CELLS", 30), ("DENSE", 0.1), ("DENSE_ITEMS", 5)):
        monkeypatch.setattr(similar, name, least)
    frame, sent = type(spark.range(1)), []
    distinct = frame.distinct
    monkeypatch.setattr(frame, "distinct", lambda df: sent.append(df.columns) or distinct(df))
    rnd = random.Random(11)
    texts = {k: " ".join(rnd.sample([f"w{i}" for i in range(12 + 20 * (k % 4))], rnd.randrange(1, 12))) for k in range(120)} | {200: "W1 w1", 201: "w1 W1 w1", 202: "", 203: None, 204: "漢字 w1"}
    rows = [(k, t, ["public", "private"][k % 2], "success_pattern", k == 5) for k, t in texts.items()] + [(300, "w1 w2", "public", "lesson", False)]
    got = {r["fact_id"]: (r["similar"], r["promoted"]) for r in reflection.recurring_success(spark.createDataFrame(rows, "fact_id long, content string, tier string, kind string, tombstoned boolean")).collect()}
    sets = {k: {*t.replace("漢字", "漢 字 ").split()} for k, t in texts.items() if t and k != 5}
    want = {a: sum(a % 2 == b % 2 and round(len(x & y) / len(x | y), 9) >= 0.3 for b, y in sets.items()) for a, x in sets.items()}
    assert got == {k: (n, k % 2 == 1 and n >= 3) for k, n in want.items()} and max(want.values()) > 5
    assert not any({"a", "b"} <= {*c} for c in sent)


def test_unlike_texts_of_one_prefix_are_told_apart_in_seconds(spark):
    from corpusmill.operators import lifecycle

    rng = np.random.default_rng(6)
    head = "a head of thirty characters ok "
    texts = [head + "".join(rng.choice(list("abcdefgh"), 780)) for _ in range(1500)]
    texts += [t[:600] for t in texts[:40]] + [t[:-5] + "\U0001f600é" for t in texts[40:60]]
    grams = sorted({t[i : i + 3] for t in texts for i in range(len(t) - 2)})
    at, held = {g: k for k, g in enumerate(grams)}, np.zeros((len(texts), len(grams)), dtype=np.float32)
    for k, t in enumerate(texts):
        held[k, [at[t[i : i + 3]] for i in range(len(t) - 2)]] = 1
    both, n = (held @ held.T).astype(int), held.sum(axis=1)
    near = np.argwhere(np.triu(both >= 0.7 * (n[:, None] + n[None, :] - both), 1))
    began = time.time()
    ids, low = components.stars(*near.T)
    found = lifecycle._near_texts(np.arange(len(texts)), texts, np.zeros(len(texts), int), 0.7)
    assert time.time() - began < 15
    got = components.stars(found["a"].to_numpy(), found["b"].to_numpy())
    assert got[0].tolist() == ids.tolist() and got[1].tolist() == low.tolist() and 40 < len(near) < 200_000
    assert [len(lifecycle._near_texts(np.arange(2), ["abc", "abcd"], np.array([1, 1]), 0.7)), len(lifecycle._near_texts(np.arange(2), ["ab", "ab "], np.array([0, 1]), 0.7))] == [0, 0]

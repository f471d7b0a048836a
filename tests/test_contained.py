"""Texts inside other texts by keys of covering pieces, and merged texts whose tasks see pairs, not texts."""

import random

import pytest

from corpusmill.operators import contained, reflection


@pytest.mark.parametrize("keys", [2_000_000, 40])
def test_texts_inside_others_in_one_and_more_passes(spark, monkeypatch, keys):
    monkeypatch.setattr(contained, "KEYS", keys)
    rnd = random.Random(2)
    long = ["".join(rnd.choice("abé漢 ") for _ in range(n)) for n in (30, 60, 200, 700)]
    texts = {t for t in long} | {t[i : i + n] for t in long for i, n in ((rnd.randrange(len(t) - 1), rnd.randrange(1, 130)) for _ in range(25))} | {"a", "aa", "a" * 40, "xyz"}
    rows = [(k % 2, 10 * k, t) for k, t in enumerate(sorted(texts))] + [(k % 2, 10_000 + k, t) for k, t in enumerate(long)]
    rows = list({(g, t): (g, i, t) for g, i, t in rows}.values())
    df = spark.createDataFrame([*rows, (0, 50_000, "a" * 90), (0, 50_001, "")], "group long, id long, body string")
    got = [tuple(r) for r in contained.inside(df.select("id", "body"), df.where("id < 50000").select("id", "group")).collect()]
    want = {(i, j) for g, i, t in rows for h, j, u in rows if g == h and i != j and t in u}
    assert set(got) == want and len(got) == len(want) > 100
    assert contained.inside(df.select("id", "body"), df.where("id < 0").select("id", "group")).count() == 0


def test_merged_parts_of_a_crowded_cluster_send_no_texts_in_order(spark, monkeypatch):
    seen, repartition = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *a: seen.append(df.columns) or repartition(df, *a))
    rnd = random.Random(7)
    head = "this head stands before many texts. "
    words = [head[:-1], "a b", "b c", "long tail here", "x"]
    texts = {k: " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6))) + (str(k) if k % 3 else "") for k in range(200)} | {200: "  ", 201: ""}
    members = spark.createDataFrame([(k, k % 2, 11 - k % 2 * 4) for k in texts], "fact_id long, cluster long, winner long")
    facts = spark.createDataFrame(list(texts.items()), "fact_id long, content string")
    got = sorted(map(tuple, reflection.merged_parts(members, facts).collect()))
    want = []
    for c in (0, 1):
        winner, taken = 11 - c * 4, []
        for k in sorted((k for k in texts if k % 2 == c), key=lambda k: (k != winner, k)):
            t = texts[k].strip()
            if t and not any(t in u or u in t for u in taken):
                want.append((c, len(taken), k))
                taken.append(t)
    assert got == want and len(got) > 20
    assert seen and not any("body" in c for c in seen)


def test_white_space_around_merged_texts_goes_as_before(spark):
    ends = ["", " ", "\t\n", "\x0b\f\r ", "\u0085", " \u0085", "\u2028", " \n\u2029", "\u00a0", " \u00a0 ", "\u2028 "]
    texts = {k * 20 + j: a + f"text {k} {j} end." + b for k, a in enumerate(ends) for j, b in enumerate(ends)} | {900: "text 1 1 end.", 901: "text 5 5 end. \u0085", 902: "text 5 5 end.\u0085"}
    facts = spark.createDataFrame([*texts.items(), (999, None)], "fact_id long, content string")
    got = {r["fact_id"] for r in reflection.merged_parts(facts.selectExpr("fact_id", "1L AS cluster", "900L AS winner"), facts).collect()}
    body = {r["fact_id"]: r["b"] for r in facts.selectExpr("fact_id", r"trim(regexp_replace(content, '^\\s+|\\s+$', '')) AS b").collect()}
    taken = []
    for k in sorted(texts, key=lambda k: (k != 900, k)):
        if body[k] and not any(body[k] in body[t] or body[t] in body[k] for t in taken):
            taken.append(k)
    assert got == set(taken) and 900 in got and 21 not in got

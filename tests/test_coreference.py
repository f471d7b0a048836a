"""Pronouns that names bring in, and texts with many names, against the plain walk of test_more."""

import random
import time

from test_more import plain_names, plain_resolve

from corpusmill.operators import coreference


def plain(rows):
    for k, group, _, text in rows:
        past = [t for i, g, _, t in rows if g == group and i < k][-20:][::-1]
        pool = []
        for t in [t for t in past if t.strip() != text.strip()][:10]:
            for n in plain_names(t):
                if n.lower() not in {p.lower() for p in pool}:
                    pool.append(n)
        yield k, plain_resolve(text, pool) if text.strip() else text


def test_names_that_are_or_make_pronouns(spark):
    rnd = random.Random(4)
    parts = ["They", "This", "Person", "That Thing", "It", "Her", "his", "they", "it person", "this it", "他", "他们", "那", "位", "那位", "Anna", "王经理", "this person", "THEM", "itſ", "hiſ", "_it", "it's", "é", ",", "x it", "9", "Über", "Ana Ñu", "\U0001d49cit"]
    rows = [(k, "ab"[k % 2], k, "So " + "".join(rnd.choice(parts) + rnd.choice([" ", " ", "", "\n"]) for _ in range(rnd.randrange(1, 7)))) for k in range(400)]
    df = spark.createDataFrame(rows, "fact_id long, grp string, created int, content string")
    got = {r["fact_id"]: r["resolved"] for r in coreference.resolve_pronouns(df, ["grp"], ["created"]).collect()}
    assert got == dict(plain(rows)) and sum(got[k] != t for k, _, _, t in rows) > 200


def test_texts_with_many_names_ask_for_no_more_than_kinds(spark):
    letters = "abcdefghij"
    name = lambda n: "N" + "".join(letters[int(c)] for c in f"{n:06d}")
    rows = [(k, "a", k, "all " + " of ".join(name(6000 * k + i) for i in range(6000)) + " and it was her or him or they") for k in range(24)]
    df = spark.createDataFrame(rows, "fact_id long, grp string, created int, content string")
    began = time.time()
    got = {r["fact_id"]: r["resolved"] for r in coreference.resolve_pronouns(df, ["grp"], ["created"]).collect()}
    assert time.time() - began < 20
    for k, _, _, text in rows[1:]:
        they, her, him, it = (name(6000 * (k - 1) + i) for i in range(4))
        assert got[k] == text.replace(" it was her or him or they", f" {it} was {her} or {him} or {they}")

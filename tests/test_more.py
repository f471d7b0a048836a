"""Private spans, entities, merged texts, tokens of other scripts and substring joins against plain Python."""

import random
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import entities, lexical, lifecycle, pairing, private, reflection, similar, vectors

SF = "/root/testdata/sf0.001"
SAMPLES = [
    None, "", "plain words", "mail me: ann.lee@example.org or +1 415 555 2671 now", "key sk-abcdefghijklmnopqrstuvwx and ghp_" + "a1" * 20,
    "card 4111 1111 1111 1111, ssn 123-45-6789, ip 10.1.2.3", "chat id: 123456789 and 微信 user_id 7654321 é12.34.56.78", "https://x.io/?a=1&api_key=SECRET99&b=2",
    "-----BEGIN RSA PRIVATE KEY-----\nQUJD\nREVG\n-----END RSA PRIVATE KEY----- tail", "postgres://me:pw@db.host/x " + "Z" * 55, "call 415-555-2671 12345678901234567890",
]


def plain_findings(text):
    out = []
    for k, (name, pattern, severity) in enumerate(private.PATTERNS):
        for m in re.finditer(pattern, text or ""):
            out.append((m.start(), -k if severity == "redact" else len(private.PATTERNS) + k, m.end(), name, severity, m[0]))
    return sorted(out)


def plain_redact(text):
    out, at = "", 0
    for start, _, end, name, severity, _ in plain_findings(text):
        if start >= at:
            out += text[at:start] + f"[{'BLOCKED' if severity == 'block' else 'REDACTED'}:{name}]"
            at = end
    return out + (text or "")[at:]


def test_private_spans_equal_python(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = SAMPLES + docs
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(8)
    got = {}
    for r in private.pii_spans(df, "id", "text").collect():
        got.setdefault(r["id"], set()).add((r["start"], r["end"], r["name"], r["severity"], r["snippet"]))
    mask = lambda h: h[:2] + "***" + h[-2:] if len(h) <= 8 else h[:4] + "***" + h[-2:]
    want = {k: {(s, e, n, v, mask(h)) for s, _, e, n, v, h in plain_findings(t)} for k, t in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v}
    clean = {r["id"]: (r["redacted"], r["hits"]) for r in private.pii_redact(df, "id", "text").collect()}
    assert clean == {k: (plain_redact(t), len(plain_findings(t))) for k, t in enumerate(texts)}
    kept = {r["id"]: r["redacted"] for r in private.pii_redact(df, "id", "text", "block").where("blocked").collect()}
    assert kept and all(v == texts[k] for k, v in kept.items())


def test_entities_by_context(spark):
    rows = ["", None, "  ", "Maria met Bob and maria in NYC on 2024-05-06. \"red house\"", "叫李雷 来了 昨天的王芳是", "交易 数据 的张三", " ".join(f"Name{chr(97 + k)}x" for k in range(26)).replace("Name", "N")]
    got = [[(e["type"], e["value"]) for e in r[0]] for r in spark.createDataFrame([(t,) for t in rows], "t string").coalesce(1).select(entities.extract(F.col("t"))).collect()]
    assert got[:3] == [[], [], []]
    assert got[3] == [("person", "Maria"), ("person", "Bob"), ("person", "NYC"), ("time", "2024-05-06"), ("topic", "NYC"), ("topic", "red house")]
    assert ("time", "昨天") in got[4] and ("person", "李雷") not in got[4]  # the run is 叫李雷, nothing introduces it
    assert len(got[6]) == 16


def plain_tokens(text):
    out, last = [], ""
    for t in re.findall("[a-z0-9]+|[一-鿿]", unicodedata.normalize("NFKC", text or "").lower()):
        if re.match("[一-鿿]", t):
            out += [t, last + t] if last else [t]
            last = t
        else:
            last = ""
            if len(t) >= 2 and t not in lexical.STOPWORDS:
                out.append(t)
    return out


def test_tokens_of_other_scripts(spark):
    rows = [None, "", "ＢＭ２５ ﬁle of ①② and x", "相关性闸门 abc 防 the 隐, 性", "中文 mixed ㍿ text", "plain café “quoted” words…", "½ ㎏ 𝐛𝐨𝐥𝐝 ⑩"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").coalesce(1).select(lexical.tokens(F.col("t"))).collect()]
    assert got == [plain_tokens(t) for t in rows]


def test_substring_join_equals_nested_loop(spark):
    rnd = random.Random(4)
    texts = [(k, " ".join("".join(rnd.choice("abcé1") for _ in range(rnd.randrange(1, 7))) for _ in range(rnd.randrange(12)))) for k in range(60)] + [(99, None), (98, "a-b, c! --")]
    words = ["a", "ab", "abc", "bca1", "c a", "b-", "--", "", "é", "zzz", "-b, c", "a1"]
    found = pairing.containing(spark.createDataFrame(texts, "fact_id long, low string"), spark.createDataFrame([(w,) for w in words], "keyword string"))
    assert sorted(map(tuple, found.collect())) == sorted((k, w) for k, t in texts for w in words if w and t and w in t)


def plain_groups(ids, near):
    label = {i: i for i in ids}
    while True:
        new = {i: min([label[i]] + [label[j] for j in ids if near(i, j)]) for i in ids}
        if new == label:
            return label
        label = new


def test_near_duplicates_of_a_hot_prefix(spark):
    rnd = random.Random(7)
    head = "the same first thirty characters of all "
    base = [head + "".join(rnd.choice("abcdefgh ") for _ in range(80)) for _ in range(4)]
    texts = {k: base[k % 4][: rnd.randrange(70, 120)] + rnd.choice(["", "x", "yz"]) for k in range(60)}
    rows = [(k, 0.5, t, False) for k, t in texts.items()] + [(100, 0.9, None, False), (101, 0.9, "", False)]
    got = {r["fact_id"]: r["winner"] for r in lifecycle.near_dup_prefix(spark.createDataFrame(rows, "fact_id long, importance double, content string, tombstoned boolean")).collect()}
    grams = {k: {t.strip()[i : i + 3] for i in range(len(t.strip()) - 2)} for k, t in texts.items()}
    label = plain_groups(list(texts), lambda i, j: len(grams[i] & grams[j]) >= 0.7 * len(grams[i] | grams[j]))
    sizes = {c: sum(v == c for v in label.values()) for c in label.values()}
    assert got == {k: c for k, c in label.items() if sizes[c] > 1}


def test_similar_sets_without_hubs_in_common(spark):
    probes = spark.createDataFrame([(k, k // 2) for k in range(40)] + [(k, (k + 1) // 2) for k in range(40)], "id long, key long")
    payload = spark.createDataFrame([(k, k) for k in range(40)], "id long, p long")
    got = {r["id"]: r["component"] for r in similar.components(probes, payload, lambda x, y: F.abs(x - y) == 1).collect()}
    assert got == dict.fromkeys(range(40), 0)


def test_merged_parts_equal_a_plain_fold(spark):
    body = {1: "alpha beta", 2: " alpha ", 3: "gamma", 4: "gamma delta", 5: "alpha beta", 6: "", 7: "eps"}
    members = [(k, 10, 3) for k in range(1, 7)] + [(7, 20, 7)]
    facts = spark.createDataFrame([(k, t) for k, t in body.items()], "fact_id long, content string")
    got = sorted(map(tuple, reflection.merged_parts(spark.createDataFrame(members, "fact_id long, cluster long, winner long"), facts).collect()))
    assert got == [(10, 0, 3), (10, 1, 1), (20, 0, 7)]


def test_two_level_search_equals_plain(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = vectors.unit([r["embedding"] for r in rows])
    label, ids = np.array([r["label"] for r in rows]), np.array([r["vec_id"] for r in rows])
    raw = np.array([np.asarray(r["embedding"], dtype=float) for r in rows])
    keys = np.unique(label)
    centers = vectors.unit([raw[label == c].mean(axis=0) for c in keys])
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("fact_id"), "embedding", "label")
    q = df.where("fact_id % 50 = 0").select(F.col("fact_id").alias("query_id"), "embedding")
    got = {}
    for r in vectors.two_level_topk(q, df, "label").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["fact_id"]))
    for k in np.flatnonzero(ids % 50 == 0):
        near = keys[np.argsort(-(centers @ x[k]), kind="stable")[:3]]
        pool = [j for j in np.flatnonzero(np.isin(label, near)) if j != k]
        want = sorted(pool, key=lambda j: (-round(float(x[k] @ x[j]), 6), ids[j]))[:10]
        assert [i for _, i in sorted(got[ids[k]])] == [ids[j] for j in want]


def test_cosine_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(vectors, "PAIR_ROWS", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(90, None), (91, [0.0] * 8), (92, [1.0, 2.0])], "fact_id long, embedding array<double>")
    u = vectors.unit(x)
    pairs = {(r["a"], r["b"]) for r in vectors.cosine_pairs(df, 0.5).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.5}
    got = {(r["query_id"], r["fact_id"]): r["cosine"] for r in vectors.cosine_scores(df.withColumnRenamed("fact_id", "query_id"), df).collect()}
    assert len(got) == 60 * 59 and all(np.isclose(c, u[i] @ u[j]) for (i, j), c in got.items())


def plain_names(text):
    from corpusmill.operators.coreference import NO_NAMES, PRONOUN_STARTS, TITLES

    body = (text or "").lstrip()
    if body[:2] in PRONOUN_STARTS or body[:1].lower() in PRONOUN_STARTS or (body.split() or [""])[0].lower() in PRONOUN_STARTS:
        return []
    found = re.findall(f"[一-鿿]{{0,4}}(?:{'|'.join(TITLES)})", body) + [w for w in re.findall("[一-鿿]{2,4}", body) if w not in NO_NAMES]
    return [w for w in found + re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", body) if len(w) >= 2]


def plain_resolve(text, pool):
    from corpusmill.operators.coreference import CHINESE, ENGLISH

    at = 0
    for word in CHINESE + ENGLISH if pool else []:
        pattern = re.compile(re.escape(word) if word in CHINESE else rf"\b{word}\b", re.I)
        if pattern.search(text):
            name = pool[at % len(pool)]
            text = pattern.sub(lambda m: name[0].upper() + name[1:] if m[0][0].isupper() and word in ENGLISH else name, text)
            at = at % len(pool) + 1
    return text


def test_pronouns_equal_a_plain_walk(spark):
    from corpusmill.operators import coreference

    lines = ["王经理 met Maria Lopez in Rome", "She said he likes it", "他们 told them: That person is here", None, "  ", "It was theirs", "Bob and Ann", "her friend", "她同意 and they agree", "She said he likes it"]
    rows = [(k, "ab"[k % 2] if k < 6 else "a", k // 3, t) for k, t in enumerate(lines * 3)]
    df = spark.createDataFrame(rows, "fact_id long, grp string, created int, content string")
    got = {r["fact_id"]: r["resolved"] for r in coreference.resolve_pronouns(df, ["grp"], ["created"]).collect()}
    for k, group, _, text in rows:
        text = text or ""
        past = [t or "" for i, g, _, t in rows if g == group and i < k][-20:][::-1]
        pool = []
        for t in [t for t in past if t.strip() != text.strip()][:10]:
            pool += [n for n in plain_names(t) if n.lower() not in {p.lower() for p in pool}]
            pool = [p for j, p in enumerate(pool) if p.lower() not in {q.lower() for q in pool[:j]}]
        assert got[k] == (plain_resolve(text, pool) if text.strip() else text), k


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from corpusmill.operators import changes
    from corpusmill.streaming import jobs

    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", (F.col("event_id") % 5).alias("nonce"), F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(jobs.run_to_memory(jobs.nonces(stream()), "nonces")) == key(changes.nonce_dedup(events))
    assert key(jobs.run_to_memory(jobs.admissions(stream(), 3, 168), "admissions")) == key(changes.rate_admission(events, 3, 168))
    seen = []
    jobs.each_batch(stream(), lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "c"))
    assert sum(n for _, n in seen) == events.count()


def test_sessions_of_one_hot_user(spark):
    rnd = random.Random(9)
    rows, s = [], 0
    for k in range(500):
        s += rnd.choice([60, 1800, 1801, 4000])
        rows.append((k, 1 if k % 10 else None, s))
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r["user_id"] or 0, r["cluster"], r["n"], r["first_id"], r["last_id"]) for r in lifecycle.session_clusters(df.drop("s")).collect())
    want = []
    for user in (None, 1):
        last, cluster = None, 0
        for k, u, t in rows:
            if u != user:
                continue
            if last is None or t - last > 1800:
                cluster += 1
                want.append([user or 0, cluster, 0, k, k])
            want[-1][2] += 1
            want[-1][4] = k
            last = t
    assert got == sorted(map(tuple, want))


def test_links_of_facts_with_many_entities(spark):
    from corpusmill.operators import relations

    rnd = random.Random(3)
    rows = [(k, "t", str(e)) for k in range(40) for e in rnd.sample(range(60), 9 if k % 4 == 0 else 3)]
    own = {k: {e for i, _, e in rows if i == k} for k in range(40)}
    got = dict(map(tuple, relations.entity_links(spark.createDataFrame(rows, "fact_id long, type string, value string")).collect()))
    assert got == {k: sum(bool(own[k] & own[j]) for j in range(40) if j != k) for k in range(40)}


def test_chain_selects_by_tag(spark):
    from corpusmill.plans.chain import Registry

    steps = Registry()
    steps.add("even", lambda d: d.where("id % 2 = 0"), "screen", "cheap")
    steps.add("big", lambda d: d.where("id > 4"), "screen")
    assert steps.select("screen") == ["even", "big"] and steps.select("screen", "cheap") == ["even"]
    assert [r["id"] for r in steps.chain(spark.range(10), steps.select("screen")).collect()] == [6, 8]

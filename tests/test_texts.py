"""Text rules without SQL against plain Python, and the edge rows of the others."""

import datetime as dt
import re

from pyspark.sql import functions as F

from corpusmill.operators import experiences, texts
from corpusmill.operators.texts import PARTS


def col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "t string").coalesce(1)
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


def plain_parts(text):
    def cut(pattern):
        return [b.strip() for b in re.split(pattern, text or "") if b.strip()]

    blocks = cut(r"\n\s*\n")
    if len(blocks) == 1:
        blocks = cut("\n")
    out = dict.fromkeys(["trigger", *PARTS], "")
    for b in blocks:
        name = next((n for n in PARTS if not out[n] and any(h in b[:40].lower() for h in PARTS[n])), "trigger")
        out[name] = out[name] or b
    line = out["trigger"].split("\n")[0].strip()
    out["trigger"] = line[:157].rstrip() + "..." if len(line) > 160 else line
    return out


def test_procedure_parts_equal_plain_python(spark):
    cases = [None, "", "one line", "why\n\nanalyze it\n\nfix: do it\n\nverify it", "why\nanalyze\nanalyze more\nconfirm", "x" * 200, "fix a\n\nfix b\n\nfix c", "a\n\n \n\nb", "诊断 it\n修 it"]
    got = [r.asDict() for r in col(spark, cases, texts.split_procedure)]
    assert got == [plain_parts(c) for c in cases]


def plain_clear(text, keep):
    blocks = list(re.finditer(r"__tool_result_([\w\-]+?)__(.*?)__/tool_result__", text, re.S))
    for m in reversed(blocks[: max(0, len(blocks) - keep)]):
        text = text[: m.start()] + f"[TOOL_RESULT_CLEARED:{m.group(1)}]" + text[m.end() :]
    return text


def test_cleared_results_equal_plain_python(spark):
    one = "__tool_result_{}__{{\n}}__/tool_result__"
    cases = ["", "none", *[" a ".join(one.format(f"id-{k}") for k in range(n)) + " end" for n in range(1, 7)]]
    for keep in (0, 1, 3):
        assert col(spark, cases, lambda t, keep=keep: texts.clear_tool_results(t, keep)) == [plain_clear(c, keep) for c in cases]
    assert col(spark, [None], texts.clear_tool_results) == [None]


def test_distilled_text_has_no_private_sentence(spark):
    cases = ["Use a lock. Then my key is red. Write to a@b.org!", "our salary is 5. See ~/x/y and 10.1.2.3.", None, "", "I am. me."]
    assert col(spark, cases, texts.distill) == ["Use a lock. Write to [REDACTED:email]!", "See <PATH> and <IP>.", "", "", ""]


def test_dates_of_phrases(spark):
    anchor = F.lit(dt.date(2024, 3, 6))  # a Wednesday
    cases = {
        "today": "2024-03-06", "last weekend": "2024-03-02", "this weekend": "2024-03-09", "next weekend": "2024-03-16", "last friday": "2024-03-01", "friday": "2024-03-01", "wednesday": "2024-03-06",
        "next wednesday": "2024-03-13", "10 days ago": "2024-02-25", "3 months ago": "2023-12-06", "2 years ago": "2022-03-06", "on Feb 30, 2023": None, "Feb 28, 2023": "2023-02-28", "31/12/2023": "2023-12-28",
        "1.13": None, "5-6-99": "2099-06-05", "unknown": None, "": None, "99999 days ago": None,
    }
    got = col(spark, list(cases), lambda t: texts.resolve_date(t, anchor)["event_date"].cast("string"))
    assert dict(zip(cases, got)) == cases
    ranges = {"last week": ("2024-02-26", "2024-03-03"), "this month": ("2024-03-01", "2024-03-06"), "last month": ("2024-02-01", "2024-02-29"), "past 3 days": ("2024-03-03", "2024-03-06"), "2023-02-30": None, "this friday": ("2024-03-08", "2024-03-08"), "": None}
    found = col(spark, list(ranges), lambda t: texts.time_range(t, anchor))
    assert [r and (str(r["lo"]), str(r["hi"])) for r in found] == list(ranges.values())


def test_outcome_order(spark):
    cases = ["this works", "this works but that failed", "crash because of x; this failed", "R-class locked: that failed", "plain", None, " ", "the fix", "shipped, done, verified"]
    df = spark.createDataFrame([(c,) for c in cases], "t string").coalesce(1)
    got = [(r["outcome"], r["strength"]) for r in texts.with_outcome(df, "t").collect()]
    assert [g[0] for g in got] == ["success", "failure", "lesson", "success", "neutral", "neutral", "neutral", "neutral", "success"]
    assert got[2][1] == 0.7 and got[8][1] == 1.0


def test_negation_conflicts_link_classes(spark):
    base = "the red door opens with a small brass key at noon"
    rows = [(1, base), (2, base), (3, base.replace("opens", "never opens")), (4, "never mind the sea"), (5, None), (6, ""), (7, base + " and evening and morning and night or later then")]
    pairs, members = experiences.negation_conflicts(spark.createDataFrame(rows, "fact_id long, content string"))
    assert [tuple(r) for r in pairs.collect()] == [(1, 3, round(11 / 12, 6))]
    assert dict(map(tuple, members.collect())) == {1: 1, 2: 1, 3: 3, 4: 4, 7: 7}


def test_grounding_of_lists(spark):
    rows = [(1, "red blue green"), (2, "set (red/blue/green)"), (3, "set (red/blue/pink)"), (4, "no list"), (5, None), (6, "no parent")]
    facts = spark.createDataFrame(rows, "fact_id long, content string")
    edges = spark.createDataFrame([(k, 1) for k in (2, 3, 4, 5)], "child long, parent long")
    assert dict(map(tuple, texts.grounding_audit(facts, edges).collect())) == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_replacement_needs_kind_topic_and_importance(spark):
    f = spark.createDataFrame(
        [(1, "decision", "t", 0.5, False, None), (2, "decision", "t", 0.5, False, None), (3, "decision", "u", 0.1, False, None), (4, "decision", "t", 0.9, False, None), (5, "decision", "t", 0.1, True, None)],
        "fact_id long, kind string, topic string, importance double, tombstoned boolean, ended_days int",
    )
    near = spark.createDataFrame([(1, k, 0.9) for k in (2, 3, 4, 5)], "query_id long, fact_id long, score double")
    assert [tuple(r) for r in experiences.auto_invalidate(f, near, f, ["decision"]).collect()] == [(2, 1, 0.9)]


def test_mined_texts_are_new_and_clean(spark):
    facts = spark.createDataFrame([(1, "lesson", "A long enough text about locks and doors." * 2, False), (2, "lesson", "I am here.", False), (3, "fact", "x" * 99, False), (4, "lesson", None, False)], "fact_id long, kind string, content string, tombstoned boolean")
    none = spark.createDataFrame([], "fact_id long")
    assert [r["fact_id"] for r in texts.mine_public(facts, ["lesson"], none).collect()] == [1]
    assert texts.mine_public(facts, ["lesson"], facts.select("fact_id")).count() == 0


def test_auto_invalidate_looks_at_all_candidates(spark):
    # fact 30 is the least important of 30 and the only similar one
    old = [(k, "fact", "t", False, None, 0.9 - k / 100) for k in range(1, 31)]
    new = [(99, "fact", "t", 0.95)]
    facts = spark.createDataFrame(old, "fact_id long, kind string, topic string, tombstoned boolean, ended_days int, importance double")
    news = spark.createDataFrame(new, "fact_id long, kind string, topic string, importance double")
    similar = spark.createDataFrame([(99, k, 0.9 if k == 30 else 0.1) for k in range(1, 31)], "query_id long, fact_id long, score double")
    assert [tuple(r) for r in experiences.auto_invalidate(news, similar, facts, ["fact"]).collect()] == [(30, 99, 0.9)]
    assert experiences.auto_invalidate(news, similar, facts, ["fact"], most=20).count() == 0

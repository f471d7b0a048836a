"""Local identifiers in texts and JSON values, prefilters of private patterns, and names, against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill import catalog_texts
from corpusmill.operators import personal_names, private, scrubbing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text,want", [
    ("", ""), ("plain https://a.b/c text", "plain https://a.b/c text"),
    ("run D:\\proj\\tool\\a.py now", "run <root>\\tool\\a.py now"), ("at C:/Users/marlow/xx/y", "at <home>/xx/y"), ("C:\\Users\\marlow\\x; marlow said disallow, marlows", "<home>\\x; <user> said disallow, marlows"),
    ("/c/Users/bo/AppData/z", "<home>/AppData/z"), ("/d/data/z", "<root>/z"), ("/home/jane/q and jane", "<home>/q and <user>"), ("see \\\\srv01\\share\\f", "see \\\\<host>\\share\\f"),
    ("~/.tmp/x.html", "<home>/.tmp/x.html"), ("10.1.2.3 172.16.0.9 172.32.0.9 127.0.0.1 192.168.0.7", "<private-host>.3 <private-host> 172.32.0.9 127.0.0.1 <private-host>"),
    ("八字 丙子/丙申/壬辰/乙巳", "八字 <birth-pillars>"), ("甲子、甲辰、甲申、甲午", "甲子、甲辰、甲申、甲午"), ("born 1996-08-23, 生日是1990/1/2", "born <birth-date>, 生日是<birth-date>"),
    ("/home/admin2/x admin2 /home/all/y all", "<home>/x <user> <home>/y all"), ("D:/AI/users或C:/Users/zoe/k", "<root>/users或C:<home>/k"),
])
def test_identifiers(text, want):
    assert scrubbing.scrub(text)[0] == want
    again, changes = scrubbing.scrub(want)
    assert again == want and not changes


def test_known_names_and_slots():
    assert scrubbing.scrub("marlow ran it as admin, _probe and x-test", {"marlow", "admin", "_probe", "x-test", "ab"})[0] == "<user> ran it as admin, _probe and x-test"
    assert scrubbing.scrub("小明说", {"小明们", "小明说"})[0] == "<user>"


def test_split_tokens():
    text, changes = scrubbing.rejoin("open maker_pocket. py at mp. weixin. qq. com, bus. _connect, a/. venv. It failed. local retry")
    assert text == "open maker_pocket.py at mp.weixin.qq.com, bus._connect, a/.venv. It failed. local retry"
    assert [c.kind for c in changes] == ["split_file", "split_identifier", "split_dotdir", "split_domain"]


def leaves(x):
    if isinstance(x, dict):
        return {k: leaves(v) for k, v in x.items()}
    if isinstance(x, list):
        return [leaves(v) for v in x]
    if isinstance(x, str):
        try:
            inner = json.loads(x)
        except ValueError:
            inner = None
        return json.dumps(leaves(inner), ensure_ascii=False) if isinstance(inner, (dict, list)) else scrubbing._without_names(scrubbing.scrub(x)[0], NAMES, [])
    return x


NAMES = {"marlow"}


def test_json_is_rewritten_by_its_strings_alone():
    rnd = random.Random(3)
    words = ["marlow", "C:\\Users\\jane\\x", "10.0.0.1", "plain", '"q"', "é漢", "a\nb", "~/k", '{"p": "/home/eve/z"}', "x: y", ""]

    def value(depth):
        kind = rnd.randrange(6 if depth else 3)
        if kind == 0:
            return rnd.choice(words)
        if kind == 1:
            return rnd.choice([1, 2.50, -3e10, True, None])
        if kind == 2:
            return " ".join(rnd.choice(words[:8]) for _ in range(3))
        return [value(depth - 1) for _ in range(rnd.randrange(4))] if kind < 4 else {rnd.choice(words): value(depth - 1) for _ in range(rnd.randrange(4))}

    for _ in range(300):
        x = [value(3)]
        for text in (json.dumps(x), json.dumps(x, ensure_ascii=False, indent=1)):
            got, _ = scrubbing.scrub_value(text, NAMES)
            assert json.loads(got) == leaves(x)
    for text in (' {"a" : 1.500,\n "b":[1e400, 12345678901234567890123] } ', '{"a": "plain"}'):
        assert scrubbing.scrub_value(text, NAMES) == (text, [])
    broken = '{"a": "/home/eve/z", '
    assert scrubbing.scrub_value(broken, set())[0] == scrubbing.scrub(broken)[0]
    deep = "[" * 100_000 + "]" * 100_000
    assert scrubbing.scrub_value(deep, set())[0] == deep


def test_rows_share_names(spark):
    rows = [(1, '{"p": "x"}', "/home/marlow/a", 5), (2, None, "", 5), (3, '["marlow"]', "C:/Users/marlow", 5), (4, "marlow", None, 5), (5, "w " * 200_000, "ok", 5), (3, '["marlow"]', "C:/Users/marlow", 5)]
    df = spark.createDataFrame(rows, "id long, p string, q string, scrubbed_ int").withColumn("changes", F.lit(1))
    out = scrubbing.scrub_values(df, ["p", "q"])
    assert out.columns == ["id", "p", "q", "scrubbed_", "changes"]
    got = {r["id"]: (r["p"], r["q"], [c["kind"] for c in r["changes"]]) for r in out.collect()}
    assert got[1] == ('{"p": "x"}', "<home>/a", ["posix_home"]) and got[2] == (None, "", []) and got[4] == ("marlow", None, [])
    assert got[3][:2] == ('["<user>"]', "<home>") and got[5][2] == [] and out.count() == 6
    assert scrubbing.scrub_values(df.limit(0), ["p"]).count() == 0


def test_queries_of_scrubbing_equal_plain_python(spark):
    plain = {r["event_id"]: scrubbing.scrub_row([r["props"], r["note"]]) for r in catalog_texts.nested_props(spark, SF).collect()}
    rows = catalog_texts.j8(spark, SF).collect()
    assert rows and all(([r["props"], r["note"]], r["n_changes"]) == (plain[r["event_id"]][0], len(plain[r["event_id"]][1])) for r in rows)
    assert not any("bob" in json.dumps([v for k, v in json.loads(r["props"]).items()]) for r in rows if r["event_id"] % 5 > 1)
    kinds = {k for r in catalog_texts.j7_names(spark, SF).collect() for k in r["kinds"].split(",")}
    assert {"windows_path", "posix_home", "birth_date", "username"} <= kinds


def test_prefilter_loses_no_match():
    """Whatever a pattern matches must meet the pattern's needs: matches are made from the pattern itself."""
    from re import _constants as C
    from re import _parser as parser

    rnd = random.Random(8)

    def one(items):
        out = ""
        for op, arg in items:
            if op is C.LITERAL:
                out += chr(arg)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, body = arg
                out += "".join(one(body) for _ in range(rnd.randint(low, min(int(high), low + 3))))
            elif op is C.SUBPATTERN:
                out += one(arg[3])
            elif op is C.BRANCH:
                out += one(rnd.choice(arg[1]))
            elif op is C.IN:
                kind, value = rnd.choice(arg)
                if kind is C.NEGATE:
                    out += "q"
                else:
                    out += chr(value) if kind is C.LITERAL else chr(rnd.randint(*value)) if kind is C.RANGE else {C.CATEGORY_DIGIT: "7", C.CATEGORY_SPACE: " ", C.CATEGORY_NOT_SPACE: "z"}[value]
            elif op is C.CATEGORY:
                out += {C.CATEGORY_DIGIT: "7", C.CATEGORY_SPACE: " "}[arg]
        return out

    finder = private.Finder(private.PATTERNS)
    for k, (name, pattern, _) in enumerate(private.PATTERNS):
        made = 0
        for _ in range(300):
            text = f"see ?{one(parser.parse(pattern))} end"
            if re.search(pattern, text):
                made += 1
                assert k in finder.tried(text), (name, text)
        assert made or name in ("unix_home_path",), name


def test_names_need_a_whole_run(spark):
    rows = [(None, None), ("李雷", True), ("x李雷y", True), ("李雷来了", True), ("李 雷", False), ("李雷强，", True), ("雷李", False), ("李李", False), ("方法", False), ("", False)]
    df = spark.createDataFrame(rows, "t string, y boolean")
    assert [r[0] for r in df.coalesce(1).select(personal_names.first_name(F.col("t"), "李方", "雷强")).collect()] == [None, "李雷", "李雷", None, None, "李雷强", None, None, None, None]
    assert tuple(personal_names.measure(df, "t", "y", "李方", "雷强").first()) == (3, 0, 1, 6, 1.0, 0.75)
    assert tuple(personal_names.measure(df.limit(0), "t", "y", "李", "雷").first()) == (0, 0, 0, 0, None, None)

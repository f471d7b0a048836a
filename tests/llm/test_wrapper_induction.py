"""Wrapper induction: what alignment decides without marks, what marks decide without a host, and articles that must not go."""

import random

import pytest

from corpusmill.llm import wrappers

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, PAGES)).collect()}


@pytest.mark.parametrize("html,want", [
    ('<div class="content no-sidebar"><p>Article text', "Article text"), ('<div class="layout-with-nav"><p>Article text', "Article text"),
    ('<div id="page" class="comments-open"><p>Article text', "Article text"), ('<section class="pagination-enabled post"><p>Article text', "Article text"),
    ("<main><p>real</p></main><article><p>related card</p></article>", "real"),
    ("<article>A teaser</article><div><p>The long story of the page</p><p>goes on here</p></div>", "A teaser\nThe long story of the page\ngoes on here"),
    ("<article><h1>T</h1><p>one</p></article><article><p>two</p></article><p>x</p>", "T\none\ntwo"), ("<main><div>menu of the page</div><article><p>The story that is longer</p></article></main>", "The story that is longer"),
    ('<div class="site-footer">f</div><div class="main-nav">n</div><div class="sidebar-left">s</div><div class="ad-slot-300x250">a</div><div class="post-comments-list">c</div><p>text</p>', "text"),
    ('<div class="adsorption nav2vec commentary">text</div>', "text"), ('<div class="is-open">a</div><div class="not-found">b</div>', "a\nb"),
])
def test_pages_without_a_host(spark, html, want):
    assert texts(spark, [(1, "http://one/", html)]) == {1: want}


def host(rnd, n, low, high):
    """Pages of numbered classes alone: menus, boxes and footers with words of their own on each page, and an article."""
    words = lambda k: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randrange(99)) for _ in range(k))
    rows, want = [], {}
    for k in range(n):
        blocks = [f"Title {k} {words(3)}"] + [words(rnd.randrange(8, 60)) for _ in range(rnd.randrange(low, high))]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        if k % 3 == 0:
            blocks.append(words(2))
            body += f"<blockquote>{blocks[-1]}</blockquote>"
        menu = "".join(f"<li><a href=/{i}>{words(1)}</a>" for i in range(5))
        rows.append((k, "https://www.h.example/p", f"<body><div class=c1><ul>{menu}</ul></div><div class=c2>{words(4)}</div><div class=c3><div class=c4>{body}</div><div class=c5>{words(2)}</div></div><div class=c6>&copy; all rights {words(1)}</div></body>"))
        want[k] = "\n".join(blocks)
    return rows, want


@pytest.mark.parametrize("seed", range(4))
def test_numbered_classes_are_told_apart_by_alignment(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    rows, want = host(rnd, 8 + 10 * seed, 3, 9)
    assert texts(spark, rows) == want
    few = [r for r in rows if r[0] < 4]  # too few pages for a wrapper: boxes and menus stay
    assert all(text != want[k] for k, text in texts(spark, few).items())


def test_templates_of_the_given_pages_are_not_empty(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = wrappers.induce(pages.select(wrappers.host_of(pages["url"]).alias("host"), "html")).collect()
    with_slots = [r for r in found if r["slots"]]
    assert with_slots
    for r in with_slots:
        keys = {}
        todo = [wrappers.load(r["template"])]
        while todo:
            node = todo.pop()
            keys[node.number] = node.key
            todo += node.children
        assert [keys[k] for k in r["slots"]] == ["article"]


def test_slots_decide_against_a_marked_teaser(spark):
    rnd = random.Random(9)
    rows, want = host(rnd, 12, 3, 6)
    teased = [(k, u, h.replace("<div class=c3>", f"<article>Read also {k}: " + "more " * 200 + "</article><div class=c3>") if k == 5 else h) for k, u, h in rows]
    got = texts(spark, teased)
    assert {k: v for k, v in got.items() if k != 5} == {k: v for k, v in want.items() if k != 5}


def test_pages_of_another_layout_are_read_by_marks(spark):
    rows, want = host(random.Random(2), 20, 3, 6)
    rows.append((99, "https://h.example/x", "<body><table><tr><td><p>Another layout</p><p>of one page</p></td></tr></table></body>"))
    got = texts(spark, rows)
    assert got.pop(99) == "Another layout\nof one page" and got == want


def test_constant_text_goes_but_for_articles(spark):
    page = "<body><div class=c1><p>{k} the text of this page</p><h2>Summary</h2><p>{k} more of it</p><div class=c2>Always the same</div></div></body>"
    rows = [(k, "http://a/", page.format(k=k)) for k in range(6)] + [(10 + k, "http://b/", page.format(k=k).replace("<div class=c1>", "<article>").replace("</div></body>", "</article></body>")) for k in range(6)]
    got = texts(spark, rows)
    assert all(got[k] == f"{k} the text of this page\n{k} more of it" for k in range(6))
    assert all(got[10 + k] == f"{k} the text of this page\nSummary\n{k} more of it\nAlways the same" for k in range(6))


def test_slots_lie_on_the_way_of_most_text():
    t = wrappers.load("r:9(nav:9\tdiv:9(h1:9\tdiv:9(p:9\tul:2\tdiv.b:9))\tdiv.c:9\th2:9)")
    number = {k: i for i, k in enumerate("r nav div h1 inner p ul b c h2".split())}
    chars = {number["p"]: 900, number["h1"]: 40, number["ul"]: 9, number["b"]: 30, number["c"]: 50, number["h2"]: 20, number["nav"]: 0}
    slots, dropped = wrappers.content_slots(t, chars, set())
    assert sorted(slots) == sorted([number["h2"], number["h1"], number["inner"]]) and dropped == [number["b"]]
    assert wrappers.content_slots(t, chars, {number["h2"]})[0] == [number["h1"], number["inner"]]
    assert wrappers.content_slots(t, {}, set()) == ([], [])

"""HTML main-text extraction by wrapper induction.

Pages of a host are parsed to DOM trees whose block nodes form a skeleton (adjacent siblings of one kind share a node).
Simple tree matching aligns the skeletons of a host and unites them to its template, in rounds of bounded groups. Over all
distinct contents every template node then shows how often it recurs, how many different texts it has and how much text
outside links: a node that recurs with few texts is constant and belongs to the template, the slots that hold most of the
varying text are the content. Extraction aligns each page with its host's template and reads the content slots, without page
furniture: nodes marked by tag, role or class and id words, and nodes with softer words (legal, related, share and the like)
where the template holds them constant or links make up most of their text.

Unknown hosts, hosts of few pages and pages that do not show their host's content slots are read by marks and links alone:
main or article, where one holds most of the text around it, else the body.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.runtime import bounded_batches, checkpoint

MIN_PAGES = 5
BROADCAST_BYTES = 16 << 20
#: Levels of a skeleton; what lies deeper belongs to the node above it. A bound of recursion, far beyond what pages show.
MAX_DEPTH = 128
FAN_IN = 64
RARE = 1 / 16
CELLS = 4_000_000
#: A node is constant with at most this share of different texts; content is followed into a node with this share of the text;
#: a slot beside it counts as content from this share of it on; a page with less than this share of its text there is read by marks.
SAME, MOST, FAIR, SHOWN = 1 / 4, 1 / 2, 1 / 10, 1 / 4
#: Share of the pages that have what belongs to every page.
USUAL = 0.9

# HTML element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
BLOCK = set(
    "html head body address article aside blockquote caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"},
}
SCOPE = set("table ul ol dl td th body html article section div main".split())
# Marks of page furniture. Soft words also name parts of articles and need evidence of the page or host.
NOISE_TAGS = set("head nav footer aside form script style noscript iframe svg template button select option textarea input dialog menu object canvas video audio".split())
FIRM_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter subscribe subscription "
    "signup login nav navigation navbar menu breadcrumb breadcrumbs sidebar footer comments commentlist disqus pagination pager".split()
)
SOFT_WORDS = set(
    "promotion banner notice notices alert overlay aside related recommended recommendations share sharing social comment reply replies respond widget toolbar "
    "copyright legal disclaimer hidden skip".split()
)
# Soft words that are firm where a name has nothing but furniture and layout words.
NAMED_WORDS = set("notice notices comment reply replies banner overlay".split())
LAYOUT_WORDS = set(
    "area bar block body bottom box button buttons card col column container content group header heading icon icons inner item items left link links list main outer "
    "panel post posts right row section site slot text title to top unit wrap wrapper".split()
)
# Words of a name that turn its meaning: a layout without a sidebar is no sidebar.
TURNING_WORDS = set("no not non without with has have is enable enabled disable disabled".split())
TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd td th caption figcaption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
KEPT_TAGS = {"html", "body", "article", "main"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
TOKEN = re.compile(r"[a-z0-9]+")


class Node:
    """An element: tag, key (tag with its class words), children (elements and texts), and its mark as furniture (0 none, 1 soft, 2 firm)."""

    __slots__ = ("tag", "key", "children", "noise")

    def __init__(self, tag: str, key: str, noise: int):
        self.tag, self.key, self.noise, self.children = tag, key, noise, []


def _mark(names: str) -> int:
    """How firmly class and id names mark furniture.

    A firm word marks a name that ends with it, words of layout apart, or that has none but words of furniture and layout.
    Parts with digits do not count.
    """
    mark = 0
    for name in names.split():
        words = [w for w in TOKEN.findall(name) if not any(map(str.isdigit, w))]
        if not TURNING_WORDS.isdisjoint(words):
            continue
        end = [w for w in words if w not in LAYOUT_WORDS][-1:]
        only = FIRM_WORDS.union(SOFT_WORDS, LAYOUT_WORDS).issuperset(words)
        if not FIRM_WORDS.isdisjoint(end) or (only and not (FIRM_WORDS | NAMED_WORDS).isdisjoint(words)):
            return 2
        if not SOFT_WORDS.isdisjoint(words):
            mark = 1
    return mark


def _element(tag: str, attributes: str) -> Node:
    noise, key = 2 * (tag in NOISE_TAGS), tag
    if attributes and not attributes.isspace():
        found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
        if found.get("class"):
            key = f"{tag}.{'.'.join(w for w in TOKEN.findall(found['class']) if not w.isdigit())}"
        if tag not in KEPT_TAGS:
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
            if hidden or found.get("role", "") in NOISE_ROLES:
                noise = 2
            noise = max(noise, _mark(f"{found.get('class', '')} {found.get('id', '')}"))
    return Node(tag, key, noise)


def parse(html: str) -> Node:
    """A lenient tree: implied end tags are closed, stray end tags ignored, unfinished tags and comments at the end dropped."""
    root = Node("#root", "#root", 0)
    stack, pos, n = [root], 0, len(html)
    opened: Counter[str] = Counter()

    def cut(k: int) -> None:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    while pos < n:
        m = TAG.search(html, pos)
        start = m.start() if m else n
        if start > pos:
            stack[-1].children.append(unescape(html[pos:start]))
        if not m:
            break
        pos = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k].tag == tag:
                    cut(k)
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK:
            ends = CLOSED_BY.get(tag, set()) | ({"p"} if tag not in ("html", "head", "body") else set())
            for k in range(len(stack) - 1, 0, -1) if any(opened[e] > 0 for e in ends) else ():
                if k < len(stack) and stack[k].tag in ends:
                    cut(k)
                    if tag not in ("tr", "tbody", "tfoot", "td", "th"):
                        break
                elif k < len(stack) and stack[k].tag in SCOPE and not (tag in CLOSED_BY and stack[k].tag in ends):
                    break
        node = _element(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
            if tag == "textarea":
                node.children.append(html[pos : end.start() if end else n])
            pos = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


class Shape:
    """A skeleton node: key, children, its number in preorder, the pages that have it, and a hash and the size of its subtree."""

    __slots__ = ("key", "children", "number", "weight", "code", "size")

    def __init__(self, key: str, children: list[Shape], weight: int = 1):
        self.key, self.weight, self.number = key, weight, 0
        self.close(children)

    def close(self, children: list[Shape]) -> None:
        self.children = children
        self.code = hash((self.key, *(c.code for c in children)))
        self.size = 1 + sum(c.size for c in children)


def skeleton(root: Node) -> tuple[list, list[str], dict[int, int], list[int]]:
    """(tree [key, children], own text of each node in preorder, node number by DOM node id, characters of each node).

    Adjacent sibling blocks of one key share a skeleton node; inline elements and levels below MAX_DEPTH belong to the
    block around them; scripts and styles have none. Characters are those of own text outside links and firm furniture.
    """
    texts, chars, number = [[]], [0], {id(root): 0}
    tree = [root.key, [], 0]
    # depth first in page order: an explicit stack of iterators keeps preorder numbers
    stack = [(iter(root.children), tree, 0, False)]
    while stack:
        it, here, depth, apart = stack[-1]
        for child in it:
            if isinstance(child, str):
                texts[here[2]].append(child)
                chars[here[2]] += 0 if apart else len(child) - child.count(" ")
                continue
            if child.tag in RAW:
                continue
            without = apart or child.noise == 2 or child.tag == "a"
            if child.tag in BLOCK and depth < MAX_DEPTH:
                if here[1] and here[1][-1][0] == child.key:
                    sub = here[1][-1]
                else:
                    sub = [child.key, [], len(texts)]
                    texts.append([])
                    chars.append(0)
                    here[1].append(sub)
                number[id(child)] = sub[2]
                stack.append((iter(child.children), sub, depth + 1, without))
            else:
                number[id(child)] = here[2]
                stack.append((iter(child.children), here, depth, without))
            break
        else:
            stack.pop()
    return tree, [" ".join(" ".join(t).split()) for t in texts], number, chars


def dump(tree: list) -> str:
    """A skeleton as text: keys, and children in brackets between tabs."""
    return tree[0] + ("(" + "\t".join(dump(c) for c in tree[1]) + ")" if tree[1] else "")


def write(shape: Shape) -> str:
    """The same form with the weight of each node after its key."""
    return f"{shape.key}:{shape.weight}" + ("(" + "\t".join(map(write, shape.children)) + ")" if shape.children else "")


def load(text: str, weight: int = 1) -> Shape:
    """The tree of a text form, numbered in preorder; nodes without a weight get the given one."""
    root = Shape("", [])
    stack, children, count, at = [root], [[]], 0, 0
    for m in re.finditer(r"[()\t]|\Z", text):
        if name := text[at : m.start()]:
            key, _, own = name.partition(":")
            node = Shape(key, [], int(own) if own else weight)
            node.number = count
            count += 1
            children[-1].append(node)
        if m[0] == "(":
            stack.append(children[-1][-1])
            children.append([])
        elif m[0] == ")":
            stack.pop().close(children.pop())
        at = m.end()
    return children[0][0]


def _pairs(weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Positions of the heaviest common order of x and y, whose items i and j match with weights[i, j].

    A row of the table is one numpy pass. Tables above CELLS are halved, first by x, so that memory grows with a row only.
    """
    if not len(x) or not len(y):
        return []
    if len(x) > 1 and len(x) * len(y) > CELLS:
        half = len(x) // 2

        def last(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            row = np.zeros(len(b) + 1, dtype=np.int64)
            for i in a:
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[i, b]))
            return row

        cut = int((last(x[:half], y) + last(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _pairs(weights, x[:half], y[:cut]) + [(i + half, j + cut) for i, j in _pairs(weights, x[half:], y[cut:])]
    m = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int64)
    for k, i in enumerate(x):
        m[k + 1, 1:] = np.maximum.accumulate(np.maximum(m[k, 1:], m[k, :-1] + weights[i, y]))
    out, i, j = [], len(x), len(y)
    while i and j:
        w = weights[x[i - 1], y[j - 1]]
        if w and m[i, j] == m[i - 1, j - 1] + w:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif m[i, j] == m[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def matching(a: Shape, b: Shape, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the largest number of matched nodes under equal roots, and the matched child positions.

    Equal subtrees match whole, so equal children at both ends are paired first, which loses nothing; the rest meets in one
    table over its distinct subtrees.
    """
    if a.key != b.key:
        return 0, []
    x, y = a.children, b.children
    if a.code == b.code:
        return a.size, [(k, k) for k in range(len(x))]
    key = a.code, b.code
    if key not in memo:
        head, tail = 0, 0
        most = min(len(x), len(y))
        while head < most and x[head].code == y[head].code:
            head += 1
        while tail < most - head and x[-1 - tail].code == y[-1 - tail].code:
            tail += 1
        inner_x, inner_y = x[head : len(x) - tail], y[head : len(y) - tail]
        place_x, place_y = ({code: k for k, code in enumerate(dict.fromkeys(n.code for n in inner))} for inner in (inner_x, inner_y))
        one_x, one_y = ({n.code: n for n in inner} for inner in (inner_x, inner_y))
        weights = np.array([[matching(one_x[p], one_y[q], memo)[0] for q in place_y] for p in place_x], dtype=np.int64).reshape(len(place_x), len(place_y))
        found = _pairs(weights, np.array([place_x[n.code] for n in inner_x], dtype=int), np.array([place_y[n.code] for n in inner_y], dtype=int))
        pairs = [(k, k) for k in range(head)] + [(i + head, j + head) for i, j in found] + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]
        total = 1 + sum(n.size for n in x[:head]) + sum(n.size for n in x[len(x) - tail :]) + sum(int(weights[place_x[inner_x[i].code], place_y[inner_y[j].code]]) for i, j in found)
        memo[key] = total, pairs
    return memo[key]


def unite(a: Shape, b: Shape, memo: dict | None = None) -> Shape:
    """The template that holds both trees: matched nodes once, with both weights, the others of both in order."""
    memo = {} if memo is None else memo
    out, i, j = [], 0, 0
    for p, q in [*matching(a, b, memo)[1], (len(a.children), len(b.children))]:
        out += a.children[i:p] + b.children[j:q]
        if p < len(a.children):
            out.append(unite(a.children[p], b.children[q], memo))
        i, j = p + 1, q + 1
    return Shape(a.key, out, a.weight + b.weight)


def prune(shape: Shape, least: float) -> Shape:
    """Without the nodes that fewer pages have."""
    return Shape(shape.key, [prune(c, least) for c in shape.children if c.weight >= least], shape.weight)


def align(template: Shape, tree: Shape) -> dict[int, int]:
    """Template node number of each aligned node of a tree."""
    memo: dict = {}
    out, todo = {}, [(template, tree)] if template.key == tree.key else []
    while todo:
        t, s = todo.pop()
        out[s.number] = t.number
        todo += [(t.children[i], s.children[j]) for i, j in matching(t, s, memo)[1]]
    return out


def links_prevail(node: Node) -> bool:
    """Do links hold at least half of the characters of a node that has any, or has it form fields?"""
    linked = total = 0
    todo: list[tuple[Node, bool]] = [(node, node.tag == "a")]
    while todo:
        here, inside = todo.pop()
        for child in here.children:
            if isinstance(child, str):
                n = len(child) - child.count(" ")
                total += n
                linked += n * inside
            elif child.tag in ("input", "select", "textarea", "button"):
                return True
            else:
                todo.append((child, inside or child.tag == "a"))
    return total > 0 and 2 * linked >= total


def content_slots(template: Shape, chars: dict[int, int], constant: set[int]) -> tuple[list[int], list[int]]:
    """(slots, dropped): template nodes under which content lies, and nodes under these that belong to the template.

    chars has the characters of all pages in each node. From the root the way leads into the child with at least MOST of the
    text, until text is spread or lies in paragraphs. What lies beside the way belongs to the template if it is constant, or if
    USUAL of all pages have it with less than a FAIR share of its fullest neighbour's text; headings that vary do not, and beside
    an article all does. At the end of the way the same holds for parts that are no paragraphs; an article is content as a whole.
    """
    total: dict[int, int] = {}

    def add(node: Shape) -> int:
        own = 0 if node.number in constant else chars.get(node.number, 0)
        total[node.number] = own + sum(map(add, node.children))
        return total[node.number]

    tag = lambda node: node.key.partition(".")[0]
    if not add(template):
        return [], []
    usual = lambda c, most: c.weight >= USUAL * template.weight and total[c.number] < FAIR * total[most.number]
    here, kept = template, []
    while here.children:
        heavy = max(here.children, key=lambda c: total[c.number])
        if total[heavy.number] < MOST * total[here.number] or tag(heavy) in TEXT_TAGS:
            break
        if tag(heavy) not in ("article", "main"):
            kept += [c.number for c in here.children if c is not heavy and total[c.number] and (tag(c) in HEADINGS or not usual(c, heavy))]
        here = heavy
    if tag(here) in ("article", "main") or not here.children:
        return [*kept, here.number], []
    fullest = max(here.children, key=lambda c: total[c.number])
    return [*kept, here.number], [c.number for c in here.children if tag(c) not in TEXT_TAGS and usual(c, fullest)]


def _letters(node: Node, furniture) -> int:
    """Characters of a node without spaces and furniture."""
    n, todo = 0, [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, str):
                n += len("".join(child.split()))
            elif child.tag not in RAW and not furniture(child):
                todo.append(child)
    return n


def _marked(root: Node, furniture) -> list[Node]:
    """The outermost main or article elements that hold most of the text around them, else the root."""
    def outermost(top: Node, tag: str) -> list[Node]:
        out, todo = [], [top]
        while todo:
            node = todo.pop()
            if node.tag == tag and node is not top:
                out.append(node)
            else:
                todo += [c for c in reversed(node.children) if not isinstance(c, str) and not furniture(c)]
        return out

    around = outermost(root, "main") or [root]
    articles = [a for region in around for a in outermost(region, "article")]
    if articles and sum(_letters(a, furniture) for a in articles) >= MOST * sum(_letters(r, furniture) for r in around):
        return articles
    return around


def main_text(root: Node, number: dict[int, int], constant: set[int] = frozenset(), slots: set[int] = frozenset(), dropped: set[int] = frozenset()) -> str:
    """Blocks of the content slots (skeleton numbers) of a page without dropped ones, or by marks alone where it shows too little of them.

    Furniture is left out of both; constant skeleton nodes are evidence for soft marks.
    """
    judged: dict[int, bool] = {}

    def furniture(node: Node) -> bool:
        if node.noise != 1:
            return node.noise == 2
        if id(node) not in judged:
            judged[id(node)] = number.get(id(node)) in constant or links_prevail(node)
        return judged[id(node)]

    regions = _marked(root, furniture)
    plain = _blocks(regions, furniture, constant, number)
    if not slots:
        return plain
    inside, todo = [], [root]
    while todo:
        node = todo.pop()
        if number.get(id(node)) in slots and (node.tag in BLOCK or node is root):
            inside.append(node)
        else:
            todo += [c for c in reversed(node.children) if not isinstance(c, str) and not furniture(c)]
    found = _blocks(inside, lambda node: furniture(node) or (node.tag in BLOCK and number.get(id(node)) in dropped), constant, number)
    return found if len(found) >= SHOWN * len(plain) else plain


def _blocks(regions: list[Node], furniture, constant: set[int], number: dict[int, int]) -> str:
    """Texts of the blocks in some elements, one a line, without furniture; but in an article, without constant text either.

    A header of the body itself is none of an article.
    """
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    for region in regions:
        article, headers_go = region.tag in ("article", "main"), region.tag in ("#root", "html", "body")
        stack = [(region, iter(region.children))]
        while stack:
            node, it = stack[-1]
            for child in it:
                if isinstance(child, str):
                    if article or number.get(id(node)) not in constant:
                        run.append(child)
                    continue
                if child.tag == "br":
                    run.append(" ")
                    continue
                if furniture(child) or child.tag in RAW or (child.tag == "header" and headers_go):
                    continue
                if child.tag in BLOCK:
                    flush()
                stack.append((child, iter(child.children)))
                break
            else:
                stack.pop()
                if node.tag in BLOCK:
                    flush()
        flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Host name in lower case without www; a null or odd url has ''."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1), F.lit(""))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def induce(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, template, constant, slots, dropped): each host's united skeleton, and the numbers of its constant nodes and content slots.

    A node is constant if min_pages pages at least and most of the host's have it, with different texts on a share SAME of
    them at most, while other nodes vary. A host of fewer distinct pages has neither. Pages whose text without furniture is equal are copies and count once, by one of them. The distinct
    skeletons of a host meet in groups of about FAN_IN, whose united trees meet in turn until one is left. A united tree
    leaves out nodes that under RARE of its group's pages have: a node on most pages of the host loses less than RARE of
    them a round and so stays for seven rounds (64^7 skeletons), while a template is at most 1 / RARE mean pages large.
    """

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for host, html in zip(b["host"], b["html"]):
                root = parse(html)
                tree, texts, number, chars = skeleton(root)
                # node -1 stands for the page
                filled = [(-1, 0, 0), *((k, _hash(t), chars[k]) for k, t in enumerate(texts) if t)]
                shape = dump(tree)
                rows.append((host, _hash(main_text(root, number)), _hash(shape), shape, *map(list, zip(*filled))))
            yield pd.DataFrame(rows, columns=["host", "content", "code", "shape", "node", "hash", "chars"])

    seen = pages.mapInPandas(observe, "host string, content long, code long, shape string, node array<int>, hash array<long>, chars array<int>")
    once = checkpoint(seen.groupBy("host", "content").agg(F.min(F.struct("code", "shape", "node", "hash", "chars")).alias("page")).select("host", "page.*"))
    # nodes carry the skeleton's code, not its text, which is as long as the page has nodes
    nodes = once.select("host", "code", F.inline(F.arrays_zip("node", "hash", "chars")))
    counts = checkpoint(nodes.groupBy("host", "code", "node", "hash").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")))
    shapes = checkpoint(once.groupBy("host", "code").agg(F.min("shape").alias("shape"), F.count("*").alias("n")))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        whole, memo = None, {}
        for shape, n in sorted(zip(group["shape"], group["n"])):
            tree = load(shape, n)
            whole = tree if whole is None else unite(whole, tree, memo)
        return pd.DataFrame({"host": group["host"].iloc[:1], "shape": [write(prune(whole, RARE * whole.weight))], "n": [whole.weight]})

    level = shapes.select("host", "shape", "n")
    while True:
        sizes = level.groupBy("host").agg(F.ceil(F.count("*") / FAN_IN).cast("int").alias("groups"))
        dealt = level.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("shape"), F.col("groups")).cast("int"))
        level = checkpoint(dealt.groupBy("host", "salt").applyInPandas(merge, "host string, shape string, n long"))
        if level.groupBy("host").count().where("count > 1").isEmpty():
            break
    templates = level.select("host", F.col("shape").alias("template"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, c, k, t) for h, c, s, w in zip(b["host"], b["code"], b["shape"], b["template"]) for k, t in align(load(w), load(s)).items()]
            yield pd.DataFrame(rows, columns=["host", "code", "node", "place"])

    placed = shapes.select("host", "code", "shape").join(templates, "host").mapInPandas(place, "host string, code long, node int, place int")
    texts = counts.join(placed, ["host", "code", "node"]).groupBy("host", "place", "hash").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    places = texts.groupBy("host", "place").agg(F.sum("n").alias("pages"), F.count("*").alias("kinds"), F.sum("chars").alias("chars"))
    total = counts.where("node = -1").groupBy("host").agg(F.sum("n").alias("total")).where(F.col("total") >= min_pages)
    fixed = (F.col("pages") >= min_pages) & (2 * F.col("pages") > F.col("total")) & (F.col("kinds") <= F.greatest(F.lit(1.0), SAME * F.col("pages")))
    judged = places.join(total, "host").select("host", F.struct("place", "chars", fixed.alias("fixed"), (F.col("kinds") > 1).alias("varies")).alias("of"))
    known = templates.join(judged.groupBy("host").agg(F.collect_list("of").alias("places")), "host")  # as many as the template has nodes

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for host, template, found in zip(b["host"], b["template"], b["places"]):
                constant = {p["place"] for p in found if p["fixed"]}
                if not any(p["varies"] and p["chars"] for p in found):
                    constant = set()  # pages that only grow are no template
                rows.append((host, template, sorted(constant), *content_slots(load(template), {p["place"]: p["chars"] for p in found}, constant)))
            yield pd.DataFrame(rows, columns=["host", "template", "constant", "slots", "dropped"])

    return checkpoint(known.mapInPandas(choose, "host string, template string, constant array<int>, slots array<int>, dropped array<int>"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Return (page_id, url, text, n_chars) for every page (page_id, url, html).

    A null html counts as empty and gives an empty text; a null url belongs to the host ''. Repeated rows stay; very long
    and deeply nested pages are read whole; no rows give no rows; other columns of pages, whatever their names, are left out.
    Hosts of fewer than min_pages distinct pages have no wrapper and are read by marks alone.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    wrappers = induce(rows.select("host", "html"), min_pages)
    size = wrappers.agg(F.sum(F.octet_length("template") + 4 * (F.size("constant") + F.size("slots") + F.size("dropped")) + F.octet_length("host") + 64).alias("b")).first()["b"] or 0
    # a larger table of wrappers meets its pages on the host; the pages of a hot one are split where Spark splits skewed joins
    joined = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Shape] = {}
        placed: dict[tuple[str, str], dict[int, int]] = {}
        for b in batches:
            out = []
            if len(loaded) > 256 or len(placed) > 4096:
                loaded.clear()
                placed.clear()
            for html, template, *numbers in zip(*(b[c] for c in ("html", "template", "constant", "slots", "dropped"))):
                root = parse(html)
                tree, _, number, _ = skeleton(root)
                sets: list[set[int]] = []
                if template is not None:
                    shape = dump(tree)
                    if template not in loaded:
                        loaded[template] = load(template)
                    if (template, shape) not in placed:
                        placed[template, shape] = align(loaded[template], load(shape))
                    wanted = [set(np.asarray(x).tolist()) for x in numbers]
                    sets = [{k for k, t in placed[template, shape].items() if t in w} for w in wanted]
                out.append(main_text(root, number, *sets))
            yield pd.DataFrame({"page_id": b["page_id"].to_numpy(), "url": b["url"].to_numpy(), "text": out})

    kind = dict(pages.dtypes)
    found = joined.select("page_id", "url", "html", "template", "constant", "slots", "dropped").mapInPandas(run, f"page_id {kind['page_id']}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))

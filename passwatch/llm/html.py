"""Main text of web pages by tree scoring.

A tolerant reader builds a page's tree in one pass. Parts that are never the article (menus, headers and footers of the page, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are cut by element, by role, and by class or id where all its words name such
parts; inside an <article> or <main> only boxes, and paragraphs that advertise, are cut by words. An element that merely mentions a part among other words
(`with-sidebar`), and a form, is cut unless it holds most of the page's text outside links: then it is the article's wrapper.
Every paragraph-like block passes points for its length and its commas to its parent in full, to its grandparent by half and
to further ancestors by less; a container's sum is discounted by the share of its text that lies in links. The best container is kept, and at
each level from it up to the page those siblings that read like text: all of them inside an <article> or <main>, elsewhere headings of what
follows, paragraphs, lists, tables and boxes of sentences, unless links make up most of them. Blocks give one line each in page order,
references decoded and white space collapsed. Names of elements weigh in the score and choose among siblings, but don't choose the container.

Edge cases: a null or blank page, or one without text outside the cut parts, gives an empty text; a page cut off in a tag
loses that tag, and a reference without its semicolon is decoded where HTML has it; nothing is capped, however long or deep the page (the time
is linear in both); repeated rows are read each for itself; other columns are not read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import map_arrow, texts_of

# Names of elements and of parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("aside button canvas datalist dialog embed footer form head iframe input link menu meta nav noscript object script search select style svg template textarea title".split())
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "tbody": frozenset(["thead", "tbody", "tr", "td", "th"])}
SCOPE = frozenset("ul ol dl table body html div section article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCORED = frozenset("p pre td blockquote li dd div section article main".split())
PART_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus"
    " footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination popup promo"
    " related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar topbar widget widgets".split()
)
CALLS = frozenset("ad ads advert advertisement newsletter promo signup sponsor sponsored subscribe".split())
PART_ROLES = frozenset("banner navigation complementary contentinfo search alert dialog menu menubar form".split())
#: Words that say nothing about a box's content.
PLAIN_WORDS = frozenset("area articles bar block box button buttons container content form group icon icons inner item items section link links list module panel posts reader row stories thread user wrap wrapper".split())
BOXES = frozenset("article aside div dl figure footer header ol section table ul".split())
PROSE = frozenset("blockquote dl figure ol p pre table ul".split())
TABLES = frozenset("table tr tbody thead tfoot body html div article section main".split())
BODY_WORDS = frozenset("article body content entry main post story text".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("tag", "words", "parent", "children", "text", "linked", "links", "blocks", "points", "doubtful")

    def __init__(self, tag: str, words: frozenset, parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.children: list[Node | str] = []
        self.text = self.linked = self.links = 0  # characters below, those of them inside links, and links
        self.blocks = False  # whether a block lies below
        self.points = 0.0
        self.doubtful = False  # a part by its words, unless it holds most of the page's text


PART, DOUBTFUL = 2, 1


def is_part(tag: str, words: frozenset, in_article: bool) -> int:
    """PART for an element that is not the article, DOUBTFUL for one that is none unless it holds most of the text, 0 for any other."""
    if tag == "form" and not in_article:
        return DOUBTFUL
    if tag in NEVER or "__hidden" in words or "__part" in words:
        return PART
    if tag in ("html", "body", "main"):
        return 0
    if tag == "article":
        return PART * bool(words & {"comment", "comments", "reply", "replies"})
    if in_article:
        return PART * ("__named" in words and (tag in BOXES or tag == "p" and bool(words & CALLS)))
    if tag == "header" or "__named" in words:
        return PART
    return DOUBTFUL * (bool(words & PART_WORDS) and not words & {"article", "main"})


def names(attributes: str) -> frozenset:
    out = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            own = {w.lower() for w in WORD.findall(value)}
            out |= own
            own -= PLAIN_WORDS
            if own and own <= PART_WORDS:
                out.add("__named")  # by this attribute nothing but a part
        elif name == "role":
            if value.lower() in PART_ROLES:
                out.add("__part")
            elif value.lower() == "main":
                out.add("main")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out.add("__hidden")
    return frozenset(out)


class Open:
    """The open elements by name: in all, since the last table or cell, and since the last element that bounds paragraphs and items."""

    def __init__(self):
        self.all, self.cell, self.scope = {}, [{}], [{}]

    def add(self, tag: str) -> None:
        if tag in ("td", "th", "table"):
            self.cell.append({})
        if tag in SCOPE:
            self.scope.append({})
        for counts in (self.all, self.cell[-1], self.scope[-1]):
            counts[tag] = counts.get(tag, 0) + 1

    def remove(self, tag: str) -> None:
        for counts in (self.all, self.cell[-1], self.scope[-1]):
            counts[tag] -= 1
        if tag in ("td", "th", "table"):
            self.cell.pop()
        if tag in SCOPE:
            self.scope.pop()


def tree(page: str) -> Node:
    """The page's tree without the parts that are never the article."""
    root = Node("html", frozenset(), None)
    at, here, n = 0, root, len(page)
    cut = None  # the node whose subtree is thrown away
    doubts = False
    open_ = Open()

    def leave(last: Node) -> Node:
        """End every open element up to and with `last`; each element ends once, so that all ends together are linear."""
        nonlocal cut
        step = here
        while True:
            open_.remove(step.tag)
            if step is cut:
                cut = None
            if step is last:
                return last.parent
            step = step.parent

    def nearest(names_) -> Node:
        node = here
        while node.tag not in names_:
            node = node.parent
        return node

    while at < n:
        found = TOKEN.search(page, at)
        if cut is None and (end := found.start() if found else n) > at:
            here.children.append(page[at:end])
        if not found:
            break
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[5], found[6], found[7])
        if not tag or not (found[4] or found[8]):
            continue  # a comment, a declaration, or a tag that the end of the page cuts off
        tag = tag.lower()
        if tag in ("html", "body"):
            continue
        if closing:
            # a cell or table keeps the ends of what stands around it out
            if (open_.all if tag in TABLES or tag in ("td", "th") else open_.cell[-1]).get(tag):
                here = leave(nearest((tag,)))
            continue
        if tag in BLOCK:
            # a block ends an open paragraph, a heading a heading, and an item the item before it
            ends = {"p", *CLOSED_BY.get(tag, ()), *(HEADINGS if tag in HEADINGS else ())}
            counts = open_.scope[-1]
            while open_ends := [e for e in ends if counts.get(e)]:
                here = leave(nearest(open_ends))
        words = names(attributes) if attributes.strip(" /") else frozenset()
        kind = 0 if cut is not None else is_part(tag, words, bool(open_.all.get("article") or open_.all.get("main")))
        part = kind == PART
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            inner, at = (page[at : end.start()], end.end()) if end else (page[at:], n)
            if cut is None and not part:
                here.children.append(inner)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            if cut is None and tag in ("br", "hr", "wbr"):
                here.children.append(Node(tag, frozenset(), here))
            continue
        node = Node(tag, words, here)
        open_.add(tag)
        if kind == DOUBTFUL:
            node.doubtful, doubts = True, True
        if part:
            cut = node
        elif cut is None:
            here.children.append(node)
        here = node
    if doubts:
        settle(root)
    return root


def settle(root: Node) -> None:
    """Cut the doubtful elements but those that hold most of the text outside links."""
    nodes = walk(root)
    size = {}
    for node in reversed(nodes):
        own = sum(len(c.strip()) if isinstance(c, str) else size[id(c)] for c in node.children)
        size[id(node)] = 0 if node.tag == "a" else own
    for node in nodes:
        if node.doubtful and size[id(node)] <= 0.5 * size[id(root)]:
            node.parent.children = [c for c in node.parent.children if c is not node]


def walk(root: Node) -> list[Node]:
    """Every element, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def score(root: Node) -> list[Node]:
    """Fill in texts, links and points; returns every element."""
    nodes = walk(root)
    for node in reversed(nodes):
        node.text += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.linked, node.links = node.text, node.links + 1
        if (above := node.parent) is not None:
            above.text += node.text
            above.linked += node.linked
            above.links += node.links
            above.blocks |= node.blocks or node.tag in BLOCK
    for node in nodes:
        if node.tag not in SCORED or node.blocks or node.text < 25:
            continue
        plain = flat(node)
        points = (1 + plain.count(",") + min(len(plain) // 100, 3)) * (1 - node.linked / node.text)
        above, level = node.parent, 1
        while above is not None and level <= 5:
            above.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            above, level = above.parent, level + 1
    for node in nodes:
        node.points *= 1 - node.linked / max(node.text, 1)
        if node.tag in ("article", "main") or node.words & BODY_WORDS:
            node.points *= 1.25
    return nodes


def flat(node: Node) -> str:
    """All text below a node."""
    out, stack = [], [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            stack.extend(reversed(item.children))
    return "".join(out)


def is_menu(node: Node) -> bool:
    """A list or box that is nearly all links."""
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.links > 1 and node.linked > 0.8 * node.text


def lines(nodes: list[Node | str], menus: bool) -> list[str]:
    """One line for each run of inline content, in page order; lists of links outside an <article> or <main> only with `menus`."""
    out, run = [], []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack = [iter(nodes)]
    blocks = [False]
    inside = [menus]
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            inside.pop()
            if blocks.pop():
                flush()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag in ("br", "wbr"):
            run.append(" " * (item.tag == "br"))
        elif item.tag == "hr":
            flush()
        elif inside[-1] or not is_menu(item):
            if item.tag in BLOCK:
                flush()
            blocks.append(item.tag in BLOCK)
            inside.append(inside[-1] or item.tag in ("article", "main"))
            stack.append(iter(item.children))
    flush()
    return out


def reads(item: Node | str) -> bool:
    """Whether a sibling outside an <article> reads like a part of the text."""
    if isinstance(item, str):
        return len(item.strip()) >= 25 or item.strip().endswith((".", "!", "?"))
    if not item.text or item.linked > 0.5 * item.text:
        return False
    if item.tag in PROSE or item.tag in ("article", "main") or item.points > 0:
        return True
    return flat(item).rstrip().endswith((".", "!", "?", ":", "…", '"', "”"))


def is_heading(node: Node) -> bool:
    """A heading, or boxes around nothing but one."""
    while node.tag not in HEADINGS:
        inner = [c for c in node.children if not isinstance(c, str) or c.strip()]
        if len(inner) != 1 or isinstance(inner[0], str) or node.tag not in BOXES:
            return False
        node = inner[0]
    return True


def kept(best: Node) -> list[tuple[list[Node | str], bool]]:
    """The best container and, at each level above it, what is kept of its siblings: runs in page order, and whether an <article> or
    <main> holds them."""
    held = []  # whether an <article> or <main> holds the level, from the best container up
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    inside = False
    for node in reversed(path[1:]):
        inside |= node.tag in ("article", "main")
        held.append(inside)
    held.reverse()
    before, after = [], []
    for node, article in zip(path, held):
        level = node.parent.children
        at = next(i for i, c in enumerate(level) if c is node)
        good, follows = [], False
        for k in range(len(level) - 1, -1, -1):
            item = level[k]
            if k == at:
                follows = True
                continue
            heads = not isinstance(item, str) and is_heading(item)
            if article or (follows and item.linked <= 0.5 * item.text if heads else reads(item)):
                good.append((k, item))
                follows = True
        good.reverse()
        before.append(([c for k, c in good if k < at], article))
        after.append(([c for k, c in good if k > at], article))
    return [*reversed(before), ([best], held[0] if held else False), *after]


def main_text(page: str) -> str:
    root = tree(page)
    nodes = score(root)
    best = max(nodes, key=lambda x: x.points)
    if best.points == 0:
        return "\n".join(lines([root], False))
    return "\n".join(line for run, article in kept(best) for line in lines(run, article))


def extract(df: DataFrame, html: str, keep: list[str], name: str = "text") -> DataFrame:
    """The columns `keep` and the main text of `html`. Rows are independent: no shuffle."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"`{name}` string"])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*batch.columns[: len(keep)], pa.array(map(main_text, texts_of(batch.column(len(keep)))), pa.string())], [*keep, name])

    return map_arrow(df.select(*keep, F.col(html).alias("__html")), kernel, schema, "__html")

"""Main text of web pages by composite text density.

A page is parsed into blocks (inline tags belong to the block around them). Menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts and styles are known by tag, role, class or id (whole tokens) and left out; a class or id,
and a form, does not count where the block holds <main>, the article, or blocks of most of the text that is not in links. Each remaining node has its
characters per tag, adjusted for links; a node's sum is that of its children's densities (a leaf's own). The node of the
largest sum is the core of the article, and the smallest density on the path to it from the body is the threshold. Where
the core holds one <article> or <main> of most of its text, that is the core.

From the core the article grows along the path to the body. Inside an <article> all is kept but lists of links: two links
or more that make up over half of the text of a block below the threshold. Beside an <article> only its first headings and
further articles that reach the threshold are kept. Where no <article> holds the core, a block beside the path is kept if it
is built like the one on the path (same tag and class or id; or up to digits and reaching the threshold; or a <div> without any) or a heading, a list, a table; a
paragraph or figure directly in the body, and any section or block of another name, if it reaches the threshold, the named
block also 80 characters, and if no menu, header or footer stands beside it; text that is mostly links is not kept.

Null and empty pages, and pages without text, give an empty text. Unclosed and stray tags are repaired; markup that never
ends is read as text, a comment that never ends hides the rest. Rows are treated one by one, so repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import free_name

# HTML element names and their roles in parsing.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr q ruby rp rt s samp small span strike strong sub sup svg time tt u var wbr".split())
FOREIGN = frozenset(["svg", "math"])
#: What ends unclosed foreign markup.
BREAKOUT = frozenset("article aside b blockquote br center code dd div dl dt em figure footer form h1 h2 h3 h4 h5 h6 header hr i img li main nav ol p pre section small span strong table td th tr u ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object textarea title annotation annotation-xml select".split())
SKIPPED = frozenset("nav header footer aside form button menu dialog head fieldset".split()) | RAW
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: A class or id token is a mark if all of its parts (between hyphens and underscores) are words of one of the two sets, one of MARKS at least.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored sponsorship promo promos promotion promotions promotional banner banners"
    " nav navs navbar navigation navlinks navmenu menu menus menubar menuitem breadcrumb breadcrumbs sidebar sidebars footer header masthead cookie cookies consent notice gdpr popup modal newsletter"
    " subscribe signup comment comments disqus respond replies share sharing social related recommend recommended recommendation recommendations widget widgets pagination pager toolbar login search skip"
    " copyright tags".split()
)
BESIDE = frozenset(
    "site page global main primary secondary top bottom left right upper lower mobile desktop sticky fixed google bar box list lists link links area areas container wrapper wrap block blocks section slot unit"
    " item items inner outer form panel button buttons icon icons media posts articles stories threads thread overlay bottombar topbar leaderboard rectangle".split()
)
THREADS = frozenset("comment comments disqus respond replies".split())
_TAG = re.compile(r"<!--(?:.*?-->)?|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_DIGITS = re.compile("[0-9]+")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
FLOW = frozenset("p blockquote pre figure details address".split())
SOLID = frozenset("h1 h2 h3 h4 h5 h6 hgroup ul ol dl table caption thead tbody tfoot tr td th li dt dd picture img hr figcaption br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CHROME = frozenset("nav header footer aside menu".split())
CONTENT = 80  #: characters out of links that a block of another name needs
OPEN, SOFT, HARD = 0, 1, 2  # read; left out for its class or id, unless it holds the article; left out


class Node:
    __slots__ = ("tag", "skip", "name", "parts", "chars", "links", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, skip: int = OPEN, name: str = ""):
        self.tag, self.skip, self.name, self.parts = tag, skip, name, []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _read(tag: str, attributes: str) -> tuple[int, str]:
    """Whether a block is left out, and its class, or else its id."""
    if tag in SKIPPED:
        return (SOFT if tag in ("form", "fieldset") else HARD), ""
    if tag in ("body", "html", "article", "main") or not attributes.strip():
        return OPEN, ""
    skip, known, names = OPEN, set(), {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in known:  # the first of a name counts
            continue
        known.add(name)
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and not ROLES.isdisjoint(value.split()[:1])):
            return HARD, ""
        if name in ("class", "id"):
            names[name] = " ".join(value.split())
            for token in value.split():
                parts = {x for x in re.split("[-_]+", token) if x}
                if parts and parts <= MARKS | BESIDE and not MARKS.isdisjoint(parts):
                    skip = max(skip, SOFT if THREADS.isdisjoint(parts) else HARD)
    return skip, names.get("class") or names.get("id") or ""


def reopen(root: Node) -> None:
    """Blocks left out for their class or id are read if they hold <main>, the page's articles, or most of its text."""
    nodes, parents = [root], [-1]
    for i, node in enumerate(nodes):
        below = [p for p in node.parts if isinstance(p, Node) and p.skip != HARD]
        nodes += below
        parents += [i] * len(below)
    if all(node.skip == OPEN for node in nodes):
        return
    plain = [node.chars - node.links for node in nodes]
    main, article = [x.tag == "main" for x in nodes], [x.tag == "article" for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        up = parents[i]
        plain[up] += plain[i]
        main[up] |= main[i]
        article[up] |= article[i]
    hidden = [False] * len(nodes)
    for i, node in enumerate(nodes):
        hidden[i] = node.skip == SOFT or (i > 0 and hidden[parents[i]])
    seen = max((n for n, node, away in zip(plain, nodes, hidden) if node.tag in ("article", "main") and not away), default=0)
    for i, node in enumerate(nodes):
        hidden[i] = i > 0 and hidden[parents[i]]
        if node.skip == SOFT and not hidden[i]:
            wraps = any(isinstance(p, Node) and p.skip != HARD and p.chars for p in node.parts) or article[i]
            if main[i] or (wraps and plain[i] > 4 * seen and plain[i] * (4 if article[i] else 2) > plain[0]):
                node.skip = OPEN
            else:
                hidden[i] = True


def parse(page: str) -> Node:
    """The tree of blocks; a part of a block is a text, or another block."""
    root = Node("body")
    stack, at, in_link, foreign = [root], 0, False, False
    n = len(page)
    ends = page.rfind(">") + 1  # no tag ends behind

    def add(text: str) -> None:
        node = stack[-1]
        node.parts.append(text)
        size = len(text) - sum(map(text.count, " \t\r\n"))
        node.chars += size
        node.links += size if in_link else 0

    def close(index: int) -> None:
        while len(stack) > index:
            stack.pop()

    for m in iter(lambda: _TAG.search(page, at, max(at, ends)), None):
        if m.start() > at:
            add(page[at : m.start()])
        if m[0] == "<!--":  # a comment that never ends
            at = n
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag or tag in ("html", "body"):
            if tag == "body" and not m[1] and len(stack) > 1:
                close(1)
            continue
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n if tag in ("script", "style") else at
            continue
        if foreign and tag not in BREAKOUT | FOREIGN:  # drawing and formula: their text, whatever the element
            if tag in ("text", "tspan", "mtr", "mtd"):
                add(" ")
            continue
        foreign = tag in FOREIGN and not m[1] and not m[3].endswith("/")
        if tag in INLINE:
            if stack[-1].skip and stack[-1].tag == tag and not m[1]:  # one of the same kind inside ends first
                node = Node(tag, HARD)
                stack[-1].parts.append(node)
                stack.append(node)
                continue
            stack[-1].tags += not m[1]
            if tag == "a":
                in_link = not m[1]
                stack[-1].link_tags += in_link
            elif tag == "br":
                stack[-1].parts.append(" ")
            elif not m[1] and tag not in VOID and _read(tag, m[3])[0]:
                node = Node(tag, HARD)
                stack[-1].parts.append(node)
                stack.append(node)
                continue
            if not (m[1] and stack[-1].skip and stack[-1].tag == tag):
                continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            in_link = in_link and tag in INLINE
            continue
        if stack[-1].tag in CLOSED_BY_BLOCK:
            stack.pop()
        if tag in CLOSED_BY_SAME and stack[-1].tag in CLOSED_BY_SAME[tag]:
            stack.pop()
        in_link = False
        node = Node(tag, *_read(tag, m[3]))
        stack[-1].parts.append(node)
        stack[-1].tags += 1
        if tag not in VOID:
            stack.append(node)
    if at < n:
        add(page[at:].partition("<!--")[0])
    return root


def _blocks(node: Node) -> list[Node]:
    return [p for p in node.parts if isinstance(p, Node) and not p.skip]


def measure(root: Node) -> tuple[list[Node], list[int]]:
    """Fill in counts, densities and sums; all nodes, children after their parents, and the place of each one's parent."""
    nodes, parents = [root], [-1]
    for i, node in enumerate(nodes):
        below = _blocks(node)
        nodes += below
        parents += [i] * len(below)
    for i in range(len(nodes) - 1, 0, -1):
        node, up = nodes[i], nodes[parents[i]]
        for name in ("chars", "links", "tags", "link_tags"):
            setattr(up, name, getattr(up, name) + getattr(node, name))
    share = root.links / max(1, root.chars)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        chars, tags, links, link_tags = node.chars, max(1, node.tags), max(1, node.links), max(1, node.link_tags)
        if chars:
            base = math.log(chars / max(1, chars - node.links) * node.links + share * chars + math.e)
            node.density = chars / tags * math.log(max(1.0, chars / links * tags / link_tags)) / max(math.log(base), 1e-9) if base > 1.0 + 1e-9 else chars / tags * math.log(max(1.0, chars * tags / links / link_tags))
        node.total = node.total or node.density  # a leaf's own
        if i:
            up = nodes[parents[i]]
            up.total = up.total + node.density
    return nodes, parents


def text_of(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    out: list[str] = []
    run: list[str] = []
    todo: list = [node]

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    while todo:
        part = todo.pop()
        if isinstance(part, str):
            run.append(part)
        elif part is None:
            flush()
        elif not part.skip:
            flush()
            todo += [None, *reversed(part.parts)]
        elif part.tag not in INLINE:
            flush()
    flush()
    return out


def core_of(nodes: list[Node], parents: list[int]) -> int:
    """The node of the largest density sum, or the one <article> (else <main>) in it that holds most of its text."""
    best = max(range(len(nodes)), key=lambda i: nodes[i].total)  # the first of equals is the outermost
    within, inside = [False] * len(nodes), {"article": [False] * len(nodes), "main": [False] * len(nodes)}
    outer: dict[str, list[int]] = {"article": [], "main": []}
    for i in range(len(nodes)):
        up = parents[i]
        within[i] = i == best or (up >= 0 and within[up])
        for tag, flags in inside.items():
            flags[i] = up >= 0 and flags[up]
            if nodes[i].tag == tag and not flags[i]:
                flags[i] = True
                if within[i] and i != best:
                    outer[tag].append(i)
    for tag, found in outer.items():
        if not inside["article"][best] and len(found) == 1:
            node = nodes[found[0]]
            if 2 * (node.chars - node.links) > nodes[best].chars - nodes[best].links:
                return found[0]
    return best


def _leave_beside_article(node: Node, child: Node, threshold: float) -> None:
    """Of a block around an <article>: the headings before it, and further articles."""
    before, kept = True, []
    for part in node.parts:
        if part is child:
            before = False
        elif isinstance(part, str):
            continue
        elif not part.skip and not (before and part.tag in HEADINGS and 2 * part.links <= part.chars):
            if part.tag != "article" or part.density < threshold or 2 * part.links > part.chars:
                continue
        kept.append(part)
    node.parts = kept


def _leave_beside(node: Node, child: Node | None, threshold: float) -> None:
    """Of a block on the path without an <article>: what is built like the path, and what reaches the threshold."""
    left = []
    page = node.tag == "body" or any(isinstance(p, Node) and p.skip and p.tag in CHROME for p in node.parts)
    for block in _blocks(node):
        if block is child or not block.chars:
            continue
        dense = block.density >= threshold
        like = not block.name and block.tag == "div"
        if child is not None and block.tag == child.tag:
            like = like or block.name == child.name or (dense and _DIGITS.sub("", block.name) == _DIGITS.sub("", child.name))
        if 2 * block.links > block.chars:
            kept = False
        elif block.tag in SOLID or like:
            kept = True
        elif block.tag in FLOW:
            kept = dense or not page or child is None
        elif block.tag in ("section", "article"):
            kept = dense
        else:
            kept = dense and (child is None or not page) and block.chars - block.links >= CONTENT
        if not kept:
            left.append(block)
    if child is None and sum(x.chars for x in left) == node.chars:  # nothing stands out
        return
    for block in left:
        block.skip = HARD


def main_text(page: str) -> str:
    root = parse(page)
    reopen(root)
    nodes, parents = measure(root)
    at, path = core_of(nodes, parents), []
    while at >= 0:
        path.append(nodes[at])
        at = parents[at]
    threshold = min(x.density for x in path)
    article = max((i for i, node in enumerate(path) if node.tag == "article"), default=-1)  # the outermost around the core
    for i, node in enumerate(path):
        child = path[i - 1] if i else None
        if i <= article:
            for block in _blocks(node) if i else []:
                if block is not child and block.density < threshold and 2 * block.links > block.chars and block.link_tags > 1:
                    block.skip = HARD
        elif article >= 0:
            _leave_beside_article(node, child, threshold)
        elif i or node is root:
            _leave_beside(node, child, threshold)
    return "\n\n".join(text_of(root))


def extract(pages: DataFrame) -> DataFrame:
    """pages with a last column: the main text."""

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x) if x else "" for x in column.to_pylist()], pa.string())

    return pages.withColumn(free_name(pages, "main_text"), texts("html"))

"""Main text of a page by composite text density.

Every node of the page has characters C, tags T, link characters LC and link tags LT. Its composite
density is C / T, adjusted by how much of the text are links compared with the page's body. The sum
of the densities of a block's child blocks (text of its own counts as one more) is largest for the
subtree of the article; a block without child blocks, such as a paragraph, has its own density. The
smallest density on the path from that node to the body is the threshold: where an article is dealt
over several sections, the siblings of that path that are as dense, no links, and hold several
blocks belong to it. Within an article or main element (or the node whose sections those are) every
sibling of the path that is no links belongs to it, whatever its density; outside only headings,
paragraphs, lists, tables and the like do.

What names itself something else is left out before: scripts, styles, menus and so on by element,
and by the words of class, id and role, as are forms. An element that has its name for a part of it,
such as a layout with a sidebar or a form around the page, is told by what it holds: the main
element, all articles, or, if there is none elsewhere, most of the text that is no links. It stays,
and what is in it is judged by itself. Where names would leave no text at all they do not count.
Ids of headings never do, as many are made of their titles; inside an article neither do ids of
sections that could be such a title, nor words such as "alert" and "reply" on paragraphs and quotes.
Elements that pages leave open are closed as browsers do where a block begins.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Batches, extend, importable, sliced, with_columns

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_ITSELF = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"),
}
FENCES = frozenset("html body table ul ol dl td th div article section main aside nav header footer form blockquote".split())
NEVER = frozenset(
    "head script style template noscript iframe object embed svg canvas audio video map input button select "
    "textarea label nav menu aside footer dialog title datalist search".split()
)
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo "
    "promotion promotions banner banners cookie cookies consent gdpr notice notices notification notifications alert "
    "alerts popup modal overlay subscribe subscription newsletter signup login nav navbar navigation menu menus "
    "menubar breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer footnav masthead topbar comment "
    "comments commentlist disqus reply replies respond discussion share sharing social related recommended "
    "recommendations toolbar pager pagination skip search hidden complementary contentinfo dialog form".split()
)
FLOW = frozenset("h1 h2 h3 h4 h5 h6 hgroup p ul ol dl pre table blockquote figure".split())
HEADER_WORDS = frozenset("header head banner masthead".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
MODIFIERS = re.compile(r"\b(?:with|without|has|have|no|hide|show)[-_]+[a-z]+(?:[-_][a-z]+)*")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p", "blockquote", "pre"}
# Inside an article: words that do not tell prose from other prose, and ids that a section's title may give it.
PROSE_WORDS = frozenset("alert alerts reply replies respond discussion search form".split())
TITLE_WORDS = frozenset(
    "discussion search social advertising promotion navigation recommendations notifications replies".split()
)
LINK_SHARE, PROSE_LINK_SHARE = 0.3, 0.8
MOST, MOST_COMMENTS = 0.5, 0.9  # of the text: comments are often longer than their article


class Node:
    __slots__ = ("tag", "parent", "parts", "out", "c", "t", "lc", "lt", "density", "sum", "named")

    def __init__(self, tag: str, parent: Node | None, out: bool, named: float = 0.0):
        self.tag, self.parent, self.out, self.named = tag, parent, out, named
        self.parts: list[Node | str] = []
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.sum = 0.0


def _other(tag: str, attributes: str, inside: bool, within_text: bool = False) -> tuple[bool, float]:
    """Whether an element cannot be the article, and the share of the text it needs to be despite its name."""
    if tag in NEVER and not within_text or tag == "header" and not inside:
        return True, 0.0
    named = MOST if tag == "form" else 0.0
    if not attributes or tag in ("html", "body", "main", "article"):
        return False, named
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, 0.0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, 0.0
        if name in ("class", "id", "role") and not (name == "id" and tag in HEADINGS):
            words = set(NAMES.findall(MODIFIERS.sub(" ", CAMEL.sub("-", value).lower())))
            if inside and tag in PROSE:
                words -= PROSE_WORDS
            elif inside and tag == "section" and name == "id":
                words -= TITLE_WORDS
            if words & OTHER_WORDS or not inside and words & HEADER_WORDS:
                named = max(named, MOST_COMMENTS if words & COMMENT_WORDS else MOST)
    return False, named


def parse(page: str) -> Node:
    root = at = Node("html", None, False)
    pos, end = 0, len(page)
    inside = 0  # open article or main elements
    while pos < end:
        m = TOKEN.search(page, pos)
        text = page[pos : m.start() if m else end]
        if text and not at.out:
            at.parts.append(html.unescape(text) if "&" in text else text)
        if m is None:
            break
        pos = max(m.end(), pos + 1)
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = at
            while node is not root and node.tag != tag and not (tag not in BLOCKS and node.tag in FENCES):
                node = node.parent
            if node is not root and node.tag == tag:
                while at is not node:
                    inside -= at.tag in ("article", "main")
                    at = at.parent
                inside -= at.tag in ("article", "main")
                at = at.parent
            continue
        if tag in ("html", "body"):
            if tag == "body" and at is root:
                body = Node("body", root, False)
                root.parts.append(body)
                at = body
            continue
        if tag in CLOSES_ITSELF:
            node = at
            while node is not root and node.tag not in FENCES - {"td", "th"} and node.tag not in CLOSES_ITSELF[tag]:
                node = node.parent
            if node.tag in CLOSES_ITSELF[tag]:
                outer = CLOSES_ITSELF[tag]
                while node.parent is not None and node.parent.tag in outer:
                    node = node.parent
                at = node.parent
        if tag in BLOCKS:
            node = at
            while node is not root and node.tag != "p" and node.tag not in BLOCKS:
                node = node.parent
            if node.tag == "p":  # a block ends an open paragraph, and what is open within it
                at = node.parent
        # a key or a label that a sentence names, as opposed to one that begins a line of a form
        spoken = tag in ("label", "button") and at.tag in PROSE and any(type(x) is str and x.strip() for x in at.parts)
        never, named = _other(tag, m[3], inside > 0, spoken)
        node = Node(tag, at, at.out or never, named)
        at.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, pos)
            pos = page.find(">", close.start()) + 1 or end if close else end
        elif tag not in VOID and not m[0].endswith("/>"):
            at = node
            inside += tag in ("article", "main")
    return root


def _judged(root: Node) -> list[Node]:
    """The measured nodes without those whose name holds; all if nothing would be left."""
    order = _measure(root)
    named = [x for x in order if x.named]
    if not named:
        return order
    plain = root.c - root.lc
    inner: dict[int, list[int]] = {}  # articles and main elements within
    for node in reversed(order):
        n = inner.setdefault(id(node), [0, 0])
        if (up := node.parent) is not None:
            m = inner.setdefault(id(up), [0, 0])
            m[0] += n[0] + (node.tag == "article")
            m[1] += n[1] + (node.tag == "main")
    articles, mains = inner[id(root)]
    for x in named:
        held, most = inner[id(x)], x.named
        whole = held[1] or articles and held[0] == articles and most < MOST_COMMENTS
        up = x.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        if up is not None:
            most = MOST_COMMENTS  # of an article most is not named at all
        elif held != [articles, mains]:
            most = 1.0  # the article is elsewhere
        x.out = not whole and x.c - x.lc <= most * plain
    left = _measure(root)
    if root.c:
        return left
    for x in named:
        x.out = False
    return _measure(root)


def _measure(root: Node) -> list[Node]:
    """Sums of every node, children first; returns the nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.c = node.t = node.lc = node.lt = 0
        order.append(node)
        stack.extend(x for x in reversed(node.parts) if type(x) is Node and not x.out)
    for node in reversed(order):
        node.c += sum(len("".join(x.split())) for x in node.parts if type(x) is str)
        if node.tag == "a":
            node.lc, node.lt = node.c, node.lt + 1
        if (up := node.parent) is not None:
            up.c += node.c
            up.t += node.t + 1
            up.lc += node.lc
            up.lt += node.lt
    return order


def _densities(order: list[Node], body: Node) -> None:
    share = body.lc / max(1, body.c)
    for node in order:
        c, t = node.c, max(1, node.t)
        if not c:
            continue
        lc, plain, lt = max(1, node.lc), max(1, c - node.lc), max(1, node.lt)
        base = math.log(c / plain * lc + share * c + math.e)
        node.density = c / t * math.log(c / lc * (t / lt) + 1e-9) / math.log(base + 1e-9) if base > 1 else c / t
        node.density = max(node.density, 0.0)
    for node in order:
        blocks = [x for x in node.parts if type(x) is Node and not x.out and x.tag in BLOCKS]
        if not blocks:
            node.sum = node.density
            continue
        own, tags = node.c - sum(x.c for x in blocks), node.t - sum(x.t + 1 for x in blocks)
        node.sum = own / max(1, tags) + sum(x.density for x in blocks)


def _article(path: list[Node]) -> list[Node | str]:
    """What belongs to the article, in page order; ``path`` goes from the best node to the body.

    Beside the path these stay if few of their characters are links: within the outermost article
    of the path, else its main element, else the highest node of the path where the article is
    dealt over several sections, everything; outside, headings, paragraphs, lists and the like,
    and sections that are as dense as the path and hold several blocks.
    """
    best, threshold = path[0], min(x.density for x in path)

    def few_links(x: Node, prose: bool = False) -> bool:
        share = PROSE_LINK_SHARE if prose and x.tag in PROSE else LINK_SHARE
        return x.c > 0 and (x.lc <= share * x.c or x.tag == "h1")  # a title links to its page

    def section(x: Node) -> bool:
        blocks = sum(type(y) is Node and y.tag in BLOCKS and y.c > 0 for y in x.parts)
        return x.density >= threshold and (blocks > 1 or x.tag == best.tag and x.tag not in FENCES)

    levels = range(1, len(path))
    within = max((k for k, x in enumerate(path) if x.tag == "article"), default=0)
    within = within or max((k for k, x in enumerate(path) if x.tag == "main"), default=0)

    def beside(k: int) -> list[Node]:
        parts = [x for x in path[k].parts if type(x) is Node and x is not path[k - 1] and not x.out]
        return [x for x in parts if few_links(x, k <= within)]

    if not any(x.tag in ("article", "main") for x in path):
        within = max((k for k in levels[:-1] if any(map(section, beside(k)))), default=0)
    before: list[list[Node | str]] = []
    after: list[Node | str] = []
    for k in levels:
        kept = {id(x) for x in beside(k) if k <= within or x.tag in FLOW or section(x)}
        sides: list[list[Node | str]] = [[], []]
        run: list[Node | str] = []  # text and inline elements between two blocks
        side = 0
        for x in [*path[k].parts, None]:
            if x is not None and (type(x) is str or x.tag not in BLOCKS and x is not path[k - 1]):
                run.append(x)
                continue
            inline = [y for y in run if type(y) is Node and not y.out]
            c = sum(y.c for y in inline) + sum(len("".join(y.split())) for y in run if type(y) is str)
            if k <= within and c and sum(y.lc for y in inline) <= LINK_SHARE * c:
                sides[side] += [" ", *run, " "]
            else:
                sides[side] += [y for y in inline if id(y) in kept]
            run = []
            if x is path[k - 1]:
                side = 1
            elif x is not None and id(x) in kept:
                sides[side].append(x)
        before.append(sides[0])
        after += sides[1]
    return [*(x for side in reversed(before) for x in side), best, *after]


def _text(nodes: list[Node | str]) -> str:
    """Blocks in page order, white space as one space."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if type(x) is str:
            out.append(x)
        elif not x.out:
            gap = x.tag in BLOCKS or x.tag == "br"
            if gap:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.parts))
    return " ".join("".join(out).split())


def main_text(page: str) -> str:
    """The article of a page, empty if there is no text."""
    if not page:
        return ""
    root = parse(page)
    order = _judged(root)
    body = next((x for x in order if x.tag == "body"), root)
    if not body.c:
        body = root
    if not body.c:
        return ""
    _densities(order, body)
    best = max((x for x in order if x.c and (x.tag in BLOCKS or x is body)), key=lambda x: x.sum, default=body)
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    return _text(_article(path))


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the main text, empty if none) and ``n_chars`` (its code points).

    A row in, a row out; a null or empty page has an empty text; markup of any length, left open
    or nested to any depth is read without recursion. Other columns pass; input columns of the two
    names are replaced. An empty table gives an empty result.
    """
    importable(pages.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches):
            found = [main_text(x) if x else "" for x in batch.column(column).to_pylist()]
            yield extend(batch, {"text": pa.array(found, pa.string()), "n_chars": pa.array([len(x) for x in found], pa.int64())})

    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return pages.mapInArrow(run, with_columns(pages.schema, *new))

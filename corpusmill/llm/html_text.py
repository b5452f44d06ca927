"""Main text of web pages by tree scoring.

A forgiving parser builds a tree. What is never part of an article (scripts, menus, page headers, footers, sidebars,
notices, adverts, forms, reader comments) is taken out by element, role and name. Every paragraph then passes points
for its length and commas to its ancestors, less with each level; an ancestor's total is discounted by its link
density. From the best container the way goes up to the article element that holds it, or else as long as what stands
beside it is text and not links. That container is kept, block by block, with those of its siblings that score well and
all that stands between the first and the last of these.

Headings and inline elements aren't judged by names. Beside an article element one word decides; elsewhere a name takes an
element out only if nothing in it says otherwise (`related-work`, `comments-on-method`), and inside an article only some
words do so by themselves: the others ask for links, reader comments or short text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .common import table

#: Element names by role in a page, and words that name what isn't part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form script style noscript template iframe textarea title head button select dialog menu object svg canvas option input label fieldset annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NEGATIVE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer discussion disqus feedback foot footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted promotion recommend recommendations recommended related replies reply respond share sharing sidebar sidebars "
    "signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar tracking widget widgets".split()
)
#: Of these, words that articles use of their own parts too: they count outside an article, and inside it only where
#: the element is full of links or holds reader comments.
WEAK = frozenset("discussion related recommend recommendations recommended replies reply respond tags teaser skip disclaimer".split())
#: Words that take nothing of length out of an article: what bears them goes where its text is short or full of links.
SOFT = frozenset("banner foot footer login masthead menu nav navbar navigation notice notices skip social toolbar topbar tracking widget widgets".split())
#: A block of so many characters is text of its own; one of FAIR is enough beside the best container.
LONG, FAIR = 200, 140
#: Headings of lists of links that belong to an article.
REFERENCES = frozenset(
    "references|sources|bibliography|notes|footnotes|endnotes|literature|citations|works cited|further reading|see also|external links|links|"
    "références|sources et références|bibliographie|quellen|literatur|einzelnachweise|weblinks|referencias|fuentes|bibliografía|enlaces externos".split("|")
)
#: Words that may stand beside a negative one in a name without changing what it says.
NEUTRAL = frozenset(
    "area articles bar block body bottom box center col column container content count embed form global group header inner item items left link links list "
    "main mobile module more outer page panel post posts primary reader readers right row secondary section site slot stories story thread top unit user users visitor visitors wrap wrapper".split()
)
READERS = frozenset("comment comments commentlist disqus feedback".split())
POSITIVE = frozenset("article body content entry main page post story text".split())
EXCEPT = frozenset("has with no without is not".split())
#: Elements that are judged by their names.
NAMED = frozenset("div section ul ol dl table tr td p header center figure details blockquote".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl html body article section main div aside".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "children", "names", "role", "hidden", "points", "text", "linked", "links", "commas", "readers", "bodies", "longest", "inline")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.names, self.role, self.hidden = [], "", False
        self.points, self.text, self.linked, self.links, self.commas = 0.0, 0, 0, 0, 0
        self.readers, self.bodies, self.longest, self.inline = False, 0, 0, 0
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    self.names += value.split()
                elif name == "role":
                    self.role = value.strip().lower()
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                    self.hidden = True
                elif name == "style":
                    flat = re.sub(r"\s+", "", value.lower())
                    self.hidden |= "display:none" in flat or "visibility:hidden" in flat


def parse(html: str) -> Node:
    """A tree of Node and str (text with character references decoded). Never fails; unmatched end tags are ignored."""
    root = Node("#root", None)
    at, here, end = root, 0, len(html)
    while here < end:
        m = TOKEN.search(html, here)
        if m is None:
            at.children.append(unescape(html[here:]))
            break
        if m.start() > here:
            at.children.append(unescape(html[here : m.start()]))
        here = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            node = at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                at = node.parent
            continue
        attributes = m[3] or m[6] or ""
        if tag in BLOCK and tag not in ("html", "body"):
            at = _close(at, ("p",))
        if tag in CLOSED_BY:
            at = _close(at, CLOSED_BY[tag])
        node = Node(tag, at, attributes)
        at.children.append(node)
        if tag in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, here)
            here = close.end() if close else (end if tag in ("script", "style") else here)
            if close is None and tag not in ("script", "style"):
                at = node
        elif tag not in VOID and not attributes.endswith("/"):
            at = node
    return root


def _close(at: Node, tags: tuple[str, ...]) -> Node:
    node = at
    while node.parent is not None and node.tag not in tags:
        if node.tag in SCOPE:
            return at
        node = node.parent
    return node.parent if node.parent is not None else at


def _pieces(node: Node) -> list[set[str]]:
    return [{w for p in PIECE.findall(t) for w in _words(p.lower())} for t in node.names]


def _words(piece: str) -> tuple[str, ...]:
    """A piece of a name, or the two known words that it is made of (`cookiebanner`)."""
    if piece in NEGATIVE or piece in NEUTRAL or len(piece) > 24:
        return (piece,)
    for i in range(4, len(piece) - 2):
        first, second = piece[:i], piece[i:]
        if (first in NEGATIVE and (second in NEGATIVE or second in NEUTRAL)) or (first in NEUTRAL and second in NEGATIVE and len(second) > 3):
            return first, second
    return (piece,)


def _own(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in ("main", "article")


def _named_away(node: Node, inside: bool, beside: bool) -> bool:
    """inside: an article or main element stands above; beside: the page has one elsewhere."""
    for pieces in _pieces(node):
        found = pieces & NEGATIVE
        if not found or pieces & EXCEPT:
            continue
        unknown = any(p not in NEUTRAL and not p.isdigit() and len(p) > 1 for p in pieces - NEGATIVE)
        if unknown and (inside or not beside):
            continue
        linked = density(node) > 0.3 or node.readers
        if not inside or found - WEAK - SOFT or linked or (found & SOFT and node.longest < LONG):
            return True
    return False


def dropped(node: Node, inside: bool, beside: bool) -> bool:
    if node.tag == "form" and not node.hidden and node.bodies >= 3:
        return False  # a form round the whole page: only its controls go
    if node.tag in DROPPED or node.hidden or node.role in ROLES or (node.tag == "header" and not inside):
        return True
    return node.tag in NAMED and _named_away(node, inside, beside)


def prune(root: Node) -> None:
    """Takes out what is never part of an article. Measures come first, once and from the leaves up."""
    order = _measure(root)
    holds = {id(n) for n in order if _own(n)}
    beside = bool(holds)
    for n in reversed(order):
        if id(n) in holds and n.parent is not None:
            holds.add(id(n.parent))
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or _own(node)
        # what holds an article is judged as on a page without one
        node.children = [c for c in node.children if isinstance(c, str) or not dropped(c, inside, beside and id(c) not in holds)]
        stack += [(c, inside) for c in node.children if isinstance(c, Node)]


def blocks(node: Node) -> list[tuple[Node, str]]:
    """(block element, text) of the runs of inline text under node, in page order; white space is one space."""
    out: list[tuple[Node, str]] = []
    run: list[str] = []

    def flush(owner: Node) -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append((owner, text))
            run.clear()

    stack: list[tuple[Node, Node, Iterator]] = [(node, node, iter(node.children))]
    while stack:
        here, owner, rest = stack[-1]
        for c in rest:
            if isinstance(c, str):
                run.append(c)
                continue
            if c.tag == "br":
                run.append(" ")
                continue
            if c.tag in BLOCK:
                flush(owner)
                stack.append((c, c, iter(c.children)))
            else:
                stack.append((c, owner, iter(c.children)))
            break
        else:
            stack.pop()
            if here.tag in BLOCK or not stack:
                flush(owner)
    return out


def _measure(root: Node) -> list[Node]:
    """Fills the counts of all nodes from the leaves up: text, linked text, links, commas, whether reader comments stand
    below, paragraphs and articles below, the longest block. Returns all nodes, parents first."""
    order, stack = [], [(root, False)]
    linked: dict[int, bool] = {}
    while stack:
        node, in_link = stack.pop()
        in_link = in_link or node.tag == "a"
        linked[id(node)] = in_link
        order.append(node)
        stack += [(c, in_link) for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        node.text = node.linked = node.links = node.commas = node.bodies = node.longest = node.inline = 0
        for c in node.children:
            if isinstance(c, str):
                n = len("".join(c.split()))
                node.text += n
                node.inline += n
                node.linked += n if linked[id(node)] else 0
                node.commas += c.count(",")
            else:
                node.text += c.text
                node.linked += c.linked
                node.links += c.links + (c.tag == "a")
                node.commas += c.commas
                node.readers = node.readers or c.readers or any(p & READERS for p in _pieces(c))
                node.bodies += c.bodies + (c.tag in ("p", "article", "main"))
                node.longest = max(node.longest, c.longest)
                node.inline += 0 if c.tag in BLOCK else c.inline
        if node.tag in BLOCK:
            node.longest = max(node.longest, node.inline)
    return order


def density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _initial(node: Node) -> float:
    own = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "h1": -5.0, "h2": -5.0, "h3": -5.0, "th": -5.0}.get(node.tag, 0.0)
    if node.role in ("main", "article"):
        own += 20
    return own + (10 if {p.lower() for t in node.names for p in PIECE.findall(t)} & POSITIVE else 0)


def _refers(node: Node) -> bool:
    """Whether the heading before a list says that its links are references."""
    before = None
    for c in node.parent.children:
        if c is node:
            break
        if not isinstance(c, str):
            before = c
    return before is not None and before.tag in ("h2", "h3", "h4", "h5", "h6") and " ".join(t for _, t in blocks(before)).lower().strip(" :") in REFERENCES


def _container(best: Node) -> Node:
    """The article that holds the best node; else the highest ancestor to which what is beside is text and not links."""
    node = best
    while node is not None:
        if node.tag == "article" or node.role == "article":
            return node
        node = node.parent
    node = best
    while not _own(node) and node.parent is not None and node.parent.tag not in ("body", "html", "#root"):
        up = node.parent
        text, linked = up.text - node.text, up.linked - node.linked
        if text and linked >= 0.25 * text:
            break
        node = up
    return node


def extract(html: str | None, least: int = 25) -> list[str]:
    """The blocks of the main text. Lists of links inside it count as menus, those under a heading of references don't."""
    root = parse(html or "")
    prune(root)
    order, menus = _measure(root), set()
    for node in order:
        menu = node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.links >= 3 and density(node) > 0.66
        if menu and node.parent is not None and not (node.tag in ("ul", "ol", "dl") and _refers(node)):
            menus.add(id(node))
    if menus:
        for node in order:
            node.children = [c for c in node.children if isinstance(c, str) or id(c) not in menus]
        order = _measure(root)
    found = blocks(root)
    scored: dict[int, Node] = {}
    for owner, text in found:
        if len(text) < least or owner.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        node, level = (owner if owner.tag in ("div", "article", "section", "main", "body", "td", "#root") else owner.parent), 1
        while node is not None and level <= 5:
            if id(node) not in scored:
                scored[id(node)] = node
                node.points = _initial(node)
            node.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            node, level = node.parent, level + 1
    total = lambda n: n.points * (1 - density(n))
    if not scored:
        named = [n for n in order if n.tag in ("article", "main") or n.role == "main"] or [n for n in order if n.tag == "body"] or [root]
        return [t for _, t in blocks(max(named, key=lambda n: n.text))]
    rank = {id(n): k for k, n in enumerate(order)}
    best = max(scored.values(), key=lambda n: (total(n), -rank[id(n)]))
    best = _container(best)
    if best.parent is None or best.tag in ("body", "html"):
        return [t for _, t in blocks(best)]
    limit, good = max(10.0, 0.2 * total(best)), []
    for k, c in enumerate(best.parent.children):
        if isinstance(c, str):
            continue
        fits = c is best
        if not fits and id(c) in scored:
            alike = bool(c.names) and c.names == best.names
            fits = total(c) + (0.2 * total(best) if alike else 0) >= limit and c.tag in ("article", "section", "div", "main", "td", "p")
        if not fits and c.tag == best.tag and best.tag not in ("article", "main"):
            fits = c.longest >= FAIR and density(c) < 0.25
        if not fits and c.tag == "p":
            long = c.text >= 80 and density(c) < 0.25
            fits = long or (0 < c.text < 80 and density(c) == 0 and best.tag not in ("article", "main"))
        if fits or (c.tag == "h1" and c.text > 0):
            good.append(k)
    part = Node("#part", None)
    part.children = [c for c in best.parent.children[good[0] : good[-1] + 1] if isinstance(c, str) or c.tag == "p" or density(c) <= 0.5]
    return [t for _, t in blocks(part)]


FOUND = "text string, n_chars long, n_blocks int"


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `text` (the blocks of the main text, joined by two line ends), `n_chars` (its code points) and
    `n_blocks`; all other columns but the html stay, columns of these names are replaced.

    The whole html is read, however long. A null or empty html, or one without text, has an empty text; of equally good
    containers the outer or earlier one counts. Repeated rows each get a row; an empty table gives an empty result.
    """
    pages = pages.drop("text", "n_chars", "n_blocks").withColumnRenamed(html, "_html")
    kept = [f for f in pages.schema.fields if f.name != "_html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract(h) for h in b.column("_html").to_pylist()]
            texts = ["\n\n".join(x) for x in found]
            own = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *own], names=[*(f.name for f in kept), "text", "n_chars", "n_blocks"])

    return pages.mapInArrow(run, StructType(kept + StructType.fromDDL(FOUND).fields))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "n_blocks")


QUERIES = {"op9_main_text": op9_main_text}
SQL: dict[str, str] = {}

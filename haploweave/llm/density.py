"""HTML extraction by composite text density (public: Sun, Song and Liao, 2011): the densest subtree is the main text."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul").split())
_ENDS_P = _BLOCK - frozenset(("html", "body", "caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"))
#: An opening tag on the left ends open elements on the right, up to the nearest of the fences.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
_FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist")}
_SKIP = frozenset(("head", "script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "canvas", "nav", "menu", "header", "footer", "aside", "form", "button", "select", "input", "textarea", "dialog", "title"))
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"))
#: Words of class and id that mostly name what stands around an article: texts of their own, and lists of links. They only
#: weigh: see measure() and select().
_TEXTS = frozenset("ad ads advert adverts advertisement advertising adsense banner comment comments commentlist discussion discussions disqus cookie cookies consent gdpr footer masthead newsletter notice notices popup modal promo respond replies sidebar sponsor sponsored subscribe".split())
_LISTS = frozenset("breadcrumb breadcrumbs header menu nav navbar navigation related share sharing social toolbar widget widgets".split())
#: Words that may stand beside one of these in a name, as in comment-list or site_footer.
_BESIDE = frozenset("area articles bar block body bottom box buttons container content form global icons inner item items law left level links list main message page policy posts right section signup site slot stories thread top unit wrap wrapper".split())
#: What a named text's density counts for; named lists are left out of the main text if they are thinner than its path, or
#: at least this share of them is links.
_NAMED, _LINKED = 0.02, 0.5
_INLINE_OR_SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr dd dt blockquote pre figcaption span a b i em strong small label code font mark".split())


class Node:
    """An element: its children are texts and Nodes. chars and tags (with those of links apart) are of its whole subtree.

    named: "texts" or "lists" if its class or id mostly names such things around an article. weight: what its density
    counts for.
    """

    __slots__ = ("name", "parent", "children", "skip", "named", "weight", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, skip: bool = False, named: str = "") -> None:
        self.name, self.parent, self.skip, self.named, self.weight = name, parent, skip, named, 1.0
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _named(value: str) -> str:
    """Whether a class or id attribute names texts or lists around an article: by a whole name, or with words beside it."""
    found = ""
    for name in value.lower().split():
        parts = [x for x in re.split(r"[-_]+|\d+", name) if x]
        if any(x in _TEXTS for x in parts) and all(x in _TEXTS or x in _LISTS or x in _BESIDE for x in parts):
            return "texts"
        if any(x in _LISTS for x in parts) and all(x in _LISTS or x in _BESIDE for x in parts):
            found = "lists"
    return found


def _around(name: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is no part of any main text by its name, role or being hidden; else what class and id name."""
    if name in _SKIP:
        return True, ""
    if not attributes.strip() or name in ("html", "body", "main"):
        return False, ""
    named = ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or m[5]).lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in _ROLES:
            return True, ""
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, ""
        if key in ("class", "id") and named != "texts":
            named = _named(value) or named
    return False, "" if named == "lists" and name in _INLINE_OR_SINGLE else named


class _Open:
    """The open elements, and where those of a name stand among them: each is found, and each is left, once."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at = [root], {}

    def enter(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.stack))
        if node.name in _BLOCK and node.name != "p":
            self.at.setdefault("", []).append(len(self.stack))
        self.stack.append(node)

    def last(self, name: str) -> int:
        """Place of the innermost open element of a name ("": of a block that isn't a paragraph); 0 if there is none."""
        places = self.at.get(name)
        return places[-1] if places else 0

    def leave(self, place: int) -> None:
        """Close the element at a place, and all in it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.at[node.name].pop()
            if node.name in _BLOCK and node.name != "p":
                self.at[""].pop()


def parse(source: str) -> Node:
    """A tree for any text: unknown, unclosed and misnested tags are taken as browsers mostly take them, nothing fails.

    One pass: each end tag finds its element by name.
    """
    root = Node("#root", None)
    at, open_, end = 0, _Open(root), len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            open_.stack[-1].children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            open_.stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                open_.stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            if place := open_.last(name):
                open_.leave(place)
            elif name == "br":
                open_.stack[-1].children.append(Node("br", open_.stack[-1]))
            continue
        if name in _ENDS_P and (place := open_.last("p")) > open_.last(""):
            open_.leave(place)
        if name in _CLOSES:
            fence = max(open_.last(x) for x in _FENCES.get(name, ("table",)))
            inside = [places[k] for x in _CLOSES[name] if (places := open_.at.get(x)) and (k := bisect_right(places, fence)) < len(places)]
            if inside:
                open_.leave(min(inside))
        here = open_.stack[-1]
        node = Node(name, here, *_around(name, m[3]))
        if name == "header" and open_.last("article"):
            node.skip = False  # that of the article: see _settle()
        here.children.append(node)
        if name in _RAW:
            close = _ends(name).search(source, at)
            node.children.append(source[at : close.start() if close else end])
            at = close.end() if close else end
        elif name not in _VOID and not m[3].rstrip().endswith("/"):
            open_.enter(node)
    return root


@cache
def _ends(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


def _order(root: Node) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.skip:
            found.append(node)
            todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return found


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_STRUCTURE = _HEADINGS | frozenset(("article", "main", "header", "footer", "nav", "aside", "section"))


def _within(node: Node) -> tuple[int, set[str]]:
    """Characters of a subtree without what is skipped below its top, and the names of all elements in it."""
    chars, names, todo = 0, set(), [(node, True)]
    while todo:
        x, counts = todo.pop()
        for y in x.children:
            if isinstance(y, Node):
                names.add(y.name)
                todo.append((y, counts and not y.skip))
            elif counts:
                chars += len(y.strip())
    return chars, names


def _settle(root: Node) -> None:
    """Decide on what its name alone doesn't: an article's header is part of it if it holds a heading; a form that holds most
    of the page and its structure, or all of its text and paragraphs, is the page's wrapper, of which the fields go."""
    todo, forms, headers = [root], [], []
    while todo:
        x = todo.pop()
        if x.name == "form" and x.skip:
            forms.append(x)
            continue
        if x.name == "header" and not x.skip:
            headers.append(x)
            continue
        todo.extend(y for y in x.children if isinstance(y, Node) and (not y.skip or y.name == "form"))
    for x in headers:
        x.skip = not _within(x)[1] & _HEADINGS
    if forms:
        outside = _within(root)[0]
        for x in forms:
            chars, names = _within(x)
            x.skip = not (chars > outside and (names & _STRUCTURE or not outside and "p" in names))


def _scope(nodes: list[Node]) -> list[Node]:
    """The nodes among which the main text is looked for: those of the only main element, then of the only article that
    holds a heading of the first rank. Without such, the body's."""
    nodes = nodes[next((k for k, x in enumerate(nodes) if x.name == "body"), 0) :]
    for name in ("main", "article"):
        tops = [x for x in _outermost(nodes[0], name) if x.weight == 1.0 and x.chars and (name == "main" or "h1" in _within(x)[1])]
        if len(tops) == 1:
            nodes = _order(tops[0])
    return nodes


def _outermost(top: Node, name: str) -> list[Node]:
    """The elements of a name within top that aren't skipped and don't lie in another such."""
    found, todo = [], [x for x in top.children if isinstance(x, Node)]
    while todo:
        x = todo.pop()
        if x.skip:
            continue
        if x.name == name:
            found.append(x)
        else:
            todo.extend(y for y in x.children if isinstance(y, Node))
    return found


def measure(root: Node) -> list[Node]:
    """Set density and total of every node that isn't skipped. Density: characters per tag, lowered by the share of links.

    density = C / T * log_b(C / LC * T / LT), b = ln(C / (C - LC) * LC + LC_body / C_body * C + e), zero counts taken as
    one; C, LC: characters, of links; T, LT: tags, of links. total: the sum of the children's densities. In texts that a
    class or id names as apart from the article, each character counts for less outside, and each density.
    """
    nodes = _order(root)
    for node in nodes:
        node.weight = (node.parent.weight if node.parent is not None else 1.0) * (_NAMED if node.named == "texts" else 1.0)
    for node in reversed(nodes):
        own = sum(len(_SPACE.sub(" ", x).strip(" ")) for x in node.children if isinstance(x, str))
        inner = [x for x in node.children if isinstance(x, Node) and not x.skip]
        share = [_NAMED if x.named == "texts" else 1.0 for x in inner]
        node.chars, node.tags = own + sum(x.chars * w for x, w in zip(inner, share, strict=True)), len(inner) + sum(x.tags for x in inner)
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, 1 + sum(x.link_tags for x in inner)
        else:
            node.link_chars, node.link_tags = sum(x.link_chars * w for x, w in zip(inner, share, strict=True)), sum(x.link_tags for x in inner)
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in nodes:
        c, lc, t, lt = node.chars, node.link_chars, max(1, node.tags), max(1, node.link_tags)
        node.density = 0.0
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = node.weight * c / t * math.log(max(c / max(1, lc) * t / lt, 1.0)) / (math.log(base) if base > 1 else 1.0)
    for node in nodes:
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.skip)
    return nodes


def select(root: Node) -> Node:
    """The node with the largest total of those in _scope(); then up while the parent holds nothing thinner than the body path allows.

    The threshold is the least density on the path from the body to that node. An article or main element around the
    node is the whole article. The first such node wins ties. Of what class or id names within it, texts are left out, and
    lists that are thinner than the threshold or mostly links, unless that would be half of it or more.
    """
    _settle(root)
    nodes = _scope(measure(root))
    best = max(nodes, key=lambda x: x.total)
    if not best.total:
        best = max(nodes, key=lambda x: (x.chars > 0, x.density))
    path = [best]
    while path[-1].parent is not None and path[-1].name != "body":
        path.append(path[-1].parent)
    threshold = min((x.density for x in path if x.chars), default=0.0)
    whole = next((x for x in path if x.name in ("article", "main")), None)
    if whole is not None:
        best = whole
    else:
        for node in path[1:]:
            if all(x.density >= threshold for x in node.children if isinstance(x, Node) and not x.skip and x.chars):
                best = node
            else:
                break
    out, todo = [], [x for x in best.children if isinstance(x, Node) and not x.skip]
    while todo:
        x = todo.pop()
        thin = x.density * best.weight < threshold * x.weight or x.link_chars >= _LINKED * max(1, x.chars)
        if x.named == "texts" or x.named == "lists" and thin:
            out.append(x)
        else:
            todo.extend(y for y in x.children if isinstance(y, Node) and not y.skip)
    if 2 * sum(x.chars * (_NAMED if x.named == "texts" else 1.0) for x in out) < best.chars:
        for x in out:
            x.skip = True
    return best


def text_of(node: Node) -> str:
    """Blocks in page order, one per line: white space turned into single spaces, trimmed, empty ones left out."""
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        line = _SPACE.sub(" ", "".join(now)).strip(" ")
        now.clear()
        if line:
            blocks.append(line)

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.name in ("br", "hr") and not x.skip:
            now.append(" ")
            if x.name == "hr":
                flush()
        elif not x.skip:
            if block := x.name in _BLOCK:
                flush()
                todo.append(None)
            elif x.name in ("td", "th"):
                now.append(" ")
            todo.extend(reversed(x.children))
            del block
    flush()
    return "\n".join(blocks)


def extract(source: str | None) -> str:
    """Main text of a page; empty for null, empty and textless pages."""
    return text_of(select(parse(source))) if source else ""


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, url, text, n_chars): one row out per row in, no shuffle, whole pages.

    Null html counts as empty and gives an empty text and 0. Repeated and null ids stay as they are. Other columns are
    not read.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

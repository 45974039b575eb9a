"""Main text of raw pages by scoring the element tree.

The markup is read into a tree of elements (unclosed and stray tags as browsers do: a new
paragraph, list item or cell ends the open one, end tags close what is open inside, and what belongs
to the body ends an open head).  Scripts, styles and what is marked hidden are cut off.  Forms, navigation,
headers, footers and sidebars are cut but for those that hold the longest article of the page or three
quarters of its unlinked text; elements whose class or id names a notice, advert, comment or menu but for
those that hold that article or most of the unlinked text.  What stays so has a quarter of its points.
A header inside an article is a header, and cut.  Where little text is left the
page is read again without regard to names.  Each text block passes points - one, one per comma, up
to three for its length - to its parent and half of them to its grandparent; a container's points
are scaled by one minus its link density.  The best container is kept with the siblings that score
at least a fifth of it or are plain paragraphs of their own; all their blocks are joined.

Edge rows: null and empty html give the empty text; pages without any block give the empty text;
broken markup never fails, tags cut off at the end of the page are dropped; repeated rows are
extracted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import map_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^<]*\Z|[^<]+|<",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|.""", re.S)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|legal|login|"
    r"masthead|menu|modal|nav\w*|newsletter|notices?|pagination|pager|popup|promo\w*|related|replies|reply|share|"
    r"sharing|sidebar|side|signup|social|sponsor\w*|subscribe|toolbar|widget|banner|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in _RAW}
_CUT = _RAW | {"head", "select", "svg", "object", "canvas", "audio", "video", "math"}
# Cut, but for those that hold the article: a form round the page, a menu whose end tag is missing.
_ASIDE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog"}
_HEAD = {"head", "title", "meta", "link", "script", "style", "base", "noscript", "template", "basefont", "bgsound", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
           "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
           "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2",
             "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"article", "section", "div", "body", "html", "main", "ul", "ol", "table", "td", "th", "dl", "blockquote"}


class Node:
    __slots__ = ("name", "parent", "cut", "kids", "points", "chars", "linked", "link", "named", "dim", "free")

    def __init__(self, name: str, parent: Node | None, cut: bool = False, named: str = "") -> None:
        self.name, self.parent, self.cut = name, parent, cut or parent is not None and parent.cut
        self.link = name == "a" or parent is not None and parent.link
        self.kids: list[Node | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.named, self.dim, self.free = named, False, 0  # named: why it is doubtful; free: unlinked text below


def _marks(name: str, attrs: str) -> tuple[bool, str]:
    """Whether an element is cut for what it is, and whether its tag or a name makes it doubtful."""
    if name in _CUT:
        return True, ""
    named = "tag" if name in _ASIDE else ""
    if not attrs or name in ("html", "body", "article", "main"):
        return False, named
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, ""
        if not named and key in ("class", "id", "role") and _BAD_NAME.search(value):
            named = "name"
    return False, named


def _judge(nodes: list[Node], by_name: bool) -> None:
    """Cut doubtful elements, but never the longest article; nor, by name, most of the page's unlinked
    text, or, by tag, three quarters of it."""
    for node in reversed(nodes):  # parents come before what they hold
        node.free += 0 if node.link else sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if node.parent is not None:
            node.parent.free += node.free
    at = max((n for n in nodes if n.name in ("article", "main")), key=lambda n: n.free, default=None)
    around: set[int] = set()
    while at is not None and at.free:
        around.add(id(at))
        at = at.parent
    for node in nodes[1:]:
        node.dim, node.cut = node.parent.dim, node.parent.cut
        if node.cut or not (node.named == "tag" or by_name and node.named):
            continue
        most = 4 * node.free > 3 * nodes[0].free if node.named == "tag" else 2 * node.free > nodes[0].free
        node.dim = id(node) in around or most
        node.cut = not node.dim


def parse(html: str, by_name: bool = True) -> Node:
    """The tree; text nodes are strings, cut elements keep no text."""
    root = Node("html", None)
    nodes = [root]
    here, at_char = root, 0
    while at_char < len(html):
        token = _TOKEN.match(html, at_char)
        at_char, name = token.end(), token["name"]
        if name is None:
            text = token["cdata"] if token["cdata"] is not None else token[0] if token[0][0] != "<" or token[0] == "<" else ""
            if here.name == "head" and text.strip():
                here = here.parent
            if text and not here.cut:
                here.kids.append(unescape(text))
            continue
        name = name.lower()
        if token["close"]:
            at: Node | None = here
            while at is not None and at.name != name:
                at = at.parent if name not in _INLINE and name != "p" or at.name not in _SCOPE else None
            if at is not None and at.parent is not None:
                here = at.parent
            continue
        if here.name == "head" and name not in _HEAD:
            here = here.parent  # the end tag of the head may be left out
        if name in _CLOSES_P:
            at = here
            while at is not None and at.name not in _SCOPE and at.name != "p":
                at = at.parent
            if at is not None and at.name == "p":
                here = at.parent
        if name in _SIBLINGS:
            at = here
            while at is not None and at.name not in _SIBLINGS[name] and at.name not in ("ul", "ol", "table", "dl", "html", "select"):
                at = at.parent
            if at is not None and at.name in _SIBLINGS[name]:
                here = at.parent
        if name in _RAW:
            # What is inside is no markup: on behind its own end tag, or nothing more without one.
            end = _RAW_END[name].search(html, at_char)
            at_char = end.end() if end else len(html)
            continue
        if name in ("html", "body"):
            continue
        node = Node(name, here, *_marks(name, token["attrs"]))
        if not node.cut:
            here.kids.append(node)
            nodes.append(node)
        if name not in _VOID and not token["attrs"].endswith("/"):
            here = node
    _judge(nodes, by_name)
    return root


def blocks(node: Node, out: list[tuple[Node, str]] | None = None) -> list[tuple[Node, str]]:
    """(block element, text) below ``node`` in page order; one entry per unbroken run of inline text."""
    out = [] if out is None else out
    run: list[str] = []

    def flush(owner: Node) -> None:
        text = _SPACE.sub(" ", "".join(run)).strip(" ")
        if text:
            out.append((owner, text))
        run.clear()

    # An own stack: pages may nest deeper than Python recurses.
    stack: list[tuple[Node, Node, int]] = [(node, node, 0)]
    while stack:
        at, owner, i = stack.pop()
        if i == len(at.kids):
            if at is owner:
                flush(owner)
            continue
        stack.append((at, owner, i + 1))
        kid = at.kids[i]
        if isinstance(kid, str):
            run.append(kid)
            owner.chars += len(kid)
            owner.linked += len(kid) if at.link else 0
        elif kid.cut:
            continue
        elif kid.name == "br":
            run.append(" ")
        elif kid.name in _INLINE:
            stack.append((kid, owner, 0))
        else:
            flush(owner)
            stack.append((kid, kid, 0))
    return out


def main_text(html: str | None) -> str:
    """The main text, found without regard to names where these leave under a tenth of the unlinked text."""
    if not html:
        return ""
    root = parse(html)
    text = _best_text(root)
    return _best_text(parse(html, by_name=False)) if 10 * len(text) < root.free else text


def _best_text(root: Node) -> str:
    """The text of the best container and its good siblings."""
    found = blocks(root)
    if not found:
        return ""
    scored: dict[int, Node] = {}
    for owner, text in found:
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        points *= 0.25 if owner.dim else 1
        parent = owner.parent or owner
        if owner.name in _SCOPE:  # bare text of a container speaks for the container itself
            parent = owner
        parent.points += points
        scored[id(parent)] = parent
        if parent.parent is not None:
            parent.parent.points += points / 2
            scored[id(parent.parent)] = parent.parent
    chars: dict[int, list[int]] = {}
    seen: set[int] = set()
    for owner, _ in found:
        if id(owner) in seen:
            continue
        seen.add(id(owner))
        at: Node | None = owner
        while at is not None:
            total = chars.setdefault(id(at), [0, 0])
            total[0] += owner.chars
            total[1] += owner.linked
            at = at.parent

    def value(node: Node) -> float:
        whole, linked = chars.get(id(node), (0, 0))
        return node.points * (1 - linked / whole) if whole else 0.0

    order = {id(n): i for i, n in enumerate(scored.values())}
    best = max(scored.values(), key=lambda n: (value(n), n.name in ("article", "main"), -order[id(n)]))
    at = best
    while at is not None:  # a semantic container around the best one is the article
        if at.name in ("article", "main"):
            best = at
        at = at.parent
    keep = [best]
    if best.parent is not None:
        least = max(10.0, value(best) / 5)
        keep = []
        for kid in best.parent.kids:
            if kid is best:
                keep.append(kid)
            elif isinstance(kid, Node) and kid.name not in _INLINE:
                whole, linked = chars.get(id(kid), (0, 0))
                plain = kid.name == "p" and whole > 80 and linked < 0.25 * whole
                if value(kid) >= least or plain:
                    keep.append(kid)
    wanted = {id(n) for n in keep}
    inside: dict[int, bool] = {}

    def kept(node: Node | None) -> bool:
        path = []
        while node is not None and id(node) not in inside and id(node) not in wanted:
            path.append(node)
            node = node.parent
        answer = node is not None and (id(node) in wanted or inside[id(node)])
        for step in path:
            inside[id(step)] = answer
        return answer

    return " ".join(text for owner, text in found if kept(owner))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(html) for html in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    thin = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_batches(thin, run, "page_id long, url string, text string, n_chars long")

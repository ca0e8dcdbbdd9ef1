"""Main text of web pages by tree scoring.

Every paragraph earns points for its length and its commas and passes them to its
ancestors, less with each level; a container's points are discounted by the share of its
text inside links. The best container is kept together with those of its siblings that
score well or read like prose, and so on up to the ancestor that it shares with other
containers of high score, or to the <main> or <article> around it.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
#: Tags that never hold the article's text.
_DROPPED = frozenset(
    "script style noscript iframe template textarea title head nav footer aside form button select "
    "option object embed svg canvas video audio dialog menu input label fieldset noembed noframes".split())
#: Words in class, id or role that mark page furniture.
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|comments?|disqus|respond|reply|replies|"
    r"cookies?|consent|notices?|alerts?|pop-?up|modal|overlay|newsletter|subscri\w*|sign-?up|nav\w*|menu|"
    r"breadcrumbs?|pag(?:er|ination)|foot(?:er)?|head(?:er)?|masthead|share|sharing|social|related|recommend\w*|"
    r"widget|login|search|complementary|contentinfo|navigation|toolbar|skip|hidden|print-only|"
    r"copyright|legal|disclaimer|feedback|user-comments?|discussion)(?:$|[\s_-]|\d)", re.I)
#: Furniture that may hold much text that is not the article's.
_APART = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|comments?|disqus|respond|reply|replies|"
    r"cookies?|consent|newsletter|subscri\w*|foot(?:er)?|related|recommend\w*|complementary|contentinfo|"
    r"copyright|legal|disclaimer|feedback|user-comments?|discussion)(?:$|[\s_-]|\d)", re.I)
#: Tags whose furniture may be a wrapper of the whole article.
_WRAPPERS = frozenset("form fieldset header".split())
_KEEPS = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body)(?:$|[\s_-])", re.I)
#: A start tag; its quoted values may hold anything, or, on a page where a quote is left open, nothing special.
_START = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_START = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
_END = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""",
                        re.I)
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"},
           "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_CONTAINERS = frozenset("ul ol dl table select".split())
_PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())


class Node:
    __slots__ = ("tag", "parent", "children", "score", "attrs")

    def __init__(self, tag: str, parent: "Node | None", attrs: dict):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node | str] = []
        self.score = 0.0


def _attributes(source: str) -> dict[str, str]:
    if not source or not source.strip():
        return {}
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(source)}


class _Path:
    """The open nodes from the root down, and at which depths each tag and the blocks stand."""

    def __init__(self) -> None:
        self.nodes = [Node("#root", None, {})]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        """The node at ``depth`` and all below it end."""
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.depths[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def last(self, tags: frozenset[str] | set[str]) -> int:
        """Depth of the innermost open node with one of the tags; 0 if there is none."""
        return max((d[-1] for d in map(self.depths.get, tags) if d), default=0)

    def end(self, tag: str) -> None:
        """An end tag; an inline one does not close the blocks around it, one without a start does nothing."""
        found = self.depths.get(tag)
        if found and (tag in _BLOCK or not self.blocks or self.blocks[-1] < found[-1]):
            self.close(found[-1])

    def start(self, tag: str, attrs: dict) -> Node:
        """A new child of the innermost node, once those are closed that it does not go into."""
        if tag in _BLOCK and self.blocks and self.nodes[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in _CLOSES:
            found = self.last(_CLOSES[tag])
            if found > self.last(_CONTAINERS):
                self.close(found)
        node = Node(tag, self.nodes[-1], attrs)
        self.nodes[-1].children.append(node)
        return node


def parse(source: str) -> Node:
    """A tree of the page; unclosed and misnested tags are mended as browsers mostly do.

    One pass: every step moves on in the source, and no search that failed is made again.
    """
    path = _Path()
    start, at, size, text = _START, 0, len(source), 0  # text: where the text not yet in the tree begins
    lowered, close = None, -1  # close: the next ">" that was found

    def put(stop: int) -> None:
        if stop > text:
            path.nodes[-1].children.append(source[text:stop])

    while True:
        at = source.find("<", at)
        if close < at:
            close = source.find(">", at)
        if at < 0 or close < 0:
            # what is left has no whole tag; a comment left open hides the rest
            hidden = source.find("<!--", at) if at >= 0 else -1
            put(size if hidden < 0 else hidden)
            return path.nodes[0]
        if source.startswith("<!--", at):
            put(at)
            stop = source.find("-->", at + 4)
            if stop < 0:
                return path.nodes[0]
            at = text = stop + 3
            continue
        if source[at + 1] in "!?":
            put(at)
            at = text = close + 1
            continue
        found = _END.match(source, at)
        if found:
            put(at)
            at = text = found.end()
            tag = found[1].lower()
            if tag == "br":
                path.start("br", {})
            else:
                path.end(tag)
            continue
        found = start.match(source, at)
        if not found and start is _START and source[at + 1].isalpha() and source[at + 1].isascii():
            start = _PLAIN_START  # a quote is open to the end: from here on quotes are plain characters
            found = start.match(source, at)
        if not found:
            at += 1
            continue
        put(at)
        at = text = found.end()
        tag, rest = found[1].lower(), found[2]
        child = path.start(tag, _attributes(rest))
        if tag in _RAW:
            if lowered is None:
                lowered = _lower(source)
            end = lowered.find("</" + tag, at)
            stop = size if end < 0 else end
            child.children.append(source[at:stop])
            close = source.find(">", stop)
            if end < 0 or close < 0:
                return path.nodes[0]
            at = text = close + 1
        elif tag not in _VOID and not rest.rstrip().endswith("/"):
            path.push(child)


def _lower(source: str) -> str:
    """A-Z lowered, every character in its place."""
    lowered = source.lower()  # longer where a character has no single small letter
    return lowered if len(lowered) == len(source) else source.translate({c: c + 32 for c in range(65, 91)})


def _names(node: Node) -> str:
    return " ".join(node.attrs.get(k, "") for k in ("class", "id", "role"))


def _furniture(node: Node, in_article: bool) -> str:
    """"all" of a node goes, or what is no "wrapper" of the article, or nothing."""
    if node.tag in _DROPPED and node.tag not in _WRAPPERS:
        return "all"
    a = node.attrs
    if a and node.tag not in ("html", "body", "article", "main"):
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or \
                re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
            return "all"
        names = _names(node)
        if _FURNITURE.search(names) and not _KEEPS.search(names):
            return "wrapper"
    return "wrapper" if node.tag in _DROPPED or (node.tag == "header" and not in_article) else ""


def _prune(root: Node) -> None:
    """Take furniture out of the tree. Trees may be deep, so no walk here is recursive.

    A form or a wrapper with a name of furniture stays if it holds the page's article, or
    most of its paragraph text (nearly all, if such furniture often has much text).
    """
    wrappers: set[int] = set()
    order: list[Node] = []
    outside: dict[int, int] = {}  # articles by the innermost wrapper around them
    stack = [(root, False, 0)]
    while stack:
        node, in_article, within = stack.pop()
        order.append(node)
        inside = in_article or node.tag in ("article", "main")
        if node.tag == "article":
            outside[within] = outside.get(within, 0) + 1
        left: list[Node | str] = []
        for c in node.children:
            if isinstance(c, str):
                left.append(c)
                continue
            what = _furniture(c, inside)
            if what == "all":
                continue
            left.append(c)
            if what:
                wrappers.add(id(c))
            stack.append((c, inside, id(c) if what else within))
        node.children = left
    if not wrappers:
        return
    held = {id(n): [0, int(n.tag == "article")] for n in order}  # paragraph text, articles
    for node in reversed(order):
        mine = held[id(node)]
        if node.tag == "a":
            mine[0] = 0
        else:
            own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
            mine[0] += own if node.tag in ("p", "pre", "blockquote") or own >= 40 else 0
        if node.parent is not None:
            up = held[id(node.parent)]
            up[0] += mine[0]
            up[1] += mine[1]
    whole = held[id(root)][0]
    walk = [(root, outside.get(0, 0))]
    while walk:
        node, seen = walk.pop()
        left = []
        for c in node.children:
            if isinstance(c, str):
                left.append(c)
                continue
            articles = seen
            if id(c) in wrappers:
                text, inner = held[id(c)]
                apart = _APART.search(_names(c))
                if not (text * 10 > whole * 9 and not seen if apart else text * 2 > whole or (inner and not seen)):
                    continue
                articles += outside.get(id(c), 0)
            left.append(c)
            walk.append((c, articles))
        node.children = left


def _nodes(root: Node) -> list[Node]:
    """All nodes, each after its parent."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def _read(node: Node) -> str:
    """Text of a subtree with single spaces; blocks and line breaks stand apart."""
    out, stack = [], [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(html.unescape(item) if item != " " else item)
            continue
        apart = item.tag in _BLOCK or item.tag == "br"
        if apart:
            out.append(" ")
            stack.append(" ")
        stack += reversed(item.children)
    return " ".join("".join(out).split())


def _own_text(node: Node) -> str:
    return " ".join(html.unescape("".join(c for c in node.children if isinstance(c, str))).split())


def _measure(nodes: list[Node]) -> dict[int, tuple[int, int]]:
    """Characters of each subtree, and how many of them are inside links."""
    found: dict[int, list[int]] = {id(n): [0, 0] for n in nodes}
    for node in reversed(nodes):
        total = found[id(node)]
        total[0] += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            total[1] = total[0]
        if node.parent is not None and id(node.parent) in found:
            up = found[id(node.parent)]
            up[0] += total[0]
            up[1] += total[1]
    return {k: (v[0], v[1]) for k, v in found.items()}


def _score(nodes: list[Node]) -> list[Node]:
    """Give every paragraph's points to its ancestors; the containers that got any."""
    scored: list[Node] = []

    def give(up: Node, points: float) -> None:
        if not up.score:
            scored.append(up)
            up.score = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 3.0, "td": 3.0,
                        "ul": -3.0, "ol": -3.0}.get(up.tag, 0.01)
        up.score += points

    higher: dict[int, float] = {}  # what a node passes on above the fourth level
    for node in nodes:
        leaf = node.tag in _PARAGRAPHS and not any(
            not isinstance(c, str) and c.tag in _BLOCK for c in node.children)
        own = _read(node) if leaf else \
            _own_text(node) if node.tag in _BLOCK and node.tag not in ("html", "body") else ""
        if not own:
            continue
        points = 1 + own.count(",") + own.count("،") + own.count("、") + min(len(own) / 100, 3)
        up, level = (node if node.tag not in _PARAGRAPHS else node.parent), 0
        while up is not None and up.tag != "#root" and level < 4:
            part = points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            give(up, part)
            if level == 3:
                higher[id(up)] = higher.get(id(up), 0.0) + 0.75 * part
            up, level = up.parent, level + 1
    for node in reversed(nodes):
        points = higher.get(id(node), 0.0)
        up = node.parent
        if points and up is not None and up.tag != "#root":
            give(up, points)
            higher[id(up)] = higher.get(id(up), 0.0) + 0.75 * points
    return scored


def extract(source: str | None) -> str:
    """Main text of one page, blocks in page order joined by one space; empty if there is none."""
    if not source:
        return ""
    root = parse(source)
    _prune(root)
    nodes = _nodes(root)
    scored = _score(nodes)
    if not scored:
        return _read(root)
    sizes = _measure(nodes)

    def density(node: Node) -> float:
        total, linked = sizes[id(node)]
        return linked / total if total else 0.0

    worth = {id(n): n.score * (1 - density(n)) for n in scored}
    best = max(scored, key=lambda n: worth[id(n)])
    if best.tag in ("html", "body") or best.parent is None:
        return _read(best)
    least = max(10.0, 0.2 * worth[id(best)])
    chain = [best]
    while chain[-1].parent is not None:
        chain.append(chain[-1].parent)
    height = {id(n): k for k, n in enumerate(chain)}
    # containers of high score that are neither around nor inside the best one, and what holds them
    inside = {id(n) for n in _nodes(best)}
    holds: dict[int, int] = {}
    last = 0
    for node in scored:
        if worth[id(node)] < least or id(node) in height or id(node) in inside or density(node) >= 0.5:
            continue
        up, passed = node, []
        while id(up) not in height and id(up) not in holds:
            passed.append(up)
            up = up.parent
        met = holds[id(up)] if id(up) in holds else height[id(up)]
        holds.update((id(n), met) for n in passed)
        last = max(last, met - 1)
    # <main> and <article> are the page's own word for what belongs together
    named = [k for k, n in enumerate(chain) if n.tag in ("main", "article")]
    if named:
        last = max(last, named[-1] - (chain[named[-1]].tag == "main"))
    last = min(last, len(chain) - 2)

    def prose(text: str, share: float, heading: bool) -> bool:
        return bool(text) and (share < 0.25 if len(text) > 80 or heading
                               else share == 0 and text.rstrip("\"')")[-1:] in (".", "!", "?"))

    kept = [_read(best)]
    for level in range(last + 1):
        within = bool(named) and level < named[-1]
        out: list[str] = []
        run = Node("#run", None, {})  # text and inline elements between blocks
        for sibling in [*chain[level + 1].children, None]:
            if sibling is not None and sibling is not chain[level] and (
                    isinstance(sibling, str) or (sibling.tag not in _BLOCK and worth.get(id(sibling), 0.0) < least)):
                run.children.append(sibling)
                continue
            if run.children:
                total = linked = 0
                for item in run.children:
                    size = (len(item.strip()), 0) if isinstance(item, str) else sizes[id(item)]
                    total, linked = total + size[0], linked + size[1]
                text = _read(run) if total else ""
                if prose(text, linked / total if total else 0.0, False):
                    out.append(text)
                run = Node("#run", None, {})
            if sibling is None:
                break
            if sibling is chain[level]:
                out += kept
            elif worth.get(id(sibling), 0.0) >= least or id(sibling) in holds:
                out.append(_read(sibling))
            elif sibling.tag in _PARAGRAPHS or within:
                text = _read(sibling)
                if prose(text, density(sibling), sibling.tag[0] == "h" and sibling.tag in _PARAGRAPHS):
                    out.append(text)
        kept = out
    return " ".join(t for t in kept if t)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row; pages are read whole, no shuffle.

    Null or empty html gives an empty text; repeated rows stay. A page that is broken off,
    or has tags, quotes or comments left open, takes time in proportion to its length.
    """
    def look(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x) for x in part.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                          F.col(html_col).alias("html"))
    return map_texts(chosen, "page_id long, url string, text string, n_chars long", look, "html")

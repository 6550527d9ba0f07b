"""Main text of web pages by tree scoring.

The markup becomes a tree (end tags that authors leave out are implied).  Parts that say
what they are (navigation, page header and footer, sidebars, forms, notices, adverts,
comments, by element, role or the words of a class or id; inside an article by these only if
sure or if the part looks like it) go.  Each paragraph earns
points: one, one for each comma, one for each hundred characters up to three.  It passes
them to its parent, half to its grandparent and less to what is further up; a container's
sum is discounted by its link density.  The best container is kept, with the siblings whose
points come near it or that read like its paragraphs, and all that they hold; an article is
kept whole, with the articles beside it that are worth as much.

Text blocks are the runs of text between block elements, in page order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: what elements do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table td th tr article section div body html main aside nav form header footer blockquote details fieldset".split())
#: Elements, roles and words that mark what isn't main text.
NOT_MAIN = frozenset("head script style noscript template iframe nav footer aside form button select option input textarea svg canvas object embed dialog menu audio video math datalist noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners
    cookie cookies consent gdpr notice notices popup modal overlay alert newsletter subscribe subscription signup signin login register
    sidebar sidebars aside rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs crumbs topbar toolbar masthead
    header footer comment comments disqus respond reply replies discussion share sharing social related recommended recommendations
    pagination pager search skip copyright disclaimer hidden outbrain taboola form""".split()
)
#: Of these the words that inside an article mark a part by themselves; the others, only what looks like no text.
SURE = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe
    subscription signup signin login sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs toolbar comment comments disqus respond reply replies discussion pagination
    outbrain taboola""".split()
)
GOOD = frozenset("article main content post entry story body text page hentry blog".split())

#: Share of link text from which a part of an article looks like a list of links.
ASIDE_LINKS = 0.3
#: Points of a sibling, as a share of the best part's.
SIBLING = 0.2

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ENDS = re.compile(r"""[>"']""")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table".split())
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPLIT_WORDS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "points", "size", "linked", "commas", "ends", "holds_main")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.linked = self.commas = self.ends = 0
        self.holds_main = False


class _Tags:
    """The tags of a page, one after the other, in time that grows with its length only."""

    def __init__(self, html: str):
        self.html, self.quoted = html, True

    def _close(self, at: int) -> int:
        """Where the tag ends whose attributes begin at ``at``; -1 if it doesn't.  Quotes hide a ``>``."""
        html, begin = self.html, at
        while self.quoted:
            end = ENDS.search(html, at)
            if end and end[0] == ">":
                return end.start()
            at = html.find(end[0], end.end()) + 1 if end else 0
            if not at:  # a quote is never closed: from here on quotes hide nothing
                self.quoted = False
        return html.find(">", begin)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start and end of the next tag or comment from ``at`` on, its slash, name (empty in a comment) and attributes."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), "", "", ""
            name = NAME.match(html, start + 1)
            if name:
                end = self._close(name.end())
                if end < 0:
                    return None
                return start, end + 1, name[1], name[2].lower(), html[name.end() : end]
            if html[start + 1 : start + 2] in ("!", "?", "/") and start + 1 < len(html):
                end = html.find(">", start)
                if end < 0:
                    return None
                return start, end + 1, "", "", ""
            at = start + 1
        return None


class _Open:
    """The open elements: the innermost, and how many of a name are open in all, in its scope and in its list.

    The counts tell whether climbing would find anything, so that each climb closes what it
    passes.
    """

    def __init__(self, root: Node):
        self.here = self.root = root
        self.all: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]
        self.lists: list[Counter[str]] = [Counter()]

    def enter(self, node: Node) -> None:
        self.all[node.tag] += 1
        self.scopes[-1][node.tag] += 1
        self.lists[-1][node.tag] += 1
        if node.tag in SCOPES:
            self.scopes.append(Counter())
        if node.tag in LISTS:
            self.lists.append(Counter())
        self.here = node

    def leave(self) -> None:
        node = self.here
        if node.tag in SCOPES:
            self.scopes.pop()
        if node.tag in LISTS:
            self.lists.pop()
        self.all[node.tag] -= 1
        self.scopes[-1][node.tag] -= 1
        self.lists[-1][node.tag] -= 1
        self.here = node.parent

    def close(self, names: frozenset[str]) -> None:
        while self.here.tag not in names:
            self.leave()
        self.leave()

    def end(self, name: str) -> None:
        """An end tag closes the innermost element of its name; one that is no block, only in the same scope."""
        if self.scopes[-1][name] or name in BLOCK and self.all[name]:
            self.close(frozenset([name]))

    def begin(self, name: str) -> None:
        """What a start tag closes."""
        if name in BLOCK:
            scope = self.scopes[-1]
            if scope["p"]:
                self.close(frozenset(["p"]))
            elif name in HEADINGS and any(scope[h] for h in HEADINGS):
                self.close(HEADINGS)
        closed = CLOSED_BY.get(name)
        while closed and any(self.lists[-1][c] for c in closed):
            self.close(closed)


def parse(html: str) -> Node:
    root = Node("#root", {}, None)
    tags, open_ = _Tags(html), _Open(root)
    at, n = 0, len(html)
    while at < n:
        tag = tags.next(at)
        if not tag:
            open_.here.children.append(html[at:])
            break
        start, end, slash, name, text = tag
        if start > at:
            open_.here.children.append(html[at:start])
        at = end
        if not name:
            continue
        if slash:
            open_.end(name)
            continue
        open_.begin(name)
        attributes = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}
        child = Node(name, attributes, open_.here)
        open_.here.children.append(child)
        if name in VOID or text.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(html, at)
            at = close.start() if close else n
            continue
        open_.enter(child)
    return root


def _marked(node: Node, inside: bool, unlike: Callable[[Node], bool]) -> bool:
    """Whether a part says that it isn't main text.

    ``inside`` an article or the main part, a class or id that isn't sure counts only if the
    part looks like it: many links, or no end of a sentence; a part with the title stays.
    """
    a = node.attributes
    if node.tag in NOT_MAIN:
        return True
    if not a or node.tag in ("html", "body"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if node.tag in ("article", "main") and not a.get("class", "").lower().startswith("comment"):
        return False
    for name in [*a.get("class", "").split(), a.get("id", "")]:
        words = [w.lower() for w in SPLIT_WORDS.split(name) if w and not w.isdigit()]
        if not words:
            continue
        if inside and words[-1] in SURE:
            return True
        if (words[-1] in WORDS or words[0] in WORDS and words[-1] not in GOOD) and not (inside and unlike(node)):
            return True
    return False


def _prune(root: Node) -> None:
    """Removes marked parts, unless they hold the main part or the page's heading."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if type(c) is Node]
    for node in reversed(order):
        node.holds_main = node.tag in ("article", "main") or any(type(c) is Node and (c.holds_main or c.tag == "h1") for c in node.children)
    measured = False

    def unlike(node: Node) -> bool:
        """Whether a part reads like text; the tree is measured when this is first asked."""
        nonlocal measured
        if not measured:
            _measure(root, ends=True)
            measured = True
        return node.holds_main or node.ends > 0 and _density(node) < ASIDE_LINKS

    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        kept = []
        for c in node.children:
            if type(c) is Node:
                own = c.tag in ("article", "main")
                if c.tag == "header" and not inside and not c.holds_main:
                    continue
                if _marked(c, inside, unlike) and (c.tag in NOT_MAIN or own or not c.holds_main or inside):
                    continue
                stack.append((c, inside or own))
            kept.append(c)
        node.children = kept


def _measure(root: Node, ends: bool = False) -> list[Node]:
    """Sets each node's characters of text and of link text; the nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if type(c) is Node]
    for node in reversed(order):
        node.size = sum(len(" ".join(c.split())) if type(c) is str else c.size for c in node.children)
        node.commas = sum(c.count(",") if type(c) is str else c.commas for c in node.children)
        if ends:
            node.ends = sum(c.count(".") + c.count("!") + c.count("?") if type(c) is str else c.ends for c in node.children)
        node.linked = node.size if node.tag == "a" else sum(c.linked for c in node.children if type(c) is Node)
    return order


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _value(article: Node) -> float:
    """What the paragraphs anywhere in an article are worth."""
    total, stack = 0.0, [article]
    while stack:
        node = stack.pop()
        if _is_paragraph(node) and node.size >= 25:
            total += (1 + node.commas + min(node.size // 100, 3)) * (1 - _density(node))
        stack += [c for c in node.children if type(c) is Node]
    return total


def _flat(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if type(x) is str:
            out.append(x)
        else:
            stack += reversed(x.children)
    return " ".join(unescape("".join(out)).split())


def _is_paragraph(node: Node) -> bool:
    if node.tag in ("p", "pre", "blockquote", "td", "dd"):
        return True
    # A part with text of its own that holds no other block reads like a paragraph.
    return node.tag in ("div", "section", "li", "article", "main", "body") and any(type(c) is str and len(c.strip()) > 20 for c in node.children) and not any(
        type(c) is Node and c.tag in BLOCK for c in node.children
    )


def _best(root: Node, order: list[Node]) -> Node | None:
    for node in order:
        if _is_paragraph(node) and node.size >= 25:
            points = (1 + node.commas + min(node.size // 100, 3)) * (1 - _density(node))
            up, level = node.parent if node.tag not in ("article", "main", "body", "div", "section") else node, 0
            while up is not None and level < 6:
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up, level = up.parent, level + 1
    best, most = None, 0.0
    for node in order:
        if node.points:
            value = node.points * (1 - _density(node))
            names = {w.lower() for w in SPLIT_WORDS.split(node.attributes.get("class", "") + " " + node.attributes.get("id", ""))} if node.attributes else ()
            value *= 1.25 if node.tag in ("article", "main") or any(w in GOOD for w in names) else 0.8 if node.tag in ("li", "td", "th", "dd") else 1.0
            if value > most:
                best, most = node, value
    return best


def _blocks(part: Node, out: list[str]) -> None:
    line: list[str] = []

    def flush() -> None:
        if text := " ".join(unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    stack: list[Node | str | None] = [part]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif type(x) is str:
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()


def main_text(html: str | None) -> str:
    """The main text of a page: blocks joined by one line feed; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    _prune(root)
    order = _measure(root)
    best = _best(root, order)
    parts: list[Node] = []
    if best is None:
        best = next((x for tag in ("article", "main", "body") for x in order if x.tag == tag), root)
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        best = up  # the whole article, with the sections that scored less
    if best.tag == "article" and best.parent is not None:
        # further articles beside it that read like it
        least = max(2.0, SIBLING * _value(best))
        parts = [x for x in best.parent.children if x is best or type(x) is Node and x.tag == "article" and _value(x) >= least]
    elif best.tag in ("article", "main", "body", "#root", "html") or best.parent is None:
        parts = [best]
    else:
        near = max(10.0, SIBLING * best.points)
        for x in best.parent.children:
            if type(x) is not Node:
                continue
            density = _density(x)
            if (
                x is best
                or x.points * (1 - density) >= near
                or x.tag == "p" and x.size and (density < 0.25 if x.size >= 80 else density == 0 and re.search(r"[.!?]\W*$", _flat(x)))
                or x.tag in ("h1", "h2", "h3") and density < 0.25
            ):
                parts.append(x)
    out: list[str] = []
    for part in parts:
        _blocks(part, out)
    return "\n".join(out)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the columns ``keep``, ``text`` and ``n_chars`` (its code points), a row for each row of ``df``.

    Null or empty markup gives an empty text.  Markup of any length is read whole.  Null and
    repeated identifiers keep their rows; an empty table gives an empty result.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, *keep)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["__html"].tolist()]
            out = batch.drop(columns="__html")
            yield out.assign(text=texts, n_chars=[len(t) for t in texts])

    # what is carried along travels as strings, since pandas has no null among integers
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in kinds], F.col(f"`{html_col}`").alias("__html"))
    out = rows.mapInPandas(run, ", ".join([*[f"`{c}` string" for c in kinds], "text string", "n_chars bigint"]))
    return out.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()], "text", "n_chars")

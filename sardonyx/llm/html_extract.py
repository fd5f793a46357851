"""Main text of web pages by tree scoring.

A page becomes a light tree of elements.  Elements that are never main text
(scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms,
reader comments, hidden parts) are cut first, by tag, role, or the words of
class and id.  Words never cut an ``article``, a ``main`` or a heading, nor a
part that holds most of the page's unlinked text (nor does ``form`` cut that);
only reader comments (also as articles inside an article) and consent notices
may be longer than the text beside them.  On a paragraph and inside an article
a name cuts by its last word alone.  Of an article's own header the headings stay.  Every text block then passes points for its length and commas
to its nearest ``ANCESTORS``: all to the parent, half to the next, less to those
above, discounted by the share of its characters inside links.  The container with
the best score (again discounted by link density) is kept with the siblings
that look like more of the same; inside an ``article`` or ``main`` the whole
element is kept.  Its blocks, in page order, are the text.  Lengths and scores are
summed up the tree once, so the work grows with the page, however deep it is.

Defined results: NULL or empty html, and pages without any block, give the
empty text; repeated rows give a row each; unclosed or stray tags never fail;
tags nest to any depth (no recursion).  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from sardonyx.llm.common import arrow_map, texts_of

# ---- fixed values: tag names of HTML, and words that mark parts beside the main text
DROPPED_TAGS = frozenset("""script style noscript template iframe object embed svg annotation annotation-xml canvas audio video
    head title nav header footer aside button select textarea input dialog menu""".split())
DROPPED_ROLES = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert
    menu menubar toolbar""".split())
DROPPED_WORDS = frozenset("""ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored
    promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer
    comment comments commentlist disqus respond reply replies notice notices cookie cookies consent gdpr popup
    modal overlay newsletter subscribe subscription signup login social share sharing related recommended
    recommendations pagination pager widget toolbar copyright disclaimer alert search banner""".split())
#: First words of classes that describe what an element holds or is about.
DESCRIBES = frozenset("has with no without category cat tag tagged topic type format status".split())
#: Beside a class of these words, ``right-sidebar`` and the like are the page's layout.
LAYOUT_WORDS = frozenset("layout template page site wrapper wrap".split())
#: Words for parts that may well be longer than the main text, and what such a name may hold besides.
LONG_WORDS = frozenset("comment comments commentlist disqus respond reply replies cookie cookies consent gdpr".split())
LONG_NAMES = LONG_WORDS | DROPPED_WORDS | frozenset(
    "list section area thread threads wrapper wrap container box bar body content item main".split())
#: Last words that say nothing of what an element holds.
PLAIN_ENDS = LONG_NAMES - DROPPED_WORDS | frozenset("block inner left right top bottom link links button buttons".split())
#: First words that mark a part whatever follows.
FIRM_WORDS = LONG_WORDS | frozenset("""ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored
    promo promotion newsletter subscribe sidebar""".split())
#: In an article only the headings of parts so named stay.
HEADER_WORDS = frozenset("header masthead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no class or id cuts.
NEVER_BY_NAME = HEADINGS | {"html", "body", "article", "main"}
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary
    table tbody td tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - frozenset("body caption dd dt html li summary tbody td tfoot th thead tr".split())
#: An opening tag on the left ends an open one on the right, up to the nearest border.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
          "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
BORDERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
TABLE_BORDER = ("table",)
P_BORDER = frozenset("article aside body caption div html main section table td th".split())
#: Tags, and roles, whose element is kept whole.
WHOLE_TAGS = frozenset(("article", "main"))
CONTAINERS = frozenset(("#root", "body", "div", "section", "article", "main"))
#: Points for a block of at least this many characters; shorter ones earn by length alone.
LEAST_CHARS = 25
#: Levels above a block that get points of it.
ANCESTORS = 8
SIBLING_SHARE = 0.2
WHOLE_BONUS = 25.0

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
_DECLARATION = re.compile(r"<!\[(?!CDATA\[)")


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "named", "plain", "points", "chars", "linked", "titles", "whole",
                 "inside", "holds", "quiet", "p")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids, self.cut = tag, parent, [], False
        self.named = self.plain = 0  # cut for a name alone (NAMED, LONG); characters outside links
        self.points, self.chars, self.linked, self.titles = 0.0, 0, 0, 0  # titles: characters inside h1
        self.whole = tag in WHOLE_TAGS
        self.inside = parent is not None and (parent.inside or parent.whole)
        self.holds = False  # an article or main
        self.quiet = False  # only headings in it are text
        # the open paragraph that a block would end
        self.p = self if tag == "p" else None if parent is None or tag in P_BORDER else parent.p


NAMED, LONG = 1, 2


def _name_says(name: str, layout: bool, by_end: bool) -> int:
    """Whether a class or id names a part beside the text (NAMED), or one that may be longer than it (LONG).

    ``has-sidebar``, ``category-social`` and the like describe what holds the part, not the part.
    ``by_end``: only the last word that says something counts (``social-contract`` is a contract),
    or a first word that is firm (``ad-300x250``).
    """
    words = [w.lower() for w in _WORDS.findall(name)]
    if DROPPED_WORDS.isdisjoint(words) or words[0] in DESCRIBES:
        return 0
    if by_end and words[0] not in FIRM_WORDS and next((w for w in reversed(words) if w not in PLAIN_ENDS and not w.isdigit()), "") not in DROPPED_WORDS:
        return 0
    if layout and len(words) > 1 and "sidebar" in (words[0], words[-1]) and len(DROPPED_WORDS.intersection(words)) == 1:
        return 0
    return LONG if LONG_NAMES.issuperset(words) and not LONG_WORDS.isdisjoint(words) else NAMED


def _named(attrs: list, by_end: bool) -> int:
    """What an element's classes and id say of it."""
    names = [n for k, v in attrs if v and (k == "class" or k == "id") for n in v.split()]
    if not names:
        return 0
    parts = [{w.lower() for w in _WORDS.findall(n)} for n in names]
    layout = any(not LAYOUT_WORDS.isdisjoint(p) and DROPPED_WORDS.isdisjoint(p) for p in parts)
    return max(_name_says(n, layout, by_end) for n in names)


def _is_header(attrs: list) -> bool:
    """Whether a class or id says that an element is the header of what holds it."""
    return any(words and words[-1].lower() in HEADER_WORDS for k, v in attrs if v and (k == "class" or k == "id")
               for words in map(_WORDS.findall, v.split()))


def _beside(tag: str, attrs: list) -> bool:
    """Whether an element's tag, role or state marks it as beside the main text, whatever its name."""
    if tag in DROPPED_TAGS:
        return True
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true":
            return True
        if not v:
            continue
        if k == "role" and v.lower() in DROPPED_ROLES:
            return True
        if k == "style" and _HIDDEN.search(v):
            return True
    return False


class Tree(HTMLParser):
    """Builds the tree; the kids of a node are nodes and strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.most_named = 0
        self.open: Counter[str] = Counter()  # so that nothing is looked for that is not there

    def _up_to(self, node: Node) -> None:
        """End the open elements inside ``node``."""
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _close(self, tags, border) -> None:
        n = self.at
        while n.parent is not None and any(self.open[t] > 0 for t in tags):
            if n.tag in tags:
                self._up_to(n.parent)
                n = self.at
                continue
            if n.tag in border:
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and self.at.p is not None:
            self._up_to(self.at.p.parent)
        if tag in CLOSES:
            self._close(CLOSES[tag], BORDERS.get(tag, TABLE_BORDER))
        node = Node(tag, self.at)
        node.quiet = node.inside and (tag == "header" or tag not in NEVER_BY_NAME and _is_header(attrs))
        node.cut = not (node.quiet and tag == "header") and _beside(tag, attrs)
        node.whole = node.whole or any(k == "role" and v in WHOLE_TAGS or k == "itemprop" and v == "articleBody"
                                       for k, v in attrs)
        self.at.kids.append(node)
        named = 0 if node.cut or node.quiet or tag in ("html", "body") else _named(attrs, tag == "p" or node.inside)
        if tag == "form" or any(k == "role" and v == "form" for k, v in attrs):
            named = max(named, NAMED)
        if named and (not node.whole and tag not in NEVER_BY_NAME
                      or named == LONG and node.whole and tag != "main" and node.inside):
            node.cut, node.named = True, named
            self.most_named = max(self.most_named, named)
        if node.whole and not node.cut and not named:  # what holds an article is no sidebar
            up = self.at
            while up is not None and not up.whole and not up.holds:
                if up.tag in ("form", "div", "section", "header"):
                    up.cut = False
                up.holds, up = True, up.parent
        if tag not in VOID_TAGS:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.open[tag] <= 0:
            return
        n = self.at
        while n.parent is not None and n.tag != tag:
            if tag not in BLOCK_TAGS and n.tag in BLOCK_TAGS or n.tag == "table" and tag in ("p", "li"):
                return
            n = n.parent
        if n.parent is not None:
            self._up_to(n.parent)

    def handle_data(self, data):
        self.at.kids.append(data)


def _spare(root: Node, most: int) -> None:
    """Elements cut for a name (up to ``most``) come back if they hold most of the unlinked text."""
    root.plain = 0
    order, stack = [], [(root, False)]
    while stack:
        node, links = stack.pop()
        order.append(node)
        for kid in node.kids:
            if isinstance(kid, str):
                node.plain += 0 if links else len(kid.strip())
            elif not kid.cut or 0 < kid.named <= most:
                kid.plain = 0
                stack.append((kid, links or kid.tag == "a"))
    for node in reversed(order):  # kids before their parents
        if node.parent is not None:
            node.parent.plain += node.plain
    for node in order:
        if node.cut and 2 * node.plain > root.plain:
            node.cut = False


def parse(html: str) -> Node:
    t = Tree()
    t.feed(_DECLARATION.sub("<! [", html))
    t.close()
    if t.most_named:
        _spare(t.root, NAMED)
    if t.most_named == LONG and not any(len(text) - linked >= LEAST_CHARS and holder.tag not in HEADINGS
                                        for text, holder, linked in blocks_of(t.root)):
        _spare(t.root, LONG)  # no other text is there
    return t.root


def blocks_of(root: Node) -> list[tuple[str, Node, int]]:
    """``(text, holder, characters inside links)`` of the uncut blocks, in page order."""
    out: list[tuple[str, Node, int]] = []
    run: list[str] = []
    linked = 0

    def end(holder: Node) -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            out.append((text, holder, min(linked, len(text))))
        run.clear()
        linked = 0

    # (node, next kid, nearest block, links around, inside an article's header but not in a heading)
    stack = [[root, 0, root, 0, False]]
    while stack:
        top = stack[-1]
        node, k, holder, links, quiet = top
        if k == len(node.kids):
            stack.pop()
            if node is holder:
                end(holder)
            continue
        top[1] += 1
        kid = node.kids[k]
        if isinstance(kid, str):
            if not quiet:
                run.append(kid)
                if links:
                    linked += len(kid.strip())
        elif kid.cut:
            if kid.tag in BLOCK_TAGS:
                end(holder)
        elif kid.tag == "br":
            run.append(" ")
        elif kid.tag in BLOCK_TAGS:
            end(holder)
            stack.append([kid, 0, kid, links, kid.tag not in HEADINGS and (quiet or kid.quiet)])
        else:
            stack.append([kid, 0, holder, links + (kid.tag == "a"), quiet])
    return out


def _uncut(root: Node) -> list[Node]:
    """The elements that are not cut, parents before their kids."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [kid for kid in node.kids if not isinstance(kid, str) and not kid.cut]
    return order


def _score(root: Node, blocks: list[tuple[str, Node, int]]) -> list[Node]:
    """Passes points up; the nodes that have any, in order of first touch."""
    touched: dict[int, Node] = {}
    for text, holder, linked in blocks:
        n, commas = len(text), text.count(",")
        density = linked / n
        points = (min(n / 100, 3.0) + (1 + commas if n >= LEAST_CHARS else 0)) * (1 - density)
        # a block that is an element of its own passes its points to the element around it, a cell to its table
        up, level = holder, 0
        if holder.tag in ("td", "th"):
            while up.parent is not None and up.tag != "table":
                up = up.parent
        elif holder.tag not in CONTAINERS and holder.parent is not None:
            up = holder.parent
        while up is not None and level < ANCESTORS:
            touched.setdefault(id(up), up)
            up.points += points / (1, 2, 6)[level] if level < 3 else points / (3 * level)
            up, level = up.parent, level + 1
        holder.chars += n
        holder.linked += linked
        holder.titles += n if holder.tag == "h1" else 0
    for node in reversed(_uncut(root)):  # kids before their parents
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.titles += node.titles
    return list(touched.values())


def main_text(html: str) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root = parse(html)
    blocks = blocks_of(root)
    if not blocks:
        return ""

    def value(n: Node) -> float:
        return (n.points + WHOLE_BONUS * (n.whole and n.chars > 0)) * (1 - n.linked / max(n.chars, 1))

    scored = [n for n in _score(root, blocks) if n.tag != "html"]
    if any(n.tag == "body" for n in scored):  # a fragment has its root for a body
        scored = [n for n in scored if n is not root]
    nodes = scored or [root]
    best = max(nodes, key=value)  # ties: the first touched
    whole = best
    while whole is not None and not whole.whole:
        whole = whole.parent
    kept = {id(whole or best)}
    top = whole or best
    if top.parent is not None:
        least, before = SIBLING_SHARE * value(best), True
        for s in top.parent.kids:
            before = before and s is not top
            if isinstance(s, str) or s.cut or s.named or s is top:
                continue
            plain = s.chars > 0 and s.linked < s.chars / 4
            if top.whole:
                more = s.tag == top.tag and value(s) >= least or s.tag == "h1"
            else:
                more = value(s) >= (least if s.tag == top.tag else max(10.0, least)) or s.tag in (
                    "p", "h1", "h2", "h3")
            more = more or before and 0 < s.titles == s.chars  # the page's title alone
            if more and plain:
                kept.add(id(s))
    for node in _uncut(root):  # what a kept element holds is kept
        if node.parent is not None and id(node.parent) in kept:
            kept.add(id(node))
    return "\n".join(text for text, holder, _ in blocks if id(holder) in kept)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of every page."""
    def run(batches):
        for b in batches:
            texts = [main_text(x.decode("utf-8", "replace")) for x in texts_of(b, html)]
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in range(len(keep))]
                + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"])

    src = pages.select(*keep, html)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:len(keep)])
    return arrow_map(src, run, f"{kinds}, text string, n_chars bigint")

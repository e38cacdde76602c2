"""Main text of web pages by composite text density.

A page is parsed into a tree by one linear pass. Elements that are never article text (menus, page headers, footers,
asides, controls, scripts, styles), forms and blocks whose class, id or role names an advert, a notice, a sidebar, a menu or
reader comments are penalised: their text counts for nothing, and they are left out unless they turn out to wrap
the article. On the rest every node gets its link-adjusted number of characters per tag; a node's density sum is that
of its children, and the node with the largest sum is the core. The least number of plain characters per tag on
the path from the body to the core is the threshold that further blocks beside this path have to reach. Headings
and paragraphs beside the core belong to it at any length, as do all parts of an <article> that holds the core.

Defined cases: null or empty html, or a page without text: empty text. Broken markup never fails: unclosed
elements end with their parents, a '<' that begins no tag is text, an unclosed comment, script or style runs to the end,
quotes that don't close are ignored. Repeated rows give repeated results. Extra columns of the input are ignored. The work
per page is linear in its length, whatever its markup: open elements are found by their depths, not by climbing.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import require

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object canvas select".split())
CUT = frozenset("head nav footer aside button menu dialog".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article section div main table ul ol dl blockquote body html td th aside nav form header footer".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FLOW = HEADINGS | frozenset("p blockquote pre ul ol dl figure table center address hr details".split())
# blocks whose names tell what they are; names of single paragraphs and inline elements tell less
NAMED_BLOCKS = frozenset("div section ul ol dl table td header main article center details fieldset figure".split())

# Words in class and id names of blocks that are no article text.
ADVERTS = "ads? advert\\w* adsense sponsor\\w* promo\\w* cookies? consent gdpr newsletter subscribe signup"
OTHERS = (
    "banner breadcrumbs? notice notification alert popup modal overlay login sidebar side widget menu navbar nav navigation topbar masthead header footer "
    "footnav copyright share sharing social related recommend\\w* pagination pager toolbar search skip\\w* disclaimer widgets"
)
# what may stand beside such a word in a name that still says the same; with any other word ("side-effects") the name says nothing
PARTS = (
    "area areas article articles bar bars block blocks body bottom box btn button buttons center col cols column columns container content desktop dropdown "
    "fixed form global group holder home icon icons info inner item items layout left link links list lists main mini mobile news outer page pages panel "
    "post posts primary right row section secondary site small sticky stories story text tab tabs title tools top trail wrap wrapper zone"
)
COMMENTS = "comments? commentlist disqus replies reply respond responses discussion threads?"
TEASERS = "teasers? preview previews card cards excerpt related recommend\\w* promo\\w*"
WRITERS = "author authors byline user username avatar commenter poster"
TIMES = "date time timestamp posted published ago datetime"
CONTENT = "post article entry story content main blog text body page"
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[_-])(?:{'|'.join(words.split())})(?=$|[_-])")


ADVERT, READERS, OWN, TEASER, WRITER, TIME = map(_named, (ADVERTS, COMMENTS, CONTENT, TEASERS, WRITERS, TIMES))
OTHER, PART = (re.compile(rf"(?:{'|'.join(w.split())})$") for w in (OTHERS, f"{OTHERS} {ADVERTS} {PARTS}"))
#: Modifiers: "has-sidebar" or "comments-open" say something about a wrapper.
MODIFIER = re.compile(r"^(?:has|with|no|without|is|not)[_-]|[_-](?:open|closed|enabled|disabled|free|count|left|right)$")

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
SPACE = re.compile(r"\s+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ZEROS = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])")
HUGE = re.compile(r"&#(?:[0-9]{9,}+|[xX][0-9a-fA-F]{9,}+);?")

PLAIN, CUT_OFF, NAME_OF_OTHER, OF_READERS, OF_ADVERT, HEADER, FORM = range(7)


class Node:
    __slots__ = ("tag", "kids", "parent", "own", "names", "signs", "cut", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, parent: Node | None, own: int, names: bool = False, signs: int = 0):
        self.tag, self.parent, self.own, self.names, self.signs, self.cut, self.kids = tag, parent, own, names, signs, False, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0

    def nodes(self) -> list[Node]:
        return [k for k in self.kids if not isinstance(k, str)]

    def plain(self) -> float:
        """Characters outside links per tag."""
        return (self.chars - self.link_chars) / max(self.tags, 1)


def _says_other(word: str) -> bool:
    """Whether a class or id names a menu, a sidebar and the like: by one of these words, with nothing beside it that may mean something else."""
    parts = [p for p in re.split("[_0-9-]+", word) if p]
    return any(map(OTHER.match, parts)) and all(map(PART.match, parts))


def _own(tag: str, attributes: str) -> tuple[int, bool, int]:
    """What an element is by itself, whether it is named as content, and signs of who wrote it (1) and when (2)."""
    if tag in CUT:
        return CUT_OFF, False, 0
    out, content = (HEADER if tag == "header" else FORM if tag == "form" else PLAIN), False
    signs = 1 if tag == "cite" else 2 if tag == "time" else 0
    if attributes and tag not in ("body", "html"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name in ("class", "id"):
                for word in CAMEL.sub("-", value).lower().split():
                    if MODIFIER.search(word):
                        continue
                    content = content or OWN.search(word) is not None
                    signs |= (WRITER.search(word) is not None) | 2 * (TIME.search(word) is not None)
                    if READERS.search(word) and (tag in NAMED_BLOCKS or tag == "li"):
                        out = OF_READERS
                    elif out in (PLAIN, NAME_OF_OTHER, HEADER) and tag not in ("article", "main") and ADVERT.search(word):
                        out = OF_ADVERT
                    elif out == PLAIN and tag == "article" and TEASER.search(word):
                        out = NAME_OF_OTHER
                    elif out == PLAIN and tag in NAMED_BLOCKS and tag not in ("article", "main") and _says_other(word):
                        out = NAME_OF_OTHER
            elif (
                (name == "role" and value.strip().lower() in ROLES and not (tag == "form" and value.strip().lower() == "form"))
                or name == "hidden"
                or (name == "aria-hidden" and value.lower() == "true")
                or (name == "style" and "display:none" in value.replace(" ", "").lower())
            ):
                return CUT_OFF, False, 0
    return out, content, signs


def settle(root: Node) -> None:
    """Decides what is cut. A named block is kept if it wraps an article or main element, or if it holds two fifths of the
    text of the article around it (of the page, without one); a form if it wraps one or if its paragraphs do; a block of reader comments only if it holds a
    page's heading. A block of items that all tell who wrote them and when is one of reader comments. A header is kept in an article, or where it or its
    parent is named as content."""
    order = _order(root)
    holds: dict[int, bool] = {}
    heads: dict[int, bool] = {}
    text: dict[int, int] = {}
    prose: dict[int, int] = {}
    signs: dict[int, int] = {}
    for n in reversed(order):
        kids = n.nodes()
        signs[id(n)] = n.signs
        for k in kids:
            signs[id(n)] |= signs[id(k)]
        heads[id(n)] = n.tag in ("h1", "main") or any(heads[id(k)] for k in kids)
        if n.own == PLAIN and signs[id(n)] == 3 and n.tag in ("ul", "ol", "dl", "div", "section") and not heads[id(n)] and _is_thread(n, kids, signs):
            n.own = OF_READERS
        gone = n.own in (CUT_OFF, OF_READERS)
        holds[id(n)] = not gone and ((n.tag in ("article", "main") and n.own == PLAIN) or any(holds[id(k)] for k in kids))
        text[id(n)] = 0 if gone or n.own == OF_ADVERT else sum(len(k.strip()) for k in n.kids if isinstance(k, str)) + sum(text[id(k)] for k in kids)
        prose[id(n)] = text[id(n)] if n.tag == "p" or gone else sum(prose[id(k)] for k in kids)
    around: dict[int, int] = {}
    within: dict[int, bool] = {}
    for n in order:
        up = n.parent
        starts = n.tag == "article" and n.own == PLAIN
        around[id(n)] = text[id(n)] if up is None or starts else around[id(up)]
        within[id(n)] = starts or n.tag == "main" or (up is not None and within[id(up)])
        if n.own == PLAIN:
            stays = True
        elif n.own == OF_READERS:
            stays = heads[id(n)]
        elif n.own == HEADER:
            stays = within[id(n)] or holds[id(n)] or n.names or (up is not None and up.names and up.tag not in ("body", "html") and not any(k.tag == "nav" for k in n.nodes()))
        elif n.own == FORM:
            stays = holds[id(n)] or prose[id(n)] * 5 > around[id(n)] * 2
        else:
            stays = n.own != CUT_OFF and (holds[id(n)] or (n.own == NAME_OF_OTHER and text[id(n)] * 5 > around[id(n)] * 2))
        n.cut = (up is not None and up.cut) or not stays


def _is_thread(node: Node, kids: list[Node], signs: dict[int, int]) -> bool:
    """Whether most of a block's parts are items of one kind, at least two, that each tell who wrote them and when."""
    items = [k for k in kids if signs[id(k)] == 3 and k.tag in ("li", "div", "article", "section", "dd", "blockquote")]
    return len(items) >= 2 and len({k.tag for k in items}) == 1 and 4 * len(items) >= 3 * sum(k.tag not in ("br", "hr") for k in kids)


class Open:
    """The open elements, with the depths of each name, so that the nearest one is known without climbing."""

    def __init__(self, root: Node):
        self.stack, self.depths, self.scopes, self.walls = [root], {"html": [0]}, [0], []

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.depths.setdefault(node.tag, []).append(at)
        if node.tag in SCOPE:
            self.scopes.append(at)
        if node.tag in ("article", "body"):
            self.walls.append(at)

    def close(self, at: int) -> None:
        """Closes the element at this depth and all in it."""
        at = max(at, 1)
        while len(self.stack) > at:
            node = self.stack.pop()
            self.depths[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()
            if node.tag in ("article", "body"):
                self.walls.pop()

    def last(self, tag: str) -> int:
        found = self.depths.get(tag)
        return found[-1] if found else -1


def parse(page: str) -> Node:
    """The tree of a page. Text leaves are plain strings among the children, with their references decoded."""
    root = Node("html", None, PLAIN)
    open_ = Open(root)
    at, end, lower, quotes, last = 0, len(page), None, True, page.rfind(">")
    text_from = 0

    def text(upto: int) -> None:
        if upto > text_from:
            t = page[text_from:upto]
            open_.stack[-1].kids.append(decode(t) if "&" in t else t)

    while True:
        at = page.find("<", at)
        if at < 0 or at > last and not page.startswith("<!--", at):
            break
        if page.startswith("<!", at) or page.startswith("<?", at):
            text(at)
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                stop = end if stop < 0 else stop + 3
            else:
                stop = page.find(">", at) + 1
            at = text_from = stop
            continue
        m = NAME.match(page, at + 1)
        if m is None:
            if page.startswith("</", at):  # no name: it goes up to the next '>'
                text(at)
                at = text_from = page.find(">", at) + 1
            else:
                at += 1
            continue
        rest = REST.match(page, m.end()) if quotes else None
        if rest is None:
            quotes = False  # a quote is open up to the end of the page: from here on they mean nothing, so this is tried once
        stop = rest.end() if rest else page.find(">", m.end()) + 1
        text(at)
        attributes = page[m.end() : stop - 1]
        at = text_from = stop
        tag = m[2].lower()
        if m[1]:  # an end tag closes up to the nearest open element of that name
            found = open_.last(tag)
            if found > 0 and (tag in SCOPE or not open_.walls or open_.walls[-1] < found):
                open_.close(found)
            continue
        if tag == "html":
            continue
        if tag == "body" and open_.stack[-1].tag == "head":
            open_.close(len(open_.stack) - 1)
        if tag in RAW and not attributes.endswith("/"):
            if lower is None:
                lower = page.lower()
                if len(lower) != end:  # a character whose lower case is longer
                    lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)
            close = lower.find(f"</{tag}", at)
            stop = lower.find(">", close) if close >= 0 else -1
            at = text_from = end if stop < 0 else stop + 1
            continue
        if tag == "br":
            node = open_.stack[-1]
            node.kids += [" ", Node("br", node, PLAIN)]
            continue
        if tag in CLOSES_P and open_.last("p") > open_.scopes[-1]:  # a block ends an open paragraph, and inline elements left open in it
            open_.close(open_.last("p"))
        if tag in SAME_CLOSES:
            found = max(map(open_.last, SAME_CLOSES[tag]))
            wall = next((x for x in reversed(open_.scopes[-3:]) if open_.stack[x].tag not in ("td", "th")), 0)
            if found > wall:
                open_.close(found)
        node = open_.stack[-1]
        if tag == "label" and open_.last("form") > open_.last("p"):
            new = Node(tag, node, CUT_OFF)  # the label of a control
        else:
            new = Node(tag, node, *_own(tag, attributes))
        node.kids.append(new)
        if tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK):
            open_.push(new)
    text(end)
    settle(root)
    return root


def decode(text: str) -> str:
    """Character references decoded; numbers that stand for no character, however long, become U+FFFD."""
    return _html.unescape(HUGE.sub("\ufffd", ZEROS.sub(r"&#\1", text)))


def _order(root: Node) -> list[Node]:
    """Nodes that are not cut, parents first, without recursion: markup may nest deeply."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(k for k in reversed(n.kids) if not isinstance(k, str) and not k.cut)
    return out


def measure(root: Node) -> list[Node]:
    """Fills in characters, tags and the composite density of every node that is not cut."""
    nodes = _order(root)
    for n in reversed(nodes):
        is_link = n.tag == "a"
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len(SPACE.sub(" ", k).strip())
            elif not k.cut and k.tag != "br":
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
        if is_link:
            n.link_chars, n.link_tags = n.chars, n.tags
    share = root.link_chars / root.chars if root.chars else 0.0
    for n in nodes:
        if n.chars:
            tags = max(n.tags, 1)
            plain = max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * n.link_chars + share * n.chars + math.e)
            arg = (n.chars / max(n.link_chars, 1)) * (tags / max(n.link_tags, 1))
            n.density = n.chars / tags * math.log(1.0 + arg) / max(math.log(base), 1.0)
    return nodes


def article(root: Node) -> list:
    """The subtrees and texts that make up the article, in page order."""
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    core, most = None, 0.0
    for n in nodes:
        kids = [k for k in n.nodes() if not k.cut and k.tag != "br"]
        total = sum(k.density for k in kids)
        if not total and n.density and not any(k.chars for k in kids):
            total = n.density * 0.5  # a leaf: its own text, below any parent that holds several
        if total > most:
            core, most = n, total
    if core is None:
        return []
    while core.parent is not None and core is not body and core.tag not in SCOPE:
        core = core.parent  # a paragraph, an item or an inline element stands for the block that holds it
    path = [core]
    while path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.plain() for n in path if n.chars)
    linked = lambda n: n.link_chars * 2 > n.chars
    dense = lambda n: n.chars > 0 and not linked(n) and n.plain() >= threshold
    top = next((n for n in reversed(path) if n.tag == "article"), None)
    if top is not None and top.parent is not None:
        # further articles beside it that are as dense belong to the page's text
        return [k for k in top.parent.nodes() if not k.cut and (k is top or (k.tag == "article" and dense(k)))]
    # the blocks of the core, without those of links
    chosen = [k for k in core.kids if isinstance(k, str) or (not k.cut and not (k.tag in SCOPE and linked(k)))]
    for child, up in zip(path, path[1:]):
        # what stands beside the path: by density; beside the core and in blocks named as content, running text too
        own = up is not body and (child is core or up.names or up.tag == "main")
        before, after, seen = [], [], False
        for k in up.kids:
            if k is child:
                seen = True
            elif isinstance(k, str):
                if own:
                    (after if seen else before).append(k)
            elif not k.cut and (
                (own and not (k.tag in SCOPE) and not (linked(k) and k.tag in FLOW))
                or (not seen and child is core and k.tag in HEADINGS)
                or (k.tag == "header" and own and not linked(k))
                or dense(k)
            ):
                (after if seen else before).append(k)
        chosen = [*before, None, *chosen, None, *after]
    return chosen


def blocks(tops: list) -> list[str]:
    """Texts of the blocks under these subtrees: white space single, empty ones left out. None ends a block."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip() if run else ""
        run.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(tops))
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            run.append(n)
        elif not n.cut:
            if n.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(n.kids))
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(article(parse(page)))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""
    require(pages, id_col, url_col, html_col)
    slim = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(x) if isinstance(x, str) else "" for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return slim.mapInPandas(run, "page_id long, url string, text string, n_chars long")

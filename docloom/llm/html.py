"""Main text of web pages by tree scoring.

A page is parsed into a tree. Scripts, styles, forms, menus and the like are left out by tag, role and hiding attributes. Names of
classes and ids that speak of menus, adverts, comments and so on (by their last word, but for words of layout) leave a container out too, unless it holds an article of the page
or most of its plain text. Inside the article they do so only where the container looks the part: it has a form, is short or mostly links, or its class
names an advert or the like; an id that begins the container's first heading is a slug. On headings names mean nothing, on other
text blocks only classes outside the article do. Every paragraph (a block with text of its own) has points for its length and its commas and passes them to its
parent in full, to its grandparent by half and to those above by a third less each step. A container's
points are discounted by the share of its text that stands in links. The best container is kept, or the article or main element
around it, and with it those of its siblings that score alike or are blocks of mostly plain text. Sums go up the tree and
decisions down it once, so the time of a page grows with its length, however deep it is nested.

Defined results: null html is empty and gives an empty text; broken markup is repaired as far as blocks go; each
input row gives one output row, repeated rows too; null page_id and url stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import texts_of

_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
_OUT = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea input label dialog menu audio video map search title".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Names that are hardly ever given to a part of an article.
_ALIEN = frozenset("ad ads advert adverts advertisement advertisements adsense sponsored promo promos sidebar navbar breadcrumb breadcrumbs consent gdpr popup modal overlay newsletter signup login pagination pager".split())
_OUT_WORDS = _COMMENTS | _ALIEN | frozenset("advertising sponsor sponsors promotion promotions banner widget widgets nav navigation menu menus footer header masthead topbar cookie cookies subscribe toolbar notice recommended recommendations".split())
#: Words of layout that may follow the word that a name turns on.
_LAYOUT = frozenset("box block wrapper wrap container area item items list section top bottom left right inner outer slot unit bar row column col module panel text image link links content body form collapse group holder area zone main primary secondary".split())
#: Containers, whose names count.
_CONTAINERS = frozenset("div section article aside ul ol dl table figure details fieldset center hgroup".split())
_FORM_PARTS = frozenset("form input button select textarea".split())
#: Plain characters of a container that is short.
SHORT = 200
#: Words that speak of such things only alone or with one of the words beside them.
_WITH = {
    "related": frozenset("posts post articles article stories links content news items entries topics reading pages".split()), "share": frozenset("buttons button bar links icons this tools".split()),
    "sharing": frozenset("buttons button bar links icons tools".split()), "social": frozenset("buttons button bar links icons media share sharing".split()), "skip": frozenset("link links nav to content".split()),
}
_NOT = frozenset("has with no not without".split())
_BODY_WORDS = frozenset("article content main post entry story body text".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PLAIN_BLOCKS = frozenset([*_HEADINGS, *"p blockquote pre ul ol dl table figure section details".split()])
#: Blocks whose container is the parent.
_TEXT_BLOCKS = frozenset([*_HEADINGS, *"p li pre td th dt dd blockquote figcaption caption summary".split()])
_SCOPE = ("table", "td", "th", "div", "section", "article", "li", "blockquote", "button", "object")
#: What a start tag ends, if it's open: the tags, and where to stop looking.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SLUG = re.compile(r"[^\W_]+")


def named(names: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether names speak of something beside the article, of comments, and of adverts and the like."""
    out = comments = alien = False
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if not parts or parts[0] in _NOT:
            continue
        own = set(parts)
        while len(parts) > 1 and (parts[-1] in _LAYOUT or len(parts[-1]) == 1):
            parts.pop()
        head = parts[-1]
        if head == "header" and (inside or own & _BODY_WORDS):
            continue
        out = out or head in _OUT_WORDS or any(k in own and (own == {k} or own & more) for k, more in _WITH.items())
        comments = comments or head in _COMMENTS
        alien = alien or head in _ALIEN
    return out, comments, alien


class Node:
    __slots__ = ("tag", "parent", "children", "depth", "inside", "within", "out", "soft", "comments", "alien", "slug", "form", "first", "cue", "chars", "linked", "own", "passed", "article", "kept", "menu", "gone", "block")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str | None]):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}" if attrs else ""
        self.out = tag in _OUT or (tag == "header" and not self.inside)
        self.soft = self.comments = self.alien = self.form = False
        self.slug: list[str] = []  # the words of an id that would leave the node out
        self.first: list[str] | None = None  # the words of the first heading
        self.within = parent is not None and (parent.within or (parent.cue > 0 and parent.tag not in ("html", "body")))
        self.cue = int(tag in ("article", "main"))
        if attrs:
            self.out = (
                self.out or "hidden" in attrs or (attrs.get("role") or "").lower() in _OUT_ROLES
                or (attrs.get("aria-hidden") or "").lower() == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style") or ""))
            )
            if names.strip():
                own = self.inside or self.within
                if tag in _CONTAINERS or "-" in tag:
                    self.soft, self.comments, self.alien = named(attrs.get("class") or "", self.inside)
                    by_id, comments, _ = named(attrs.get("id") or "", self.inside)
                    if by_id and not self.soft:
                        self.slug = [x.lower() for x in _SLUG.findall(attrs["id"])]
                    self.soft, self.comments = self.soft or by_id, self.comments or comments
                elif tag in _TEXT_BLOCKS and tag not in _HEADINGS and not own:
                    self.soft, self.comments, self.alien = named(attrs.get("class") or "", False)
                if not self.cue and set(re.split(r"[\s_-]+", names.lower())) & _BODY_WORDS:
                    self.cue = 1
        self.chars = self.linked = 0
        self.own = self.passed = 0.0
        self.article = tag == "main" or (tag == "article" and not self.comments)
        self.kept = self.menu = self.gone = False
        #: Depth of the block that holds the node, or is it.
        self.block = self.depth if tag in _BLOCKS or parent is None else parent.block


class _Tree(HTMLParser):
    """CDATA elements (script, style) and comments give no text; unclosed paragraphs, items, cells and heads end at what cannot stand in them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None, {})
        self.now = self.root
        self.nodes = [self.root]  # parents before children
        self.open: dict[str, list[Node]] = {}

    def _close(self, node: Node) -> None:
        while self.now is not node.parent:
            self.open[self.now.tag].pop()
            self.now = self.now.parent

    def _deepest(self, tags: tuple[str, ...]) -> Node | None:
        return max((o[-1] for t in tags if (o := self.open.get(t))), key=lambda n: n.depth, default=None)

    def _end(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        node = self._deepest(tags)
        if node is not None and ((limit := self._deepest(stop)) is None or limit.depth < node.depth):
            self._close(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.now.tag == "head" and tag not in _HEAD:
            self._close(self.now)
        if tag in _BLOCKS:
            self._end(("p",), _SCOPE)
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        node = Node(tag, self.now, dict(attrs))
        self.now.children.append(node)
        self.nodes.append(node)
        if tag not in _VOID:
            self.open.setdefault(tag, []).append(node)
            self.now = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.now.tag == tag and tag in ("svg", "path", "g", "circle", "rect", "use", "script", "iframe"):
            self._close(self.now)

    def handle_endtag(self, tag: str) -> None:
        node = self._deepest((tag,))
        # an inline end tag ends nothing beyond its block
        if node is not None and (tag in _BLOCKS or node.depth >= self.now.block):
            self._close(node)

    def handle_data(self, data: str) -> None:
        if self.now.tag == "head" and data.strip():
            self._close(self.now)
        self.now.children.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def _blocks(top: Node) -> list[tuple[Node, str, int]]:
    """In page order: the block that holds a run of text, the text, and its characters in links."""
    found: list[tuple[Node, str, int]] = []
    run: list[str] = []
    linked = 0
    holder = top

    def flush(to: Node) -> None:
        nonlocal linked, holder
        text = " ".join("".join(run).split())
        if text:
            found.append((holder, text, min(linked, len(text))))
        run.clear()
        linked, holder = 0, to

    stack: list[tuple[Node, int, bool, Node]] = [(top, 0, False, top)]
    while stack:
        node, at, link, block = stack.pop()
        if at == len(node.children):
            if node.tag in _BLOCKS:
                flush(stack[-1][3] if stack else top)
            continue
        stack.append((node, at + 1, link, block))
        child = node.children[at]
        if isinstance(child, str):
            run.append(child)
            linked += len(" ".join(child.split())) if link else 0
        elif child.tag == "br" or child.tag == "wbr":
            run.append(" ")
        elif not child.out:
            if child.tag in _BLOCKS:
                flush(child)
            stack.append((child, 0, link or child.tag == "a", child if child.tag in _BLOCKS else block))
    flush(top)
    return found


def _sum(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Characters, characters in links and points of every subtree."""
    for node in nodes:
        node.chars = node.linked = 0
        node.own = node.passed = 0.0
    for block, text, linked in blocks:
        block.chars += len(text)
        block.linked += linked
        # a paragraph's container is its parent; text straight in a container is its own
        holder = block.parent if block.tag in _TEXT_BLOCKS and block.parent is not None else block
        holder.own += (1 - linked / len(text)) * (1 + text.count(",") + min(len(text) / 100, 3))
    for node in reversed(nodes):
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.linked += node.linked
            up.passed += node.own / 2 + node.passed * 2 / 3


def _looks_the_part(node: Node) -> bool:
    """Whether a container inside the article that is named like something beside it is that."""
    if node.comments or node.alien or node.form:
        return True
    if node.slug and node.first and node.first[: len(node.slug)] == node.slug:
        return False
    return node.chars <= SHORT or 2 * node.linked > node.chars


def _cut(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> bool:
    """Leaves out what is named as something beside the article; whether there is any."""
    for block, text, _ in blocks:
        if block.tag in _HEADINGS and block.first is None:
            block.first = [x.lower() for x in _SLUG.findall(text)]
    for node in reversed(nodes):
        if (up := node.parent) is None:
            continue
        if node.article and not node.out:
            up.article = True
        up.form |= node.form or node.tag in _FORM_PARTS
        up.first = node.first if node.first is not None else up.first
    plain = nodes[0].chars - nodes[0].linked
    some = False
    # comments go where there is anything else; of the others, what holds most of the rest stays
    for comments in (True, False):
        gone = 0
        for node in nodes:
            if node.soft and node.comments is comments and not node.out and (not (node.inside or node.within) or _looks_the_part(node)):
                own = node.chars - node.linked
                node.out = not (node.article or (own == plain if comments else 2 * own > plain))
                some |= node.out
                gone += own * node.out * (node.parent is None or not node.parent.gone)
            node.gone = node.out or (node.parent is not None and node.parent.gone)
        plain -= gone
    return some


def main_text(page: str) -> str:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    nodes = tree.nodes
    blocks = _blocks(tree.root)
    _sum(nodes, blocks)
    if _cut(nodes, blocks):
        blocks = _blocks(tree.root)
        _sum(nodes, blocks)
    if not blocks:
        return ""
    plainness = lambda n: 1 - n.linked / n.chars if n.chars else 0.0
    score = lambda n: (n.own + n.passed + 5 * n.cue) * plainness(n)
    best = max((n for n in nodes[1:] if n.chars and not n.out and n.tag != "html" and n.tag not in _TEXT_BLOCKS), key=lambda n: (score(n), n.cue), default=tree.root)
    # parts of one article: climb to the article around the best container, or else to the main element
    around, article, main = best, None, None
    while around is not None:
        article = around if around.tag == "article" else article
        main = around if around.tag == "main" else main
        around = around.parent
    best = article or main or best
    best.kept = True
    titles = False
    for node in nodes:
        node.kept = node.kept or (node.parent is not None and node.parent.kept and not node.out)
        titles |= node.kept and node.tag == "h1"
    for sibling in best.parent.children if best.parent and best.tag not in ("body", "main") else []:
        if isinstance(sibling, str) or sibling is best or sibling.out or not sibling.chars:
            continue
        plain = plainness(sibling) > 0.5
        if sibling.tag in _HEADINGS:
            keep = plain and not (article and titles)
        elif article:
            keep = sibling.tag == "article" and plain and score(sibling) >= 0.2 * score(best)
        else:
            keep = plain and (sibling.tag in _PLAIN_BLOCKS or sibling.chars > 80 or score(sibling) >= max(5.0, 0.2 * score(best)))
        sibling.kept = sibling.kept or keep
    for node in nodes[1:]:
        # lists of nothing but links are menus, but where a tag or name says that this is the article
        node.menu = node.parent.menu or (node.tag in ("ul", "ol") and not node.within and plainness(node) < 0.2 and sum(not isinstance(c, str) for c in node.children) >= 3)
        node.kept = (node.kept or node.parent.kept) and not node.menu
    return "\n".join(text for block, text, _ in blocks if block.kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x) for x in texts_of(batch.column("html")).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")

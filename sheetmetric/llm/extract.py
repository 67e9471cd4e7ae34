"""Main text of web pages by tree scoring.

Parts that are no article by their element or role (menus, scripts, hidden parts, ...) are cut off, and so are
forms and parts with the name of an advert, reader comments and the like, unless they hold most of the page's
points. Each paragraph passes points for its length and commas to its ancestors, fewer the further up; a
container's points are discounted by the share of its text that is links. The best container is kept, with
those of its siblings that look like more of the same.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.llm.text import col, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title nav aside header footer dialog menu button select textarea option datalist".split())
FORMS = frozenset(("form", "fieldset"))
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "tbody", "thead", "tfoot", "tr"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset("nav navbar navigation menu header masthead footer sidebar ad ads advert adverts advertisement advertising adsense banner cookie cookies consent gdpr notice popup modal overlay promo promotion sponsor sponsored subscribe subscription newsletter paywall share sharing social related recommend recommended recommendations comment comments respond replies disqus discussion breadcrumb breadcrumbs pagination pager widget widgets login signup toolbar skip".split())
STRONG = frozenset("comment comments respond replies disqus discussion ad ads advert adverts advertisement advertising sponsor sponsored promo related recommended".split())
LAYOUT = frozenset("has with no without".split())      # "has-sidebar" tells of a layout, not of a part
TOPIC = frozenset("category cat tag type format status topic term taxonomy".split())       # "tag-ads" tells what a post is about
REMARKS = frozenset("comment comments respond replies disqus".split())
LISTS = frozenset("related recommend recommended recommendations".split())     # names of lists of links, but also of an article's own parts
CERTAIN, LISTED, REMARK, NAMED = 4, 3, 2, 1    # reasons to cut a part off: the last three only where it does not hold most of the page
KEPT = frozenset("html body main article".split())
RUNNING = frozenset("p pre blockquote li dd td".split())      # elements of running text
COMMAS = ",，、"
CONTAINERS = frozenset("div section article main body td form fieldset".split())
LEVELS = 5                  # ancestors that a paragraph gives points to
PARAGRAPH = 25              # least characters of a paragraph that counts
PAGES = "page_id long, url string, text string, n_chars long"


class Node:
    __slots__ = ("tag", "parent", "parts", "score", "chars", "linked", "own", "commas", "own_commas", "gone", "doubt", "points", "base")

    def __init__(self, tag: str, parent: Node | None, why: int = 0):
        self.tag, self.parent, self.gone, self.doubt = tag, parent, why == CERTAIN, why % CERTAIN
        self.parts: list = []                # text and nodes, in order
        self.score = self.points = self.base = 0.0
        self.chars = self.linked = self.own = self.commas = self.own_commas = 0


@lru_cache(4096)
def _names(value: str) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """All words of the names in a class or id; those that name the part itself; the first of each name."""
    every, own, first = set(), set(), set()
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        every.update(words)
        first.update(words[:1])
        if words and words[0] not in TOPIC:
            own.update(words[:next((i for i, w in enumerate(words) if w in LAYOUT), None)])
    return frozenset(every), frozenset(own), frozenset(first)


def unlikely(tag: str, attrs: list) -> int:
    """Is an element no part of an article? 0 if it may be one, or the reason."""
    if tag in DROPPED:
        return CERTAIN
    why = NAMED if tag in FORMS else 0
    every: set[str] = set()
    own: set[str] = set()
    first: set[str] = set()
    for key, value in attrs:
        if key in ("class", "id"):
            for known, new in zip((every, own, first), _names(value or "")):
                known |= new
        elif key == "role" and (value or "").strip().lower() in ROLES and tag not in KEPT:
            if value.strip().lower() != "form":
                return CERTAIN
            why = NAMED
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or "", re.I):
            return 0 if tag in ("html", "body") else CERTAIN
    if tag in KEPT:
        named = tag == "article" and bool(own & STRONG)
    else:
        named = bool(own & NAMES) and not (every & LAYOUT and not own & STRONG)
    if not named:
        return why
    if first & REMARKS:
        return REMARK
    return LISTED if not why and own & NAMES <= LISTS else NAMED


RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
MARK = re.compile("[>\"']")


class Tags:
    """Ends of the tags of a page. What failed once is remembered, so that all searches together stay linear."""

    def __init__(self, html: str):
        self.html = html
        self.missing: dict[str, int] = {}    # quote -> place from which on there is none
        self.failed: set[int] = set()        # opening quotes from which no tag end is reached

    def _value_opens(self, at: int, quote: int) -> bool:
        while quote > at and self.html[quote - 1].isspace():
            quote -= 1
        return quote > at and self.html[quote - 1] == "="

    def _close(self, quote: int) -> int:
        c = self.html[quote]
        if quote + 1 >= self.missing.get(c, len(self.html)):
            return -1
        close = self.html.find(c, quote + 1)
        if close < 0:
            self.missing[c] = quote + 1
        return close

    def end(self, at: int) -> int:
        """Place of the ">" that ends a tag: the first outside quotes, or at all where quotes never close; -1 if none."""
        html = self.html
        first = html.find(">", at)
        if first < 0 or html.find('"', at, first) < 0 and html.find("'", at, first) < 0:
            return first
        opened: list[int] = []
        mark = MARK.search(html, at)
        while mark:
            here = mark.start()
            if mark[0] == ">":
                return here
            if self._value_opens(at, here):
                if here in self.failed:
                    break
                opened.append(here)
                here = self._close(here)
                if here < 0:
                    break
            mark = MARK.search(html, here + 1)
        self.failed.update(opened)
        return first


def _attributes(raw: str) -> list[tuple[str, str]]:
    return [(name.lower(), unescape(a or b or c)) for name, a, b, c in ATTRIBUTE.findall(raw)]


class Tree:
    """A tolerant tree: what is not closed ends where its parent or a follower ends it; a cut-off tag or comment is left out."""

    def __init__(self, html: str):
        self.root = self.now = Node("", None)
        self.depth = 0
        self.open: dict[str, list[int]] = {}     # tag -> depths of its open elements
        self.nodes: list[Node] = [self.root]
        self._read(html)

    def _read(self, html: str) -> None:
        at, tags = 0, Tags(html)
        while (tag := html.find("<", at)) >= 0:
            if tag > at:
                self.text(html[at:tag])
            name = NAME.match(html, tag + 1)
            if name:
                end = tags.end(name.end())
                if end < 0:
                    return
                kind = name[0].lower()
                self.start(kind, _attributes(html[name.end():end]))
                at = end + 1
                if kind in RAW:
                    close = re.compile(rf"</{kind}(?=[\s/>]|$)", re.I).search(html, at)
                    if close is None:
                        return
                    at = close.start()
            elif name := NAME.match(html, tag + 2) if html.startswith("/", tag + 1) else None:
                end = html.find(">", name.end())
                if end < 0:
                    return
                self.end(name[0].lower())
                at = end + 1
            elif html.startswith("<!--", tag):
                end = html.find("-->", tag + 2 if html.startswith("<!-->", tag) else tag + 4)
                if end < 0:
                    return
                at = end + 3
            elif html[tag + 1:tag + 2] in ("!", "?", "/"):
                end = html.find(">", tag)
                if end < 0:
                    return
                at = end + 1
            else:
                self.text("<")
                at = tag + 1
        self.text(html[at:])

    def _pop(self) -> None:
        self.open[self.now.tag].pop()
        self.now = self.now.parent
        self.depth -= 1

    def _innermost(self, tags: set[str] | frozenset[str]) -> int:
        """Depth of the innermost open element of ``tags``, 0 if none is open."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _end(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Closes the innermost open element of ``tags`` not beyond one of ``stop``."""
        found = self._innermost(tags)
        if found and found >= self._innermost(stop):
            while self.depth >= found:
                self._pop()

    def start(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P and self.open.get("p"):
            self._end({"p"}, {"table", "button", "object"})
        if tag in ENDS:
            tags, stop = ENDS[tag]
            if any(self.open.get(t) for t in tags):
                self._end(tags, stop)
                if tag == "tr":
                    self._end({"tr"}, stop)
        node = Node(tag, self.now, unlikely(tag, attrs))
        self.now.parts.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.now = node
            self.depth += 1
            self.open.setdefault(tag, []).append(self.depth)

    def end(self, tag: str) -> None:
        if self.open.get(tag):
            self._end({tag}, frozenset() if tag in BLOCKS or tag == "table" else {"table", "article", "section", "div", "body"})

    def text(self, data: str) -> None:
        if data:
            self.now.parts.append(unescape(data) if "&" in data else data)


def _measure(nodes: list[Node]) -> None:
    """Lengths of text and links and the commas of each node (children stand behind their parents in the list)."""
    for node in reversed(nodes):
        node.chars = node.linked = node.own = node.commas = node.own_commas = 0
        if node.gone:
            continue
        for part in node.parts:
            if isinstance(part, str):
                node.own += len(part.strip())
                node.own_commas += sum(map(part.count, COMMAS))
            else:
                node.chars += part.chars
                node.linked += part.linked
                node.commas += part.commas
        node.chars += node.own
        node.commas += node.own_commas
        if node.tag == "a":
            node.linked = node.chars


def blocks(top: Node) -> list[str]:
    """Texts of the blocks below a node, white space made single spaces; empty ones left out."""
    out, line = [], []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [top]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            line.append(part)
        elif not part.gone:
            if part.tag in BLOCKS:
                flush()
                todo.append(None)
            elif part.tag in ("br", "td", "th"):
                line.append(" ")
            todo.extend(reversed(part.parts))
    flush()
    return out


def _paragraphs(nodes: list[Node]) -> Iterator[Node]:
    """Elements that hold running text of their own."""
    hidden: set[int] = set()
    for node in nodes:
        if node.gone or node.parent is not None and id(node.parent) in hidden:
            hidden.add(id(node))
        elif node.tag in RUNNING or node.tag in CONTAINERS and node.own >= PARAGRAPH:
            yield node


def _points(node: Node) -> float:
    """Points of a paragraph for its length and commas; of a container, for the text directly in it."""
    chars, commas = (node.chars, node.commas) if node.tag in RUNNING else (node.own, node.own_commas)
    return 1 + commas + min(chars / 100, 3)


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 1.0


def _whole(best: Node) -> Node:
    """The article or main element around the best container; without one, the container that holds all of it.

    A list, a quotation or a table is part of a container; and a container that adds a fifth and more to the points
    of its best part holds other parts of the article.
    """
    node = best
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    if node is not None:
        return node
    while best.parent is not None and best.tag not in CONTAINERS:
        best = best.parent
    while best.parent is not None and best.parent.tag in ("div", "section") and best.parent.score - best.score / 2 >= 0.2 * best.score:
        best = best.parent
    return best


def _settle(nodes: list[Node]) -> None:
    """Cuts off the parts in doubt, but those that hold most of the points of what is around them.

    Around a part is the page, or the last part that was kept so. Readers' remarks stay only where there are no
    others, and in a page without points a form that holds most of the text stays.
    """
    for p in _paragraphs(nodes):
        if p.chars >= PARAGRAPH:
            p.points = _points(p) * (1 - _density(p))
    for node in reversed(nodes[1:]):
        node.parent.points += node.points
    root = nodes[0]
    root.base = root.points
    for node in nodes[1:]:
        node.base = node.parent.base
        if node.doubt == LISTED and node.chars and _density(node) < 0.1:
            continue                    # running text, no list of links
        if node.doubt:
            most = 2 * node.points > node.base if node.doubt != REMARK else 0 < node.points >= 0.999 * node.base
            if most or not root.points and node.tag in FORMS and 2 * node.chars > root.chars:
                node.base = node.points
            else:
                node.gone = True


def main_blocks(html: str) -> list[str]:
    """Blocks of the main text of a page, in page order."""
    tree = Tree(html)
    nodes = tree.nodes
    _measure(nodes)
    if any(node.doubt for node in nodes):
        _settle(nodes)
        _measure(nodes)
    scored: dict[int, Node] = {}
    for p in _paragraphs(nodes):
        if p.chars < PARAGRAPH:
            continue
        points = _points(p) * (1 - _density(p))
        node = p if p.tag in CONTAINERS and any(not isinstance(x, str) and x.tag in BLOCKS for x in p.parts) else p.parent
        for level in range(LEVELS):
            if node is None:
                break
            node.score += points / (1, 2, 6, 9, 12)[level]
            scored[id(node)] = node
            node = node.parent
    best = max(scored.values(), key=lambda n: n.score * (1 - _density(n)), default=None)
    if best is None or best.score <= 0:
        best = next((n for n in nodes if n.tag in ("article", "main") and n.chars and not n.gone), tree.root)
        return blocks(best)
    best = _whole(best)
    if best.parent is None:
        return blocks(best)
    least = max(10.0, 0.2 * best.score * (1 - _density(best)))
    parts = [p for p in best.parent.parts if not isinstance(p, str) and not p.gone]
    alike = [k for k, p in enumerate(parts) if p is best or p.tag == "p" and _density(p) < 0.25 and p.chars > 80 or p.score * (1 - _density(p)) >= least]
    kept = set(alike)
    out: list[str] = []
    for k in range(alike[0], alike[-1] + 1):        # what stands between kept parts belongs to them, but lists of links
        if k in kept or _density(parts[k]) < 0.5:
            out += blocks(parts[k])
    return out


def main_text(html: str | None) -> str:
    return "\n".join(main_blocks(html or ""))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points of each page.

    One row for each row of ``pages``, repeated and null ids and urls too; null and empty html give an empty text;
    no rows give no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            texts = [main_text(html) for html in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(col("page_id").cast("long").alias("page_id"), col("url").cast("string").alias("url"), F.coalesce(col("html"), F.lit("")).alias("html"))
    return plain.mapInArrow(run, PAGES)

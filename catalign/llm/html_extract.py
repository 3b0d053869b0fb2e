"""Main text of web pages by consensus of hosts.

Each page is read once to score its containers: text of content, without what is in
boilerplate elements and half of what is in links. From the deepest container with most
of a page's content it climbs to the nearest article or main around it; where there is
none, to the lowest container that holds all text outside boilerplate. That is the
page's vote, written as a path of tags and generalised classes (digits, which number
posts, become ``#``). Spark counts the votes of each host; the
path with most wins, ties go to the one with more characters, then to the greater
path. Pages are then read again and the text is taken from the container on the
winning path, from all of them in page order if several stand on it; a page that has none, or whose host has fewer than ``min_pages``
pages, keeps its own best container.

What is left out inside the container: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments, told by tag, role, or words of
class and id. Blocks end at block-level tags; inline tags do not part words.

Edge cases: null or empty html gives the empty text, as does a page without text.
Markup that is not closed is closed where its parent ends; a ``<`` that starts no tag is
text. A null URL has no host: such a page stands for itself.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import attach_groups
from .urls import split_url

MIN_PAGES = 3
#: Share of a page's content that a container must hold to be deeper than its parent.
MOST = 0.8

#: Tags by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg math object select".split())
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
thead tr ul""".split())
CONTAINERS = set("body main article section div td center".split())
DROPPED = RAW | set("head nav footer aside form button dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words in class or id that mark boilerplate.
MARKS = set("""nav navbar navigation menu menubar submenu topbar toolbar sidebar masthead footer breadcrumb breadcrumbs pagination pager
ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice
notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond
replies share sharing social related recommended recommendations widget widgets search skip""".split())
#: Tags that close an open one of the same group, up to the given parents.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table div article section main body td th blockquote aside nav header footer form".split())

#: No part of it is tried twice, and only text in front of the last ``>`` is searched, so a page takes time in proportion.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>"
    r"|<(/?)([A-Za-z][^\s/<>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/<>]*+)([^>]*+)>", re.S)
#: Parts of a class that say what a layout has or lacks.
FLAG = re.compile(r"(?:has|have|no|not|with|without|is|non)-.*|.*-free")
#: An element with a marked class or a form stays if it has the page's longest article, with so much of all text, or on a
#: page without articles so much of all text.
HELD_SHARE, ARTICLE_SHARE = 0.5, 0.2
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "step", "parent", "children", "dropped", "marked")

    def __init__(self, tag: str, step: str, parent: Node | None, dropped: bool, marked: bool = False):
        self.tag, self.step, self.parent, self.dropped, self.marked = tag, step, parent, dropped, marked
        self.children: list = []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _is_boilerplate(tag: str, at: dict[str, str], parent: Node) -> bool:
    """Whether the element's tag, role or style rules it out."""
    if (tag in DROPPED and tag != "form") or at.get("role", "").lower() in ROLES or at.get("aria-hidden") == "true":
        return True
    if "display:none" in at.get("style", "").replace(" ", "").lower():
        return True
    if tag == "header":  # The head of a page; that of an article has its title.
        node = parent
        while node and node.tag not in ("article", "main"):
            node = node.parent
        return node is None
    return False


def _is_marked(tag: str, at: dict[str, str]) -> bool:
    """Whether its class or id speaks against an element; that is decided by its text."""
    if tag == "form":
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    names = [n for n in (at.get("class", "") + " " + at.get("id", "")).split() if not FLAG.fullmatch(n.lower())]
    if tag == "p":  # A paragraph is judged by whole names.
        return any(n.lower() in MARKS for n in names)
    return any(w.lower() in MARKS for n in names for w in WORD.findall(n))


def _judge_marked(root: Node) -> None:
    """Drop marked elements, but for those that hold much of the page's text or an article that does."""
    size, article = {}, {}
    stack = [(root, False)]
    order = []
    while stack:
        node, ends = stack.pop()
        if ends:
            order.append(node)
            held = most = 0
            for c in node.children:
                if isinstance(c, str):
                    held += len(c.strip())
                elif not c.dropped:
                    held += size[id(c)]
                    most = max(most, article[id(c)])
            size[id(node)] = held
            article[id(node)] = max(most, held) if node.tag in ("article", "main") else most
        else:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children if isinstance(c, Node) and not c.dropped)
    whole, longest = size[id(root)], article[id(root)]
    for node in order:
        # On a page with an article only the element around it can be the page; on others one with most of its text.
        held = article[id(node)] >= max(ARTICLE_SHARE * whole, longest) if longest else size[id(node)] >= HELD_SHARE * whole
        if node.marked and not held:
            node.dropped = True


def parse(text: str) -> Node:
    """Tree of elements with their texts; boilerplate is marked."""
    root = node = Node("", "", None, False)
    at, limit = 0, text.rfind(">") + 1
    is_open: Counter[str] = Counter()  # so that no tag is looked for in vain

    def close(upto: Node) -> Node:
        inner = node
        while inner is not upto:
            is_open[inner.tag] -= 1
            inner = inner.parent
        is_open[upto.tag] -= 1
        return upto.parent

    while at < limit:
        m = TOKEN.search(text, at, limit)
        if m is None:
            break
        if m.start() > at:
            node.children.append(text[at:m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = len(text)  # a comment without end
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if is_open[tag]:
                opened = node
                while opened.tag != tag:
                    opened = opened.parent
                node = close(opened)
            continue
        raw = m[3] or m[6] or ""
        if tag in RAW:
            end = re.compile(r"</" + re.escape(tag) + r"\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            if tag not in ("svg", "math"):
                node.children.append(Node(tag, tag, node, True))
            continue
        if tag in CLOSES or tag in BLOCKS:
            closes = CLOSES.get(tag, {"p"})
            if any(is_open[c] for c in closes):
                opened = node
                while opened and opened.tag not in closes and opened.tag not in SCOPES:
                    opened = opened.parent
                if opened and opened.tag in closes:
                    node = close(opened)
        attributes = _attributes(raw)
        step = tag + "".join("." + DIGITS.sub("#", c) for c in sorted(set(attributes.get("class", "").split())))
        new = Node(tag, step, node, node.dropped or _is_boilerplate(tag, attributes, node), _is_marked(tag, attributes))
        node.children.append(new)
        if tag not in VOID and not raw.endswith("/"):
            node = new
            is_open[tag] += 1
    if at < len(text):
        node.children.append(text[at:])
    _judge_marked(root)
    return root


def _walk(root: Node):
    """(node, is_end) and texts in page order, without boilerplate."""
    stack = [(root, False)]
    while stack:
        item, ends = stack.pop()
        yield item, ends
        if isinstance(item, Node) and not ends:
            stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children) if not (isinstance(c, Node) and c.dropped))


def path_of(node: Node) -> str:
    steps = []
    while node is not None and node.tag:
        if node.tag in BLOCKS:
            steps.append(node.step)
        node = node.parent
    return ">".join(reversed(steps))


def _scores(root: Node) -> dict[int, tuple[Node, float, int]]:
    """Content of each container and of the root, by node, and its characters where links count in full."""
    out, open_sums = {}, [(0.0, 0)]
    for item, ends in _walk(root):
        if isinstance(item, str):
            n = len(item.strip())
            open_sums[-1] = (open_sums[-1][0] + n, open_sums[-1][1] + n)
        elif not ends:
            open_sums.append((0.0, 0))
        else:
            held, full = open_sums.pop()
            held *= 0.5 if item.tag == "a" else 1
            open_sums[-1] = (open_sums[-1][0] + held, open_sums[-1][1] + full)
            if item.tag in CONTAINERS or item is root:
                out[id(item)] = (item, held, full)
    return out


def best_containers(root: Node, path: str | None = None) -> list[Node]:
    """All containers with content on ``path``, in page order; without one the page's own best container.

    That is the nearest article or main around the deepest container with most of the page's content, or else the
    lowest container that holds all of it.
    """
    scores = list(_scores(root).values())
    if path:
        on_path = {id(node) for node, s, _ in scores if s > 0 and path_of(node) == path}
        if on_path:
            return [node for node, ends in _walk(root) if not ends and id(node) in on_path]
    top = max(s for _, s, _ in scores)
    if top <= 0:
        return []
    # Containers end in order from the deepest outwards: the first that holds most is the deepest.
    best = next(n for n, (_, s, _) in enumerate(scores) if s >= MOST * top)
    node = scores[best][0]
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    if node is not None:
        return [node]
    # From the deepest outwards the first that holds all; one beside it cannot. The root comes last.
    whole = next(node for node, _, full in scores[best:] if full == scores[-1][2])
    return [whole]


def text_of_nodes(nodes: list[Node]) -> str:
    blocks, held = [], []

    def close():
        joined = " ".join(html.unescape("".join(held)).split())
        if joined:
            blocks.append(joined)
        held.clear()

    for node in nodes:
        for item, _ in _walk(node):
            if isinstance(item, str):
                held.append(item)
            elif item.tag in BLOCKS:
                close()
            elif item.tag == "br":
                held.append(" ")
        close()
    return "\n".join(blocks)


def vote(page: str | None) -> tuple[str | None, int]:
    """Path and content of a page's own best container."""
    root = parse(page or "")
    best = best_containers(root)
    return (path_of(best[0]), int(_scores(root)[id(best[0])][1])) if best else (None, 0)


def extract(page: str | None, path: str | None = None) -> str:
    """Main text of a page, from the containers on ``path`` if it has any."""
    if not page:
        return ""
    root = parse(page)
    return text_of_nodes(best_containers(root, path) or [root])


def winning_paths(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, path, pages) of hosts with enough pages, from (host, html)."""
    def run(batches):
        for batch in batches:
            votes = [vote(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([p for p, _ in votes], pa.string()), pa.array([n for _, n in votes], pa.int64())],
                names=["host", "path", "chars"])

    voted = pages.select("host", "html").mapInArrow(run, "host string, path string, chars long")
    counted = voted.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    return counted.groupBy("host").agg(
        F.max_by("path", F.when(F.col("path").isNotNull(), F.struct("votes", "chars", "path"))).alias("path"),
        F.sum("votes").alias("pages")).filter((F.col("pages") >= min_pages) & (F.col("host") != ""))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    host, _ = split_url(pages[url_col].cast("string"))
    read = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"), host.alias("host"))
    winners = cut(winning_paths(read, min_pages))
    total = read.select("page_id").count()
    joined = attach_groups(read, winners, "host", "pages", total).select("page_id", "url", "path", "html")

    def run(batches):
        for batch in batches:
            texts = [extract(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")

"""Main text of web pages by consensus of container paths within a host.

Each page is parsed into a small tree and its containers are scored: a block of running text counts for
its parent, half for its grandparent, less for the share of it that stands in links; tags and class
words that mean articles add, boxes of menus, adverts, comments and the like are left out unless they
hold the article or most of the text. A page then votes for the generalised path (tags and classes from the root, digits levelled) of its best
container, widened to the whole article around it. Votes are added up for each host in Spark, and every page of the host is extracted again
from the elements on the winning path, or from its own best container where it has none.
"""

from __future__ import annotations

import functools
import html
import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm.common import cut, fields, free_name, table, tidied, written

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("article main section div body td".split())
#: Elements that never hold the article's text.
DROPPED = set("head script style noscript template button select option input textarea iframe svg canvas object audio video title".split())
#: Elements that are boilerplate unless they hold the page's article or main element.
ASIDE = set("nav footer aside menu dialog header".split())
#: Elements that may be a small box or wrap the whole page; their content decides.
FORMS = set("form fieldset".split())
#: Words of class, id and role that mark boilerplate, and those that mark the article. Fixed values.
NEGATIVE = set(
    "ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search comment comments disqus discussion replies reply respond related recommended recommendations share sharing social widget pagination pager skip hidden legal disclaimer copyright tags byline-links outbrain taboola paywall form".split()
)
HEADERS = set("header head top site-header page-header banner".split())
#: Unlinked characters from which a box is judged by its text, as a paragraph would be.
PARAGRAPH = 250
POSITIVE = set("article content entry main post story text body page blog prose".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
#: Start tags that close an open element of their like: tag -> (closed tags, tags that shield them).
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SHIELD = set("table td th button body html article section main".split())


class Node:
    __slots__ = ("tag", "parent", "children", "step", "hidden", "score", "label", "tokens", "mass", "linked", "flat", "anchor")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.parent, self.children, self.score = tag, parent, [], 0.0
        self.step = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()})])
        label = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".lower()
        self.tokens = set(label.split())
        self.label = self.tokens | set(re.split(r"[\s_-]+", label)) if label.strip() else set()
        self.mass = self.linked = 0  # characters outside and inside of links
        self.flat, self.anchor = True, False  # no container or title below; holds the article
        self.hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")


    def path(self) -> str:
        """The steps from the root."""
        return "/".join([n.step for n in _above(self)][::-1] + [self.step])


def attributes(text: str) -> dict[str, str]:
    out = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}
    if re.search(r"(?:^|\s)hidden(?:\s|$|/)", text):
        out["hidden"] = ""
    return out


def parse(page: str) -> Node:
    """A tree of Nodes and strings; never fails, whatever the input."""
    root = Node("#root", {}, None)
    stack, at, end = [root], 0, len(page)
    open_tags: Counter[str] = Counter()

    def close(depth: int) -> None:
        open_tags.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    last = page.rfind(">")
    while at < end:
        start = page.find("<", at)
        if start < 0 or start > last:
            stack[-1].children.append(page[at:])
            break
        if start > at:
            stack[-1].children.append(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1
            continue
        m = _TAG.match(page, start) or _LOOSE.match(page, start)
        if not m:
            stack[-1].children.append("<")
            at = start + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if open_tags[tag] > 0:
                # an end tag of an inline element does not close blocks that stand in it
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        break
                    if tag not in BLOCK and stack[depth].tag in BLOCK:
                        break
            continue
        if tag in BLOCK and tag not in ("html", "body") and open_tags["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in _SHIELD:
                    break
        if tag in _CLOSES and any(open_tags[t] > 0 for t in _CLOSES[tag][0]):
            closed, shields = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shields:
                    break
                if stack[i].tag in closed:
                    close(i)
                    break
        if tag == "body" and stack[-1].tag == "head":
            close(len(stack) - 1)
        node = Node(tag, attributes(m[3]) if m[3].strip(" /\n\t\r") else {}, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            found = _raw_end(tag).search(page, at)
            stop = found.start() if found else end
            if tag == "textarea" or tag == "title":
                node.children.append(page[at:stop])
            at = page.find(">", stop) + 1 if found and stop <= last else end
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            stack.append(node)
            open_tags[tag] += 1
    return root


@functools.cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(f"</{re.escape(tag)}[\\s/>]", re.I)


def _named(node: Node) -> bool:
    """Whether a whole word of class, id or role says boilerplate and none says article, or the tag does."""
    if node.tag in ("html", "body", "article", "main"):
        return False
    words = node.tokens - {"form"} if node.tag == "form" else node.tokens
    return node.tag in ASIDE or bool(words & (NEGATIVE | HEADERS)) and not node.label & POSITIVE


def measure(root: Node) -> None:
    """Sets mass, linked, flat and anchor of all elements. Text of elements named as boilerplate counts for them
    alone. Anchors are the article and main elements outside of such elements, or else the largest one in them."""
    order: list[tuple[Node, bool, bool]] = []
    work = [(root, False, False)]
    while work:
        node, link, named = work.pop()
        if node is not root and (node.tag in DROPPED or node.hidden):
            continue
        link, named = link or node.tag == "a", named or _named(node)
        order.append((node, link, named))
        work.extend((c, link, named) for c in node.children if isinstance(c, Node))
    for node, link, _ in reversed(order):
        length = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if link:
            node.linked += length
        else:
            node.mass += length
        if node.parent:
            node.parent.flat &= node.flat and node.tag not in CONTAINERS and node.tag not in ("h1", "h2")
            if not _named(node):
                node.parent.mass += node.mass
                node.parent.linked += node.linked
    articles = [(n, named) for n, _, named in order if n.tag in ("article", "main") and n.mass]
    outside = [n for n, named in articles if not named and not n.label & NEGATIVE]
    for n in outside or [max((n for n, _ in articles), key=lambda n: n.mass)] if articles else []:
        while n and not n.anchor:
            n.anchor, n = True, n.parent


def boilerplate(node: Node, top: Node, inside: bool) -> bool:
    """Whether an element below ``top`` is dropped; ``inside``: below the chosen container.

    What holds the article stays. Elements named as boilerplate by a whole word stay only where there is next to no
    other text. Forms, and elements with a part of a name, stay where they hold most of the text or, as wrappers
    of other elements, a paragraph of text that does not stand in links.
    """
    if node.tag in DROPPED or node.hidden:
        return True
    if node.anchor or node.tag in ("html", "body", "article", "main"):
        return False
    if node.tag == "header" or node.label & HEADERS:
        # a heading of the article itself may stand in a header of its own
        if inside and (any(isinstance(c, Node) and c.tag in ("h1", "h2") for c in node.children) or _within(node) and _titled(node)):
            return False
    elif node.tag not in ASIDE | FORMS and not node.label & NEGATIVE:
        return False
    if node.tag in ASIDE:
        return True
    if _named(node) or node.flat and node.tag not in FORMS:
        return node.mass < PARAGRAPH or 10 * (top.mass - (0 if _named(node) else node.mass)) > node.mass
    return 2 * node.mass <= top.mass and (node.flat or node.mass < PARAGRAPH or node.mass < node.linked)


def _within(node: Node) -> bool:
    return any(n.tag in ("article", "main") for n in _above(node))


def _titled(node: Node) -> bool:
    work = [node]
    while work:
        n = work.pop()
        if n.tag in ("h1", "h2"):
            return True
        work.extend(c for c in n.children if isinstance(c, Node))
    return False


def blocks(top: Node) -> Iterator[str]:
    """The text blocks under ``top`` in page order: references decoded, white space levelled, empty ones left out."""
    parts: list[str] = []
    work: list[tuple[object, int]] = [(top, 0)]

    def text() -> str:
        joined = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        return joined

    while work:
        item, closing = work.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        if closing or item.tag in BLOCK:
            if found := text():
                yield found
        if closing:
            continue
        if item is not top and boilerplate(item, top, True):
            continue
        if item.tag in ("br", "wbr", "img"):
            parts.append(" " if item.tag == "br" else "")
            continue
        if item.tag in BLOCK:
            work.append((item, 1))
        work.extend((c, 0) for c in reversed(item.children))
    if found := text():
        yield found


def score(root: Node) -> list[Node]:
    """The containers outside boilerplate, their scores set."""
    measure(root)
    found: list[Node] = []
    work: list[tuple[Node, bool]] = [(root, False)]
    while work:
        node, link = work.pop()
        if node is not root and boilerplate(node, root, False):
            continue
        if node.tag in CONTAINERS:
            found.append(node)
            node.score += 30 * (node.tag in ("article", "main")) + 15 * bool(node.label & POSITIVE)
        length = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if length:
            weight = length * (0.1 if link or node.tag == "a" else 1.0)
            up = node
            while up.parent and up.tag not in BLOCK:
                up = up.parent
            if up.tag in CONTAINERS:
                up.score += weight
                if up.parent:
                    up.parent.score += weight / 2
            elif up.parent:
                up.parent.score += weight
                if up.parent.parent:
                    up.parent.parent.score += weight / 2
        work.extend((c, link or node.tag == "a") for c in reversed(node.children) if isinstance(c, Node))
    return found


def widened(node: Node, root: Node) -> Node:
    """The whole article around the best container: the article or main element that holds it, or without one the
    highest container in reach that adds text outside of links and of boilerplate. Other boxes directly in the body
    are not the article's; headings, paragraphs and text there are."""
    above = [node, *_above(node)]
    for tag in ("article", "main"):
        for n in above:
            if n.tag == tag:
                return n
    top = node
    for below, n in zip(above, above[1:], strict=False):
        if n is root or n.tag == "html":
            break
        added = linked = 0
        for c in n.children:
            if isinstance(c, str):
                added += len(c.strip())
            elif c is not below and not boilerplate(c, n, True) and (n.tag != "body" or c.tag not in CONTAINERS):
                added, linked = added + c.mass, linked + c.linked
        if n.tag in CONTAINERS and added > linked:
            top = n
    return top


def best_path(page: str | None) -> str | None:
    """The generalised path of a page's best container; null without text."""
    root = parse(page or "")
    found = [n for n in score(root) if n.score > 45]
    return widened(max(found, key=lambda n: n.score), root).path() if found else None  # of equals the first met


def extract(page: str | None, path: str | None) -> str:
    """The text of a page's elements on ``path``, or of its own best container."""
    root = parse(page or "")
    found = score(root)
    step = path.rpartition("/")[2] if path else None
    on = [n for n in found if n.step == step and n.path() == path]  # elements on one path never hold each other
    text = "\n".join(b for n in on for b in blocks(n))
    if text:
        return text
    rich = [n for n in found if n.score > 0]
    top = widened(max(rich, key=lambda n: n.score), root) if rich else root
    return "\n".join(blocks(top))


def _above(node: Node) -> Iterator[Node]:
    while node.parent:
        node = node.parent
        yield node


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].translate(_LOWER) if m else ""


def _votes(pages: DataFrame) -> DataFrame:
    schema = fields("host string", "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, 1):
                rows = [(host(u), best_path(h)) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=schema.names)

    return pages.select("url", "html").mapInArrow(tidied(run), schema)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes): the path that most pages of a host vote for; equal votes go to the path that sorts first.

    Votes are counted for each (host, path) on the map side first, so a hot host costs as many rows as it has paths.
    """
    counted = _votes(pages).where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))
    top = counted.groupBy("host").agg(F.min(F.struct(-F.col("votes"), "path")).alias("top"))
    return top.select("host", F.col("top.path").alias("path"), (-F.col("top.col1")).alias("votes"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` and the main text of each whole page.

    Null or empty html, and pages without text, give the empty string; a null or odd url counts as the
    host "". Repeated rows repeat. A column named ``out_col`` is replaced (unless it is the html or url
    column, which is an error), all others pass through, whatever their names.
    """
    if out_col.lower() in (url_col.lower(), html_col.lower()):
        raise ValueError(f"output column {out_col} is an input column")
    winners = written(host_paths(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))), "host_paths")
    key, path, other = (free_name(pages, n) for n in ("_host", "_path_of_host", "_host_of_path"))
    hosts = pages.drop(out_col).withColumn(key, _host_column(F.col(url_col)))
    joined = hosts.join(winners.select(F.col("host").alias(other), F.col("path").alias(path)), F.col(key) == F.col(other), "left").drop(other, key)
    kept = [f for f in joined.schema.fields if f.name != path]
    at = {f.name: i for i, f in enumerate(joined.schema.fields)}
    schema = T.StructType([*kept, T.StructField(out_col, T.StringType())])
    page = next(i for n, i in at.items() if n.lower() == html_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, page):
                texts = [extract(h, p) for h, p in zip(batch.column(page).to_pylist(), batch.column(at[path]).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(at[f.name]) for f in kept), pa.array(texts, pa.string())], names=schema.names)

    return joined.mapInArrow(tidied(run), schema)


def _host_column(url: F.Column) -> F.Column:
    """``host`` of a url column; lower case for A-Z only, as there."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _HOST.pattern, 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

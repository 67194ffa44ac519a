"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text in one pass. A linear classifier over a block's place in the document, the names
around it, its links and its length gives the cost of calling it boilerplate or content; these costs are the capacities to the two terminals. Blocks that
follow each other, or share a parent, are joined by edges whose capacities rise with their proximity in the document.
The minimum cut is the labelling of least total cost: it keeps a short paragraph among long ones and drops a long line
in a menu.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rillway.llm.staging import whole_texts

#: A name in a tag with what stands around it, an equals sign that may follow, and a value without quotes.
_NAME = re.compile(r"[\s/]*([^\s=>/]*)\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements that begin and end blocks.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page, the first few up to their end tag whatever lies between.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
SILENT = frozenset("head select button svg math object canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes if it is open, with all that is open inside it.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What such a search doesn't go beyond.
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: What the end tag of an inline element doesn't go beyond.
WALLS = ("article", "main", "body", "table", "td", "th")

OUTSIDE = frozenset("nav aside footer form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words in class and id that speak against content, in the languages of the web's templates; those that speak for it; and those that say nothing.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager related recommended recommendations footer masthead topbar toolbar copyright comment comments commentlist disqus reply replies respond skip outbrain taboola werbung anzeige kommentare kommentar fusszeile seitenleiste publicite pub commentaires commentaire partager publicidad anuncio comentarios comentario compartir".split()
)
REMARKS = frozenset("comment comments commentlist disqus reply replies respond kommentare commentaires comentarios".split())
FOR = frozenset("article content entry post story text main body artikel inhalt contenu contenido texto articulo".split())
PLAIN = frozenset("list item items box block section area wrapper wrap container bar link links button buttons btn left right top bottom inner outer widget widgets row col column panel unit slot group thread form field the a of".split())

# Weights of the classifier, in sixteenths, so that capacities are whole numbers. Names in class and id add up: one made
# of words against content alone, and of plain ones, weighs W_NAMED; one that has other words too W_HINTED.
W_BASE, W_OUTSIDE, W_NAMED, W_HINTED, W_ARTICLE, W_FOR, W_LINKS, W_SHORT, W_LONG, W_SENTENCE, W_HEADING = -4, -180, -150, -20, 56, 24, -72, -12, 32, 12, 8
#: Edge capacities: blocks of the same parent, of the same grandparent, others that follow each other; and the last block of the same parent further back.
E_SAME, E_NEAR, E_NEXT, E_KIN = 20, 10, 3, 6


def named(value: str) -> tuple[int, bool, bool]:
    """What a class or id says against content, whether it names remarks and whether it speaks for content."""
    worst, remarks, liked = 0, False, False
    for name in value.split():
        parts = [x.lower() for x in _PART.findall(name)]
        against = [x for x in parts if x in AGAINST]
        liked |= any(x in FOR for x in parts)
        if against:
            pure = all(x in AGAINST or x in PLAIN or x.isdigit() for x in parts)
            worst = min(worst, W_NAMED if pure else W_HINTED)
            remarks |= pure and any(x in REMARKS for x in parts)
    return worst, remarks, liked


class _Open:
    """An open element. against: the worst that it, or one around it, says against being content."""

    __slots__ = ("tag", "number", "parent", "block", "against", "article", "liked", "link", "silent")

    def __init__(self, tag: str, number: int, parent: "_Open | None", attributes: dict[str, str]):
        self.tag, self.number, self.parent = tag, number, parent
        self.against, self.article, self.liked, self.link, self.silent = (0, False, False, False, False) if parent is None else (parent.against, parent.article, parent.liked, parent.link, parent.silent)
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.link |= tag == "a"
        self.silent |= tag in SILENT
        worst, remarks, liked = named(f"{attributes.get('class', '')} {attributes.get('id', '')}") if attributes else (0, False, False)
        if attributes:
            role = attributes.get("role", "").lower()
            if role in ROLES:
                self.against = min(self.against, W_OUTSIDE)
            self.article |= role in ("main", "article")
            if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
                self.silent = True
        if tag in ("article", "main"):
            if remarks:
                self.against = min(self.against, W_OUTSIDE)
            self.article = True
        elif tag in BLOCKS and tag not in ("html", "body"):
            if tag in OUTSIDE or tag == "header" and not self.article:
                worst = min(worst, W_OUTSIDE)
            elif not self.article and not liked and "header" in attributes.get("class", "").lower():
                worst = min(worst, W_NAMED)
            self.against = min(self.against, worst)
            self.liked |= liked


class Block:
    __slots__ = ("text", "place", "linked", "words")

    def __init__(self, text: str, place: _Open, linked: float):
        self.text, self.place, self.linked = text, place, linked
        self.words = text.count(" ") + 1


def tags(page: str) -> Iterator[tuple[int, int, str, bool, dict[str, str]]]:
    """Of each tag where it begins and ends, its name in lower case, whether it ends an element, and its attributes; comments have the name "".

    One pass: a quote is looked for once, and one that is never closed, or whose value holds what follows its own tag, ends at the next ">".
    """
    at, size = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    no_more = page.rfind(">")
    while (begin := page.find("<", at)) >= 0:
        sign = page[begin + 1 : begin + 2]
        if sign == "!" or sign == "?":
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                at = end + 3 if end >= 0 else size
            elif page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin)
                at = end + 3 if end >= 0 else size
            else:
                at = page.find(">", begin) + 1 or size
            yield begin, at, "", False, {}
            continue
        ends = sign == "/"
        name = _TAG_NAME.match(page, begin + 1 + ends)
        if not name:
            at = begin + 1
            continue
        i, attributes = name.end(), {}
        while i < size and page[i] != ">":
            if i > no_more:
                i = size
                break
            m = _NAME.match(page, i)
            i, value = m.end(), ""
            if m[2]:
                sign = page[i : i + 1]
                if sign in last and sign:
                    close = page.find(sign, i + 1) if last[sign] > i else -1
                    stop = page.find(">", i, close if close >= 0 else size)
                    if close < 0 or stop >= 0 and page.find("<", i, stop) < 0 <= page.find("<", stop, close):
                        value, i = page[i + 1 : stop], stop if stop >= 0 else size
                    else:
                        value, i = page[i + 1 : close], close + 1
                else:
                    m2 = _BARE.match(page, i)
                    value, i = m2[0], m2.end()
            if m[1] and not ends:
                attributes.setdefault(m[1].lower(), value)
            elif m.end() == m.start():
                i += 1
        at = min(i + 1, size)
        yield begin, at, name[0].lower(), ends, attributes | ({"/": ""} if page[i - 1 : i] == "/" else {})


@lru_cache(None)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, with character references decoded and white space as single blanks."""
    out: list[Block] = []
    number = 0
    stack = [_Open("", 0, None, {})]
    places: dict[str, list[int]] = {}  # of each tag, where in the stack it is open
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            raw = "".join(x for x, _ in parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                total = sum(len(x) for x, _ in parts)
                out.append(Block(text, stack[-1].block, sum(len(x) for x, link in parts if link) / total))
            parts.clear()

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def nearest(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    at, skip = 0, 0
    for begin, end, name, ends, attributes in tags(page):
        if begin < skip:
            continue
        top = stack[-1]
        if begin > at and not top.silent:
            parts.append((page[at:begin], top.link))
        at = end
        if not name:
            if page.startswith("<![CDATA[", begin) and not top.silent:
                parts.append((page[begin + 9 : end - 3], top.link))
            continue
        if ends:
            if name in BLOCKS:
                flush()
            k = nearest((name,))
            if k and (name in BLOCKS or k > nearest(WALLS)):
                close(k)
            continue
        if name == "br":
            if not top.silent:
                parts.append((" ", top.link))
            continue
        if name in BLOCKS:
            flush()
            if stack[-1].block.tag == "p":  # an open paragraph ends where a block begins
                close(places["p"][-1])
        if name in CLOSES:
            bound = nearest(BOUNDS.get(name, WALLS))
            inside = [p[k] for x in CLOSES[name] if (p := places.get(x)) and (k := bisect_right(p, bound)) < len(p)]
            if inside:
                close(min(inside))
        if name in RAW:
            stop = _raw_end(name).search(page, end)
            skip = at = stop.end() if stop else len(page)
            continue
        if name in VOID or "/" in attributes and name not in BLOCKS:
            continue
        if name == "body":  # what lies in a head that was never closed has ended
            close(1)
        number += 1
        places.setdefault(name, []).append(len(stack))
        stack.append(_Open(name, number, stack[-1], attributes))
    if at < len(page) and not stack[-1].silent:
        parts.append((page[at:], stack[-1].link))
    flush()
    return out


def content_costs(found: list[Block]) -> list[int]:
    """The classifier's value of each block: above 0 it costs that much to call it boilerplate, below 0 to call it content."""
    has_article = any(b.place.article and not b.place.against for b in found)
    out = []
    for b in found:
        p = b.place
        value = W_BASE + p.against + int(W_LINKS * b.linked)
        value += W_ARTICLE if p.article else -W_ARTICLE if has_article else 0
        value += W_FOR if p.liked else 0
        value += W_SHORT if b.words < 4 else W_LONG if b.words >= 12 else 0
        value += W_SENTENCE if b.text[-1] in ".!?…:;\"'”»)" else 0
        value += W_HEADING if p.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 0
        out.append(value)
    return out


def proximity_edges(found: list[Block]) -> list[tuple[int, int, int]]:
    out = []
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        own, parent = b.place, b.place.parent
        if k:
            before = found[k - 1].place
            same = before is own or before.parent is parent
            near = parent is not None and before.parent is not None and (before.parent.parent is parent.parent or before is parent or before.parent is own)
            out.append((k - 1, k, E_SAME if same else E_NEAR if near else E_NEXT))
        key = parent.number if parent is not None else -1
        if last.get(key, k - 1) < k - 1:
            out.append((last[key], k, E_KIN))
        last[key] = k
    return out


def minimum_cut(value: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling of least cost: value[k] > 0 is the price of False for k, -value[k] > 0 that of True, an edge's capacity the price of different labels.

    Where a node's own value outweighs all its edges, its label is settled and its edges become values of its
    neighbours; what remains is settled by maximum flow. Of equal cuts the one with the fewest True is taken.
    """
    n = len(value)
    value = list(value)
    edge: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        edge[a][b] = edge[a].get(b, 0) + c
        edge[b][a] = edge[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        weight = sum(edge[k].values())
        if label[k] is None and (value[k] > weight or -value[k] >= weight):
            label[k] = value[k] > weight
            for j, c in edge[k].items():
                del edge[j][k]
                value[j] += c if label[k] else -c
                queue.append(j)
            edge[k] = {}
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        reached = _reached_from_source(rest, value, edge)
        for k in rest:
            label[k] = k in reached
    return [bool(x) for x in label]


def _reached_from_source(nodes: list[int], value: list[int], edge: list[dict[int, int]]) -> set[int]:
    """Dinic's maximum flow from the content terminal to the boilerplate terminal; the nodes on the source's side of the smallest cut."""
    source, sink = -1, -2
    left: dict[int, dict[int, int]] = {k: dict(edge[k]) for k in nodes}
    left[source], left[sink] = {}, {}
    for k in nodes:
        if value[k] > 0:
            left[source][k], left[k][source] = value[k], 0
        elif value[k] < 0:
            left[k][sink], left[sink][k] = -value[k], 0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            k = queue.popleft()
            for j, c in left[k].items():
                if c > 0 and j not in level:
                    level[j] = level[k] + 1
                    queue.append(j)
        if sink not in level:
            return {k for k in level if k >= 0}
        ways = {k: iter(list(left[k])) for k in level}
        path = [source]
        while path:
            k = path[-1]
            if k == sink:
                least = min(left[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    left[a][b] -= least
                    left[b][a] = left[b].get(a, 0) + least
                path = [source]
                ways[source] = iter(list(left[source])) if any(left[source][j] > 0 and level.get(j) == 1 for j in left[source]) else iter(())
                continue
            for j in ways[k]:
                if left[k][j] > 0 and level.get(j) == level[k] + 1:
                    path.append(j)
                    break
            else:
                path.pop()


def main_text(page: str | None) -> str:
    """The blocks that the cut calls content, one in a line; empty if there are none."""
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = minimum_cut(content_costs(found), proximity_edges(found))
    return "\n".join(b.text for b, good in zip(found, keep) if good)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """pages without the html, with the main text (empty for a null or empty page) and its length in code points.

    Rows that repeat are treated alike, other columns stay (those with the new columns' names are replaced), an empty
    table stays empty. The whole page is read, however long it is.
    """
    whole_texts(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_col, text_col, size_col)]
    chosen = pages.select(*others, html_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), f"`{text_col}` string", f"`{size_col}` long"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(others)).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*others, text_col, size_col])

    return chosen.mapInArrow(rows, schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; null, empty and repeated pages and empty tables as in extract."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))

"""Main text of web pages by composite text density.

A page becomes a tree. Menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts and styles are cut off by element, role or class. For every node left the
density is characters per tag, adjusted by links: long text in few tags with few link
characters is dense. The node whose children's densities sum highest is the core of the
article. The least density on the path from there to the body is the threshold: below the
body, each subtree at least as dense gives up its own highest-sum subtree, so an article
split over several containers stays whole. Elements that call themselves an article and are
no list of links are given out beside them; all parts come in page order.

Pages are parsed one by one in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Element kinds of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul video audio".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
# Nodes that can hold an article; paragraphs, headings and marked-up words are parts of one.
HOLDERS = frozenset("article main section div body td table tbody tr center blockquote dd dl ul ol figure details".split())
WALLS = frozenset("table ul ol dl select article section main div body html".split())
DROPPED = frozenset(
    "head nav header footer aside form button select input label fieldset script style noscript template textarea title iframe svg math "
    "object canvas dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MARKERS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header footer masthead sidebar aside ad ads advert adverts advertisement banner promo "
    "sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search comment comments "
    "respond disqus replies share sharing social related recommended widget toolbar pagination pager copyright disclaimer skip".split()
)
# What may stand beside a marker in a class name without changing its meaning: "site-header", "related-posts".
PLAIN = frozenset(
    "area articles bar block body bottom box btn button buttons card cards col container content count feed global group holder icon icons inner item items "
    "label left line link links list main more news outer page panel pane post posts primary reader readers right row secondary section site slot small stories "
    "story strip text thread title top unit user users wide wrap wrapper zone".split()
)
# A quote opens a value after "=" only; elsewhere it is a letter of a name.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Page:
    """Tree of a page: per node its tag, parent, parts (text or child number), whether it is cut off."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.parts, self.cut = ["html"], [-1], [[]], [False]
        self.soft = [False]  # cut by its class or id only
        self.body = 0
        open_nodes, at = [0], 0
        self.open: Counter[str] = Counter()
        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self.parts[open_nodes[-1]].append(source[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if self.open[name]:  # each node is passed once, since it is closed
                    k = len(open_nodes) - 1
                    while self.tag[open_nodes[k]] != name:
                        k -= 1
                    self._close(open_nodes, k)
                continue
            if name == "html":
                continue
            self._imply(open_nodes, name)
            if name == "body" and self.body:
                continue
            node = len(self.tag)
            hard, soft = self._boiler(name, m[3])
            self.tag.append(name)
            self.parent.append(open_nodes[-1])
            self.parts.append([])
            self.cut.append(hard)
            self.soft.append(soft)
            self.parts[open_nodes[-1]].append(node)
            if name == "body":
                self.body = node
            if name in RAW:
                end = re.compile(rf"</{name}\s*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif name not in VOID and not m[3].rstrip().endswith("/"):
                open_nodes.append(node)
                self.open[name] += 1
        if at < len(source):
            self.parts[open_nodes[-1]].append(source[at:])

    def _close(self, open_nodes: list[int], k: int) -> None:
        for node in open_nodes[k:]:
            self.open[self.tag[node]] -= 1
        del open_nodes[k:]

    def _imply(self, open_nodes: list[int], name: str) -> None:
        """Close what a start tag ends by itself."""
        ends = CLOSES.get(name, set()) | ({"p"} if name in BLOCK and name != "br" else set())
        if not any(self.open[tag] for tag in ends):
            return
        for k in range(len(open_nodes) - 1, 0, -1):
            tag = self.tag[open_nodes[k]]
            if tag in ends:
                self._close(open_nodes, k)
                return
            if tag in WALLS and tag not in ends:
                return

    @staticmethod
    def _boiler(name: str, attributes: str) -> tuple[bool, bool]:
        if name in DROPPED:
            return True, False
        if not attributes.strip() or name in ("body", "html", "main", "article"):
            return False, False
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
            return True, False
        if re.search(r"display\s*:\s*none", found.get("style", "")):
            return True, False
        for token in f"{found.get('class', '')} {found.get('id', '')}".split():
            names = {n.lower() for n in _NAME.findall(token)}
            # "share-buttons" marks furniture, "share-price" does not.
            if names & MARKERS and all(n in MARKERS or n in PLAIN or len(n) == 1 for n in names):
                return False, True
        return False, False


def _settle(page: Page) -> list[bool]:
    """Nodes that are cut off, with all below them. A class alone never cuts off what holds the article."""
    n = len(page.tag)
    holds = [t in ("article", "main", "h1") for t in page.tag]
    for k in range(n - 1, 0, -1):
        holds[page.parent[k]] |= holds[k]
    gone, inside = [False] * n, [False] * n
    for k in range(1, n):
        up = page.parent[k]
        inside[k] = inside[up] or page.tag[k] in ("article", "main")
        # The heading of the article itself is no page header.
        own = page.tag[k] == "header" and inside[up] and holds[k]
        gone[k] = gone[up] or (page.cut[k] and not own) or (page.soft[k] and not holds[k])
    return gone


def _densities(page: Page, gone: list[bool]) -> tuple[list[float], list[float], list[float]]:
    """Link-adjusted characters per tag of each node, the sum over its children, and the share of characters in links."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [1] * n, [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        if gone[k]:
            chars[k], tags[k] = 0, 0
            continue
        chars[k] += sum(len("".join(html.unescape(p).split())) for p in page.parts[k] if isinstance(p, str))
        if page.tag[k] == "a":
            link_chars[k], link_tags[k] = chars[k], link_tags[k] + 1
        if k:
            up = page.parent[k]
            chars[up] += chars[k]
            tags[up] += tags[k]
            link_chars[up] += link_chars[k]
            link_tags[up] += link_tags[k]
    body = page.body
    share = link_chars[body] / max(1, chars[body])
    density = [0.0] * n
    for k in range(n):
        if gone[k] or not chars[k]:
            continue
        plain = max(1, chars[k] - link_chars[k])
        base = math.log(math.log(chars[k] / plain * link_chars[k] + share * chars[k] + math.e))
        ratio = max(1.0, chars[k] / max(1, link_chars[k]) * tags[k] / max(1, link_tags[k]))
        density[k] = chars[k] / max(1, tags[k]) * math.log(ratio + 1) / max(base, 0.05)
    total = [0.0] * n
    leaf = [True] * n
    for k in range(1, n):
        total[page.parent[k]] += density[k]
        leaf[page.parent[k]] = leaf[page.parent[k]] and gone[k]
    return density, [density[k] if leaf[k] else total[k] for k in range(n)], [a / max(1, b) for a, b in zip(link_chars, chars)]


def _content(page: Page, gone: list[bool]) -> list[bool]:
    """Roots of the subtrees that are the article."""
    n, body = len(page.tag), page.body
    density, total, linked = _densities(page, gone)
    below = [False] * n
    below[body] = True
    for k in range(body + 1, n):
        below[k] = below[page.parent[k]] and not gone[k]
    best = [k if page.tag[k] in HOLDERS or k == body else -1 for k in range(n)]  # highest-sum node of each subtree
    for k in range(n - 1, body, -1):
        up, own = page.parent[k], best[k]
        if below[k] and own >= 0 and (best[up] < 0 or total[own] > total[best[up]]):
            best[up] = own
    path = [best[body]]
    while path[-1] != body:
        path.append(page.parent[path[-1]])
    threshold = min(density[k] for k in path)
    chosen = [False] * n
    inside = [False] * n
    for k in range(body, n):
        inside[k] = inside[k] or chosen[k] or (k > body and inside[page.parent[k]])
        if below[k] and not inside[k] and density[k] >= threshold > 0:
            core = best[k] if best[k] >= 0 else k
            chosen[core] = True
            inside[k] = core == k
    # Less dense parts of an article in several elements say what they are.
    for k in range(body + 1, n):
        chosen[k] = chosen[k] or (below[k] and page.tag[k] == "article" and linked[k] < 0.5)
    return chosen


def main_text(source: str | None) -> str:
    """Text of a page's article: blocks in page order, one blank between words."""
    if not source or not source.strip():
        return ""
    page = Page(source)
    gone = _settle(page)
    chosen = _content(page, gone)
    out: list[str] = []
    stack: list[tuple[object, bool]] = [(page.body, False)]
    while stack:
        part, inside = stack.pop()
        if isinstance(part, str):
            if inside:
                # Each piece for itself: a reference never reaches over a tag.
                out.append(html.unescape(part))
            continue
        if gone[part]:
            out.append(" ")
            continue
        inside = inside or chosen[part]
        edge = " " if page.tag[part] in BLOCK else ""
        out.append(edge)
        stack.append((edge, True))
        stack.extend((p, inside) for p in reversed(page.parts[part]))
    return " ".join("".join(out).split())


def extract(df: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` (main text) and ``n_chars`` (its code points).

    NULL, empty and text-free pages give an empty text. Broken markup is read as far as it
    goes: unclosed elements end with their parent. Repeated rows are each extracted; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pages = batch.columns
            texts = [main_text(p) for p in pages.to_pylist()]
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["row", "text", "n_chars"])

    wide = df.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(source).alias("source"))
    done = wide.mapInArrow(run, StructType([wide.schema["row"], StructField("text", StringType()), StructField("n_chars", LongType())]))
    return done.select(*[F.col("row")[c].alias(c) for c in keep], "text", "n_chars")

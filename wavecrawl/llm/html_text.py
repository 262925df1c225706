"""Main text of web pages by composite text density.

Each page is parsed into a tree (missing end tags are implied). Elements that never hold
article text (menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments; by element, role, or words in class and id) are left out. Every
other node has C characters and T tags, of them LC characters and LT tags in links, and the
composite density

    C/T * log(C/LC * T/LT, base = ln(C/(C-LC) * LC + LCbody/Cbody * C + e))

(0 counts as 1 below a fraction line). The node whose children's densities have the largest
sum is the core of the article. The least density on the path from ``body`` to it is the
threshold: neighbours of that path that reach it, within the enclosing ``article`` or
``main`` where there is one, belong to the article too.

Text of the chosen nodes: character references decoded, white space inside a block one
blank, blocks trimmed, empty ones left out, joined in page order by one newline. ``br`` is
white space. Null and empty pages, and pages without article text, give the empty text.
Trees are walked with loops, never recursion, so that nesting has no limit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, table

# Element names of HTML, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr br img".split()
)
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select textarea input fieldset label iframe object embed "
    "canvas svg math audio video dialog menu".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert sidebar sidebars aside menu menus nav navbar navigation topbar breadcrumb breadcrumbs footer footers masthead "
    "comment comments commentlist respond disqus replies share sharing social related recommended newsletter subscribe subscription "
    "popup modal overlay pagination pager toolbar widget widgets copyright login signup search form".split()
)
HEADERS = frozenset("header headers".split())
ARTICLE_WORDS = frozenset("article post entry story content body text".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
# An element of the first kind ends, where it starts, an open one of the second, up to the third.
CLOSES = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "thead": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
SCOPE = frozenset("table td th button object applet marquee".split())
_WORD = re.compile(r"[a-z0-9]+")
_ABOUT_OTHERS = re.compile(r"\b(?:has|no|with|without|hide)[-_][a-z0-9]+")  # tells of a node's surroundings, not of the node
LEFT_SHARE = 0.1  # text left by class words that is less of what they leave out is not the article
_KEEP, _BY_WORDS, _BY_ELEMENT = 0, 1, 2


class _Page(HTMLParser):
    """Flat tree: parallel lists by node, and the page's texts and block borders in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.drop, self.tags = ["#page"], [-1], [_KEEP], [0]
        self.comments = [False]  # nodes whose class tells of reader comments
        self.events: list[tuple[int, str | None]] = []  # None: a border between blocks
        self.open = [0]
        self.opened: Counter[str] = Counter()  # open elements by name
        self.body = 0

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            name = self.tag[self.open.pop()]
            self.opened[name] -= 1
            if name not in INLINE:
                self.events.append((self.open[-1], None))

    def _close(self, names, stop) -> None:
        if not any(self.opened[x] for x in names):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[depth]]
            if name in names:
                self._pop_to(depth)
                return
            if name in stop:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "html" or (tag == "body" and self.body):
            return
        if self.tag[self.open[-1]] == "head" and tag not in HEAD_ONLY:
            self._pop_to(len(self.open) - 1)
        if tag not in INLINE:
            self._close(("p",), SCOPE)
        if tag in CLOSES:
            names, stop = CLOSES[tag]
            # several levels may be open, as td in tr
            for _ in names:
                self._close(names, stop)
        top = self.open[-1]
        if tag in VOID:
            self.tags[top] += 1
            self.events.append((top, " " if tag in INLINE else None))
            return
        attrs = {k: v or "" for k, v in attrs}
        names = _ABOUT_OTHERS.sub(" ", (attrs.get("class", "") + " " + attrs.get("id", "")).lower())
        words = set(_WORD.findall(names))
        node = len(self.tag)
        inside = self.opened["article"] + self.opened["main"] > 0
        self.tag.append(tag)
        self.opened[tag] += 1
        self.parent.append(top)
        self.tags.append(0)
        self.drop.append(self._verdict(tag, attrs, words, inside))
        self.comments.append(bool(words & COMMENT_WORDS))
        self.open.append(node)
        if tag == "body":
            self.body = node
        if tag in ("article", "main") and not words & COMMENT_WORDS:
            for x in self.open:  # a frame around the article is no furniture, whatever its class says
                if self.drop[x] == _BY_WORDS:
                    self.drop[x] = _KEEP
        if tag not in INLINE:
            self.events.append((node, None))

    def _verdict(self, tag: str, attrs: dict, words: set, inside: bool) -> int:
        if tag in DROPPED or (tag == "header" and not inside) or "hidden" in attrs:
            return _BY_ELEMENT
        if tag in ("body", "main", "#page"):
            return _KEEP
        if attrs.get("role", "").lower() in DROPPED_ROLES or attrs.get("aria-hidden", "").lower() == "true":
            return _BY_WORDS
        if words & FURNITURE:
            return _BY_WORDS
        if words & HEADERS and not inside and not words & ARTICLE_WORDS:
            return _BY_WORDS
        return _KEEP

    def chars_by_words(self) -> int:
        """Characters, blanks apart, in nodes left out for a class word, reader comments apart."""
        n = len(self.tag)
        state = [_KEEP] * n
        for i in range(n):
            state[i] = max(self.drop[i], state[self.parent[i]] if i else _KEEP)
            if self.comments[i] or i and state[self.parent[i]] == _BY_ELEMENT:
                state[i] = _BY_ELEMENT
        return sum(sum(map(len, t.split())) for k, t in self.events if t and state[k] == _BY_WORDS)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or not self.opened[tag]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[depth]]
            if name == tag:
                self._pop_to(depth)
                return
            if tag in INLINE and name not in INLINE or tag == "p" and name in SCOPE:
                return

    def handle_data(self, data: str) -> None:
        if data:
            if self.tag[self.open[-1]] == "head" and not data.isspace():
                self._pop_to(len(self.open) - 1)
            self.events.append((self.open[-1], data))


def densities(parent, tag, kept, chars, tags, body: int) -> tuple[list[float], list[float]]:
    """Composite density of every node, and the sum over its children (a leaf has its own).

    ``chars`` and ``tags`` are each node's own; parents come before their children.
    """
    n = len(parent)
    c, t = list(chars), list(tags)
    in_link = [False] * n
    lc, lt = [0] * n, [0] * n
    for i in range(1, n):
        in_link[i] = tag[i] == "a" or in_link[parent[i]]
    for i in range(n):
        if in_link[i]:
            lc[i], lt[i] = chars[i], tags[i]
    for i in range(n - 1, 0, -1):
        if kept[i]:
            p = parent[i]
            c[p] += c[i]
            t[p] += t[i] + 1
            lc[p] += lc[i]
            lt[p] += lt[i] + (1 if in_link[i] else 0)
    share = max(lc[body], 1) / max(c[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if kept[i] and c[i]:
            links = max(lc[i], 1)
            base = math.log(c[i] / max(c[i] - lc[i], 1) * links + share * c[i] + math.e)
            density[i] = c[i] / max(t[i], 1) * math.log(c[i] / links * max(t[i], 1) / max(lt[i], 1)) / math.log(base)
    leaf = [True] * n
    for i in range(1, n):
        if kept[i]:
            leaf[parent[i]] = False
            total[parent[i]] += density[i]
    for i in range(n):
        if leaf[i]:
            total[i] = density[i]
    return density, total


def main_text(html: str) -> str:
    """Article text of one page."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    text = _article(page, _BY_WORDS)
    whole = page.drop
    if len(text) < LEFT_SHARE * page.chars_by_words():  # class words are evidence only: here the densities decide
        page.drop = [_BY_ELEMENT if c else d for c, d in zip(page.comments, whole)]
        text = _article(page, _BY_ELEMENT) or text
    if not text:
        page.drop = whole
        text = _article(page, _BY_ELEMENT)
    return text


def _article(page: _Page, least: int) -> str:
    """Text with the nodes of verdict ``least`` or stronger left out."""
    tag, parent = page.tag, page.parent
    n = len(tag)
    kept = [page.drop[0] < least] * n
    for i in range(1, n):
        kept[i] = kept[parent[i]] and page.drop[i] < least
    chars = [0] * n
    for node, text in page.events:
        if text and kept[node]:
            chars[node] += sum(map(len, text.split()))
    if not any(chars):
        return ""
    body = page.body
    density, total = densities(parent, tag, kept, chars, page.tags, body)
    under = [i == body for i in range(n)]
    for i in range(1, n):
        under[i] = under[i] or under[parent[i]]
    core = max((i for i in range(n) if kept[i] and under[i]), key=lambda i: (total[i], i), default=body)
    path = [core]
    while path[-1] != body and parent[path[-1]] >= 0:
        path.append(parent[path[-1]])
    threshold = min(density[i] for i in path)
    outer = next((i for i in path if tag[i] in ("article", "main")), body)
    on_path = set(path)
    linked = [x == "a" for x in tag]
    for i in range(n - 1, 0, -1):
        linked[parent[i]] |= linked[i]
    take = [False] * n
    for i in range(n):
        p = parent[i]
        if i == core or p >= 0 and take[p] and i not in on_path:
            take[i] = kept[i]
        elif p in on_path and i not in on_path and kept[i] and (p == outer or _within(parent, p, outer)):
            heading = tag[i] in ("h1", "h2") or outer != body
            beside = tag[core] == tag[i] == "p" and p == parent[core] and not linked[i]
            take[i] = density[i] >= threshold or heading or beside
    for i in path:  # own text of the path inside the article
        take[i] = take[i] or i == outer and outer != body or outer != body and _within(parent, i, outer)
    blocks, run = [], []
    for node, text in page.events:
        if text is None:
            blocks.append("".join(run))
            run = []
        elif take[node] and kept[node]:
            run.append(text)
    blocks.append("".join(run))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _within(parent, node: int, outer: int) -> bool:
    while node > 0 and node != outer:
        node = parent[node]
    return node == outer


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the string column ``text``, replacing one of that name. Map only."""
    return pages.withColumn("text", per_text(F.col(html_col), lambda h: (main_text(h),), "text string")["text"])


#: The same for pages of one shape: a single ``article`` of ``h1`` and ``p`` with ``b`` and ``br``.
ORACLE = """
WITH parts AS (
  SELECT page_id, url, list_transform(
    regexp_split_to_array(coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), ''), '</?(?:h1|p)>'),
    x -> trim(regexp_replace(
      replace(replace(replace(replace(replace(replace(x, '<br>', ' '), '<b>', ''), '</b>', ''), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'),
      '\\s+', ' ', 'g'))) AS blocks
  FROM pages),
joined AS (SELECT page_id, url, array_to_string(list_filter(blocks, x -> x <> ''), chr(10)) AS text FROM parts)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op2: one row per page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

"""Main text of web pages by a site style tree.

The DOMs of a host are merged: elements with the same path of tags, classes
and ids are one style node. A style node matters if what pages show there
differs: its importance is the min-entropy of its content (the text below it)
and of its presentation (the tags below it) over the host's pages, at most one
bit each. That depends on the share of pages with the commonest text alone, and
so neither on how many pages a host has nor on how many texts the others show.
Where a branch is of low importance, the commonest text - a menu, notice or
other text the site repeats - is removed from the pages that show it, next to
what markup itself declares as no content (navigation, headers, forms,
adverts, comments, ... by tag, role or class). If a page marks its article,
only that is kept of the rest, and all of it.

One pass parses each page into its (style node, content, presentation) triples
and leaves one of the same pages of a host; the triples are counted before the
next shuffle, so a host with a third of all pages has only as many rows per
task as it has different contents. A second pass keeps the blocks of each page
that are in no low branch.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import frozen, put_back, set_aside
from feedlens.llm.urlfilter import url_host

#: A branch is judged if so many pages of its host have it, and removed below this importance.
MIN_SEEN, LEAST_IMPORTANCE = 8, 0.2
#: Bytes of the low branches of all hosts up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Weight of the content's entropy; the presentation's has the rest.
CONTENT_WEIGHT = 0.9

# Vocabulary of HTML and of usual class names. Fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe textarea title".split())
#: No content, but elements may be in them; where one was never ended, what follows it is not taken as its own.
EMBEDDED = set("template svg math object canvas audio video select".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span"
             " strike strong sub sup time tt u var wbr".split())
NO_CONTENT = set("head nav header footer aside form fieldset button dialog menu label legend optgroup option datalist".split()) | RAW | EMBEDDED
LANDMARK_ROLES = {"main", "article"}
#: Headings, items and cells: without a class or id they are judged as a part of the branch that holds them.
PARTS = set("h1 h2 h3 h4 h5 h6 li dt dd tr td th caption".split())
#: Never removed as a repeated branch: they hold the page, or what it marks as its article.
WHOLE = {"html", "body", "main", "article"}
NO_CONTENT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar"
                       " status tooltip".split())
NO_CONTENT_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promos promotion banner nav navbar"
    " navigation menu menus submenu breadcrumb breadcrumbs masthead header topbar footer sidebar sidebars aside widget widgets related"
    " recommended recommendations share sharing social comment comments commentlist reply replies respond discussion disqus cookie"
    " cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe"
    " subscription signup login form search searchbox pagination pager copyright disclaimer skip".split())
COMMENT_NAMES = set("comment comments commentlist reply replies respond discussion disqus".split())
#: A name with one of these says how something is set on what has it, not that it is one.
STATE_NAMES = set("has have with without no not non free open opened closed enabled disabled allow allowed is can".split())
#: Inside an article, what has these names and holds a heading is the article's own head.
HEAD_NAMES, HEADINGS = {"header", "masthead"}, {"h1", "h2", "h3"}
#: Hard drops that may hold the article all the same.
YIELDING, YIELDING_ROLES = {"form", "aside", "fieldset"}, {"form", "search", "complementary"}
#: A start tag ends these open elements, up to the first of the second set.
IMPLIED_END = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
               "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
                    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
                    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)  # the last: a quote that is never closed
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


#: Rolling hash of the texts of a branch.
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class _Page:
    """Elements and text blocks of one page, in page order."""

    def __init__(self, text: str):
        self.parent, self.tag, self.path, self.drop, self.soft, self.mark, self.whole = [-1], [""], [0], [False], [False], [False], [True]
        self.form, self.comment, self.ended = [False], [False], set()  # may yield to an article they hold; ended by an end tag
        self.head = [False]  # soft only for being named a header
        self.blocks: list[tuple[int, str]] = []  # (element, text)
        self._parts: list[str] = []
        self._stack = [0]
        self._block_at = [0]  # places in the stack of what is not inline
        self._open: dict[str, list[int]] = {}  # tag -> its places in the stack
        self._at = 0
        self._parse(text)
        self._flush()
        self._settle()

    def _flush(self) -> None:
        words = html.unescape("".join(self._parts)).split()
        if words:
            self.blocks.append((self._at, " ".join(words)))
        self._parts = []

    def _text(self, s: str) -> None:
        if s:
            if not self._parts:
                self._at = self._block_element()
            self._parts.append(s)

    def _block_element(self) -> int:
        return self._stack[self._block_at[-1]]

    def _depth(self, tags, first: bool = False) -> int:
        """Place in the stack of the last (or the first) open element with one of the tags; 0 if there is none."""
        at = [self._open[t][0 if first else -1] for t in tags if self._open.get(t)]
        return (min if first else max)(at, default=0)

    def _parse(self, text: str) -> None:
        pos = 0
        while True:
            m = _TOKEN.search(text, pos)
            if m is None:
                self._text(text[pos:])
                return
            self._text(text[pos: m.start()])
            pos = m.end()
            if m.group(1):
                self._end(m.group(1).lower())
            elif m.group(2) or m.group(4):
                tag, attrs = (m.group(2) or m.group(4)).lower(), m.group(3) or m.group(5) or ""
                self._start(tag, attrs)
                if attrs.endswith("/") and (tag in RAW or tag in EMBEDDED):
                    self._end(tag)
                elif tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, pos)
                    pos = close.end() if close else len(text)
                    self._end(tag)

    def _pop_to(self, depth: int) -> None:
        depth = max(1, depth)
        for e in self._stack[depth:]:
            self._open[self.tag[e]].pop()
        while self._block_at[-1] >= depth:
            self._block_at.pop()
        del self._stack[depth:]

    def _start(self, tag: str, attr_text: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        if tag not in INLINE and self.tag[self._block_element()] == "p":  # a block ends an open paragraph
            self._pop_to(self._block_at[-1])
        if tag in IMPLIED_END:
            ends, until = map(self._depth, IMPLIED_END[tag])
            if ends > until:
                self._pop_to(ends)
        if tag in ("article", "main", "body"):  # no menu or header holds these: it was left open
            left_open = self._depth(("head", "nav", "header", "footer", "title"), first=True)
            if left_open:
                self._pop_to(left_open)
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attr_text)} if attr_text.strip(" /\t\r\n") else {}
        names = " ".join(sorted(attrs.get("class", "").split())) + "#" + re.sub(r"\d+", "0", attrs.get("id", ""))
        up = self._stack[-1]
        role = attrs.get("role", "").lower()
        known = tag not in ("body", "html", "main")
        single = [{x.lower() for x in _NAME.findall(name)} for name in names.replace("#", " ").split()] if known else []
        single = [w for w in single if not w & STATE_NAMES]
        comment = any(w & COMMENT_NAMES for w in single)
        said = set().union(*single) & NO_CONTENT_NAMES
        form = tag in YIELDING or tag not in NO_CONTENT and role in YIELDING_ROLES
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
        self.parent.append(up)
        self.tag.append(tag)
        if tag in INLINE:
            self.path.append(self.path[up])
        else:
            self.path.append(zlib.crc32(f"{self.path[up]}/{tag}.{names}".encode("utf-8", "replace")) | (zlib.crc32(f"{tag}.{names}/{self.path[up]}".encode("utf-8", "replace")) & 0x7FFFFFFF) << 32)
        self.drop.append(tag in NO_CONTENT and tag not in YIELDING or role in NO_CONTENT_ROLES and role not in YIELDING_ROLES or hidden)
        self.form.append(form)
        self.comment.append(comment)
        self.soft.append(tag != "article" and bool(said))
        self.head.append(said <= HEAD_NAMES)
        self.mark.append(tag in ("article", "main") or role in LANDMARK_ROLES)
        self.whole.append(tag in WHOLE or self.mark[-1] or tag in PARTS and names == "#")
        if tag not in INLINE:
            self._block_at.append(len(self._stack))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        d = self._depth((tag,))
        if d and (tag not in INLINE or d > self._block_at[-1]):  # no inline end tag ends a block
            self.ended.add(self._stack[d])
            self._pop_to(d)

    def _settle(self) -> None:
        """Which elements are no content, and which lie in the article.

        Forms yield to the only article or main of the page, or, if a page marks
        none, to most of its text, asides to an only article that is most of the
        text; elements named after comments only if the page has no other text.
        """
        n = len(self.tag)
        for e in range(1, n):
            if self.tag[e] in EMBEDDED and e not in self.ended:
                self.drop[e] = False
        hard, own = self.drop, [f or c for f, c in zip(self.form, self.comment)]
        self._spread(hard, own)
        if any(own):
            if not any(m and not d for m, d in zip(self.mark, self.drop)):
                self._spread(hard, [o and not y for o, y in zip(own, self._yielding(hard))])
            if all(self.drop[e] for e, _ in self.blocks):
                self._spread(hard, [f and not c for f, c in zip(self.form, self.comment)])
            if all(self.drop[e] for e, _ in self.blocks):
                self._spread(hard, [False] * n)
        marked = [m and not d for m, d in zip(self.mark, self.drop)]
        article = [m and t != "main" for m, t in zip(marked, self.tag)]
        self.inside = marked
        self.alone = article if any(article) else list(marked)  # what entropy leaves alone
        for e in range(1, n):
            self.inside[e] = self.inside[e] or self.inside[self.parent[e]]
            self.alone[e] = self.alone[e] or self.alone[self.parent[e]]
        self.marked = any(marked)

    def _spread(self, hard: list[bool], own: list[bool]) -> None:
        """Drop what is ``hard`` or ``own``, what a class name says to drop, and all below these. A class name
        does not drop what holds the article or half of the page's text, nor the article's own head."""
        n = len(self.tag)
        drop = [h or o for h, o in zip(hard, own)]
        below = list(drop)
        for e in range(1, n):
            below[e] = below[e] or below[self.parent[e]]
        holds, heading, inside, size = [False] * n, [t in HEADINGS for t in self.tag], list(self.mark), [0] * n
        for e, text in self.blocks:
            if not below[e]:
                size[e] += len(text)
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            if (self.mark[e] or holds[e]) and not drop[e]:  # an article or main that is not dropped itself
                holds[up] = True
            heading[up] = heading[up] or heading[e]
            size[up] += size[e]
        for e in range(1, n):
            up = self.parent[e]
            inside[e] = inside[e] or inside[up]
            soft = self.soft[e] and not holds[e] and 2 * size[e] <= size[0] and not (self.head[e] and heading[e] and inside[up])
            drop[e] = drop[up] or drop[e] or soft
        self.drop = drop

    def _yielding(self, hard: list[bool]) -> list[bool]:
        """The forms that hold an article that is none of the comments, and such asides with most of the text; or else the forms with most of it."""
        n = len(self.tag)
        self._spread(hard, self.comment)
        size, holds = [0] * n, [m and not d for m, d in zip(self.mark, self.drop)]
        for e, text in self.blocks:
            if not self.drop[e]:
                size[e] += len(text)
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
            holds[self.parent[e]] = holds[self.parent[e]] or holds[e]
        most = [2 * s > size[0] for s in size]
        if any(f and h and (t != "aside" or m) for f, h, t, m in zip(self.form, holds, self.tag, most)):
            return [f and h and (t != "aside" or m) for f, h, t, m in zip(self.form, holds, self.tag, most)]
        return [f and t != "aside" and m for f, t, m in zip(self.form, self.tag, most)]

    def branches(self) -> dict[int, tuple[int, int, int]]:
        """Style node -> (content, presentation, occurrences) of the elements with text below them that may be content."""
        # blocks below an element are consecutive: its content is the hash of a range of them
        n, power, prefix = len(self.tag), [1], [0]
        low, high = [-1] * n, [-1] * n
        for e, text in self.blocks:
            if not self.drop[e]:
                k = len(prefix) - 1
                low[e], high[e] = (k if low[e] < 0 else low[e]), k + 1
                prefix.append((prefix[-1] * _BASE + zlib.crc32(text.encode("utf-8", "replace")) + 1) % _PRIME)
                power.append(power[-1] * _BASE % _PRIME)
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            if low[e] >= 0:
                low[up] = low[e] if low[up] < 0 else min(low[up], low[e])
                high[up] = max(high[up], high[e])
        content = {e: (prefix[high[e]] - prefix[low[e]] * power[high[e] - low[e]]) % _PRIME & 0xFFFFFFFF
                   for e in range(1, n) if low[e] >= 0 and self.tag[e] not in INLINE}
        shape: dict[int, int] = {}
        for e in range(len(self.tag) - 1, 0, -1):
            shape[e] = zlib.crc32(f"{self.tag[e]}{shape.get(e, 0)}".encode())
            shape[self.parent[e]] = zlib.crc32(f"{shape.get(self.parent[e], 0)}{shape[e]}".encode())
        nodes: dict[int, tuple[int, int, int]] = {}
        for e in content:
            c, p, n = nodes.get(self.path[e], (0, 0, 0))
            nodes[self.path[e]] = (zlib.crc32(b"%d" % content[e], c), zlib.crc32(b"%d" % shape[e], p), n + 1)
        return nodes

    def text(self, low: dict[int, int]) -> str:
        """The blocks that are content, in page order. ``low``: style nodes of low importance, with the content that repeats there."""
        gone = [False] * len(self.tag)
        if low and not all(self.alone[e] or self.drop[e] or self.marked and not self.inside[e] for e, _ in self.blocks):
            same = {k for k, (c, _, _) in self.branches().items() if low.get(k) == c}
            for e in range(1, len(self.tag)):
                gone[e] = gone[self.parent[e]] or self.path[e] in same and not self.whole[e]
        return " ".join(t for e, t in self.blocks if not self.drop[e] and (self.alone[e] or not gone[e]) and (self.inside[e] or not self.marked))


def style_nodes(pages: DataFrame, host: Column, html_col: str = "html") -> DataFrame:
    """(host, node, seen, pages, importance, common) of the merged style tree of each host.

    ``seen`` counts occurrences, ``pages`` the pages that have any; ``common``
    is the content most of these show there. A page counts once for its host,
    however many copies of it are there: pages are the same if all their
    branches are.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:  # a page is one row of node, content with presentation, and occurrences in turn
            yield pd.DataFrame([(h, np.array([(k, c << 32 | p, n) for k, (c, p, n) in _Page(t).branches().items()], dtype=np.uint64)
                                 .astype(np.int64).ravel()) for h, t in zip(df["host"], df["html"]) if t], columns=["host", "page"])

    distinct = pages.select(host.alias("host"), F.col(html_col).alias("html")).mapInPandas(parse, "host string, page array<long>").distinct()
    rows = (distinct.filter("size(page) > 0")
            .selectExpr("host", "explode(transform(sequence(0, size(page) - 1, 3), i -> struct(page[i] AS node, page[i + 1] AS v, page[i + 2] AS n))) AS b")
            .selectExpr("host", "b.node", "b.n", "shiftrightunsigned(b.v, 32) AS content", "b.v & 4294967295 AS shape"))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("shape").alias("value")))
    values = (rows.select("host", "node", "n", F.explode(both).alias("v")).groupBy("host", "node", "v.kind", "v.value")
              .agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("seen")))
    entropy = (values.groupBy("host", "node", "kind").agg(F.sum("seen").alias("seen"), F.sum("pages").alias("pages"), F.max(F.struct("pages", "value")).alias("top"))
               .withColumn("h", F.least(F.lit(1.0), F.log2(F.col("pages") / F.col("top.pages")))))
    weight = F.when(F.col("kind") == 0, F.lit(CONTENT_WEIGHT)).otherwise(F.lit(1 - CONTENT_WEIGHT))
    return entropy.groupBy("host", "node").agg(F.max("seen").alias("seen"), F.max("pages").alias("pages"), F.sum(F.col("h") * weight).alias("importance"),
                                               F.max(F.when(F.col("kind") == 0, F.col("top.value"))).alias("common"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """``pages`` with the main text of each page and its number of code points added.

    Character references are decoded; white space in a block becomes one
    space, and blocks are joined by one. Null and empty pages have an empty
    text. Pages without a URL count as one host. A page that repeats on a host
    counts once there, and each of its copies has its text. Columns of
    ``pages`` that have the names in ``out`` are replaced, all others stay.
    """
    pages, away = set_aside(pages, "_st_")
    url_col, html_col = away.get(url_col, url_col), away.get(html_col, html_col)
    host = url_host(F.col(url_col))
    nodes = style_nodes(pages, host, html_col)
    # a site's templates: as many nodes as it has repeated ones, not as it has pages
    low = frozen(nodes.filter((F.col("pages") >= MIN_SEEN) & (F.col("importance") < LEAST_IMPORTANCE))
                 .groupBy(F.col("host").alias("_st_of")).agg(F.flatten(F.collect_list(F.array("node", "common"))).alias("_st_low")))
    size = low.agg(F.sum(F.octet_length("_st_of") + 8 * F.size("_st_low") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # the pages stay where they are; else both sides are read from files and Spark splits a hot host
        low = F.broadcast(low)
    rows = pages.withColumn("_st_host", host).join(low, F.col("_st_host") == F.col("_st_of"), "left")

    @F.pandas_udf("string")
    def main_text(pages: pd.Series, lows: pd.Series) -> pd.Series:
        return pd.Series([_Page(t).text(dict(zip(x[::2], x[1::2])) if x is not None else {}) if t else "" for t, x in zip(pages, lows)], dtype=object)

    text, n = (away.get(c, c) for c in out)
    res = (rows.withColumn(text, main_text(F.col(html_col), F.col("_st_low")))
           .withColumn(n, F.length(text).cast("long")).drop("_st_host", "_st_of", "_st_low"))
    return put_back(res, away)

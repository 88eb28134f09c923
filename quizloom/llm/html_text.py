"""Main text of pages by site style trees.

The DOMs of a host are merged into one tree of style nodes: a node is the chain of block elements
with their classes that leads to a text. A node's importance is the mean, over its contents, of one
less the normalised entropy of the pages that show the content: text that is the same all over a
site has none, text of one page has all. Branches of low importance leave each page; so do elements
that say what they are (menus, forms, adverts, comments and the like).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A node is judged when so many different pages of its host show it, and leaves below this importance.
LEAST_PAGES, LEAST_IMPORTANCE = 8, 0.3
#: Tables of noise nodes up to this many rows are sent to all tasks; larger ones are joined.
SENT_NODES = 50_000

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head title style script noscript template nav header footer aside form button select textarea option iframe object svg "
    "canvas audio video dialog menu math map".split()
)
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption hr address details summary center fieldset legend hgroup".split()
)
CLOSES_P = BLOCKS - frozenset("html body".split())
# Words in class, id and role that tell what an element is for.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar widget widgets comment "
    "comments disqus cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing "
    "social breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer header masthead related toolbar skip "
    "complementary contentinfo search dialog alert replies reply respond".split()
)
_KEPT_WHATEVER_CLASS = frozenset("html body main article".split())


_CUT_TAG = re.compile(r"<[A-Za-z/!][^<>]*\Z")


def _digest(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - 2**63


class Page(HTMLParser):
    """Blocks of a page in order: (style node, text, place).

    A place is (in main, number of the outermost article or 0, in an article with a class of noise)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, tuple]] = []  # element, dropped, place
        self.articles = 0
        self.path: list[str] = []  # of the block elements on the stack
        self.blocks: list[tuple[int, str, tuple]] = []
        self.text: list[str] = []
        self.feed(_CUT_TAG.sub("", html))
        self.close()
        self._flush()

    def _state(self) -> tuple[bool, tuple]:
        return self.stack[-1][1:] if self.stack else (False, (False, 0, False))

    def _flush(self):
        if self.text:
            said = " ".join("".join(self.text).split())
            self.text = []
            if said:
                self.blocks.append((_digest("/".join(self.path)), said, self._state()[1]))

    def _pop(self, at: int):
        self._flush()
        for tag, _, _ in self.stack[at:]:
            if tag in BLOCKS:
                self.path.pop()
        del self.stack[at:]

    def _close(self, names, until):
        """End the innermost open element of ``names``, if none of ``until`` is inside it."""
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at][0]
            if tag in names:
                return self._pop(at)
            if tag in until:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self.text.append(" ") if tag == "br" else self._flush()
            return
        if tag in CLOSES_P:
            self._close(("p",), ("td", "th", "article", "section", "div", "li"))
        if tag == "li":
            self._close(("li",), ("ul", "ol", "menu"))
        elif tag in ("td", "th"):
            self._close(("td", "th"), ("table", "tr"))
        elif tag == "tr":
            self._close(("tr",), ("table",))
        elif tag in ("dt", "dd"):
            self._close(("dt", "dd"), ("dl",))
        dropped, place = self._state()
        named = {k: v or "" for k, v in attrs}
        noise = False
        if not dropped:
            words = set(re.split(r"[^a-z]+", " ".join((named.get("class", ""), named.get("id", ""), named.get("role", ""))).lower()))
            hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
            noise = bool(words & NOISE_WORDS)
            dropped = tag in DROPPED or (tag not in _KEPT_WHATEVER_CLASS and (hidden or noise))
        if tag in BLOCKS or tag in DROPPED:
            self._flush()
        if tag == "article":
            self.articles += 1
            place = (place[0], place[1] or self.articles, place[2] or noise)
        elif tag == "main":
            place = (True, *place[1:])
        self.stack.append((tag, dropped, place))
        if tag in BLOCKS:
            self.path.append(f"{tag}.{named.get('class', '')}")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "article", "main", "section", "body", "html"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                if tag in BLOCKS or tag in DROPPED or any(t in BLOCKS for t, _, _ in self.stack[at:]):
                    self._pop(at)
                else:
                    del self.stack[at:]
                return

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][1]):
            self.text.append(data)


def _chars(blocks) -> int:
    return sum(len(said) for _, said, _ in blocks)


def blocks_of(html: str | None) -> list[tuple[int, str, tuple]]:
    """Blocks of the region that holds the main text.

    Articles with a class of noise leave, unless all text is in such articles, or one alone holds more
    than the rest, no other article has text, and neither has main but around it. Then text outside of main and the articles leaves if it is
    shorter than main or than the longest article; else the whole page stays."""
    found = Page(html).blocks if html else []
    clean = [b for b in found if not b[2][2]]
    if clean and len(clean) < len(found):
        noisy = [b for b in found if b[2][2]]
        in_main = noisy[0][2][0]
        alone = len({b[2][1] for b in noisy}) == 1 and not any(b[2][1] or (b[2][0] and not in_main) for b in clean)
        if not (alone and _chars(noisy) > _chars(clean)):
            found = clean
    outer = [b for b in found if not (b[2][0] or b[2][1])]
    if outer and len(outer) < len(found):
        sizes: dict = {}
        for _, said, (main, article, _) in found:
            for part in {("main", main), ("article", article)}:
                sizes[part] = sizes.get(part, 0) + len(said) * bool(part[1])
        if _chars(outer) < max(sizes.values()):
            found = [b for b in found if b[2][0] or b[2][1]]
    return found


def _host(url: str = "url") -> Column:
    """Hash of the host that a url names (of the empty host, if none)."""
    name = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.xxhash64(F.lower(F.coalesce(name, F.lit(""))))


def _content(batches):
    """Task: one row per host, style node, content and page; a page is known by all its nodes and texts, so
    copies of a page count once."""
    for batch in batches:
        rows = set()
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blocks = blocks_of(html)
            if blocks:
                shown = [(node, _digest(said)) for node, said, _ in blocks]
                page = xxhash.xxh64_intdigest(np.array(shown, np.int64).tobytes()) - 2**63
                rows.update((host, node, said, page) for node, said in shown)
        cols = np.array(list(rows), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(cols[:, i].copy()) for i in range(4)], names=["host", "node", "content", "page"])


def noise_nodes(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """``host, nodes``: the style nodes of low importance (hashes) of each host (hash).

    A content shown by d of the node's m pages, evenly, has the normalised entropy log d / log m."""
    seen = pages.select(_host().alias("host"), "html").mapInArrow(_content, "host long, node long, content long, page long")
    seen = saved(seen.distinct(), "contents")
    shown = seen.groupBy("host", "node", "content").agg(F.count("*").alias("d"))
    whole = seen.select("host", "node", "page").distinct().groupBy("host", "node").agg(F.count("*").alias("m"))
    spread = shown.groupBy("host", "node").agg(F.sum("d").alias("n"), F.sum(F.col("d") * F.log(F.col("d").cast("double"))).alias("bits"))
    judged = spread.join(whole.where(F.col("m") >= least_pages), ["host", "node"])
    importance = 1 - F.col("bits") / F.col("n") / F.log(F.col("m").cast("double"))
    return judged.where(importance < least_importance).groupBy("host").agg(F.collect_list("node").alias("nodes"))


def _text(batches):
    for batch in batches:
        out = []
        for html, nodes in zip(batch.column("html").to_pylist(), batch.column("nodes").to_pylist()):
            noise = set(nodes or ())
            out.append("\n\n".join(said for node, said, _ in blocks_of(html) if node not in noise))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_text(df: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Character references are decoded, white space inside a block is one blank, blocks are joined by
    two line breaks in page order. A null, empty or text-free page has an empty text; a page whose
    url is null or names no host shares one nameless host. Repeated rows stay; copies of a page
    count once for its host. Unclosed and unknown elements end with what holds them. Other columns
    of ``df`` are ignored.
    """
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    noise = saved(noise_nodes(pages, least_pages, least_importance), "noise")
    nodes = noise.agg(F.coalesce(F.sum(F.size("nodes") + 1), F.lit(0))).first()[0]
    noise = noise.withColumnRenamed("host", "_host")
    keyed = pages.withColumn("_key", _host())
    joined = keyed.join(F.broadcast(noise) if nodes <= SENT_NODES else noise, F.col("_key") == F.col("_host"), "left")
    return joined.select("page_id", "url", "html", "nodes").mapInArrow(_text, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text. Elements that say what they are (navigation, asides, adverts,
forms, comments) are left out. Every other text node has a root-to-leaf path of tags; text length and
punctuation are added up per path and divided by the path's text nodes. Each path is smoothed with the best
of the paths beside, above and below it and beside the one above, so that a heading or a short item stands by
the paragraphs around it; both ratios are fused by a product and held against their deviation over the page. The text nodes of the
paths above it are the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A quote opens a value only after an equals sign; nothing is tried twice, so time grows with the page only.
_TAG = re.compile(r"<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PUNCTUATION = ".,;:!?…。，！？"
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("ul ol dl table body html article section div".split())
# What never is main text: elements, roles, and words of a class or an id.
ASIDE = frozenset("nav footer aside form button dialog menu".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu".split())
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|sidebar|side|comments?|commentlist|repl(?:y|ies)|disqus|menu|nav|navbar|navigation|breadcrumbs?"
    r"|footer|masthead|topbar|header|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|subscribe|newsletter|share|sharing|social|related|recommend\w*|widget|login|signup|pagination|pager)(?:$|[\s_-])", re.I)  # fmt: skip
# Headings of an article are no page header.
_OWN_HEADER = re.compile(r"(post|entry|article|story|content)[\s_-]+header", re.I)
#: Deviations of the scores of a page that select a path, and the weight of a path's own ratios.
DEVIATIONS, OWN = 0.5, 0.5


def _apart(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in ASIDE or tag == "header" and not inside_article:
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in ROLES or name in ("class", "id") and _HINT.search(_OWN_HEADER.sub(r"\1", value)):
            return tag not in ("body", "html", "article", "main")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Page:
    """Elements, tag paths and blocks of one page."""

    def __init__(self, source: str):
        # Per element: tag, path, block element around it, whether it is apart from the main text.
        self.tag, self.path, self.around, self.apart = [""], [0], [0], [False]
        # Paths are numbers; each but the first has a path above it.
        self.above, self._paths = [-1], {}
        self.blocks: list[tuple[int, str]] = []
        self.stack, self.text, self.holder = [0], [], 0
        self.open: Counter[str] = Counter()
        at, last = 0, source.rfind(">") + 1
        while m := _TAG.search(source, at, last):
            self._put(source[at : m.start()])
            at = m.end()
            if m[0] == "<!--":
                end = source.find("-->", at)
                at = end + 3 if end >= 0 else len(source)
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in VOID:
                if tag in ("br", "hr"):
                    self._put(" ")
            elif tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    # What is inside is no markup, so only the element's own end tag counts.
                    end = _END[tag].search(source, at)
                    at = end.end() if end else len(source)
            else:
                self._open(tag, m[3])
        self._put(source[at:])
        self._flush()

    def _put(self, raw: str) -> None:
        if raw:
            if not self.text:
                self.holder = self.around[self.stack[-1]]
            self.text.append(html.unescape(raw) if "&" in raw else raw)

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.holder, text))
        self.text = []

    def _open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P and self.open["p"]:
            self._close("p")
        closing = SAME_CLOSES.get(tag, "").split()
        if any(self.open[c] for c in closing):
            for e in reversed(self.stack):
                if self.tag[e] in closing:
                    self._close(self.tag[e])
                elif self.tag[e] in SCOPES:
                    break
        top = self.stack[-1]
        apart = self.apart[top] or _apart(tag, attributes, bool(self.open["article"] or self.open["main"]))
        inside = tag in INLINE and apart == self.apart[top]
        if not inside:
            self._flush()
        path = self.path[top]
        if not inside:
            path = self._paths.setdefault((path, tag), len(self.above))
            if path == len(self.above):
                self.above.append(self.path[top])
        self.around.append(self.around[top] if inside else len(self.tag))
        self.tag.append(tag)
        self.path.append(path)
        self.apart.append(apart)
        self.open[tag] += 1
        self.stack.append(len(self.tag) - 1)

    def _close(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[depth]] == tag:
                gone = self.stack[depth:]
                if any(self.around[e] == e for e in gone):
                    self._flush()
                del self.stack[depth:]
                self.open.subtract(self.tag[e] for e in gone)
                return
            if tag in INLINE and self.tag[self.stack[depth]] not in INLINE:
                return


def path_scores(page: Page) -> dict[int, float]:
    """Fused score per path that is not apart: text per node times punctuation per node, both smoothed."""
    sums: dict[int, list[float]] = {}
    for element, text in page.blocks:
        if not page.apart[element]:
            s = sums.setdefault(page.path[element], [0, 0, 0])
            s[0] += len(text)
            s[1] += sum(map(text.count, PUNCTUATION))
            s[2] += 1
    ratios = {p: (length / n, marks / n) for p, (length, marks, n) in sums.items()}
    best_below: dict[int, tuple[float, float]] = {}
    for p, own in ratios.items():
        best_below[page.above[p]] = tuple(map(max, own, best_below.get(page.above[p], own)))
    out = {}
    for p, own in ratios.items():
        up = page.above[p]
        held = best_below.get(up), ratios.get(up), best_below.get(p), best_below.get(page.above[up]) if up > 0 else None
        near = [own, *(x for x in held if x)]
        length, marks = (OWN * x + (1 - OWN) * max(y) for x, y in zip(own, zip(*near, strict=True), strict=True))
        out[p] = length * (1 + marks)
    return out


def main_text(source: str | None, score: Callable[[Page], dict[int, float]] = path_scores) -> str:
    """The main text of a page; empty for an empty page or one without text."""
    page = Page(source or "")
    scores = score(page)
    if not scores:
        return ""
    values = np.array(list(scores.values()))
    limit = min(DEVIATIONS * float(values.std()), float(values.max()))
    return " ".join(text for e, text in page.blocks if not page.apart[e] and scores[page.path[e]] >= limit)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row: white space in a block is one blank, blocks are joined by one.

    A null or empty page, and one without main text, give an empty text; ids and urls may be null, and
    repeated rows give repeated results. Very long pages are read whole, in time that grows with their length;
    equal scores are selected alike. Other columns are ignored whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s.as_py()) for s in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string").withColumn("n_chars", F.length("text"))

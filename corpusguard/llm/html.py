"""Operator 2: main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from corpusguard.llm.common import ddl, kept_columns

# Lines of the sliding window.
WINDOW = 3
# A surge needs this many characters in the window, or this share of the fullest window if that is more.
SURGE, SURGE_SHARE = 60, 0.15
# A stretch is kept if it holds this share of the characters of the largest one.
STRETCH_SHARE = 0.2

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>?", re.S
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WHITE = re.compile(r"\s+")

RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = set("nav footer aside form menu dialog head select button search fieldset".split())
PAGE = {"html", "body", "main", "article"}
HINTS = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|side-?bar\w*|foot(?:er)?\w*|masthead|banner\w*|comment\w*|reply|replies|respond|"
    r"disqus|ads?|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|newsletter|"
    r"subscri\w*|signup|login|social\w*|share\w*|sharing|related|recommend\w*|breadcrumbs?|pagination|pager|widget\w*|"
    r"toolbar|skip|copyright|legal|disclaimer|hidden|contentinfo|navigation|complementary|search|form|toc)(?:$|[\s_-])",
    re.I,
)
HEADER = re.compile(r"(?:^|[\s_-])(?:site-?)?header(?:$|[\s_-])", re.I)


@dataclass
class Line:
    text: str
    weight: int
    dropped: bool
    article: int


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, without markup.

    weight is the number of characters outside links; blocks of menus, headers, footers
    and the like are marked as dropped.  article is the number of the outermost element
    that is named as an article or main part, 0 outside of them.
    """
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int]] = []  # name, dropped, article
    links = articles = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                _, dropped, article = stack[-1] if stack else ("", False, 0)
                lines.append(Line(text, max(0, len(text) - linked), dropped, article))
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.strip())

    at = 0
    lowered = page.lower() if len(page.lower()) == len(page) else page
    for m in iter(lambda: TAG.search(page, at), None):
        take(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in RAW and not closing:
            if not m[0].rstrip().endswith("/>"):
                end = lowered.find(f"</{name}", at)
                at = len(page) if end < 0 else end
            continue
        if name == "br":
            parts.append(" ")
        if name == "a":
            links = 0 if closing else 1
        if name in BLOCKS:
            flush()
            links = 0
        if name in VOID or name == "p" or name not in BLOCKS:
            if name in BLOCKS or name in VOID or not NAMED.search(m[3] or "") and not closing:
                continue
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
        else:
            _, dropped, article = stack[-1] if stack else ("", False, 0)
            hints = " ".join(filter(None, (x for found in NAMED.findall(m[3] or "") for x in found)))
            headed = name == "header" or name not in PAGE and bool(HEADER.search(hints))
            marked = name in BOILERPLATE or headed and not article or name not in ("html", "body", "main") and bool(HINTS.search(hints))
            if name not in BLOCKS and not marked:
                stack.append((name, dropped, article))
            else:
                if not article and name in ("article", "main") and not marked:
                    article = articles = articles + 1
                stack.append((name, dropped or marked, article))
    take(page[at:])
    flush()
    return lines


def stretches(weights: np.ndarray, surge: int = SURGE, share: float = SURGE_SHARE) -> list[tuple[int, int]]:
    """(first, end) of lines between each surge and the dive after it.

    The window sum at a line covers the line and those after it.  A surge is where the
    sum climbs over the bound; the stretch reaches back over lines with text before it,
    and ends where a whole window is empty.
    """
    padded = np.concatenate((weights, np.zeros(WINDOW - 1, dtype=weights.dtype)))
    sums = np.convolve(padded, np.ones(WINDOW, dtype=weights.dtype), mode="valid")
    bound = min(max(surge, int(sums.max(initial=0) * share)), int(sums.max(initial=0)))
    found: list[tuple[int, int]] = []
    at, count = 0, len(weights)
    while at < count:
        if sums[at] < bound or not weights[at]:
            at += 1
            continue
        first = end = at
        while first > (found[-1][1] if found else 0) and weights[first - 1]:
            first -= 1
        while end < count and sums[end]:
            end += 1
        found.append((first, end))
        at = end
    return found


def main_text(page: str) -> str:
    """Text of the article; blocks joined by newlines.

    Lines marked as boilerplate weigh nothing and are never kept.  Text has to stand out:
    stretches between a surge and a dive are kept if they hold a share of the largest one.
    Where the page names articles, any text makes a surge, and the elements that a kept
    stretch meets are taken whole, nothing else; an element that none meets is a teaser
    beside the text.
    """
    lines = lines_of(page)
    wanted = [not line.dropped for line in lines]
    weights = np.array([line.weight * own for line, own in zip(lines, wanted)], dtype=np.int64)
    if not weights.any():
        return ""
    named = any(line.article and weight for line, weight in zip(lines, weights))
    found = stretches(weights, 1, 0.0) if named else stretches(weights)
    totals = [int(weights[a:b].sum()) for a, b in found]
    kept = [k for (a, b), total in zip(found, totals) if total >= STRETCH_SHARE * max(totals) for k in range(a, b)]
    articles = {lines[k].article for k in kept if weights[k]} - {0}
    if articles:
        kept = [k for k, line in enumerate(lines) if line.article in articles]
    return "\n".join(lines[k].text for k in kept if wanted[k])


def extract(df: DataFrame, page: str = "html", keep: list[Column] | None = None) -> DataFrame:
    """`keep` columns (default: all of df) with text and n_chars.

    Null and empty pages, and pages without an article, give the empty text and 0.  A
    page of any length is read whole; rows are independent, so repeated rows repeat
    their result and an empty table gives an empty one.  Columns of df named text or
    n_chars are replaced.
    """
    own = ("text", "n_chars")
    kept = kept_columns(df, page, keep, own)
    names = [c for c in kept.columns if c != "__text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(value or "") for value in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                [*names, *own],
            )

    return kept.mapInArrow(read, ddl(kept) + "text string, n_chars long")

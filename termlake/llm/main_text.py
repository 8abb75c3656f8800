"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element; a line carries its length, or 0 where it
stands in a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment,
or is mostly links. Sums of lengths over windows of `window` lines form the distribution. Text
starts where it surges above `surge` and ends where it dives to 0; everything between is kept.
Where <article> and <main> hold over half of the page's text outside such places, they weigh in:
lengths inside count `weight` times, so that short paragraphs at its edges stay, links there are
text, and windows end at its edges, so that lines outside have to surge by themselves. Names of
classes are a hint only: where those that aren't about comments would take the length from over
half of the text that is left without them, they are not heeded.

Defined cases: null, empty or text-less html gives ''; repeated rows repeat; unclosed and cut-off
tags are tolerated, and a drawing, frame, template or list of options that is never closed takes
nothing with it; other columns of the table are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|textarea|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
_NESTED = _BLOCK - frozenset("p li hr dd dt h1 h2 h3 h4 h5 h6 option tr body html".split()) | {"span", "button", "label"}
_ASIDE = frozenset("nav footer aside form dialog menu button fieldset".split())
_NAMES = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay paywall popup promo promotion related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Of the words above, those that mark reader comments.
_COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
#: Elements whose content isn't text of the page.
_EMBEDDED = frozenset("noscript template iframe svg select object".split())
_SPACE = re.compile(r"\s+")
_NO, _BY_NAME, _SURE = 0, 1, 2


def _aside(tag: str, attrs: str, in_article: bool) -> int:
    """Whether an element is surely beside the main flow, may be by its name, or isn't."""
    if tag in _ASIDE or (tag == "header" and not in_article) or re.search(r"\bhidden\b(?!\s*=\s*[\"']?until)", attrs):
        return _SURE
    if tag in ("body", "html", "article", "main") and "comment" not in attrs:
        return _NO
    found = _NO
    for m in _NAMES.finditer(attrs):
        words = re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())
        if not _COMMENT_WORDS.isdisjoint(words):
            return _SURE
        if not _SIDE_WORDS.isdisjoint(words):
            found = _BY_NAME
    return found


def lines_of(html: str) -> list[tuple[str, int, bool, int]]:
    """(text, beside the main flow or not, inside an article, characters in links) of each block."""
    out: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, aside, article
    parts: list[str] = []
    linked, in_link, aside, article, at = 0, False, _NO, False, 0
    unclosed: set[str] = set()

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                out.append((text, aside, article, linked))
        linked = 0

    def text(raw: str):
        nonlocal linked
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                linked += len(raw)

    for m in _TOKEN.finditer(html):
        if m.start() < at:  # inside an element that was passed over
            continue
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag in _EMBEDDED:
            if not m["close"] and not m["attrs"].endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(tag)
            continue
        if tag in ("br", "td", "th"):
            parts.append(" ")
        if tag == "a":
            in_link = not m["close"]
        if tag not in _BLOCK and tag not in _NESTED:
            continue
        if tag in _BLOCK:
            flush()
            in_link = False
        if tag in _NESTED:
            if m["close"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if tag not in _BLOCK and stack[k][1]:
                            flush()
                        del stack[k:]
                        break
            elif not m["attrs"].endswith("/"):
                side = _aside(tag, m["attrs"], article)
                if side and tag not in _BLOCK:
                    flush()
                stack.append((tag, side, tag in ("article", "main")))
            aside = max((s[1] for s in stack), default=_NO)
            article = any(s[2] for s in stack)
    text(html[at:])
    flush()
    return out


def main_text(html: str, window: int = 3, surge: int = 86, weight: int = 4) -> str:
    lines = lines_of(html)
    named = sum(len(t) for t, side, _, _ in lines if side == _BY_NAME)
    heeded = _BY_NAME if 2 * named <= sum(len(t) for t, side, _, _ in lines if side < _SURE) else _SURE
    lines = [(t, side >= heeded, article, links) for t, side, article, links in lines]
    marked = sum(len(t) for t, side, article, _ in lines if article and not side)
    holds = 2 * marked > sum(len(t) for t, side, _, _ in lines if not side)
    zone = [holds and article for _, _, article, _ in lines]
    sizes = [0 if side or (2 * links > len(t) and not z) else len(t) for (t, side, _, links), z in zip(lines, zone, strict=True)]
    kept, inside = [], False
    for i, z in enumerate(zone):
        if i and z != zone[i - 1]:
            inside = False
        total = sum(sizes[k] for k in range(i, min(i + window, len(lines))) if zone[k] == z) * (weight if z else 1)
        if not inside and sizes[i] and total > surge:
            inside = True
        elif inside and not total:
            inside = False
        if inside and sizes[i]:
            kept.append(lines[i][0])
    if not kept:  # no surge: a short page is all there is
        kept = [lines[i][0] for i, n in enumerate(sizes) if n and zone[i] == holds]
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, window: int = 3, surge: int = 86) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""

    def extract(batches):
        for batch in batches:
            ids, urls, html = columns(batch, "page_id", "url", "html")
            texts = [main_text(h, window, surge) if h else "" for h in html.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(extract, "page_id long, url string, text string, n_chars long")

"""Main text of HTML pages by line-block distribution (operator 5).

Markup is stripped into lines: one for each block of text, and an empty one for each
structural tag (div, section, article and the like) between two blocks.  Every line has
a weight, the weights of BLOCK neighbouring lines are summed, and the sums alone choose:
the text surges where a sum reaches SURGE (or the page's largest sum, if that is less)
and a PEAK-th of the largest, dives where a sum is nothing, and from the first to the last
surge between two dives every line is kept, with the lines that follow on either side
without an empty one.

A line weighs its characters outside links.  Elements that say what they are (menus,
headers, footers, sidebars, notices, adverts, forms, comments, hidden parts) are an empty
line.  If a page has an article (else a main part) that holds at least as much text as
any element beside it, its lines weigh as much more as the page's largest sum (SURGE at
least), so that each of them surges, and the lines beside it a quarter.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, table

BLOCK, SURGE, PEAK, BESIDE = 3, 86, 8, 4
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
# Elements and the names by which pages call their parts.
RAW = frozenset("script style textarea title xmp noscript template iframe noframes noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
DROPPED = frozenset("nav footer aside form button select dialog menu svg math canvas object audio video head".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose tags stand inside a running text and make no empty line.
FLOW = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 hgroup li ul ol dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th hr html body".split())
DISCUSSION = frozenset("comment comments reply replies respond disqus related".split())
BOILERPLATE = DISCUSSION | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header footer masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social recommended recommendations widget toolbar "
    "pagination pager copyright complementary contentinfo skip".split()
)
#: Words that may stand beside one of those in a name; beside a discussion, words for the article as well.
BESIDE_NAME = frozenset("area bar block body bottom box button buttons container desktop form global group icons inline inner item items left link links list main media mobile outer page panel posts right section site slot sticky stories text top unit user reader wrap wrapper".split())
CONTENT = frozenset("article content entry post story".split())
ASIDE = DISCUSSION | frozenset("teaser promo ad sponsored".split())  # what an article may be named without being the article


class Line(NamedTuple):
    text: str = ""  #: empty for the lines that structural tags and boilerplate leave
    told: int = 0  #: characters outside links
    holder: int = 0  #: number of the structural element that holds it, 0 for the page
    article: int = 0  #: number of the outermost article around it, 0 for none
    main: int = 0  #: number of the main part around it, 0 for none


def is_named_boilerplate(name: str, words: frozenset[str]) -> bool:
    """Whether every word of a class or id belongs to such a name, and one says it."""
    parts = {p for p in re.split(r"[^a-z]+", name) if len(p) > 2 or p in words}
    beside = BESIDE_NAME | (CONTENT if parts & DISCUSSION else frozenset())
    return bool(parts & words) and parts <= words | beside


def is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main") or not attributes.strip(" /"):
        return False
    words = ASIDE if tag == "article" else BOILERPLATE - ({"header"} if in_article else set())
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role") and any(is_named_boilerplate(called, words) for called in value.split()):
            return True
    return False


def lines_of(page: str) -> list[Line]:
    """The lines of a page; of empty lines in a row at most BLOCK."""
    out: list[Line] = []
    stack: list[str] = []
    numbers: list[int] = []
    text: list[str] = []
    links = at = opened = 0
    skip = None  # depth at which a boilerplate element began

    def number_of(tag: str) -> int:
        return next((n for t, n in zip(stack, numbers, strict=True) if t == tag), 0)

    def flush(empty: int = 0) -> None:
        nonlocal links
        line = SPACE.sub(" ", html.unescape("".join(text))).strip()
        if line:
            holder = next((n for t, n in zip(reversed(stack), reversed(numbers), strict=True) if t not in FLOW), 0)
            out.append(Line(line, max(0, len(line) - links), holder, number_of("article"), number_of("main")))
        for _ in range(empty):
            if len(out) < BLOCK or any(k.text for k in out[-BLOCK:]):
                out.append(Line())
        text.clear()
        links = 0

    def say(s: str) -> None:
        nonlocal links
        if skip is None and s:
            text.append(s)
            if "a" in stack:
                links += len(s)

    def pop_to(depth: int) -> None:
        nonlocal skip
        if skip is None and any(t not in INLINE for t in stack[depth:]):
            flush(sum(t not in FLOW for t in stack[depth:]))
        del stack[depth:], numbers[depth:]
        if skip is not None and len(stack) <= skip:
            skip = None

    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in stack:
                pop_to(len(stack) - 1 - stack[::-1].index(tag))
            elif tag == "p" and skip is None:
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in CLOSES_P and "p" in stack:
            pop_to(len(stack) - 1 - stack[::-1].index("p"))
        while stack and stack[-1] in ITSELF.get(tag, ()):
            pop_to(len(stack) - 1)
        attributes = m[3] if m[2] else m[6]
        boilerplate = skip is None and tag not in VOID and is_boilerplate(tag, attributes, "article" in stack or "main" in stack)
        if skip is None:
            if tag == "br":
                text.append(" ")
            elif boilerplate or tag not in INLINE:
                flush(int(boilerplate or tag not in FLOW and tag not in VOID))
        if tag in VOID:
            continue
        if boilerplate:
            skip = len(stack)
        opened += 1
        stack.append(tag)
        numbers.append(opened)
    say(page[at:])
    flush()
    return out


def marked_parts(lines: list[Line]) -> tuple[str, set[int]]:
    """The mark to go by ('article', 'main' or '') and the numbers of the parts that count:
    the largest, if no element beside them holds more text, and those half as large."""
    for mark in ("article", "main"):
        parts, beside = Counter(), Counter()
        for line in lines:
            if getattr(line, mark):
                parts[getattr(line, mark)] += line.told
            else:
                beside[line.holder] += line.told
        largest = max(parts.values(), default=0)
        if largest and largest >= max(beside.values(), default=0):
            return mark, {n for n, told in parts.items() if 2 * told >= largest}
    return "", set()


def weights(lines: list[Line]) -> list[float]:
    mark, parts = marked_parts(lines)
    told = [line.told for line in lines]
    if not mark:
        return told
    lift = max(SURGE, *window_sums(told))
    return [(lift + line.told if getattr(line, mark) in parts else line.told / BESIDE) if line.text else 0 for line in lines]


def window_sums(sizes: list[float]) -> list[float]:
    return [sum(sizes[i : i + BLOCK]) for i in range(len(sizes))]


def spans(sizes: list[float]) -> list[tuple[int, int]]:
    """(start, stop) of the lines from the first to the last surge between two dives."""
    sums = window_sums(sizes)
    largest, out, start, stop = max(sums, default=0), [], None, 0
    surge = max(min(SURGE, largest), largest / PEAK)
    for i, total in enumerate([*sums, 0]):
        if total and total >= surge:
            held = [k for k in range(i, min(i + BLOCK, len(sizes))) if sizes[k]]
            if start is None:
                start = held[0]
                while start and sizes[start - 1]:
                    start -= 1
            stop = held[-1] + 1
        elif not total and start is not None:  # the dive
            while stop < len(sizes) and sizes[stop]:
                stop += 1
            out.append((start, stop))
            start = None
    return out


def main_text(page: str) -> str:
    """The kept lines of a page, joined by two line feeds; empty if none."""
    lines = lines_of(page)
    return "\n\n".join(line.text for start, stop in spans(weights(lines)) for line in lines[start:stop] if line.text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row, repeated rows as often as they occur.

    A null or empty page has an empty text; an empty table gives no rows.  Other columns
    of the input, whatever their names, are left out.
    """
    importable(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda p: main_text(p) if isinstance(p, str) else "").astype(object)

    found = pages.select("page_id", "url", extracted("html").alias("text"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

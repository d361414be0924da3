"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that every block of the page that has text becomes a line. Parts whose markup says that they are
not main text (menus, notices, adverts, forms, comments, ...) leave blank lines. Over the lines a window
sums the lengths of their text outside links. The text surges where a window's sum rises above a bound
from a line that has text, and dives where it falls to nothing; lines from a surge up to the next dive
are kept. Where articles, or else main elements, outside those parts hold most of the page's text outside
links, lines outside them weigh nothing and any text in them is a surge; elsewhere the bound is ``SURGE`` characters, or the largest sum of the page if that is lower,
and a container with kept text keeps its shorter lines before and after that text too: a skipped part
inside it is no gap. An article's own headings, and its header if it holds one, are its text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, slices, text_or_empty

WINDOW = 3  # lines
SENTENCE_ENDS = (".", "!", "?", ":", "…", "。", '."', ".”", ".)")
SURGE = 120  # characters in a window, for pages that mark no article

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript"}
NEVER = RAW | {"head", "nav", "header", "footer", "aside", "form", "template", "menu", "dialog", "button", "select", "svg", "canvas", "object", "video", "audio", "map", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
         "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
         "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
ROOTS = {"html", "body", "main"}
HOLDERS = {"html", "body", "main", "article", "div", "td", "th", "center", "blockquote"}  # containers of lines; other blocks, and holders without blocks, are lines of their holder
# words in an element's class, id, role or label that mark it as no main text
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
         "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "sidebar", "menu", "nav", "navbar",
         "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "colophon", "comment", "comments", "commentlist", "reply", "replies", "respond",
         "discussion", "disqus", "related", "recommended", "share", "sharing", "social", "widget", "pagination", "pager", "toolbar", "skip", "search", "login", "complementary",
         "contentinfo", "hidden"}
# of these the first word of a token says so too ("ad-leaderboard"); of the others only its head ("share-price" is text)
FIRST = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "cookie", "cookies", "gdpr", "newsletter", "paywall",
         "sidebar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead", "footer", "comment", "comments", "commentlist", "disqus", "related", "recommended",
         "widget", "pagination"}
# parts that readers, other pages or advertisers write: they may hold most of a page's text and still be none of its main text
OTHERS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "cookie", "cookies", "gdpr",
          "comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "related", "recommended"}
# a token with one of these tells what the element has or does, not what it is
NEGATING = {"no", "not", "non", "has", "have", "with", "without", "hide", "show", "overflow"}
STATES = {"open", "opened", "close", "closed", "enabled", "disabled", "on", "off", "active", "inactive", "visible", "allowed", "none", "free", "loaded", "ready"}
# words after the head of a token
PLACES = {"area", "container", "wrapper", "wrap", "box", "block", "blocks", "bar", "list", "links", "link", "icons", "icon", "buttons", "button", "inner", "outer", "section",
          "item", "items", "content", "body", "posts", "articles", "stories", "slot", "unit", "top", "bottom", "left", "right", "primary", "secondary", "form", "title", "this",
          "group", "holder", "panel", "row", "col", "column", "module", "text", "us", "image", "img", "message", "thread", "region", "main", "toggle"}
NAMES = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _says(token: str) -> str:
    """The word by which a class, id, role or label says that its element is no main text, or none."""
    words = NAMES.findall(CAMEL.sub(" ", token).lower())
    if "".join(words) in WORDS:
        return "".join(words)
    if not words or not NEGATING.isdisjoint(words) or words[-1] in STATES:
        return ""
    if words[0] in FIRST:
        return words[0]
    while len(words) > 1 and words[-1] in PLACES:
        words.pop()
    return words[-1] if words[-1] in WORDS else ""


def _skip(name: str, attributes: str, own: bool = False) -> str:
    """Whether an element is no main text: "" nothing says so; "large": unless it holds most of the page's text
    and articles elsewhere hold little; "others": unless it holds all but a few words of it; "always". ``own``: a heading
    or a header with a heading that stands in an article or main; only what others write is none of its text."""
    if name in NEVER and not own:
        return "large" if name == "form" else "always"
    if name in ROOTS or not attributes.strip(" /\t\r\n"):
        return ""
    said = {}
    for m in ATTRIBUTE.finditer(attributes):
        said.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or "display:none" in said.get("style", "").replace(" ", "").lower():
        return "always"
    tokens = [t for k in ("class", "id", "role", "itemprop", "data-role") for t in said.get(k, "").split()]
    found = {_says(t) for t in (*tokens, said.get("aria-label", ""))} - {""}
    if name == "article":
        found -= {"header", "banner"}
    if own:
        found &= OTHERS
    return "" if not found else "others" if not found.isdisjoint(OTHERS) else "large"


def _tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attributes) of all markup; comments and the like have no name. What
    stands in raw elements (scripts, styles, ...) is no markup."""
    out, at, size, lower = [], 0, len(page), None
    while m := MARKUP.search(page, at):
        name, at = (m[1] or m[3] or "").lower(), m.end()
        closes = page.startswith("</", m.start())
        out.append((m.start(), at, name, closes, m[2] or m[4] or ""))
        if name in RAW and not closes and at < size:
            lower = lower if lower is not None else page.lower()
            if len(lower) == size:
                end = lower.find(f"</{name}", at)
            else:
                found = re.compile(f"</{name}", re.I).search(page, at)
                end = found.start() if found else -1
            at = size if end < 0 else end
    return out


def _ends(tags: list) -> dict[int, int]:
    """For each opening tag that is closed: the index of its closing tag."""
    open_: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, (_, _, name, closes, _) in enumerate(tags):
        if not name or name in VOID:
            continue
        if not closes:
            open_.setdefault(name, []).append(i)
        elif open_.get(name):
            ends[open_[name].pop()] = i
    return ends


def _own(tags: list, ends: dict[int, int]) -> set[int]:
    """Headings in an article or main, and headers there that hold a heading."""
    out, depth, headings = set(), 0, []
    for i, (_, _, name, closes, _) in enumerate(tags):
        if name in ("article", "main"):
            depth = max(0, depth + (-1 if closes else 1))
        elif depth and not closes and name in HEADINGS:
            out.add(i)
            headings.append(i)
        elif depth and not closes and name == "header" and i in ends:
            out.add(i)
    return {i for i in out if tags[i][2] in HEADINGS or 0 <= _next(headings, i) < ends[i]}


def _past(i: int, page: str, tags: list, ends: dict[int, int], blocks: list[int], roots: list[int]) -> tuple[int, int]:
    """The tag and the place to go on with when the element opened at tag ``i`` is skipped. One that is never
    closed: raw text reaches to the end, a list item or paragraph to the next block, the rest to the article."""
    if i in ends:
        return ends[i] + 1, tags[ends[i]][1]
    ahead = blocks if tags[i][2] in ("p", "li", "dd", "dt") else roots
    k = len(ahead) if tags[i][2] in RAW else bisect_right(ahead, i)
    return (ahead[k], tags[ahead[k]][0]) if k < len(ahead) else (len(tags), len(page))


def _sums(page: str, tags: list, past, skip: dict[int, str]) -> tuple[list[int], list[int]]:
    """Characters outside links before each tag and before the page's end, without what is skipped always:
    all of them, and those in articles."""
    sums, in_articles = [0] * (len(tags) + 1), [0] * (len(tags) + 1)
    whole = marked = link = articles = at = i = 0

    def add(to: int) -> None:
        nonlocal whole, marked
        if to > at and not link:
            n = len(page[at:to].strip())
            whole += n
            marked += n if articles else 0

    while i < len(tags):
        start, end, name, closes, _ = tags[i]
        add(start)
        sums[i], in_articles[i], at = whole, marked, end
        if skip.get(i) == "always":
            ahead, at = past(i)
            for k in range(i + 1, ahead):
                sums[k], in_articles[k] = whole, marked
            i = ahead
            continue
        if name == "a":
            link = 0 if closes else 1
        elif name == "article":
            articles = max(0, articles + (-1 if closes else 1))
        i += 1
    add(len(page))
    sums[-1], in_articles[-1] = whole, marked
    return sums, in_articles


def _next(places: list[int], i: int) -> int:
    """The first of the ascending ``places`` after ``i``; -1: none."""
    k = bisect_right(places, i)
    return places[k] if k < len(places) else -1


def _lines(page: str) -> list[list]:
    """Lines [text, characters outside links, in an article, in a main, tag of the container, whether that is the whole page]."""
    tags = _tags(page)
    ends = _ends(tags)
    opener = {b: a for a, b in ends.items()}
    held, open_ = [-1], {-1}
    blocks = [i for i, t in enumerate(tags) if t[2] in BLOCK]
    roots = [i for i, t in enumerate(tags) if t[2] in ("article", "main", "body")]
    past = lambda i: _past(i, page, tags, ends, blocks, roots)
    own = _own(tags, ends)
    skip = {i: how for i, (_, _, name, closes, attributes) in enumerate(tags) if not closes and name and name not in VOID and (how := _skip(name, attributes, i in own))}
    sums, in_articles = _sums(page, tags, past, skip)

    def skipped(i: int) -> bool:
        how = skip.get(i, "")
        if not how and inside["article"] and tags[i][2] == "article" and not tags[i][3]:  # a teaser or a comment inside the article
            how = "large"
        if how in ("", "always"):
            return how == "always"
        to = past(i)[0]
        mine, others = sums[to] - sums[i], in_articles[-1] - in_articles[to] + in_articles[i]
        if how == "others":
            return 2 * mine <= sums[-1] or others > 0 or sums[-1] - mine >= SURGE
        return 2 * mine <= sums[-1] or not inside["article"] and 4 * others >= mine

    lines: list[list] = []
    parts: list[str] = []
    weight = link = at = i = 0
    inside = {"article": 0, "main": 0}

    def line() -> None:
        nonlocal weight
        if text := " ".join("".join(parts).split()):
            lines.append([text, weight, inside["article"] > 0, inside["main"] > 0, held[-1], held[-1] < 0 or tags[held[-1]][2] in ("html", "body")])
        parts.clear()
        weight = 0

    def add(raw: str) -> None:
        nonlocal weight
        if raw:
            said = html.unescape(raw)
            parts.append(said)
            if not link:
                weight += len(said.strip())

    while i < len(tags):
        start, end, name, closes, attributes = tags[i]
        if start > at:
            add(page[at:start])
        at = end
        if skipped(i):
            i, at = past(i)
            if name in BLOCK or name in RAW:
                line()
                lines.extend([["", 0, False, False, held[-1], True] for _ in range(WINDOW)])
            continue
        if name in BLOCK:
            line()
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            link = 0 if closes else 1
        if name in HOLDERS:
            if closes and opener.get(i) in open_:
                while opener[i] in open_:
                    open_.discard(held.pop())
            elif not closes and i in ends and _next(blocks, i) != ends[i]:
                held.append(i)
                open_.add(i)
        if name in inside:
            inside[name] = max(0, inside[name] + (-1 if closes else 1))
        i += 1
    if at < len(page):
        add(page[at:])
    line()
    return lines


def _marked(lines: list[list]) -> int:
    """Which mark of the lines tells the main text (2 article, 3 main): the first that is set on most of the
    text outside links that no skipped part holds. 0: none."""
    whole = sum(x[1] for x in lines)
    return next((k for k in (2, 3) if any(x[k] for x in lines) and 2 * sum(x[1] for x in lines if x[k]) >= whole), 0)


def _joined(lines: list[list], on: list[bool], bound: int) -> None:
    """Carry kept lines on, in place: a container whose kept lines weigh more than ``bound`` also keeps its
    lines outside links before and after them, and what stands between. ``WINDOW`` lines in a row of links alone end
    that, but where the container is not the whole page and lines on both sides of them end as sentences do. Fewer lines of
    links after the last text stay too, in such a container. Skipped parts between them are no gap."""
    kept: dict[int, int] = {}
    for x, keep in zip(lines, on):
        if keep:
            kept[x[4]] = kept.get(x[4], 0) + x[1]
    linked = [0]  # rows of WINDOW lines of links that end before each line
    row = 0
    for x in lines:
        row = 0 if x[1] else row + bool(x[0])
        linked.append(linked[-1] + (row >= WINDOW))
    places: dict[int, list[int]] = {}
    for k, x in enumerate(lines):
        if x[1] and kept.get(x[4], 0) > bound:
            places.setdefault(x[4], []).append(k)
    spans = [0] * (len(lines) + 1)
    for holder, mine in places.items():
        groups, page = [[mine[0]]], lines[mine[0]][5]
        told = [p for p in mine if lines[p][0].endswith(SENTENCE_ENDS)]
        for before, at in zip(mine, mine[1:]):
            if linked[at] > linked[before] and (page or not told or told[0] > before or told[-1] < at):
                groups.append([])
            groups[-1].append(at)
        for group in groups:
            if any(on[p] for p in group):
                end = last = group[-1] + 1
                while not page and end < len(lines) and lines[end][4] == holder and lines[end][0] and not lines[end][1]:
                    end += 1
                spans[group[0]] += 1
                spans[end if end - last < WINDOW else last] -= 1
    for k, depth in enumerate(accumulate(spans[:-1])):
        on[k] = on[k] or depth > 0


def main_text(page: str) -> str:
    """The kept lines joined by one newline; white space inside a line is one space."""
    lines = _lines(page)
    marked = _marked(lines)
    texts = [len(x[0]) if x[marked] else 0 for x in lines] if marked else [x[1] for x in lines]
    sums = [sum(texts[i : i + WINDOW]) for i in range(len(lines))]
    bound = 0 if marked else min(SURGE, max(sums, default=0) - 1)
    kept, on = [], False
    for here, ahead in zip(texts, sums):
        if not on and here and ahead > bound:  # surge
            on = True
        elif on and not ahead:  # dive
            on = False
        kept.append(on)
    if not marked:
        _joined(lines, kept, bound)
    return "\n".join(x[0] for x, here, keep in zip(lines, texts, kept) if keep and x[0] and (here or not marked))


def extracted(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` plus ``out``, the main text of ``html_col``, which is left out.

    A null or empty page, and one without main text, gives the empty text. Broken markup never fails:
    unclosed tags, comments and scripts reach to where a browser would let them. Whole pages are read. Pages are
    judged one by one, so repeated rows and ties change nothing; other columns stay, whatever their names. An empty table gives no rows.
    """
    names = [c for c in pages.columns if c not in (html_col, out)]
    source = fresh(pages, "_html")
    schema = pages.select(*names).schema.add(out, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p) for p in batch.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, out])

    return pages.select(*names, text_or_empty(html_col).alias(source)).mapInArrow(run, schema)

"""Main text of web pages by line-block distribution.

A page becomes lines, one for each block of markup that has text. A line's weight is the length of its own text; lines
of menus, headers, footers, sidebars, notices, adverts, forms and comments weigh nothing. If the page names the element
that holds the article, lines in it weigh a surge more, and those outside nothing, unless the windows find several times
as much text outside: then the name is a teaser's, and all lines count. Sums of weights over a sliding window surge where
text begins and dive where it ends. What lies between the first surge and the last dive is kept, but for its weightless lines, and so are
the heading and short lines that lead to the first surge. A page without a surge is short: all that weighs is its text,
however short. A page takes time in proportion to its length, whatever its markup.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window; weight at which a window surges.
WINDOW, SURGE = 3, 80
#: A name that leaves out this many times the text it holds is no article's name.
OUTWEIGHS = 4

_HEAD, _STOP = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"), re.compile(r"""[>"']""")
_PLAIN, _OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"), re.compile(r"</?[a-zA-Z]")
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Elements whose content is no text, blocks, elements that are no article.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "head", "object", "annotation", "annotation-xml", "canvas", "audio", "video"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "button", "select", "fieldset", "label", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are closed by their own end tag only, or by that of an element around them.
NESTED = {"article", "aside", "blockquote", "button", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hgroup", "label", "li", "main", "menu", "nav", "ol", "search", "section", "select", "table", "ul"}
LISTS = {"ul", "ol", "menu"}
_ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|side-?bar|sidebars?|rail|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|comments?|commentlist|comment\w*|replies|reply|respond|disqus\w*|discussion|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|sign-?in|login|register|search\w*|toolbar|footer|foot|masthead|site-?header|page-?header|topbar|header|copyright|legal|skip\w*)(?=$|[\s_-])",
    re.I,
)
#: Whole classes and ids that name no part of an article.
_ASIDE_ONLY = re.compile(
    r"ads?|ad[-_]?(?:box|slot|unit|banner|container|wrapper)|advert(?:s|isements?|ising)?|sponsored(?:[-_]\w+)?|promo(?:tion)?s?(?:[-_](?:box|banner))?|cookie[-_]?(?:notice|banner|bar|consent)|gdpr(?:[-_]\w+)?|popup|modal|side-?bar|breadcrumbs?|pagination|pager|nav|navbar|navigation|menu|comments?|comment[-_]?(?:list|form|section|area)|comments[-_](?:list|section|area)|disqus_thread|respond|share[-_](?:buttons?|links|bar|tools)|(?:social|sharing)[-_](?:buttons?|links|share|icons|media)|related[-_](?:posts?|articles?|stories|links|content)|newsletter(?:[-_](?:signup|form|box))?|signup[-_]form|login[-_]form|search[-_](?:form|box)|toolbar|skip[-_]?(?:link|to-content)|(?:site|page)-?footer",
    re.I,
)
#: Names of what stands on top: inside an article they hold its title.
_TOP_NAME = re.compile(r"(?:^|[\s_-])(?:masthead|site-?header|page-?header|topbar|header)(?=$|[\s_-])", re.I)
#: Names that say what else the page has.
_HAS_NAME = re.compile(r"(?<![\w-])(?:has|with|no|without)[-_][\w-]+", re.I)
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-?body|content|contents|main|main-?content|post|post-?content|entry|entry-?content|story|story-?body|bodytext|body-?content)(?=$|[\s])", re.I)
#: How far classes and ids count: all, only whole ones of asides, none.
NAMES, WHOLE, NONE = 2, 1, 0
_ASIDE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}


def _kind(tag: str, attributes: str, inside: bool, by_name: int = NAMES) -> str:
    """What an element is by its name and attributes: "aside", "main", "content", "doubt" or "".

    Inside the article, and of a section's id, only whole names that name nothing else tell an aside; ids of headings and
    of other blocks of text are slugs and tell nothing. Other classes inside that sound like an aside's make a doubt: what
    is mostly links there is aside.
    """
    block = tag not in NESTED
    if tag in ASIDE or (tag == "header" and not inside):
        return "aside"
    named = "main" if tag in ("article", "main") else ""
    if not attributes.strip():
        return named
    names, whole = [], []
    for m in _NAMES.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return "aside"
        if name == "role" and value in _ASIDE_ROLE:
            return "aside"
        if (name == "role" and value in ("main", "article")) or (name == "itemprop" and value == "articlebody"):
            named = "main"
        if name in ("class", "id") and by_name and not (block and name == "id"):
            whole += value.split()
            value = _HAS_NAME.sub("", value)
            if not (tag == "section" and name == "id"):
                names.append(_TOP_NAME.sub("", value) if inside else value)
    if tag not in ("body", "html", "main", "article"):
        if any(_ASIDE_ONLY.fullmatch(n) for n in whole):
            return "aside"
        if by_name == NAMES and any(_ASIDE_NAME.search(n) for n in names):
            return "doubt" if inside else "aside"
    if tag in ("div", "section", "td") and any(_MAIN_NAME.search(n) for n in names + whole):
        named = named or "content"
    return named


def _tag_end(page: str, pos: int, dead: set[int]) -> int:
    """Where a tag ends whose name ends at pos: behind the first > that is in no quoted value (quotes stand after =), or -1 if there is none.

    dead: quotes from which the page's end is reached without such a >. A way that comes to one of them fails at once, so
    all failing ways together pass each quote once, and a page of any markup takes linear time.
    """
    seen = []
    while (m := _STOP.search(page, pos)) and m.start() not in dead:
        if m[0] == ">":
            return m.end()
        before = m.start() - 1
        while page[before] in " \t\n\f\r":
            before -= 1
        if page[before] != "=":  # a mark in a name or in a value without quotes
            pos = m.end()
            continue
        seen.append(m.start())
        pos = page.find(m[0], m.end()) + 1
        if not pos:
            break
    dead.update(seen)
    return -1


def _next_tag(page: str, pos: int, dead: set[int]) -> tuple[int, int, bool, str, str] | None:
    """Start, end, whether it closes, name and attributes of the next tag; comments and a tag that the page's end cuts off have no name.

    Quoted values may hold a >; where no > stands outside of quotes any more, a tag ends at the first.
    """
    while (at := page.find("<", pos)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return at, end + 3 if end >= 0 else len(page), False, "", ""
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            return at, end + 1 if end >= 0 else len(page), False, "", ""
        if m := _HEAD.match(page, at):
            end = _tag_end(page, m.end(), dead)
            if end >= 0:
                return at, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]
        if m := _PLAIN.match(page, at):
            return at, m.end(), bool(m[1]), m[2].lower(), m[3]
        if _OPEN.match(page, at):
            return at, len(page), False, "", ""
        pos = at + 1
    return None


_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}

#: Text, whether it is aside, the kind of main element around it, how much of it is in links, whether it is a heading.
Line = tuple[str, bool, str, int, bool]


def lines(page: str, by_name: int = NAMES) -> Iterator[Line]:
    """Lines of a page, one at each block tag, so with empty ones."""
    stack: list[tuple[str, str]] = []
    open_: Counter[str] = Counter()  # how many of each element are open
    lists: list[int] = []  # where in the stack lists and items are
    aside = doubt = link = linked = 0
    heading = False
    leaf = ""  # the kind of the block without an end tag of its own that is open
    mains = {"main": 0, "content": 0}
    text: list[str] = []
    pos, n, dead = 0, len(page), set()

    def line() -> Line:
        nonlocal linked
        words = " ".join(html.unescape("".join(text)).split())
        off = aside > 0 or leaf == "aside" or ((doubt > 0 or leaf == "doubt") and 2 * linked > len(words))
        out = (words, off, "main" if mains["main"] else "content" if mains["content"] else "", linked, heading)
        text.clear()
        linked = 0
        return out

    def pop() -> None:
        nonlocal aside, doubt
        tag, kind = stack.pop()
        open_[tag] -= 1
        if lists and lists[-1] == len(stack):
            lists.pop()
        aside -= kind == "aside"
        doubt -= kind == "doubt"
        if kind in mains:
            mains[kind] -= 1

    while pos < n:
        found = _next_tag(page, pos, dead)
        piece = page[pos : found[0] if found else n]
        if piece:
            text.append(piece)
            linked += len(piece) if link else 0
        if not found:
            break
        _, pos, closing, tag, attributes = found
        if not tag:
            continue
        if tag in RAW:
            if not closing and tag != "head":
                end = _ENDS[tag].search(page, pos)
                pos = end.end() if end else n
            continue
        if tag == "a":
            link = not closing
            continue
        if tag in ("br", "td", "th", "option"):
            text.append(" ")
        if tag in BLOCKS or tag in ASIDE:
            yield line()
            leaf, heading = "", tag in HEADINGS and not closing
        if tag not in NESTED:
            if tag in BLOCKS:
                leaf = _kind(tag, attributes, True, by_name) if attributes and not closing else ""
            continue
        link = False
        if tag == "li" and not closing:  # a new item ends the one before
            at = lists[-1] if lists else -1
            if at >= 0 and stack[at][0] == "li":
                while len(stack) > at:
                    pop()
        if not closing:
            kind = _kind(tag, attributes or "", mains["main"] + mains["content"] > 0, by_name)
            if tag in LISTS or tag == "li":
                lists.append(len(stack))
            stack.append((tag, kind))
            open_[tag] += 1
            aside += kind == "aside"
            doubt += kind == "doubt"
            if kind in mains:
                mains[kind] += 1
        elif open_[tag]:
            while stack[-1][0] != tag:
                pop()
            pop()
    yield line()


def main_blocks(page: str) -> list[str]:
    """Blocks of a page's main text, in page order. Where classes and ids leave nothing, only whole ones count, then none.

    Where no window surges the page counts as short, and short lines are its text.
    """
    found = []
    for by_name in (NAMES, WHOLE):
        found.append([x for x in lines(page, by_name) if x[0]])
        if out := _blocks(found[-1]):
            return out
    found.append([x for x in lines(page, NONE) if x[0]])
    return _blocks(found[0], short=True) or _blocks(found[1], short=True) or _blocks(found[2]) or _blocks(found[2], short=True)


def _between(weights: list[int], headings: list[bool], surge: int) -> range:
    """From the first surge, or the first heading that no dive parts from it, to the dive after the last surge."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    first, last, start, on = -1, -1, -1, False
    for i, s in enumerate(sums):
        if s == 0:
            on, start = False, -1  # a dive: a whole window without text
        elif weights[i]:
            if start < 0 and headings[i]:
                start = i
            if not on and s >= surge:
                on = True
                first = first if first >= 0 else start if start >= 0 else i
            last = i if on else last
    return range(first, last + 1) if first >= 0 else range(0)


def _blocks(found: list[Line], short: bool = False) -> list[str]:
    """Texts of the lines between the first surge and the last dive. found: lines with text."""
    kinds = {k for _, a, k, _, _ in found if not a}
    named = "main" if "main" in kinds else "content" if "content" in kinds else ""
    inside = [bool(named) and (k == "main" or named == k) for _, _, k, _, _ in found]
    headings = [x[4] for x in found]
    held = [0 if a or not i else len(t) for (t, a, _, _, _), i in zip(found, inside, strict=True)]
    free = [0 if a or i or 2 * in_links > len(t) else len(t) for (t, a, _, in_links, _), i in zip(found, inside, strict=True)]
    if named and sum(free[i] for i in _between(free, headings, SURGE)) <= OUTWEIGHS * sum(held):
        free = [0] * len(free)
    weights = [h + SURGE if h else f for h, f in zip(held, free, strict=True)]
    surge = SURGE
    if short:
        surge = 1
    return [found[i][0] for i in _between(weights, headings, surge) if weights[i]]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page)) if page else ""


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    text is the main text of the whole page: character references decoded, white space inside a block one space, blocks
    joined by two line ends. A null or empty page, or one without an article, has the empty text. Repeated rows are
    repeated, keys and urls may be null, no rows give none, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            for i in range(0, len(raw), 256):
                texts = [main_text(x) for x in raw[i : i + 256]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(texts)), b.column(1).slice(i, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    return pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")

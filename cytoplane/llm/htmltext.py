"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a sliding window; and the characters in one beyond which text surges.
WINDOW = 3
SURGE = 86

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL,
)
ANCHOR = re.compile(r"\s*(?:name|id)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)\s*/?", re.IGNORECASE)  # a place in the page, no link
ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Kinds of HTML elements, and names that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
OUTSIDE = frozenset("head nav footer aside form script style title textarea xmp iframe noembed noframes noscript template "
                    "button select dialog menu svg math object audio video canvas map".split())
MAIN = frozenset(("article", "main"))
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts adsense advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice newsletter subscribe subscription signup popup modal "
    "overlay comment comments disqus respond replies share sharing social related recommended footer masthead toolbar widget "
    "login search skip pagination pager copyright disclaimer".split()
)
#: What may stand beside such a name in a class or id, as in ``site-header`` or ``sidebar-left``.
AFFIXES = frozenset(
    "active area bar block bottom box btn button buttons container fixed footer form global header icon icons inner item items left "
    "link links list main mobile outer page post posts primary right secondary section site sticky sub top wrap wrapper".split()
)
#: Beside ``header`` these name the head of the article, which belongs to it, not that of the site.
ARTICLE_PARTS = frozenset("article content entry post posts section story title".split())
#: Elements that hold the article, whatever their class or id.
HOLDERS = frozenset(("html", "body", "main", "article"))


@dataclass
class Line:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    said: bool = False  # has letters or digits outside links
    outside: bool = False
    main: bool = False
    text: str = ""


def _names_outside(token: str, in_main: bool) -> bool:
    """Does a whole class or id say that this is not the article? Each of its parts must be such a name or an affix."""
    parts = [x for x in re.split(r"[^a-z]+", token) if x]
    heads = "header" in parts and not in_main and not ARTICLE_PARTS.intersection(parts)
    named = heads or any(x in OUTSIDE_NAMES for x in parts)
    return named and all(x in OUTSIDE_NAMES or x in AFFIXES for x in parts)


def _outside(name: str, attrs: str, in_main: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not in_main):
        return True
    if not attrs or attrs.isspace():
        return False
    for m in ATTR.finditer(attrs):
        key = m[1].lower()
        if key == "hidden":
            return True
        if key in ("class", "id", "role"):
            value = html.unescape(m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                if value.strip() in OUTSIDE_ROLES:
                    return True
            elif name not in HOLDERS and any(_names_outside(x, in_main) for x in value.split()):
                return True
    return False


def lines(page: str) -> list[Line]:
    """The page without markup, a line for each block, with where it stands."""
    found: list[Line] = []
    open_: list[tuple[str, bool, bool, bool]] = []  # name, outside, main (of the element and all around it), link
    count: Counter = Counter()  # open elements of each name, and links under ""
    line = Line()

    def cut() -> None:
        nonlocal line
        line.text = " ".join("".join(line.parts).split())
        if line.text:
            found.append(line)
        state = open_[-1] if open_ else ("", False, False, False)
        line = Line(outside=state[1], main=state[2])

    def shut(place: int) -> list[str]:
        closed = open_[place:]
        del open_[place:]
        for x in closed:
            count[x[0]] -= 1
            count[""] -= x[3]
        return [x[0] for x in closed]

    def add(raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw)
        line.parts.append(text)
        if count[""]:
            line.linked += len(text.strip())
        elif not line.said:
            line.said = any(map(str.isalnum, text))

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if not count[name]:  # closes nothing
                if name not in INLINE:
                    cut()
                continue
            place = len(open_) - 1
            while open_[place][0] != name:
                place -= 1
            turns = open_[place][1] != (open_[place - 1][1] if place else False)  # ends a part that is left out
            if any(x not in INLINE for x in shut(place)) or turns:
                cut()
            continue
        if name in VOID:
            if name not in INLINE:
                cut()
            continue
        outer = open_[-1] if open_ else ("", False, False, False)
        outside = outer[1] or _outside(name, m["attrs"], outer[2])
        if name not in INLINE:
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):  # these end one of their kind
                place = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] not in INLINE), None)
                if place is not None and open_[place][0] == name:
                    shut(place)
                    outer = open_[-1] if open_ else ("", False, False, False)
                    outside = outer[1] or _outside(name, m["attrs"], outer[2])
        block = name not in INLINE or outside != outer[1]
        main = outer[2] or name in MAIN or bool(re.search(r"\brole\s*=\s*[\"']?main\b", m["attrs"] or ""))
        link = name == "a" and not ANCHOR.fullmatch(m["attrs"] or "")
        open_.append((name, outside, main, link))
        count[name] += 1
        count[""] += link
        if block:
            cut()
        if name in RAW:
            stop = re.compile(rf"</{name}\b", re.IGNORECASE).search(page, at)
            at = stop.start() if stop else end
    cut()
    return found


def _listed(own: list[Line]) -> list[bool]:
    """For each line, whether it is one of ``WINDOW`` or more in a row whose words are all in links."""
    found: list[bool] = []
    for only, run in groupby(own, key=lambda x: x.linked > 0 and not x.said):
        n = len(list(run))
        found += [only and n >= WINDOW] * n
    return found


def extract(page: str | None) -> str:
    """Text between the surge and dive points of the line-block distribution.

    A line weighs its text outside links; a line in an element that is not the
    article (menu, header, footer, sidebar, notice, advert, form, comments)
    weighs nothing. A line in ``article`` or ``main`` weighs ``SURGE`` more, unless
    it is one of ``WINDOW`` lines in a row whose words are all in links: so any
    text there surges, lists of links there dive, and text elsewhere is judged by
    its own weight.
    Text surges where the sum over ``WINDOW`` lines passes ``SURGE`` and the
    line weighs something (any such line, if no sum on the page passes it), and
    dives where the sum is 0. Lines in between are kept, except those in such
    elements. Windows do not reach across the edge of ``article`` or ``main``.
    """
    parts = []
    for main, part in groupby(lines(page or ""), key=lambda x: x.main):
        own = list(part)
        more = SURGE + 1 if main else 0
        listed = _listed(own)
        weights = [0 if x.outside or y else max(len(x.text) - x.linked, 0) + more for x, y in zip(own, listed)]
        parts.append((own, weights, [sum(weights[i : i + WINDOW]) for i in range(len(weights))]))
    least = SURGE if any(s > SURGE for _, _, sums in parts for s in sums) else 0
    kept = []
    for own, weights, sums in parts:
        running = False
        for x, s, w in zip(own, sums, weights):
            running = s > 0 and (running or (s > least and w > 0))
            if running and not x.outside:
                kept.append(x.text)
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one line feed in page order. A null or empty
    page, or one without an article, gives an empty text. Markup that is cut
    off or not closed is read as far as it goes. Repeated rows give repeated
    results; other columns are not passed on; an empty table gives an empty
    result.
    """
    shape = "page_id long, url string, text string, n_chars long"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html")).mapInArrow(_extract, shape)

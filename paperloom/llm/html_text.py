"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block element. A line's weight is its text length, or nothing where it
lies in boilerplate (navigation, footers, asides, forms, scripts, adverts, notices, reader comments, by element or
by the words of class, id and role) or is mostly links. Weights are summed over a sliding window of lines. Text
surges where a window's sum leaves zero and the stretch reaches the surge threshold, and dives where the sum is zero
again; the weighted lines between surge and dive are kept, short ones too. If the page marks its article (or else its
main part) and more text lies inside the mark than outside, a line inside weighs MARK times its length and one outside
a MARK-th of it, and the two have their own windows; a smaller marked part is text like any other.

A word of class, id or role does not silence an element that holds the only marked article or the main part while none
is free, nor one that holds most of the page's text and has the word in modifiers alone ("has-sidebar", "ad-free").
Where these words silence all text that elements leave, none of them counts.

Defined cases: null or empty html gives an empty text; a page without a surge gives its longest stretch; an unclosed
element ends with its parent; stretches of equal weight: the first is the longest; repeated rows, and rows that repeat an id,
give a result each; a null id or url stays null; an empty table gives no rows; other input columns are ignored; the whole
html is read, however long or deep, in one pass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import small

WINDOW = 3
SURGE = 80  # weight in a window that makes a surge
MARK = 4
LINK_SHARE = 0.6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe title textarea svg math object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside form menu select button dialog head search fieldset label datalist".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notification alert popup modal overlay comment comments disqus reply replies "
    "respond discussion share sharing social related recommended newsletter subscribe subscription signup login footer masthead "
    "copyright pagination pager toolbar widget skip hidden disclaimer contentinfo complementary toc warning".split()
)
NOISE_STARTS = re.compile(r"(?:comment(?!ary)|advert|sponsor|cookie|breadcrumb|newsletter|sidebar|footer|subscri)")
CONTENT_WORDS = frozenset("article content main entry story body post".split())
UNSURE = frozenset("banner menu notice alert widget toc warning copyright share sharing social skip hidden".split())
#: Class tokens that tell what is beside or inside an element, not what it is.
MODIFIER = re.compile(r"(?:has|have|with|without|no|non|is|show|hide)[-_].*|.*[-_](?:free|less|on|off|open|closed|enabled|disabled|left|right|none)")
HEADER_WORDS = frozenset("header banner masthead".split())
KEEPERS = frozenset("html body main article".split())
#: An element's start closes an open one of these kinds.
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPES = frozenset("table ul ol dl select body html article main section div nav aside footer header form blockquote figure td th".split())


def _is_noise(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is boilerplate by itself, whether by a word of its class, id or role, and if so by modifiers alone."""
    if tag in KEEPERS:
        return False, False, False
    if tag in BOILERPLATE or tag == "header" and not in_article:
        return True, False, False
    if not attributes.strip():
        return False, False, False
    tokens: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            tokens.update(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split())
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False, False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False, False
    if not _noise_words(tokens, in_article):
        return False, False, False
    return False, True, not _noise_words({t for t in tokens if not MODIFIER.fullmatch(t)}, in_article)


def _noise_words(tokens: set[str], in_article: bool) -> bool:
    words = {w for t in tokens for w in _SPLIT.split(t)}
    noise = words & NOISE_WORDS | {w for w in words if NOISE_STARTS.match(w)}
    if words & HEADER_WORDS and not in_article:
        return True
    # "post-content-banner" may well be a part of the text, "article-comments" is none
    return bool(noise) and not (words & CONTENT_WORDS and noise <= UNSURE)


class _Open:
    """The open elements, innermost last, with the places of each tag, so that no end tag walks the whole stack."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, bool, int, int]] = []  # tag, boilerplate, mark, innermost element around that a word may silence
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.links = 0

    def top(self) -> tuple[str, bool, int, int]:
        return self.rows[-1] if self.rows else ("", False, 0, -1)

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1

    def push(self, tag: str, noise: bool, mark: int, around: int) -> None:
        self.places.setdefault(tag, []).append(len(self.rows))
        if tag in SCOPES:
            self.scopes.append(len(self.rows))
        self.rows.append((tag, noise, mark, around))
        self.links += tag == "a"

    def cut(self, place: int) -> None:
        while len(self.rows) > place:
            tag = self.rows.pop()[0]
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
            self.links -= tag == "a"

    def end(self, tag: str) -> None:
        """An end tag; one of an inline element ends nothing beyond the element that bounds it."""
        place = self.last(tag)
        if place >= 0 and (tag in BLOCKS or not self.scopes or self.scopes[-1] <= place):
            self.cut(place)

    def before(self, tag: str) -> None:
        """What the start of a block ends by itself."""
        place = max(map(self.last, ("p", *CLOSED_BY.get(tag, ()))))
        if place >= 0 and (not self.scopes or self.scopes[-1] <= place):
            self.cut(place)


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters inside links, boilerplate, mark) of each block line in page order; the mark is 2 inside
    an article element, 1 inside main alone, else 0. One pass, whatever is left open or closed twice."""
    out: list[tuple[str, int, bool, int, int]] = []
    stack = _Open()
    modified: list[tuple[bool, int]] = []  # of each element with a boilerplate word: in modifiers alone, the next one around it
    marks: list[tuple[str, int]] = []
    text: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            out.append((line, linked, *stack.top()[1:]))
        text.clear()
        linked = 0

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if stack.links:
                linked += len(" ".join(piece.split()))

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        closing = bool(m[1])
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if tag in VOID or not closing and m[3].endswith("/") and tag not in BLOCKS:
            continue
        if closing:
            stack.end(tag)
            continue
        if tag in BLOCKS:
            stack.before(tag)
        _, noise, mark, around = stack.top()
        mark = max(mark, 2 if tag == "article" else tag == "main")
        hard, word, modifier = _is_noise(tag, m[3], mark > 0)
        if word:
            modified.append((modifier, around))
            around = len(modified) - 1
        noise = noise or hard
        if tag in ("article", "main") and not noise:
            marks.append((tag, around))
        stack.push(tag, noise, mark, around)
    put(page[at:])
    flush()
    mute = _silent(out, modified, marks)
    rows = [(line, linked, noise or around >= 0 and mute[around], mark) for line, linked, noise, mark, around in out]
    if all(noise for *_, noise, _ in rows):
        return [(line, linked, noise, mark) for line, linked, noise, mark, _ in out]
    return rows


def _silent(lines: list[tuple[str, int, bool, int, int]], modified: list[tuple[bool, int]], marks: list[tuple[str, int]]) -> list[bool]:
    """Whether each of the elements with a boilerplate word is silenced, by its own or by one around it."""
    held, total = [0] * len(modified), 0
    for line, _, noise, _, around in lines:
        if not noise:
            total += len(line)
            if around >= 0:
                held[around] += len(line)
    for k in range(len(modified) - 1, -1, -1):
        if modified[k][1] >= 0:
            held[modified[k][1]] += held[k]
    spared: set[int] = set()
    if all(around >= 0 for _, around in marks):
        single = sum(tag == "article" for tag, _ in marks) == 1
        for tag, k in marks:
            while k >= 0 and k not in spared and (single or tag == "main"):
                spared.add(k)
                k = modified[k][1]
    mute: list[bool] = []
    for k, (modifier, around) in enumerate(modified):
        own = k not in spared and not (modifier and 2 * held[k] > total)
        mute.append(own or around >= 0 and mute[around])
    return mute


def kept_lines(weights: list[int], window: int, surge: int, inside: list[bool] | None = None) -> list[bool]:
    """Which lines lie between a surge and the following dive; the longest stretch if none surges.

    Lines that differ in `inside` weigh nothing to each other, so no stretch joins them.
    """
    n = len(weights)
    parts = [[w if i == part else 0 for w, i in zip(weights, inside, strict=True)] for part in (True, False)] if inside else [weights]
    stretches = []
    for own in parts:
        upto = [0, *accumulate(own)]
        sums = [upto[k + 1] - upto[max(0, k - window + 1)] for k in range(n)]
        start = None
        for k in range(n + 1):
            live = k < n and sums[k] > 0
            if live and start is None:
                start = k
            elif not live and start is not None:
                stretches.append((own, start, k, max(sums[start:k]), sum(own[start:k])))
                start = None
    chosen = [s for s in stretches if s[3] >= surge]
    if not chosen and stretches:
        chosen = [max(stretches, key=lambda s: s[4])]
    keep = [False] * n
    for own, a, b, _, _ in chosen:
        for k in range(a, b):
            keep[k] = keep[k] or own[k] > 0
    return keep


def _is_menu(line: str, linked: int) -> bool:
    return linked > LINK_SHARE * len(line)


def trusted_mark(lines: list[tuple[str, int, bool, int]]) -> int:
    """The highest mark with more text inside it than outside, without boilerplate and, outside, menus; else 0."""
    for level in (2, 1):
        inside = sum(len(line) for line, _, noise, mark in lines if not noise and mark >= level)
        outside = sum(len(line) for line, linked, noise, mark in lines if not noise and mark < level and not _is_menu(line, linked))
        if inside > outside:
            return level
    return 0


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = lines_of(page or "")
    marked = trusted_mark(lines)
    inside = [marked > 0 and mark >= marked for *_, mark in lines]
    weights = []
    for (line, linked, noise, _), within in zip(lines, inside, strict=True):
        size = len(line) * MARK * MARK if within else len(line) if marked else len(line) * MARK
        weights.append(0 if noise or not within and _is_menu(line, linked) else size)
    keep = kept_lines(weights, window, surge * MARK, inside if marked else None)
    return "\n".join(line for (line, *_), k in zip(lines, keep, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch], window: int, surge: int) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        texts = [extract(page, window, surge) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, window: int = WINDOW, surge: int = SURGE, id_column: str = "page_id", html_column: str = "html", url_column: str = "url") -> DataFrame:
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    return rows.mapInArrow(partial(_extract, window=window, surge=surge), "page_id long, url string, text string, n_chars long")

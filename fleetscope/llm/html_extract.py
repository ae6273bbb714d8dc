"""Main text of web pages by line-block distribution.

A page is stripped to lines, one per block of the page. Every line has a weight, the length of its text outside links.
The weights of a sliding window of lines are summed; where the sum surges over a level the text begins, where it
dives to zero it ends, and the lines between are kept. Menus, footers, scripts and the like leave a line without weight.

What a page says of its parts only changes weights. An element whose class, id or role names boilerplate, or a form,
weighs nothing unless it wraps the page, holding half of its text or more. The one article or main
element of a page adds a bonus to its lines, so that short paragraphs, lists and link lines of it are kept, and is parted
from its surroundings, unless far more text lies outside; several articles are a list and add none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset(
    "script style noscript template nav footer aside button select textarea iframe svg canvas object dialog head menu".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an open paragraph cannot hold, and that bound the search for it.
SCOPE = BLOCK - {"p"}
MARKS = frozenset(
    "ad ads advert advertisement adverts adsense sponsored sponsor promo promotion sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs masthead footer comment comments disqus reply replies respond cookie cookies consent gdpr notice banner popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
    "pagination pager toolbar hidden side sidenav subnav topnav topbar aside advertising adbox adslot adbanner commentlist alert "
    "notification notifications disclaimer copyright searchbox".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
_TOKEN = re.compile(r"[a-z0-9]+")
_SPACES = re.compile(r"\s+")
_CUT_OFF = re.compile(r"</?[A-Za-z][^<>]*")


class _Lines(HTMLParser):
    """Collects [text parts, characters outside links, article, parts] for each block of the page.

    ``article`` is the number of the outermost article or main element around the line (0: none), ``parts`` the numbers of
    the elements around it that a name or a form makes suspect.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # name, whether it hides its content, whether it is suspect
        self.hidden = self.article = self.articles = self.links = self.suspects = 0
        self.parts: tuple[int, ...] = ()
        self.lines: list[list] = []
        self.open: list | None = None

    def _break(self) -> None:
        self.open = None

    def _line(self) -> list:
        self.lines.append([[], 0, self.articles if self.article else 0, self.parts])
        return self.lines[-1]

    def _hides(self, tag: str, attrs: dict) -> bool:
        if tag in SKIP or tag == "header" and not self.article:
            return True
        if tag in ("html", "body", "main"):
            return False
        if (attrs.get("role") or "").lower() in ROLES or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        return "display:none" in (attrs.get("style") or "").replace(" ", "").lower()

    def _suspect(self, tag: str, attrs: dict) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if tag == "form" or (attrs.get("role") or "").lower() == "form":
            return True
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        if not names.strip():
            return False
        tokens = set(_TOKEN.findall(names.lower()))
        return bool(tokens & MARKS) or "header" in tokens and not self.article

    def handle_starttag(self, tag: str, attributes: list) -> None:
        attrs = dict(attributes)
        if tag in BLOCK:
            self._break()
            self._close_paragraph(tag)
        elif tag == "br" and self.open is not None:
            self.open[0].append(" ")
        if tag in VOID:
            return
        hides = self._hides(tag, attrs)
        suspect = not hides and not self.hidden and self._suspect(tag, attrs)
        self.stack.append((tag, hides, suspect))
        if hides:
            if not self.hidden:
                self._line()
            self.hidden += 1
        if suspect:
            self.suspects += 1
            self.parts = (*self.parts, self.suspects)
            self._break()
            self._line()
        if tag == "a":
            self.links += 1
        if tag in ("article", "main") and not self.hidden:
            self.articles += not self.article
            self.article += 1

    def _close_paragraph(self, tag: str) -> None:
        same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(tag, ())
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == "p" or name in same:
                self._pop(i)
                return
            if name in SCOPE:
                return

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, hides, suspect = self.stack.pop()
            if tag in ("article", "main") and not self.hidden:
                self.article -= 1
            if hides:
                self.hidden -= 1
                self._break()
            if suspect:
                self.parts = self.parts[:-1]
                self._break()
            if tag == "a":
                self.links -= 1
            if tag in BLOCK:
                self._break()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return
            if tag not in BLOCK and self.stack[i][0] in SCOPE:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, a slash closes only elements without content

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.open is None:
            if data.isspace():
                return
            self.open = self._line()
        self.open[0].append(data)
        if not self.links:
            self.open[1] += len(data.strip())


def keep_lines(weights: list[int], window: int, surge: int, cap: int | None = None) -> list[bool]:
    """Lines of the runs in which the window sums stay above zero and reach the surge level (at most ``cap``) somewhere."""
    half, n = window // 2, len(weights)
    sums = [sum(weights[max(0, i - half) : i + half + 1]) for i in range(n)]
    level = min(surge if cap is None else cap, max(sums, default=0) / 2)
    keep, i = [False] * n, 0
    while i < n:
        j = i
        while j < n and sums[j] > 0:
            j += 1
        if j > i and max(sums[i:j]) >= level:
            solid = [k for k in range(i, j) if weights[k]]  # lines without weight belong to the text only between others
            keep[solid[0] : solid[-1] + 1] = [True] * (solid[-1] + 1 - solid[0])
        i = max(j, i + 1)
    return keep


def visible(lines: list[list], surge: int) -> list[tuple[str, int, int]]:
    """(text, weight, article) of the lines; a suspect part becomes one line without weight, unless it wraps the page.

    It does if it holds half of the text and a surge of it, or all of the text.
    """
    read = [(_SPACES.sub(" ", "".join(parts)).strip(), n, article, around) for parts, n, article, around in lines]
    total = sum(n for _, n, _, _ in read)
    held: dict[int, int] = {}
    for _, n, _, around in read:
        for part in around:
            held[part] = held.get(part, 0) + n
    out, last = [], 0
    for text, n, article, around in read:
        hidden = next((part for part in around if 2 * held[part] < total or held[part] < min(surge, total) or not total), 0)
        if not hidden:
            out.append((text, n if text else 0, article))
        elif hidden != last:
            out.append(("", 0, article))
        last = hidden
    return out


def with_bonus(lines: list[tuple[str, int, int]], window: int, surge: int) -> list[tuple[str, int, int]]:
    """Lines with the weights of the page's one article raised and lines without weight set at its borders.

    No bonus is given where the page has several articles, or where the text outside is a text of its own (two surges or
    more) and more than three times that inside.
    """
    found = {article for text, _, article in lines if article and text}
    if len(found) != 1:
        return lines
    one = found.pop()
    inside, outside = (sum(n for _, n, a in lines if (a == one) == side) for side in (True, False))
    if outside >= 2 * surge and outside > 3 * inside:
        return lines
    out: list[tuple[str, int, int]] = []
    for k, (text, n, article) in enumerate(lines):
        if k and (article == one) != (lines[k - 1][2] == one):
            out += [("", 0, 0)] * window
        out.append((text, n + 2 * surge if article == one and text else n, article))
    return out


def main_text(html: str | None, window: int = 3, surge: int = 80) -> str:
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    if _CUT_OFF.fullmatch(page.rawdata):  # the page ends inside a tag
        page.rawdata = ""
    page.close()
    plain = visible(page.lines, surge)
    lines = with_bonus(plain, window, surge)
    keep = keep_lines([n for _, n, _ in lines], window, surge, 2 * surge if lines is not plain else None)
    return "\n".join(t for (t, _, _), k in zip(lines, keep, strict=True) if k and t)


def extract_main_text(pages: DataFrame, html: str = "html", window: int = 3, surge: int = 80) -> DataFrame:
    """Add ``text`` (blocks joined by a newline) and ``n_chars`` and drop the markup column.

    A null or empty page gives an empty text and 0; every other column, nulls and repeated rows included, passes
    through unchanged (columns named ``text`` or ``n_chars`` are replaced). No row is dropped; no text is shortened.
    No shuffle: each page is read once, where it lies.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    schema = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[names].copy()
            out["text"] = [main_text(x, window, surge) for x in pdf[html]]
            out["n_chars"] = [len(x) for x in out["text"]]
            yield out

    return pages.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{html}`")).mapInPandas(run, schema)

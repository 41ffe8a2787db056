"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, and the lengths of the
lines are summed over a sliding window. Where the sums surge from nothing a text block
begins, where they dive to nothing it ends; what lies between is kept. Parts that a
page marks as something else (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) are stripped with their content and leave a
gap of empty lines as wide as the window, so that the sums dive there. A class or id
marks such a part only if it is a known name, alone or beside neutral words, and not
if the element holds most of the text of the page, or of its article and main parts. The
borders of article and main parts are gaps, and the sums of their blocks count twice
against the share; the sums choose among all blocks on every page. Of several blocks, those whose
highest sum reaches a share of the page's highest are kept, and with them the lower
blocks of the same text: those in the same box, those beyond an advert or the like in
a box beside it, and those between kept ones. A line made of links only counts as
empty in the sums, but is kept between kept lines.

Defined results: a null or empty page has an empty text; unclosed elements end with
their parent; an unfinished reference at the end of a page is kept as text, an unfinished tag is
dropped with what follows, and a comment without an end takes the rest of the page; pages
are read in time that grows with their length, broken ones too; whole pages are read whatever their length; repeated rows get
equal texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

WINDOW = 3
SHARE = 0.25
BONUS = 2

# Fixed names: elements without text of their own, blocks, and parts that are not main text.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "head", "title", "select", "textarea", "button", "canvas", "audio", "video"}
ASIDE = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "legend", "li", "main", "ol", "option", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Start tags that end an open element of these names.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"br", "option", "li", "td", "th", "tr", "dd", "dt", "caption", "tbody", "tfoot", "thead"}
MARK = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|copyright|disqus|footer|foot|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|"
    r"overlay|pagination|pager|popup|promo\w*|recommend\w*|related|respond|share|sharing|sidebar|side|social|sponsor\w*|subscribe|signup|login|toolbar|widgets?|skiplink|tags?|\d+",
    re.I,
)
#: Words that may stand beside such a name in a class or id; any other word makes it the name of something else.
BESIDE = {
    "a", "area", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "cards", "center", "col", "column", "container", "content", "entry", "form", "global",
    "group", "holder", "icons", "inline", "inner", "item", "items", "left", "link", "links", "list", "main", "media", "mobile", "outer", "page", "panel", "post", "posts", "primary", "right",
    "row", "secondary", "section", "site", "skip", "slot", "sticky", "stories", "sub", "text", "thread", "top", "unit", "wrap", "wrapper",
}
#: Elements whose own text belongs together.
BOXES = {"div", "section", "article", "main", "td", "th", "center"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond"}
#: Parts of the page's frame; other asides (adverts, scripts, forms) may stand within a text.
FRAME = {"nav", "header", "footer", "menu", "navbar", "navigation", "foot", "masthead", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "toolbar", "banner", "contentinfo", "menubar"} | COMMENTS
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
SPACE = re.compile(r"\s+")
TAG = re.compile(r"<[A-Za-z]")
UNENDED = re.compile(r"<[A-Za-z/!?]")
#: A start tag with its attributes, whose quotes end and which holds no further start of a tag outside quotes.
WHOLE_TAG = re.compile(r"<[A-Za-z][^\s/>\"'<]*+(?:[^>\"'<]++|\"[^\"]*+\"|'[^']*+')*+>")
#: Characters in which a tag must end; longer ones are taken for text.
LONGEST_TAG = 1 << 18


def split_tags(html: str) -> str:
    """The page with the start tags that don't end set apart: their quotes become marks of their own."""
    out: list[str] = []
    done = 0
    for found in TAG.finditer(html):
        at = found.start()
        if at < done:
            continue
        whole = WHOLE_TAG.match(html, at, at + LONGEST_TAG)
        if whole:
            out.append(html[done : whole.end()])
            done = whole.end()
            continue
        # Up to the next start of a tag: without an end of its own it is no tag.
        following = TAG.search(html, at + 1)
        stop = following.start() if following else len(html)
        end = html.find(">", at, stop)
        if end < 0:
            out.append(html[done:at])
            done = stop
        else:
            out.append(html[done:at] + html[at : end + 1].replace('"', "").replace("'", ""))
            done = end + 1
    out.append(html[done:])
    return "".join(out)


def marks_of(names: str) -> set[str]:
    """The aside names among the classes and ids: whole ones, or beside none but neutral words."""
    found: set[str] = set()
    for name in names.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        marks = {w for w in words if MARK.fullmatch(w) and not w.isdigit()}
        # "tag-news" tells a subject, "post-tags" a list of them.
        if marks and all(w in BESIDE or MARK.fullmatch(w) for w in words):
            found |= marks
    return found


class Line(NamedTuple):
    text: str
    plain: int  # letters outside links
    main: bool  # in a marked main part
    asides: tuple[int, ...] = ()  # open elements that are asides by name
    held: int = 0  # how many of those hold the innermost main part
    gap: int = -1  # the named aside that a gap belongs to
    home: int = 0  # the outermost main part, else the innermost box; 0 is the page
    parent: int = 0  # the box around that one
    wall: bool = False  # a gap of the page's frame


class Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool, bool, bool]] = []  # name, left out, main part, named aside, box, part of the frame
        self.open: Counter[str] = Counter()  # how many elements of a name are open
        self.out = self.main = self.links = 0
        self.asides: list[int] = []
        self.named: list[bool] = []  # of each named aside, whether it is one of reader comments
        self.mains: list[int] = []
        self.boxes = [0, 0]
        self.n_boxes = self.outermost = 0
        self.parts: list[str] = []
        self.plain = 0
        self.lines: list[Line] = []

    def line(self, text: str, plain: int, gap: int = -1, wall: bool = False) -> Line:
        at = self.outermost if self.main else len(self.boxes) - 1
        return Line(text, plain, self.main > 0, tuple(self.asides), self.mains[-1] if self.mains else 0, gap, self.boxes[at], self.boxes[at - 1], wall)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append(self.line(text, self.plain))
        self.parts, self.plain = [], 0

    def gap(self, aside: int, wall: bool) -> None:
        self.lines.extend([self.line("", 0, aside, wall)] * WINDOW)

    def pop(self) -> None:
        name, left_out, main, aside, box, wall = self.stack.pop()
        self.open[name] -= 1
        if name in BLOCKS or left_out or main or aside:
            self.flush()
        self.out -= left_out
        self.main -= main
        if main:
            self.mains.pop()
        if box:
            self.boxes.pop()
        self.links -= name == "a"
        if aside:
            nth = self.asides.pop()
            if not self.out:
                self.gap(nth, wall)
        if left_out and not self.out:
            self.gap(-1, wall)

    def whole(self) -> list[Line]:
        """The lines without the asides by name; such an element stays if it holds most of the main parts' text or of the page's, unless it holds reader comments.

        Beside a main part, most of the page's text means a whole block that leaves the main parts less than their share.
        """
        total = sum(x.plain for x in self.lines)
        total_main = sum(x.plain for x in self.lines if x.main)
        inside, main_inside, n_lines = [0] * len(self.named), [0] * len(self.named), [0] * len(self.named)
        for x in self.lines:
            for nth, aside in enumerate(x.asides):
                inside[aside] += x.plain
                n_lines[aside] += x.plain > 0
                main_inside[aside] += x.plain if nth < x.held else 0
        stays = [
            not comments and (0 < total_main < 2 * m or (2 * i > total and (not total_main or (n >= WINDOW and SHARE * i > total_main))))
            for i, m, n, comments in zip(inside, main_inside, n_lines, self.named, strict=True)
        ]
        return [x for x in self.lines if all(stays[a] for a in x.asides) and not (x.gap >= 0 and stays[x.gap])]

    def close_to(self, names: set[str], stop: set[str]) -> None:
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            self.close_to(CLOSES[tag], {"ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "body"} - CLOSES[tag])
        if tag in ENDS_P:
            self.close_to({"p"}, {"div", "article", "section", "main", "body", "td", "li", "blockquote"})
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        named = dict(attrs)
        marks = f"{named.get('class') or ''} {named.get('id') or ''}"
        main = tag in ("article", "main") or (named.get("role") or "").lower() in ("main", "article")
        left_out = tag in SILENT or (tag in ASIDE and not (tag == "header" and self.main)) or "hidden" in named or (named.get("aria-hidden") or "") == "true"
        left_out = left_out or (tag not in ("html", "body", "article", "main") and (named.get("role") or "").lower() in ROLES)
        left_out = left_out or bool(re.search(r"display\s*:\s*none", named.get("style") or "", re.I))
        # An article inside a list of reader comments is left out with it; one that is a comment itself by its name too.
        if main and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", marks, re.I):
            left_out, main = True, False
        names = set() if left_out or tag in ("html", "body", "article", "main") else marks_of(marks)
        role = (named.get("role") or "").lower()
        wall = not FRAME.isdisjoint({tag, role, *names}) or (left_out and not FRAME.isdisjoint(marks_of(marks)))
        box = tag in BOXES or main
        if left_out and not self.out:
            self.flush()
            self.gap(-1, wall)
        if names:
            self.flush()
            if not self.out:
                self.gap(len(self.named), wall)
            self.asides.append(len(self.named))
            self.named.append(bool(names & COMMENTS))
        if main:
            self.mains.append(len(self.asides))
            if not self.main:
                self.outermost = len(self.boxes)
        if box:
            self.n_boxes += 1
            self.boxes.append(self.n_boxes)
        self.stack.append((tag, left_out, main, bool(names), box, wall))
        self.open[tag] += 1
        self.out += left_out
        self.main += main
        self.links += tag == "a"

    def parse_comment(self, i: int, report: bool = True) -> int:
        # Without an end it takes the rest, and no later one looks for the end again.
        return super().parse_comment(i, report) if self.rawdata.find("-->", i) >= 0 else len(self.rawdata)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br" or tag == "p" and not self.open["p"]:
            self.flush()
        elif tag not in VOID:
            barrier = {"article", "main", "body", "html"} if tag in ("p", "b", "i", "span", "a", "em", "strong") else set()
            self.close_to({tag}, barrier)

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.parts.append(data)
            if not self.links:
                self.plain += len(data.strip())


def finished(html: str) -> str:
    """The page without what follows its last bracket and starts a tag that never ends."""
    cut = UNENDED.search(html, html.rfind(">") + 1)
    return html[: cut.start()] if cut else html


def page_lines(html: str) -> list[Line]:
    """The lines of a page, without those of its asides."""
    parser = Lines()
    parser.feed(split_tags(finished(html)))
    parser.close()
    while parser.stack:
        parser.pop()
    parser.flush()
    return parser.whole()


def homes_of(line: Line) -> set[tuple[str, int]]:
    """What a line shares with the other lines of its text; main parts side by side belong together."""
    return {("in", line.home), ("beside", line.parent)} if line.main else {("in", line.home)}


def bordered(lines: list[Line]) -> list[Line]:
    """The lines with a gap at each border of a main part."""
    found: list[Line] = []
    before = None
    for x in lines:
        if x.text:
            home = x.home if x.main else None
            if found and home != before:
                found += [Line("", 0, False, wall=True)] * WINDOW
            before = home
        found.append(x)
    return found


def joined(lines: list[Line], one: int, other: int) -> bool:
    """Whether nothing but asides within a text lie between two lines of one box, or of neighbouring boxes."""
    a, b = lines[one], lines[other]
    close = a.home == b.home or bool(({a.home, a.parent} & {b.home, b.parent}) - {0})
    return close and not any(x.wall for x in lines[one + 1 : other])


def kept_parts(lines: list[Line], sizes: np.ndarray, parts: list[tuple[int, int]], high: list[bool], share: float) -> list[tuple[int, int]]:
    """The high parts and the lower ones of the same texts: in their boxes, next to them past an inline aside, or between them."""
    homes: set[tuple[str, int]] = set()
    for (a, b), is_high in zip(parts, high, strict=True):
        if is_high:
            held: dict[tuple[str, int], int] = {}
            for i in range(a, b + 1):
                for home in homes_of(lines[i]) if sizes[i] else ():
                    held[home] = held.get(home, 0) + int(sizes[i])
            homes |= {home for home, size in held.items() if size >= share * sizes[a : b + 1].sum()}
    keep = [is_high or any(sizes[i] and not homes.isdisjoint(homes_of(lines[i])) for i in range(a, b + 1)) for (a, b), is_high in zip(parts, high, strict=True)]
    for i in range(1, len(parts)):
        keep[i] = keep[i] or (keep[i - 1] and joined(lines, parts[i - 1][1], parts[i][0]))
    for i in range(len(parts) - 2, -1, -1):
        keep[i] = keep[i] or (keep[i + 1] and joined(lines, parts[i][1], parts[i + 1][0]))
    at = np.flatnonzero(keep)
    return parts[at[0] : at[-1] + 1]


def main_text(html: str | None, window: int = WINDOW, share: float = SHARE) -> str:
    """The text between surges and dives of the windowed line lengths."""
    if not html:
        return ""
    lines = page_lines(html)
    if any(x.main for x in lines):
        lines = bordered(lines)
    sizes = np.array([x.plain for x in lines], dtype=np.int64)
    if not sizes.any():
        return ""
    # sums[i]: letters of lines i to i + window - 1.
    sums = np.convolve(sizes, np.ones(window, dtype=np.int64))[window - 1 :]
    surges = np.flatnonzero((sums > 0) & (np.concatenate(([0], sums[:-1])) == 0))
    dives = np.flatnonzero((sums > 0) & (np.concatenate((sums[1:], [0])) == 0))
    # The first sum above nothing already looks window - 1 lines ahead; lines of a main part count more.
    high = [bool((BONUS if lines[b].main else 1) * sums[a : b + 1].max() >= share * sums.max()) for a, b in zip(surges, dives, strict=True)]
    parts = [(int(a + np.flatnonzero(sizes[a : b + 1])[0]), int(b)) for a, b in zip(surges, dives, strict=True)]
    kept: list[str] = []
    end = None
    for a, b in kept_parts(lines, sizes, parts, high, share):
        if end is not None:
            # Lines of links between two parts, if they stand in the box of one of them.
            kept += [x.text for x in lines[end + 1 : a] if x.text and x.home in (lines[end].home, lines[a].home)]
        kept += [x.text for x in lines[a : b + 1] if x.text]
        end = b
    return " ".join(kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the html but with ``text`` and ``n_chars``; columns of those names are replaced."""
    kept = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(names)).to_pylist()]
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*names, "text", "n_chars"])

    schema = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*[pages[n] for n in names], pages[html]).mapInArrow(run, schema)

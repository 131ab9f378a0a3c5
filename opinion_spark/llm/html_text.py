"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold clusters.

The standard library's parser streams a page's events. Each block of text
becomes a line with its characters and tags. The ratio of text to tags, smoothed
over neighbouring lines by a Gaussian, splits the lines into content and the
rest at one standard deviation. The article, or else the innermost element around
all content and the headings above it, is the page's text region, and its blocks
are the text. Elements that by their tag hold no article text are left out from
the start. Those that by a whole name, or as forms, seem to hold none are left
out unless they have an article or the page's heading; these and those whose role
or part of a name says so are weighed by their part of the content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from opinion_spark.functions.columns import named
from opinion_spark.llm.batches import map_blocks

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TEXT = frozenset(
    "script style noscript template head title nav footer aside button select option textarea iframe object svg math canvas audio video dialog menu map".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
# Between the words of a block, but no block of their own.
SPACING = frozenset("br td th".split())
ARTICLE = frozenset("article main".split())
# Parts of a text rather than regions.
TEXT_PARTS = frozenset("h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr pre blockquote figure figcaption details summary address p".split())
NEVER_LEFT_OUT = frozenset("html body article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar widget menu navbar nav navigation "
    "breadcrumb breadcrumbs footer masthead toolbar share sharing social related recommended recommendations comment comments disqus "
    "respond reply replies pagination pager copyright login search paywall skip".split()
)

#: Lines to either side that smoothing looks at, the threshold in standard deviations, and the part of all content from which on a weighed element stays.
RADIUS, THRESHOLD, LARGE_PART = 2, 1.0, 0.5

_SPACE = re.compile(r"[\s\x00]+")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Line:
    """One block of text."""

    parts: list[tuple[int, str]] = field(default_factory=list)  # the innermost suspect around each, and its characters
    tags: int = 0
    region: int = -1
    heading: bool = False
    text: str = ""


@dataclass
class Suspect:
    """An element that seems to hold no article text."""

    parent: int
    sure: bool  # a whole name says so, or it is a form
    in_article: bool
    named: bool = False  # a whole name says so
    holds_article: bool = False
    holds_heading: bool = False
    marked: bool = False  # text of an article inside has been seen
    chars: int = 0


def _left_out(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    if tag in NEVER_LEFT_OUT:
        return False
    return tag in NEVER_TEXT or tag == "header" and not in_article or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style") or ""))


def _suspect(tag: str, attrs: dict[str, str | None], in_article: bool) -> tuple[bool, bool]:
    """Whether form, role, class or id speak against the element, and whether a whole name does."""
    if tag in NEVER_LEFT_OUT:
        return False, False
    found = tag == "form" or (attrs.get("role") or "").lower() in BOILERPLATE_ROLES
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [word.lower() in BOILERPLATE_NAMES for word in _NAMES.findall(name)]
        header = name.lower() == "header" and not in_article
        if header or words and all(words):
            return True, True
        found = found or any(words)
    return found, False


class LineParser(HTMLParser):
    """Lines of a page, and the elements that hold them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # Regions are elements that hold lines: parent and tag of each; 0 is the page.
        self.parents, self.region_tags = [-1], ["html"]
        self.suspects: list[Suspect] = []
        self.article_text = False
        # Level of the page's heading (the first of the highest level) and the suspect around it.
        self.main_heading = (7, -1)
        # Open elements: tag, left out, region, inside an article, suspect, level of the heading around (0: none).
        self._open: list[tuple[str, bool, int, bool, int, int]] = []
        self._line = Line()
        self._tags = 0
        self._open_tags: Counter[str] = Counter()
        self._blocks: list[int] = []  # places of open elements that are not inline
        self._unclosed = self._no_end = False

    def parse_comment(self, i: int, report: bool = True) -> int:
        """As the parser does, but an end that is missing is looked for once."""
        end = -1 if self._unclosed else super().parse_comment(i, report)
        self._unclosed = end < 0
        return end

    def _tag_ends(self, i: int) -> bool:
        """Whether any tag can end from here on; when none can, that holds for the rest."""
        self._no_end = self._no_end or self.rawdata.find(">", i) < 0
        return not self._no_end

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if self._tag_ends(i) else -1

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self._tag_ends(i) else -1

    def parse_pi(self, i: int) -> int:
        return super().parse_pi(i) if self._tag_ends(i) else -1

    def _close_from(self, at: int) -> None:
        while len(self._open) > at:
            self._open_tags[self._open.pop()[0]] -= 1
        while self._blocks and self._blocks[-1] >= at:
            self._blocks.pop()

    def _top(self) -> tuple[str, bool, int, bool, int, int]:
        return self._open[-1] if self._open else ("", False, 0, False, -1, 0)

    def _break(self) -> None:
        line = self._line
        line.text = _text(line.parts)
        if line.text:
            line.tags = self._tags
            self.lines.append(line)
            self._tags = 0
        self._line = Line()

    def _close_paragraph(self, tag: str) -> None:
        """A block ends an open paragraph, and a list item the one before it."""
        if self._blocks:
            name = self._open[self._blocks[-1]][0]
            if name == "p" or name == tag == "li":
                self._close_from(self._blocks[-1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in SPACING:
            self._line.parts.append((self._top()[4], " "))
        if tag in VOID:
            if tag == "hr":
                self._break()
            return
        if tag not in INLINE and tag not in SPACING:
            self._break()
            self._close_paragraph(tag)
        _, out, region, in_article, suspect, heading = self._top()
        named_as = dict(attrs)
        out = out or _left_out(tag, named_as, in_article)
        if not out and (named_as or tag == "form"):
            suspected, sure = _suspect(tag, named_as, in_article)
            if suspected:
                self.suspects.append(Suspect(suspect, sure or tag == "form", in_article, sure))
                suspect = len(self.suspects) - 1
        if not out and tag not in INLINE and tag != "p" and tag not in SPACING:
            self.parents.append(region)
            self.region_tags.append(tag)
            region = len(self.parents) - 1
        heading = heading or (int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else 0)
        self._open_tags[tag] += 1
        if tag not in INLINE:
            self._blocks.append(len(self._open))
        self._open.append((tag, out, region, in_article or tag in ARTICLE, suspect, heading))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in SPACING:
            self._line.parts.append((self._top()[4], " "))
        elif tag not in INLINE:
            self._break()
        if self._open_tags[tag]:
            at = len(self._open) - 1
            while self._open[at][0] != tag:
                at -= 1
            self._close_from(at)

    def handle_data(self, data: str) -> None:
        _, out, region, in_article, suspect, heading = self._top()
        if not out:
            if data.strip():
                if self._line.region < 0:
                    self._line.region, self._line.heading = region, heading > 0
                if in_article and not self.article_text:
                    self.article_text = True
                if heading and heading < self.main_heading[0]:
                    self.main_heading = (heading, suspect)
                while in_article and suspect >= 0 and not self.suspects[suspect].marked:
                    around = self.suspects[suspect]
                    around.marked = True
                    around.holds_article = around.holds_article or not around.in_article
                    suspect = around.parent
            self._line.parts.append((self._top()[4], data))

    def finish(self) -> list[Line]:
        self.close()
        self._break()
        return self.lines


def smooth(ratios: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Gaussian mean over the lines within ``radius``; at the ends over those that there are."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(radius / 2, 0.5)) ** 2)
    return np.convolve(ratios, weights)[radius:len(ratios) + radius] / np.convolve(np.ones(len(ratios)), weights)[radius:len(ratios) + radius]


def content_lines(lines: Sequence[Line]) -> np.ndarray:
    """Which lines are in the content cluster."""
    ratios = np.array([len(line.text) / max(1, line.tags) for line in lines])
    smoothed = smooth(ratios)
    return smoothed >= THRESHOLD * smoothed.std()


def _text(parts: Sequence[tuple[int, str]]) -> str:
    return _SPACE.sub(" ", "".join(data for _, data in parts)).strip(" ")


def without_suspects(lines: Sequence[Line], suspects: Sequence[Suspect], article_text: bool, heading_in: int = -1) -> list[Line]:
    """Lines without the text of suspects that have no article and no large part of the content.

    A whole name or a form is enough, whatever the size, where neither an article nor the page's
    heading is inside (``heading_in``: the innermost suspect around it); beside an article with
    text a whole name is enough. Where this leaves no text, as of a form around a whole page without
    headings, all are weighed.
    """
    total = 0
    while heading_in >= 0:
        suspects[heading_in].holds_heading = True
        heading_in = suspects[heading_in].parent
    for line, is_content in zip(lines, content_lines(lines), strict=True):
        if is_content:
            total += len(line.text)
            for at, data in line.parts:
                if at >= 0:
                    suspects[at].chars += len(_SPACE.sub(" ", data))
    for suspect in reversed(suspects):  # children come after their parents
        if suspect.parent >= 0:
            suspects[suspect.parent].chars += suspect.chars
    for by_name in (True, False):
        gone: list[bool] = []
        for s in suspects:
            beside = s.named and article_text and not s.in_article
            surely = beside or by_name and s.sure and not s.holds_heading
            gone.append(s.parent >= 0 and gone[s.parent] or not s.holds_article and (surely or s.chars < LARGE_PART * total))
        if any(at < 0 or not gone[at] for line in lines for at, data in line.parts if not data.isspace()):
            break
    out, tags = [], 0
    for line in lines:
        line.tags += tags
        if any(at >= 0 and gone[at] for at, _ in line.parts):
            line.parts = [(at, data) for at, data in line.parts if at < 0 or not gone[at]]
            line.text = _text(line.parts)
        tags = 0 if line.text else line.tags
        if line.text:
            out.append(line)
    return out


def _path(region: int, parents: Sequence[int]) -> list[int]:
    out = []
    while region >= 0:
        out.append(region)
        region = parents[region]
    return out[::-1]


def _region(lines: Sequence[Line], held: Sequence[int], parents: Sequence[int], tags: Sequence[str]) -> int:
    """The article (or else main) around all the ``held`` lines, or else the innermost region around them."""
    parts_of = [0] * len(parents)
    for i in held:
        parts_of[lines[i].region] += 1
    for r in range(len(parents) - 1, 0, -1):  # children come after their parents
        parts_of[parents[r]] += parts_of[r]
    best = 0
    for r in range(1, len(parents)):
        if parents[r] == best and parts_of[r] == len(held):
            best = r
    path = _path(best, parents)
    for kind in ("article", "main"):
        for r in path:
            if tags[r] == kind:
                return r
    while tags[best] in TEXT_PARTS:
        best = parents[best]
    return best


def extract_text(html: str | None) -> str:
    """The main text, one block a line; empty where there is none."""
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    lines = parser.finish()
    if lines and parser.suspects:
        lines = without_suspects(lines, parser.suspects, parser.article_text, parser.main_heading[1])
    if not lines:
        return ""
    content = content_lines(lines)
    first, last = int(content.argmax()), len(content) - 1 - int(content[::-1].argmax())
    # The content lines and the headings above them, in the region and outside of it.
    held = [i for i, line in enumerate(lines) if content[i] or line.heading and i < first]
    top = _region(lines, held, parser.parents, parser.region_tags)
    inside = {top}
    for r in range(top + 1, len(parser.parents)):
        if parser.parents[r] in inside:
            inside.add(r)
    chosen = [i for i, line in enumerate(lines) if line.region in inside]
    if parser.region_tags[top] in ("html", "body"):
        # No element of its own: from the first to the last content line, with the headings above it.
        chosen = [i for i in chosen if held[0] <= i <= last]
    return "\n".join(lines[i].text for i in chosen)


def extract_pages(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``, from the whole html.

    A null or empty page, and one without text, gives an empty text. Broken
    markup is read as far as the parser goes. Null or repeated ids and urls are
    kept as they are.
    """
    def run(c: dict[str, list]) -> dict[str, list]:
        texts = [extract_text(h) for h in c["html"]]
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    source = pages.select(named(key).cast("bigint").alias("page_id"), named(url).cast("string").alias("url"), named(html).alias("html"))
    return map_blocks(source, run, "page_id bigint, url string, text string, n_chars bigint", text="html")

"""Main text of web pages by tag-path ratios.

Every block of text has a root-to-leaf tag path. Text length and punctuation are
summed per path, so that a short paragraph counts with the long ones beside it while a
menu entry counts with its menu. The ratios are smoothed over neighbouring blocks,
fused into one score and cut at a threshold taken from their spread. The blocks above
it are content and point out the elements of the article: all article elements that hold
such blocks, or else the least element that holds all of them. Content and the shorter
blocks in those elements are returned, without the parts that are page furniture by their tag
or role, or that consist of links. Class and id words of furniture are a prior: they lower the
scores of what stands in the element, unless it holds an article or most of the text. Forms,
and elements with a class or id word of reader comments or adverts, go as a whole, inside an
article too, under the same condition. The header of an article belongs to it.

A page is one row and is read in one pass with work in proportion to its length.

Defined cases: null and empty html give an empty text; broken, unclosed and deeply
nested markup is read as far as it goes (an unfinished tag at the end is dropped);
repeated rows are read each on their own; an empty table gives an empty result; other columns
are carried along and ``text`` and ``n_chars`` replace columns of the same name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm.rows import slices

# Names of HTML elements by their role, and the words that mark page furniture.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "img", "wbr"}
FURNITURE = {"head", "nav", "header", "footer", "aside", "button", "select", "option", "dialog", "menu", "svg",
             "object", "canvas", "audio", "video", "map", "figure-nav"} | RAW
FURNITURE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog",
                  "form", "menu", "menubar"}
HINT_WORD = (
    r"(?:ad|ads|advert|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|popup|modal|overlay|"
    r"cookie|cookies|consent|gdpr|notice|notification|alert|disclaimer|sidebar|side|aside|widget|widgets|menu|nav|navbar|"
    r"navigation|breadcrumb|breadcrumbs|header|masthead|topbar|toolbar|footer|copyright|colophon|comment|comments|"
    r"commentlist|disqus|reply|replies|respond|reactions|share|sharing|social|follow|related|recommended|recommendations|"
    r"more-stories|newsletter|subscribe|subscription|signup|login|search|pagination|pager|tags|tagcloud|teaser|teasers|skip|hidden)")
# A class or id of these words only: "cookie-notice", but neither "has-sidebar" nor "overflow-hidden".
HINT = re.compile(rf"(?:^|\s){HINT_WORD}(?:[-_]+{HINT_WORD})*(?=\s|$)")
# A class or id with one of these among its parts: "comment-list", "user-comments", "ad-slot".
APART = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|adsense|sponsor|sponsored|comment|comments|commentlist|disqus|replies)"
                   r"(?=[\s_-]|$)")
PRIOR = 0.1  # what such a class leaves of a block's score
ARTICLE = {"article", "main"}
# What an opening tag closes, with all that is open inside: the first of these groups found within the nearest scope.
CLOSES = {"li": ([("li",)], ("ul", "ol", "menu", "dir")), "dt": ([("dt", "dd")], ("dl",)), "dd": ([("dt", "dd")], ("dl",)),
          "tr": ([("tr",), ("td", "th")], ("table",)), "td": ([("td", "th")], ("tr", "table")),
          "th": ([("td", "th")], ("tr", "table")), "option": ([("option",)], ("select", "datalist"))}
CLOSES |= {part: ([("thead", "tbody", "tfoot"), ("tr",)], ("table",)) for part in ("thead", "tbody", "tfoot")}
MARKS = ".,;:!?…。，、！？"

TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"""
                 r"""(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<loose_end>/?)(?P<loose>[a-zA-Z][^\s/>]*+)[^>]*+>|"""
                 r"""[!?/][^>]*+>|(?P<cut>[!?/a-zA-Z][^>]*+\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:(?P<key>class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?)""",
                       re.I)


class Block(NamedTuple):
    path: int
    element: int
    text: str
    link_chars: int


class Page:
    """Blocks of a page with their paths and elements."""

    def __init__(self, source: str):
        self.parent, self.tag, self.furniture, self.named, self.apart = [-1], ["#"], [False], [False], [False]
        self.articles = 0  # open article elements
        self.paths: dict[tuple[int, str], int] = {}
        self.path = [0]
        self.blocks: list[Block] = []
        self.open = [0]
        self.places: dict[str, list[int]] = {}  # places in ``open`` of the elements of each name
        self.links = self.link_chars = 0
        self.pieces: list[str] = []
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while found := TAG.search(source, at):
            self._text(source[at:found.start()])
            at = found.end()
            if name := found["name"] or found["loose"]:
                name = name.lower()
                if found["end"] or found["loose_end"]:
                    self._end(name)
                else:
                    self._start(name, found["attributes"] or "")
                    if name in RAW:
                        close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                        at = close.start() if close else len(source)
        self._text(source[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self.links:
                self.link_chars += len(text)

    def _flush(self) -> None:
        if self.pieces:
            if text := " ".join("".join(self.pieces).split()):
                self.blocks.append(Block(self.path[self.open[-1]], self.open[-1], text, min(self.link_chars, len(text))))
            self.pieces = []
        self.link_chars = 0

    def _start(self, name: str, attributes: str) -> None:
        if name in INLINE:
            self.links += name == "a"
            return
        self._flush()
        if name in VOID:
            return
        self.links = 0
        groups, scopes = CLOSES.get(name, ((), ()))
        scope = self._last(scopes)
        closed = next((at for group in groups if (at := self._last(group)) > scope), 0)
        if closed:
            self._close(closed)
        elif self.tag[self.open[-1]] == "p":
            self._close(len(self.open) - 1)
        above = self.open[-1]
        hint, named, apart = "", False, name == "form"
        furniture = self.furniture[above] or name in FURNITURE and not (name == "header" and self.articles)
        if attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                value = "".join(values).lower()
                key = key.lower()
                if key == "role":
                    furniture = furniture or value in FURNITURE_ROLE
                elif key == "hidden" or key == "aria-hidden" and value == "true":
                    furniture = True
                elif key in ("class", "id"):
                    hint += "." + value
                    named = named or bool(HINT.search(value))
                    apart = apart or bool(APART.search(value)) and name not in ("html", "body", "main")
        self.parent.append(above)
        self.tag.append(name)
        self.furniture.append(furniture)
        self.named.append(named and name not in ("main", "html", "body"))
        self.apart.append(apart)
        self.articles += name in ARTICLE
        self.path.append(self.paths.setdefault((self.path[above], name + hint), len(self.paths) + 1))
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append(len(self.tag) - 1)

    def _end(self, name: str) -> None:
        if name in INLINE:
            self.links = max(0, self.links - (name == "a"))
            return
        self._flush()
        self.links = 0
        if depth := self._last((name,)):
            self._close(depth)

    def _last(self, names: tuple[str, ...]) -> int:
        """Place of the innermost open element of one of these names, 0 if there is none."""
        return max((places[-1] for name in names if (places := self.places.get(name))), default=0)

    def _close(self, depth: int) -> None:
        for element in self.open[depth:]:
            self.places[self.tag[element]].pop()
            self.articles -= self.tag[element] in ARTICLE
        del self.open[depth:]


def set_apart(page: Page, blocks: list[Block], marks: list[bool], strictly: bool) -> np.ndarray:
    """Which blocks stand in a marked element that holds no article and not most of the text.

    Without ``strictly`` the share of the text counts only for article elements, and for all on a
    page without any. An article element is none here if it is marked itself and holds little.
    """
    chars = np.zeros(len(page.tag))
    for block in blocks:
        chars[block.element] += len(block.text)
    for element in range(len(page.tag) - 1, 0, -1):
        chars[page.parent[element]] += chars[element]
    little = 2 * chars <= chars[0]
    article = [tag in ARTICLE and chars[e] > 0 and not (marks[e] and little[e]) for e, tag in enumerate(page.tag)]
    holds = list(article)
    for element in range(len(page.tag) - 1, 0, -1):
        holds[page.parent[element]] = holds[page.parent[element]] or holds[element]
    found = np.zeros(len(page.tag), dtype=bool)
    for element in range(1, len(page.tag)):
        free = little[element] or not strictly and holds[0] and page.tag[element] not in ARTICLE
        found[element] = found[page.parent[element]] or marks[element] and not holds[element] and free
    return found[[b.element for b in blocks]]


def path_scores(page: Page, blocks: list[Block]) -> np.ndarray:
    """Smoothed and fused ratio of each block: text and punctuation per node of its tag path."""
    paths = np.array([b.path for b in blocks])
    chars = np.array([len(b.text) for b in blocks], dtype=float)
    marks = np.array([sum(map(b.text.count, MARKS)) for b in blocks], dtype=float)
    linked = np.array([b.link_chars for b in blocks], dtype=float)
    _, of = np.unique(paths, return_inverse=True)
    nodes = np.bincount(of)
    text_ratio = (np.bincount(of, chars - linked) / nodes)[of]
    mark_ratio = (np.bincount(of, marks) / nodes)[of]

    def smooth(x: np.ndarray) -> np.ndarray:
        padded = np.concatenate([x[:1], x, x[-1:]])
        return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]

    return np.sqrt(smooth(text_ratio) * (1 + smooth(mark_ratio)))


def main_text(source: str | None) -> str:
    """The article of a page, its blocks joined by one space."""
    if not source:
        return ""
    page = Page(source)
    blocks = [b for b in page.blocks if not page.furniture[b.element]]
    blocks = [b for b, gone in zip(blocks, set_apart(page, blocks, page.apart, True)) if not gone]
    if not blocks:
        return ""
    marked = set_apart(page, blocks, page.named, False)
    scores = path_scores(page, blocks) * np.where(marked, PRIOR, 1)
    content = scores >= min(scores.std(), 0.5 * scores.max()) if len(blocks) > 1 else scores >= 0
    inside = _region(page, blocks, content)
    linked: dict[int, list[int]] = {}
    for block in blocks:
        sums = linked.setdefault(block.path, [0, 0])
        sums[0] += block.link_chars
        sums[1] += len(block.text)
    kept = [b.text for b, is_content, is_marked in zip(blocks, content, marked)
            if (inside[b.element] and is_content or (inside[b.element] or is_content) and not is_marked) and 2 * linked[b.path][0] <= linked[b.path][1]]
    return " ".join(kept)


def _region(page: Page, blocks: list[Block], content: np.ndarray) -> np.ndarray:
    """Elements in which short blocks stand too: every article element with content, or else the least one that holds all content."""
    weight = np.zeros(len(page.tag))
    for block, is_content in zip(blocks, content):
        weight[block.element] += len(block.text) * is_content
    for element in range(len(weight) - 1, 0, -1):
        weight[page.parent[element]] += weight[element]
    inside = np.array([tag in ARTICLE for tag in page.tag]) & ~np.array(page.furniture) & (weight > 0)
    # Of several article elements one with a furniture class and little of the content is a teaser.
    inside &= ~(np.array(page.named) & (2 * weight <= weight[0]))
    if not inside.any():
        inside[max(np.flatnonzero(weight == weight[0]))] = True
    for element in range(1, len(inside)):
        inside[element] |= inside[page.parent[element]]
    return inside


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with text, the main text of ``column``, and n_chars, its code points; ``column`` is dropped."""
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(source) for source in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*kept, "text", "n_chars"])

    return pages.select(*kept, column).mapInArrow(read, schema)

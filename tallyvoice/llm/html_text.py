"""Main text of web pages by line-block distribution (operator 3).

Markup is stripped into lines: every block-level tag ends a line, scripts, styles, comments and the
inside of structural boilerplate (menus, headers, footers, sidebars, forms, adverts, notices, reader
comments) leave none. Worths of lines are summed over sliding windows of ``window`` lines; main text
surges where a sum reaches the threshold and dives where no window over a line does.

Where a page marks its article (``<article>`` or ``<main>``), the mark comes first: every line inside is
worth its whole length and the threshold is one character, so that short or linked lines of an article
stay; lines outside are worth nothing. Where a page has no mark, a line is worth its characters outside
links, and the threshold is ``SURGE`` of the largest sum of the page: the distribution alone decides.

Tags are read as HTML has it: quotes matter only around attribute values, a tag or quote that is never
closed takes the rest of the page. One forward scan, linear in the page.

A map over rows: no shuffle, memory bounded by one Arrow slice.

Defined results: a null or empty page, or one without text, gives an empty text of 0 characters;
unclosed or stray tags are tolerated, an unclosed region ends with its parent or the page; repeated
rows give equal rows; null ids stay null; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Sums run over this many lines.
WINDOW = 3
#: On pages without a mark a window surges from this share of the page's largest sum on.
SURGE = 0.25

#: The start of a tag, comment or declaration; its end is found by ``TAG_END`` and plain searches.
TAG = re.compile(r"<(?:(/?)([A-Za-z][A-Za-z0-9:-]*)|!--|[!?/])")
#: From behind a tag's name to its end; possessive, so that it never tries a place twice.
TAG_END = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+)>", re.S)
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object")}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("nav header footer aside form button select menu dialog head".split())
MAIN = {"article", "main"}
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Names that mark boilerplate, alone or as the last part of a name such as ``site-footer``.
BOILERPLATE = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "consent disclaimer footer header menu modal nav navbar navigation newsletter notice notices popup promo related replies share "
    "sharing sidebar social sponsor sponsored subscribe widget".split()
)
#: Those that mark it as the first part too, as in ``comment-list``.
LEADING = set("ad ads advert advertisement comment comments cookie cookies nav navbar newsletter sidebar sponsored".split())
#: Space of HTML and every other white space character.
WHITE = re.compile(r"\s+")


class Lines:
    """The lines of a page: their text, and how many characters of it count as main text."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.worth: list[int] = []
        self.inside: list[bool] = []
        self._parts: list[str] = []
        self._linked = 0
        #: Open elements: (name, drops its text, marks the main text), and how many of each name.
        self._open: list[tuple[str, bool, bool]] = []
        self._names_open: Counter[str] = Counter()
        self._drops = self._mains = self._links = 0
        self._read(page)

    def _break(self) -> None:
        line = WHITE.sub(" ", html.unescape("".join(self._parts))).strip()
        if line:
            self.text.append(line)
            self.worth.append(len(line) if self._mains else max(len(line) - self._linked, 0))
            self.inside.append(self._mains > 0)
        self._parts, self._linked = [], 0

    def _words(self, text: str) -> None:
        if text and not self._drops:
            self._parts.append(text)
            if self._links:
                self._linked += len(text)

    def _close(self, name: str) -> None:
        closing = self._names_open[name] > 0
        while closing:
            last, drops, main = self._open.pop()
            self._names_open[last] -= 1
            self._drops -= drops
            self._mains -= main
            closing = last != name

    def _read(self, page: str) -> None:
        at = 0
        while True:
            token = TAG.search(page, at)
            if token is None:
                break
            self._words(page[at : token.start()])
            if token[2] is None:
                mark = "-->" if token[0] == "<!--" else ">"
                end = page.find(mark, token.end())
                at = len(page) if end < 0 else end + len(mark)
                continue
            rest = TAG_END.match(page, token.end())
            if rest is None:
                at = len(page)
                break
            at, attributes = rest.end(), rest[1]
            name, closing = token[2].lower(), bool(token[1])
            if name in INLINE:
                if name == "a":
                    self._links = 0 if closing else 1
                elif name == "br":
                    self._words(" ")
                if not closing and name not in VOID and self._boilerplate(attributes):
                    self._push(name, True, False)
                elif closing:
                    self._close(name)
                continue
            self._break()
            self._links = 0
            if closing:
                self._close(name)
            elif name in RAW:
                end = RAW[name].search(page, at)
                at = len(page) if end is None else end.end()
            elif name not in VOID and not attributes.endswith("/"):
                if name in ("p", "li"):
                    self._end_sibling(name)
                main = name in MAIN
                drops = not main and (name in DROPPED or self._boilerplate(attributes))
                if name in ("header", "footer") and self._mains and not drops:
                    drops = True
                self._push(name, drops, main)
        self._words(page[at:])
        self._break()

    def _end_sibling(self, name: str) -> None:
        """An open paragraph or item ends where the next one starts."""
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == name:
                self._close(name)
                return
            if self._open[k][0] not in ("p", "li") and self._open[k][0] not in INLINE:
                return

    def _push(self, name: str, drops: bool, main: bool) -> None:
        self._open.append((name, drops, main))
        self._names_open[name] += 1
        self._drops += drops
        self._mains += main

    @staticmethod
    def _boilerplate(attributes: str) -> bool:
        """Whether a class, id or role names boilerplate."""
        if "=" not in attributes:
            return False
        for quoted, single, bare in ATTRIBUTE.findall(attributes):
            for name in (quoted or single or bare).lower().split():
                parts = re.split(r"[-_]", name)
                if parts[-1] in BOILERPLATE or parts[0] in LEADING:
                    return True
        return False


def main_lines(lines: Lines, window: int = WINDOW, surge: float = SURGE) -> list[str]:
    """The lines between surge and dive points of the sums over sliding windows."""
    marked = any(lines.inside)
    worth = [w if (i or not marked) else 0 for w, i in zip(lines.worth, lines.inside, strict=True)]
    n, running = len(worth), 0
    sums = [0] * n
    for k in range(n - 1, -1, -1):
        running += worth[k] - (worth[k + window] if k + window < n else 0)
        sums[k] = running
    threshold = 1 if marked else max(surge * max(sums, default=0), 1)
    kept, reach = [], 0  # a window that surges keeps its lines, up to ``reach``
    for k in range(n):
        if sums[k] >= threshold:
            reach = k + window
        if k < reach and (lines.inside[k] or not marked):
            kept.append(lines.text[k])
    return kept


def extract(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    return "\n\n".join(main_lines(Lines(page), window, surge)) if page else ""


def _extractor(window: int, surge: float, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, slice_bytes):
                text = [extract(page, window, surge) for page in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["id", "url", "text"]
                )

    return run


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    window: int = WINDOW,
    surge: float = SURGE,
    slice_bytes: int = 8 << 20,
) -> DataFrame:
    """Per row: the id, the url, the main ``text`` and its length ``n_chars`` in code points."""
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html")
    )
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_extractor(window, surge, slice_bytes), f"id {kind}, url string, text string")
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars")
    )

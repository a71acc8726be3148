"""Main text of web pages by line-block distribution.

Markup is stripped and every block element becomes a line.  The lengths of the lines, link text not
counted, are summed over sliding windows.  Where these sums surge the article begins, where they
dive to nothing it ends, and the lines between are kept whole, short ones too.

What the markup itself names as no article (navigation, footers, forms, adverts, comments …) is
stripped with the tags.  The limits of an article leave blank lines, which are where sums can dive.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class LineParams:
    window: int = 3        # lines in a block
    surge: int = 80        # characters in a window that begin an article
    share: float = 0.1     # of the longest stretch's text that another stretch needs


# Element names of the HTML standard.
RAW = frozenset("script style noscript template svg math iframe object textarea select title head xmp noembed".split())
NO_ARTICLE = frozenset("nav footer aside form menu dialog button fieldset header".split())
ARTICLE = frozenset("article main".split())
PARTS = frozenset("div section ul ol dl table body".split())
BLOCKS = PARTS | NO_ARTICLE | ARTICLE | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre hr br figure figcaption address "
    "details summary hgroup center option html".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
# Words in a class, id or role that name something other than the article.
ODD_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner promo promotion promoted sponsor sponsored menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer header masthead topbar cookie cookies consent notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended teaser widget comment comments "
    "reply replies disqus pagination pager toolbar search copyright legal complementary contentinfo".split())

# Those of them that an article element can be.
REMARKS = frozenset("ad ads advert advertisement sponsored promo promoted related teaser comment comments reply replies".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|</?[a-zA-Z][^>]*>""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def odd(name: str, attributes: str, inside: bool) -> bool:
    """Does the markup name this element as something other than the article?"""
    if name in NO_ARTICLE:
        return not (name == "header" and inside)  # an article may have a header of its own
    if not attributes or name in ("body", "html"):
        return False
    for key, value in _NAMED.findall(attributes):
        if key.lower() == "hidden":
            return True
        for label in value.strip("\"'").split():
            words = _WORD.findall(_CAMEL.sub(" ", label).lower())
            if not words or words[0] in ("has", "with", "no", "without"):
                continue
            ends = {words[0], words[-1]} & ODD_NAMES
            if name in ARTICLE:
                ends &= REMARKS
            elif ends == {"header"} and (inside or words[0] in ("article", "post", "entry", "story")):
                continue
            if ends:
                return True
    return False


def lines_of(page: str, named: bool = True) -> list[tuple[str, int, bool]]:
    """(text, how much of it counts, does it lie in an article element) of every line in order.

    A blank line has no text.  Link text does not count, but for headings of an article.  With
    ``named`` off only the names of elements say what is left out, not those of classes.
    """
    out: list[tuple[str, int, bool]] = []
    here: list[str] = []
    linked = 0        # characters of the line that are in links
    in_link = heading = False
    skipped: list[str] = []   # the open element that is left out and open ones of that name in it
    depth = 0         # open articles

    def end_line():
        nonlocal linked, heading
        text = " ".join(html.unescape("".join(here)).split())
        if text:
            plain = len("".join(here).strip())
            full = linked * 2 <= plain or (heading and depth)
            out.append((text, len(text) if full else 0, depth > 0))
        here.clear()
        linked, heading = 0, False

    def blank(n: int):
        end_line()
        out.extend([("", 0, False)] * n)

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        text = page[at:tag.start() if tag else size]
        if text and not skipped:
            here.append(text)
            linked += len(text.strip()) if in_link else 0
        if not tag:
            break
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag.group(1)), tag.group(3) or ""
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            # One that is never closed hides nothing but its own tag, if it is no script or style.
            at = end.end() if end else (size if name in ("script", "style") else at)
            continue
        if skipped and not closing and name in ARTICLE and not depth and not _closes(skipped[0], page, at):
            skipped.clear()  # what should end before the article was never closed
        if skipped:
            if name == skipped[0] and not attributes.endswith("/"):
                skipped.pop() if closing else skipped.append(name)
            continue
        if not closing and name not in VOID and (name in NO_ARTICLE or named) and odd(name, attributes, depth > 0):
            end_line()
            if name in NO_ARTICLE or _closes(name, page, at):
                skipped.append(name)
            continue
        if name == "a":
            in_link = not closing
        elif name in ARTICLE:
            end_line()
            depth = max(0, depth + (-1 if closing else 1))
            blank(3)
        elif name in PARTS:
            blank(1)
        elif name in BLOCKS:
            end_line()
            heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
    end_line()
    return out


def _closes(name: str, page: str, at: int) -> bool:
    return re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at) is not None


def article_lines(lengths: np.ndarray, p: LineParams) -> np.ndarray:
    """Which lines lie between a surge and the dive after it.

    ``lengths`` are what counts of the lines, 0 for blank ones and links.  Lines between two
    dives, windows that hold nothing, are one stretch; a stretch with a window of ``surge`` and
    with ``share`` of the text of the longest one is kept.  If no window surges, the longest is.
    """
    n, w = len(lengths), p.window
    keep = np.zeros(n, bool)
    if not lengths.any():
        return keep
    padded = np.concatenate((np.zeros(w - 1, np.int64), lengths, np.zeros(w - 1, np.int64)))
    total = np.concatenate(([0], np.cumsum(padded)))
    sums = total[w:] - total[:-w]          # the windows that start at each padded line
    nothing = np.flatnonzero(sums == 0)
    gap = np.zeros(len(padded), bool)
    for k in range(w):
        gap[nothing + k] = True
    gap = gap[w - 1:w - 1 + n]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
    stretches = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    mass = [int(lengths[a:b].sum()) for a, b in stretches]
    peak = [int(sums[a:b + w - 1].max()) for a, b in stretches]
    surges = [most >= p.surge and m >= p.share * max(mass) for m, most in zip(mass, peak)]
    if not any(surges):
        surges[mass.index(max(mass))] = True
    for (a, b), kept in zip(stretches, surges):
        keep[a:b] = kept
    return keep


def _between(lines: list[tuple[str, int, bool]], p: LineParams) -> str:
    counts = np.array([n for _, n, _ in lines], np.int64)
    inside = np.array([x for _, _, x in lines], bool)
    if (counts * inside).any():  # the page says which of its elements are articles
        counts *= inside
    return " ".join(text for (text, _, _), kept in zip(lines, article_lines(counts, p)) if kept and text)


def main_text(page: str | None, params: LineParams = LineParams()) -> str:
    """The text between surges and dives, lines joined by one blank; empty if there is none."""
    text = _between(lines_of(page or ""), params)
    return text or _between(lines_of(page or "", named=False), params)


def extract_articles(pages: DataFrame, params: LineParams = LineParams(), key: str = "page_id", url: str = "url",
                     source: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for every row of ``pages``, row by row, without a shuffle.

    Character references are decoded, white space inside a line is one blank, lines are joined by
    one blank.  A null or empty page, or one of links alone, gives an empty text.  Long pages are
    read whole.  Repeated rows are answered each; null keys and urls stay null; other columns are
    not read; an empty table gives none.  If two stretches tie, the first is kept.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(t, params) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["key", "url", "text", "n_chars"])

    kind, place = (pages.schema[c].dataType.simpleString() for c in (key, url))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("page"))
    return rows.mapInArrow(run, f"key {kind}, url {place}, text string, n_chars long")

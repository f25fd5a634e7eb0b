"""Main text of web pages by line-block distribution.

A page is read once from front to back into lines, one per text block. Markup that
says what it holds (menus, footers, forms, adverts, comments, ...) leaves an
empty stretch instead of its text. The text lengths of the lines, link text not
counted, are summed over sliding windows. Where the sums rise from nothing is a surge,
where they fall to nothing again a dive; a stretch between the two is kept if its
densest window is not far below the page's densest, or if it stands inside the container of
those that are. A declared article keeps all its blocks, whatever their density.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: A stretch stays if its densest window has at least this share of the page's densest.
DENSITY = 0.2

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "xmp"}
SIDE = {"nav", "footer", "aside", "form", "head", "dialog", "select", "button", "menu", "header", "fieldset"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose end tag HTML lets authors leave out; the next block ends them.
SHORT = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
NESTING = (BLOCKS - SHORT - {"hr", "h1", "h2", "h3", "h4", "h5", "h6"}) | {"button", "span"}
#: Words of class names and ids that name side matter, and words that may stand beside them.
MARKS = set(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promotion cookie cookies consent notice notices gdpr popup modal sidebar"
    " menu menus nav navbar navigation breadcrumb breadcrumbs comment comments replies respond disqus share sharing social related newsletter subscribe signup login"
    " masthead footer toolbar pagination widget widgets".split()
)
BESIDE = set(
    "wrap wrapper container box bar area block section list items item inner outer top bottom left right site page global primary secondary main mobile desktop sticky fixed"
    " header buttons button icons icon links link form forms posts post articles stories news panel slot unit group row column col policy overlay message text title content".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_REST = re.compile(r"[^\"'>]*(?:(?:\"[^\"]*\"|'[^']*')[^\"'>]*)*>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _marked(names: str) -> bool:
    """Whether a class or id names side matter: a whole name of such words and of words that go with them.

    "cookie-notice" and "site-footer" do, "has-sidebar", "market-share" and "comments-open" do not.
    """
    for name in names.replace("_", "-").split():
        words = [w for w in name.split("-") if w and not w[0].isdigit()]
        if any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words):
            return True
    return False


_FORM_PARTS = re.compile(r"<(/form|article|main|h1|h2|p)(?=[\s/>])", re.I)


class _Forms:
    """Which forms of a page hold an article: a declared one, a main heading, or a heading with three paragraphs."""

    def __init__(self, html: str):
        self.ends: list[int] = []
        self.places: dict[str, list[int]] = {k: [] for k in ("article", "h2", "p")}
        for m in _FORM_PARTS.finditer(html):
            kind = m[1].lower()
            (self.ends if kind == "/form" else self.places["article" if kind in ("article", "main", "h1") else kind]).append(m.start())
        self.ends.append(len(html))

    def holds_article(self, at: int) -> bool:
        end = self.ends[bisect_left(self.ends, at)]
        inside = {k: bisect_left(v, end) - bisect_left(v, at) for k, v in self.places.items()}
        return inside["article"] > 0 or inside["h2"] > 0 and inside["p"] > 2


def _is_side(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is not part of the article; a header inside an article is its heading."""
    if tag in SIDE and not (tag == "header" and inside):
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if (name := name.lower()) == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ROLES or name in ("class", "id") and tag not in ("body", "html", "article", "main") and _marked(value):
            return True
    return False


def page_lines(html: str) -> tuple[list[tuple[str, int, bool, int]], list[int]]:
    """(text, length without link text, declared article, container) per block in page order, and every container's parent.

    Container 0 is the page and its own parent; ("", 0, False, 0) stands where markup was left out.
    """
    lines: list[tuple[str, int, bool, int]] = []
    parents, within = [0], [0]
    pieces: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # tag, side, article
    side = article = links = 0
    quoted, forms = True, None

    def flush() -> None:
        nonlocal linked
        if pieces:
            if text := " ".join("".join(pieces).split()):
                lines.append((text, max(0, len(text) - linked), article > 0, within[-1]))
            pieces.clear()
        linked = 0

    def pop() -> None:
        nonlocal side, article
        _, was_side, was_article = stack.pop()
        within.pop()
        side -= was_side
        article -= was_article
        if was_side and not side and not article:
            lines.extend([("", 0, False, 0)] * WINDOW)

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        text_end = end if lt < 0 else lt
        if text_end > at and not side:
            piece = unescape(html[at:text_end])
            pieces.append(piece)
            linked += len(" ".join(piece.split())) if links else 0
        if lt < 0:
            break
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        name = _NAME.match(html, lt + 1)
        if not name:
            if html[lt + 1 : lt + 2] in ("!", "?", "/"):
                gt = html.find(">", lt)
                at = end if gt < 0 else gt + 1
            else:
                if not side:
                    pieces.append("<")
                at = lt + 1
            continue
        rest = _REST.match(html, name.end()) if quoted else None
        if rest:
            stop = rest.end()
        else:
            # A quote that never closes: from here on, tags end at the next bracket.
            quoted = False
            gt = html.find(">", name.end())
            stop = end if gt < 0 else gt + 1
        attributes = html[name.end() : stop - 1]
        tag, at = name[0].lower(), stop
        if tag in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, stop)
            gt = html.find(">", close.end()) if close else -1
            at = end if gt < 0 else gt + 1
            if tag in ("textarea", "iframe", "svg", "math", "object") or tag not in BLOCKS:
                continue
        closing, tag = tag[0] == "/", tag.lstrip("/")
        if tag == "br" and not side:
            pieces.append(" ")
        if tag == "a":
            links = 0 if closing else 1
        if tag in BLOCKS:
            flush()
            while stack and stack[-1][0] in SHORT and stack[-1][1]:
                pop()
        if closing:
            if tag in NESTING and any(t == tag for t, _, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
                links = 0
        elif (tag in NESTING or tag in BLOCKS or tag in ("span", "section")) and not attributes.endswith("/"):
            if tag == "form" and forms is None:
                forms = _Forms(html)
            # A form around the page's article is only its frame.
            is_side = _is_side("div" if tag == "form" and forms.holds_article(stop) else tag, attributes, article > 0)
            is_article = tag in ("article", "main") or "main" in re.findall(r"role\s*=\s*[\"']?(\w+)", attributes)
            if tag in NESTING or is_side and tag in SHORT:
                if is_side and not side:
                    flush()
                stack.append((tag, is_side, is_article and not side))
                parents.append(within[-1])
                within.append(len(parents) - 1)
                side += is_side
                article += is_article and not stack[-1][1] and stack[-1][2]
    flush()
    return lines, parents


def _inside(containers: list[int], parents: list[int]) -> list[bool]:
    """Of every container of a page, whether it is or lies in the innermost one that holds all ``containers``."""
    held = [0] * len(parents)
    for c in containers:
        held[c] += 1
    for c in range(len(parents) - 1, 0, -1):
        held[parents[c]] += held[c]
    # A child comes after its parent, so the last that holds all is the innermost.
    common = max(c for c, n in enumerate(held) if n == len(containers))
    out = [c == common for c in range(len(parents))]
    for c in range(common + 1, len(parents)):
        out[c] = out[parents[c]]
    return out


def main_text(html: str) -> str:
    """The article's blocks joined by newlines; empty if there is none."""
    lines, parents = page_lines(html)
    if not lines:
        return ""
    if any(inside for _, _, inside, _ in lines):
        return "\n".join(text for text, _, inside, _ in lines if inside)
    length = np.array([n for _, n, _, _ in lines], float)
    sums = np.convolve(length, np.ones(WINDOW), "same") if len(length) >= WINDOW else np.full(len(length), length.sum())
    dense = np.concatenate(([False], sums > 0, [False])).astype(np.int8)
    surges, dives = np.flatnonzero(np.diff(dense) == 1), np.flatnonzero(np.diff(dense) == -1)
    stretches = []
    for surge, dive in zip(surges.tolist(), dives.tolist()):
        # A window also covers its neighbours: a stretch begins and ends with a line of its own length.
        own = np.flatnonzero(length[surge:dive])
        stretches.append((surge + own[0], surge + own[-1] + 1))
    if not stretches:
        return ""
    full = [sums[surge:dive].max() >= DENSITY * sums.max() for surge, dive in stretches]
    spoken = lambda surge, dive: [c for _, n, _, c in lines[surge:dive] if n]
    inside = _inside([c for dense, stretch in zip(full, stretches) if dense for c in spoken(*stretch)], parents)
    kept: list[str] = []
    for dense, (surge, dive) in zip(full, stretches):
        kept += [text for text, _, _, c in lines[surge:dive] if text and (dense or inside[c])]
    return "\n".join(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Main text of every row's whole page: id_col, ``keep``, text, n_chars (code points).

    A null or empty page has an empty text, and so has one without blocks outside menus
    and the like. Rows are answered one by one, so repeats do not matter; null ids and
    other columns pass or are ignored. An empty table gives no rows.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            html = part.column(part.num_columns - 1)
            texts = pa.array([main_text(html[i].as_py()) for i in range(len(html))], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*part.schema.names[:-1], "text"])

    chosen = pages.select(id_col, *keep, F.coalesce(html_col, F.lit("")).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", text string"
    return chosen.mapInArrow(batches, schema).withColumn("n_chars", F.length("text").cast("long"))

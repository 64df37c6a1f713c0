"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape
from itertools import groupby, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never part of a page's article.
OUT_TAGS = frozenset("nav footer aside script style head title noscript template iframe button select option textarea input svg dialog menu noembed noframes object".split())
#: Not part of it, unless the element holds most of the page's content; so it is with what a class, an id or a role names.
NAMED_TAGS = frozenset("form".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice popup modal newsletter subscribe signup comment comments reply replies disqus share sharing social related recommended widget toolbar skip pagination pager copyright".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
HOLDS_ARTICLE = frozenset("html body main article".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS_AT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PIECE = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold text, where others hold anything.
PROSE = frozenset("p li dt dd td th pre blockquote caption figcaption summary".split()) | HEADINGS
ENDS = re.compile(r"[.!?…。！？:;]['\"”’»)\]]*$")
PUNCTUATION = frozenset(".,;:!?…。，、；：！？¿¡")


@dataclass
class Element:
    tag: str
    parent: int
    out: bool
    path: int
    named: bool = False  # by its own tag, class, id or role; not yet by those around it


@dataclass
class Path:
    """A tag path: the number of the path above and a tag, so that deep pages take no more room than they have tags."""

    linked: bool = False  # within a link
    heading: bool = False  # within a heading
    prose: bool = False  # its nearest block is one of PROSE


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, False, 0)])
    paths: list[Path] = field(default_factory=lambda: [Path()])
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # element, block number, text


def _left_out(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is left out for good, and whether a name says that it isn't content."""
    if tag in OUT_TAGS or tag == "header" and not inside:
        return True, False
    named = tag in NAMED_TAGS
    if not attributes or tag in HOLDS_ARTICLE:
        return False, named
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            words = re.findall(r"[a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", value).lower())
            named = named or bool(OUT_WORDS.intersection(words))
        elif name == "role":
            named = named or value.lower() in OUT_ROLES
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, False
    return False, named


def parse(html: str) -> Page:
    """The page's text runs, each with its element and the number of its block. Its time grows with the page's length."""
    page, at, block = Page(), 0, 0
    els, numbers = page.elements, {}
    stack, depths = [0], defaultdict(list)  # open elements; for each tag, where in the stack it is open

    def text(s: str) -> None:
        if s:
            page.runs.append((stack[-1], block, unescape(s)))

    def shut(depth: int) -> bool:
        """Closes what is open from this depth on; whether there was a block in it."""
        blocks = False
        while len(stack) > depth:
            tag = els[stack.pop()].tag
            depths[tag].pop()
            blocks |= tag in BLOCKS
        return blocks

    def deepest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths[t]), default=0)

    while at < len(html):
        m = PIECE.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br":
            page.runs.append((stack[-1], block, " "))
            continue
        if closing:
            if depths[tag]:
                block += shut(depths[tag][-1])
            continue
        if tag in BLOCKS:
            block += 1
            if depths["p"] and tag not in ("td", "th", "tr"):
                shut(depths["p"][-1])
        if tag in CLOSES and (hit := deepest(CLOSES[tag])) > deepest(STOPS_AT[tag]):
            shut(hit)
        if tag in VOID:
            continue
        now = stack[-1]
        out, named = _left_out(tag, m[3], bool(depths["article"] or depths["main"]))
        path = numbers.setdefault((els[now].path, tag), len(page.paths))
        if path == len(page.paths):
            above = page.paths[els[now].path]
            page.paths.append(Path(above.linked or tag == "a", above.heading or tag in HEADINGS, tag in PROSE if tag in BLOCKS else above.prose))
        els.append(Element(tag, now, els[now].out or out, path, named))
        if m[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        depths[tag].append(len(stack))
        stack.append(len(els) - 1)
    return page


def content_scores(page: Page, reach: int = 2) -> tuple[list[int], np.ndarray]:
    """Runs that may be content, and the fused score of each.

    A path's ratios are its characters and its punctuation marks over its number of runs. Both series, in page order,
    are smoothed by a Gaussian over ``reach`` neighbours on either side, and their product is the score.
    """
    own = [k for k, (e, _, t) in enumerate(page.runs) if not page.elements[e].out and t.strip()]
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in own:
        e, _, t = page.runs[k]
        path = page.elements[e].path
        length[path] += len(t.strip())
        marks[path] += sum(c in PUNCTUATION for c in t)
        count[path] += 1
    paths = [page.elements[page.runs[k][0]].path for k in own]
    series = [np.array([x[p] / count[p] for p in paths], dtype=float) for x in (length, marks)]
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / 2)
    smooth = [np.convolve(np.pad(s, reach, mode="edge"), kernel / kernel.sum(), "valid") if len(s) else s for s in series]
    return own, smooth[0] * (0.1 + smooth[1])


def _least(score: np.ndarray) -> float:
    """What a content score is at least: half the standard deviation of the scores, or the mean, if less."""
    return min(score.mean(), score.std() / 2)


def _content(score: np.ndarray) -> np.ndarray:
    """Which runs are content."""
    return np.flatnonzero(score >= _least(score)) if score.any() else np.arange(len(score))


def _content_paths(page: Page, own: list[int], score: np.ndarray) -> set[int]:
    """The tag paths whose runs are content on the average."""
    every: dict[int, list[float]] = defaultdict(list)
    for k, x in zip(own, score, strict=True):
        every[page.elements[page.runs[k][0]].path].append(x)
    return {p for p, x in every.items() if sum(x) / len(x) >= _least(score)}


def _weights(page: Page, runs: list[int]) -> dict[int, int]:
    """The characters of the runs within each element."""
    weight = [0] * len(page.elements)
    for k in runs:
        weight[page.runs[k][0]] += len(page.runs[k][2].strip())
    for i in range(len(weight) - 1, 0, -1):  # children come after their parents
        weight[page.elements[i].parent] += weight[i]
    return {i: w for i, w in enumerate(weight) if w}


def leave_out(page: Page, most: float = 0.5) -> None:
    """Marks what is within elements that a name says aren't content, but for those that hold ``most`` of the content."""
    if not any(x.named for x in page.elements):
        return
    own, score = content_scores(page)
    weight = _weights(page, [own[i] for i in _content(score)]) if own else {}
    for x, e in enumerate(page.elements[1:], 1):  # parents come first
        e.out = e.out or page.elements[e.parent].out or e.named and weight.get(x, 0) <= most * weight.get(0, 0)


def _stretches(lines: dict[int, str], good: set[int], heading: set[int], linked: dict[int, bool], prose: set[int]) -> list[int]:
    """The blocks that stay, in page order: the content blocks, and what belongs to them.

    A stretch between two content blocks, or between the first heading and them, stays whole, however long, unless it is
    nothing but links. Before and after the content stays what adjoins it: blocks that hold text or end as sentences do, and are no links; headings
    only if something follows them. Of what goes, the headings right before a content block stay.
    """
    order = list(lines)
    content = [i for i, b in enumerate(order) if b in good]
    if not content:
        return []
    first, last = content[0], content[-1]
    first = next((i for i in range(first) if order[i] in heading), first)
    fits = lambda i: not linked[order[i]] and (order[i] in prose or bool(ENDS.search(lines[order[i]])))
    while first and fits(first - 1):
        first -= 1
    end = last + 1
    while end < len(order) and fits(end):
        end += 1
    while end > last + 1 and order[end - 1] in heading:
        end -= 1
    out: list[int] = []
    for is_good, stretch in groupby(range(first, end), lambda i: order[i] in good):
        few = [order[i] for i in stretch]
        if not is_good and all(linked[b] for b in few if b not in heading) and any(linked[b] for b in few):
            few = list(takewhile(heading.__contains__, reversed(few)))[::-1]
        out += few
    return out


def main_text(html: str | None, share: float = 0.9) -> str:
    """The page's article: the content blocks of the element that holds the content runs.

    Runs score by their tag paths; those over half the standard deviation (or the mean, if less) are content, and a block
    stays with a run that is, or whose path is on the average, and with what belongs to it (``_stretches``). From the root down, the element follows that has ``share`` of the content's characters;
    ``article`` and ``main`` end the way unless a deeper one of them has the share, and so does the last element before the
    content parts into paragraphs. What names say isn't content is left out, unless it holds most of the content.
    """
    if not html:
        return ""
    page = parse(html)
    leave_out(page)
    own, score = content_scores(page)
    if not own:
        return ""
    content = [own[i] for i in _content(score)]
    weight = _weights(page, content)
    children = defaultdict(list)
    for i in weight:
        if i:
            children[page.elements[i].parent].append(i)
    at, named = 0, None
    while True:
        if page.elements[at].tag in ("article", "main"):
            named = at
        heavy = [i for i in children[at] if weight[i] >= share * weight[0]]
        if not heavy:
            break
        at = heavy[0]
    if named is None:
        while at and page.elements[at].tag not in ("div", "section", "body", "td", "html"):
            at = page.elements[at].parent
    root = at if named is None else named
    inside = {root}
    for i in range(root + 1, len(page.elements)):
        if page.elements[i].parent in inside:
            inside.add(i)
    blocks: dict[int, list[str]] = defaultdict(list)
    linked: dict[int, bool] = defaultdict(lambda: True)
    heading: set[int] = set()
    prose: set[int] = set()
    for e, block, t in page.runs:
        if e in inside and not page.elements[e].out:
            blocks[block].append(t)
            path = page.paths[page.elements[e].path]
            linked[block] &= not t.strip() or path.linked
            if path.heading:
                heading.add(block)
            if path.prose and t.strip():
                prose.add(block)
    lines = {b: line for b, x in sorted(blocks.items()) if (line := " ".join("".join(x).split()))}
    good = {page.runs[k][1] for k in content}
    paths = _content_paths(page, own, score)
    good |= {page.runs[k][1] for k in own if page.elements[page.runs[k][0]].path in paths}
    return "\n".join(lines[b] for b in _stretches(lines, good & lines.keys(), heading, linked, prose))


def extracted(html_col: str = "html", share: float = 0.9) -> Column:
    """The main text of a column of pages. Null, empty or contentless pages: an empty string."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: main_text(h, share))

    return run(F.coalesce(F.col(html_col), F.lit("")))

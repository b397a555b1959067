"""Operator 5: main text of web pages by line-block distribution.

Markup is stripped into blocks in page order.  Blocks in elements that can't hold
article text (navigation, headers, footers, forms, scripts, adverts, notices, comments
by name, class, id or role; elements that aren't displayed) take no part.  The others have weights: their length; none
for blocks that are links for the most part; ``LANDMARK`` more for the page's heading;
in a page with an article element only the blocks inside one take part, each with
``LANDMARK`` more.  Weights are summed over
sliding windows of blocks; text starts where the sum surges over a threshold and ends
where it dives to nothing, and what lies between is kept.  So an article element makes
its blocks surge more easily, and a page without one is read by lengths alone.

Defined results: a null, empty or text-less page gives an empty text; a page whose sums
all stay under the threshold gives what surges over the largest sum less one; broken
markup is read as far as it goes (unclosed elements end with the page); repeated rows
repeat; a very long page is a batch of its own, read in one pass; an empty table gives
an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_TAG = re.compile(r"""<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>)""", re.S)
_HINT = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
#: An element that the page doesn't display.
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|\bstyle\s*=\s*(?:"[^"]*\bdisplay\s*:\s*none|'[^']*\bdisplay\s*:\s*none|display:none)""", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose text is never shown, elements that hold no article text, elements that end a block.
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
OUTSIDE = frozenset("nav header footer aside form button menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, an id or a role that mark an element outside the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)


def _marked(attributes: str) -> bool:
    for m in _HINT.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").lower()
        if not MARKS.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
    return any(m[0].strip().lower() != "hidden" or not _quoted(attributes, m.start()) for m in _UNSEEN.finditer(attributes))


def _quoted(attributes: str, at: int) -> bool:
    """Whether a place is inside an attribute's value."""
    return any(m.start() < at < m.end() for m in _VALUE.finditer(attributes))


def blocks_of(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """Blocks in page order: text, code points in links, whether outside by its element, whether inside an article, whether in a first heading."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    parts: list[str] = []
    linked = at = links = articles = heads = 0
    outside: list[list] = []  # elements under which nothing is article text: name, depth of equal names

    def end() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((text, linked, bool(outside), articles > 0, heads > 0))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        if m[1]:  # an end tag
            if name in BLOCK:
                end()
            if outside and outside[-1][0] == name:
                outside[-1][1] -= 1
                if not outside[-1][1]:
                    outside.pop()
            if name == "a":
                links = max(0, links - 1)
            elif name in ("article", "main"):
                articles = max(0, articles - 1)
            elif name == "h1":
                heads = max(0, heads - 1)
            continue
        if name in RAW and not (name == "svg" and m[3].endswith("/")):  # a slash closes no HTML element
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in BLOCK:
            end()
        if outside and outside[-1][0] == name:
            outside[-1][1] += 1
        elif name not in VOID and (name in OUTSIDE or (m[3] and name not in ("body", "html", "article", "main") and _marked(m[3]))):
            if name not in BLOCK:
                end()
            outside.append([name, 1])
        if name == "a":
            links += 1
        elif name in ("article", "main"):
            articles += 1
        elif name == "h1":
            heads += 1
    add(page[at:])
    end()
    return out


#: What an article element adds to the weight of a block inside it.
LANDMARK = 86


def distribution(page: str, window: int = 3) -> tuple[list[str], list[int], list[int]]:
    """The blocks that may hold article text, their weights and the sums of ``window`` weights from each on."""
    blocks = [(text, linked, inside, head) for text, linked, out, inside, head in blocks_of(page) if not out]
    if any(inside for _, _, inside, _ in blocks):
        blocks = [b for b in blocks if b[2]]
        weights = [len(text) + LANDMARK for text, *_ in blocks]
    else:
        weights = [0 if 2 * linked > len(text) else len(text) + LANDMARK * head for text, linked, _, head in blocks]
    before = [0, *accumulate(weights)]
    return [text for text, *_ in blocks], weights, [b - a for a, b in zip(before, before[window:] + before[-1:] * (window - 1))]


def main_text(page: str, window: int = 3, surge: int = 86) -> str:
    """The text between surge and dive points of the block distribution."""
    blocks, weights, sums = distribution(page, window)
    if not any(weights):
        return ""
    least = min(surge, max(sums) - 1)
    kept, inside = [], False
    for text, weight, total in zip(blocks, weights, sums):
        inside = total > 0 if inside else weight > 0 and total > least
        if inside:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x) for x in part.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")

"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Tags score negative; a word
scores positive unless labelled pages say that words of its context (the innermost
structural element with its class) are boilerplate.  The weights come from pages
that label themselves with an ``<article>`` or ``<main>`` element.  One linear scan
finds the contiguous region with the largest score; its words outside elements that
never hold main text, cut into blocks at block-level tags, are the main text.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted

#: contexts and tags whose weights are kept, the most frequent first
MAX_WEIGHTS = 20_000
#: words or tags a context must have on labelled pages for a weight of its own
LEAST = 20
WORD, TAG = 1.0, -3.25  # weights of what no labelled page has
#: HTML element sets (fixed values)
SKIPPED = frozenset("script style noscript template svg math iframe object canvas head title select textarea button".split())
STRUCTURE = frozenset("body div section article main nav header footer aside form ul ol dl table figure menu dialog blockquote details fieldset".split())
BLOCKS = STRUCTURE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre br hr caption figcaption address legend summary option".split())
NEVER = frozenset("nav header footer aside form menu dialog fieldset".split())
#: words of class and id names that mark boilerplate, unless they name a frame around the page (fixed values)
MARKS = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie disqus footer header menu nav navbar newsletter notice "
                  "pagination popup promo related reply replies share sharing sidebar social sponsor sponsored subscribe widget".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CLOSERS = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in SKIPPED}


def context_of(tag: str, attributes: str) -> str:
    """Element name with its class, id and role names; digits are one sign."""
    names = sorted({w for _, *v in ATTRIBUTE.findall(attributes) for w in re.split(r"[\s_-]+", re.sub(r"\d+", "0", "".join(v).lower())) if w}) if attributes else []
    return " ".join([tag, *names[:6]])


def mark_of(context: str, attributes: str) -> int:
    """2 if a whole class, id or role name is one of :data:`MARKS`, 1 if a part of one is."""
    if MARKS.isdisjoint(context.split()[1:]):
        return 0
    return 1 if MARKS.isdisjoint(n for _, *v in ATTRIBUTE.findall(attributes) for n in "".join(v).lower().split()) else 2


class Place(NamedTuple):
    """An element; ``never`` and ``labelled`` also hold for all within it."""

    tag: str
    context: str
    never: bool
    labelled: bool
    above: int  # its parent's index
    mark: int


def settle_marks(places: list[Place], words: list[int]) -> list[bool]:
    """Whether each element is, or is in, one whose mark holds.

    Names such as ``no-sidebar`` also stand on frames around the main text.  So a part
    of a name holds only for an element with at most half of the page's words, a whole
    name up to 95 % of them.  The words are those outside :data:`NEVER` elements, in
    article and main elements if any are there, and for parts of names outside elements
    marked by a whole one.  Outermost article and main elements inherit no mark."""
    sure = any(w and p.labelled and not p.never for p, w in zip(places, words))
    words = [0 if p.never or (sure and not p.labelled) else w for p, w in zip(places, words)]

    def within(own: list[int]) -> list[int]:
        own = list(own)
        for k in range(len(places) - 1, 0, -1):
            own[places[k].above] += own[k]
        return own

    def inherited(held: list[bool]) -> list[bool]:
        held = list(held)
        for k, p in enumerate(places[1:], 1):
            held[k] |= held[p.above] and (places[p.above].labelled or not p.labelled)
        return held

    inner = within(words)
    whole = [p.mark == 2 and 20 * n <= 19 * inner[0] for p, n in zip(places, inner)]
    inner = within([0 if gone else w for gone, w in zip(inherited(whole), words)])
    return inherited([w or (p.mark == 1 and 2 * n <= inner[0]) for w, p, n in zip(whole, places, inner)])


def pieces(page: str):
    """In page order ``("<" or "/", place, name)`` for an opening or closing tag and
    ``("t", place, text)`` for text.  A place starts with ``(element, context, never,
    labelled)``: ``never`` tells whether an element around it, or the tag's own, is one
    of :data:`NEVER` or marked as such, ``labelled`` whether one is an article or main."""
    places = [Place("", "", False, False, 0, 0)]
    events = list(_events(page, places))
    if any(p.mark for p in places):
        words = [0] * len(places)
        for kind, k, text in events:
            if kind == "t":
                words[k] += len(text.split())
        places = [p._replace(never=p.never or gone) for p, gone in zip(places, settle_marks(places, words))]
    return [(kind, places[k][:4], text) for kind, k, text in events]


def _events(page: str, places: list[Place]):
    """As :func:`pieces`, with indices in ``places``, to which elements are added; marks
    are not in ``never`` yet."""
    stack = [0]
    at, end = 0, len(page)
    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            yield "t", stack[-1], page[at:m.start()]
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "t", stack[-1], html.escape(m[0][9:].removesuffix("]]>"), quote=False)
            continue
        tag = m[2].lower()
        if m[1]:
            place = stack[-1]
            if tag in STRUCTURE:
                for k in range(len(stack) - 1, 0, -1):
                    if places[stack[k]].tag == tag:
                        del stack[k:]
                        break
            yield "/", place, tag
            continue
        if tag in SKIPPED:
            if not m[3].rstrip().endswith("/"):
                close = CLOSERS[tag].search(page, at)
                at = close.end() if close else end if tag in ("script", "style") else at
        elif tag in STRUCTURE:
            context, around = context_of(tag, m[3]), places[stack[-1]]
            mark = 0 if tag in ("body", "main", "article") else mark_of(context, m[3])
            places.append(Place(tag, context, around.never or tag in NEVER, around.labelled or tag in ("article", "main"), stack[-1], mark))
            stack.append(len(places) - 1)
        yield "<", stack[-1], tag
    if at < end:
        yield "t", stack[-1], page[at:]


@dataclass
class Weights:
    """Log-odds weights of word contexts and of tags."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, kind: str, place: tuple[str, str, bool, bool], tag: str) -> float:
        """Weight of a word or a tag.  Those in elements that never hold main text count
        nothing, so they neither end a region nor carry it on.  Where weights are learned,
        the labels they come from hold as well: in an article or main element tags count
        nothing and words at least WORD, so that what lists, tables or plain boxes are on
        other pages doesn't cut it."""
        _, context, never, labelled = place
        if never:
            return 0.0
        sure = labelled and bool(self.words or self.tags)
        if kind == "t":
            value = self.words.get(context, WORD)
            return max(value, WORD) if sure else value
        return 0.0 if sure else self.tags.get(kind + tag, TAG)

    def extract(self, page: str | None) -> str:
        """The main text: blocks joined by newlines, empty if there is none."""
        items, best, left, right, total, start = [], 0.0, 0, 0, 0.0, 0
        for kind, place, text in pieces(page or ""):
            score = self.of(kind, place, text)
            if kind == "t":
                score *= len(html.unescape(text).split())
            items.append((None if kind == "t" and place[2] else kind, text))
            total += score
            if total <= 0:
                total, start = 0.0, len(items)
            elif total > best:
                best, left, right = total, start, len(items)
        blocks, now = [], []
        for what, text in items[left:right]:
            if what in ("<", "/"):
                if text in BLOCKS:
                    blocks.append(now)
                    now = []
            elif what is not None:
                now.append(html.unescape(text))
        return "\n".join(b for b in (" ".join("".join(n).split()) for n in [*blocks, now]) if b)

    def column(self, page: Column) -> Column:
        own = self

        def run(pages: pd.Series) -> pd.Series:
            return pd.Series([own.extract(p) for p in pages], dtype="object")

        return F.pandas_udf(run, "string")(page)


def learn(pages: DataFrame, html_col: str = "html", max_weights: int = MAX_WEIGHTS) -> Weights:
    """Weights from all rows that label their main text by an article or main
    element: for words, the log odds of their context to be inside; for tags, the
    same less a constant, so that they stay negative.  What is in elements that never
    hold main text isn't counted, as it would speak against equal contexts elsewhere.
    Counts are summed per task and context.  Without labelled pages the weights are
    the fixed ones."""

    def run(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for page in batch.column(0).to_pylist():
                if not re.search(r"<(?:article|main)\b", page, re.I):
                    continue
                for kind, (_, context, never, labelled), text in pieces(page):
                    if never:
                        continue
                    n, key = (len(text.split()), "t" + context) if kind == "t" else (1, kind + text)
                    count = found.setdefault(key, [0, 0])
                    count[not labelled] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()),
                                              pa.array([v[1] for v in found.values()], pa.int64())], ["key", "inside", "outside"])

    rows = pages.select(quoted(html_col).alias("html")).where("html IS NOT NULL")
    counts = rows.mapInArrow(run, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    kept = counts.where(F.col("i") + F.col("o") >= LEAST).orderBy(F.desc(F.col("i") + F.col("o")), "key").limit(max_weights).collect()
    words, tags = {}, {}
    for r in kept:
        odds = max(-2.0, min(2.0, math.log((r["i"] + 1) / (r["o"] + 1)) / 2))
        if r["key"][0] == "t":
            words[r["key"][1:]] = odds
        else:
            tags[r["key"]] = min(-0.1, TAG / 2 + odds / 2)
    return Weights(words, tags)


def main_text(pages: DataFrame, weights: Weights, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out`` (null or empty html: empty).  All
    rows and other columns stay; an existing column ``out`` is replaced."""
    spot = fresh(pages, "main_text")
    made = pages.withColumn(spot, weights.column(quoted(html_col)))
    return made.drop(*[c for c in pages.columns if c.lower() == out.lower()]).withColumnRenamed(spot, out)

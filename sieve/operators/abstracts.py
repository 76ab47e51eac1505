"""Abstract extraction from fetched paper pages.

Route by the (final) page URL, first match wins:

============================  =====================================
URL contains                  extraction
============================  =====================================
``sciencedirect``             text of the element with id ``abstracts``
``ieee``                      ``og:description`` meta content
``arxiv``                     text of the element with id ``abs``
``emerald`` or ``acm``        text of the element with id ``abstract``
``springer``                  text of the element with id ``Abs1-content``
anything else                 fallback: long paragraphs of the page text
============================  =====================================

Everything is a built-in expression: elements are found by one fold over a page's
tags with a stack of the open ones (``functions.markup``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import clean_text, decode_entities, long_paragraphs

# fixed routes: (url substring(s), route name, element id)
ROUTES = [
    (("sciencedirect",), "id", "abstracts"),
    (("ieee",), "meta", None),
    (("arxiv",), "id", "abs"),
    (("emerald", "acm"), "id", "abstract"),
    (("springer",), "id", "Abs1-content"),
]
FALLBACK_MIN_WORDS = 200


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def abstract_route(url) -> Column:
    """``struct(route, element_id)``; route is ``id``, ``meta`` or ``fallback``."""
    u = _c(url)
    route = None
    for subs, kind, elem in ROUTES:
        cond = None
        for s in subs:
            cond = u.contains(s) if cond is None else (cond | u.contains(s))
        val = F.struct(F.lit(kind).alias("route"), F.lit(elem).cast("string").alias("element_id"))
        route = F.when(cond, val) if route is None else route.when(cond, val)
    return route.otherwise(F.struct(F.lit("fallback").alias("route"), F.lit(None).cast("string").alias("element_id")))


META_TAG = "(?is)<meta\\s[^>]*property\\s*=\\s*[\"']og:description[\"'][^>]*>"
CONTENT_ATTR = "(?is)\\scontent\\s*=\\s*\"([^\"]*)\""
CONTENT_ATTR_SQ = "(?is)\\scontent\\s*=\\s*'([^']*)'"


def meta_description(html) -> Column:
    """``content`` of the first ``<meta property="og:description">``, entities
    decoded; NULL when there is no such tag or attribute."""
    tag = F.regexp_extract(_c(html), META_TAG, 0)
    dq = F.regexp_extract(tag, CONTENT_ATTR, 1)
    has_dq = tag.rlike(CONTENT_ATTR)
    sq = F.regexp_extract(tag, CONTENT_ATTR_SQ, 1)
    has_sq = tag.rlike(CONTENT_ATTR_SQ)
    raw = F.when(has_dq, dq).when(has_sq, sq)
    return F.when(tag != "", decode_entities(raw))


# elements whose whole content is dropped before the fallback text is taken
DROPPED_ELEMENTS = ["script", "style", "li", "ul"]


def page_text_without(html, elements=DROPPED_ELEMENTS) -> Column:
    """Text of a page after dropping the given elements with their content, however
    they nest."""
    return markup.text_without(html, list(elements))


def fallback_abstract(html, min_words: int = FALLBACK_MIN_WORDS) -> Column:
    """Paragraphs with more than ``min_words`` words, joined without separator,
    cleaned; cut to start at the first ``abstract`` (any case) when present."""
    body = clean_text(F.array_join(long_paragraphs(page_text_without(html), min_words), ""))
    idx = F.locate("abstract", F.lower(body))
    return F.when(idx > 0, body.substr(idx, F.lit(1 << 30))).otherwise(body)


# --- element text by id --------------------------------------------------------
def id_text(html, element_id) -> Column:
    """Cleaned text of the first element with that id; ``''`` when missing."""
    return clean_text(markup.text_by_id(html, element_id))


def text_by_id(df: DataFrame, html: str = "html", element_id: str = "element_id", out: str = "text",
               keep_html: bool = False) -> DataFrame:
    """Add ``out`` = cleaned text of the element with the row's id.  The HTML column is
    dropped unless ``keep_html``."""
    kept = [F.col(c) for c in df.columns if (keep_html or c != html) and c != out]
    return df.select(*kept, id_text(html, element_id).alias(out))


def extract_abstracts(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html",
                      out: str = "abstract") -> DataFrame:
    """``keys`` + ``url`` + ``route`` + ``out`` (abstract) per page, in one projection:
    each page is parsed for its own route only."""
    r = abstract_route(url)
    made = F.when(r["route"] == "meta", meta_description(html)).when(r["route"] == "fallback", fallback_abstract(html)) \
        .otherwise(id_text(html, r["element_id"]))
    return pages.select(*keys, F.col(url), r["route"].alias("route"), made.alias(out))

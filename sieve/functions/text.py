"""Text Column expressions: whitespace rules, DOI, entities, paragraphs, HTML.

All of these are built-in Spark expressions (regexp_*, split, higher-order
array functions), so they run inside whole-stage code generation or the
interpreted expression path on the executors; no Python runs per row.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's ``str.strip()`` / ``str.split()`` see it
# (``str.isspace``).  Java's ``\s`` is ASCII only, so the class is explicit.
PY_WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"

# DOI pattern (case-insensitive, first match wins).
DOI_PATTERN = "(?i)10\\.\\d{4,9}/[-._;()/:A-Z0-9]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: drop leading and trailing Python whitespace."""
    return F.regexp_replace(_col(c), f"^{PY_WS}+|{PY_WS}+$", "")


def py_words(c) -> Column:
    """``str.split()`` with no argument: non-empty runs between whitespace."""
    return F.filter(F.split(_col(c), f"{PY_WS}+"), lambda w: w != "")


def clean_text(c) -> Column:
    """Strip the ends, delete every newline; NULL becomes ``''``."""
    return F.coalesce(F.regexp_replace(py_strip(c), "\n", ""), F.lit(""))


def extract_doi(c) -> Column:
    """First DOI-looking substring of a URL, case kept; NULL when none."""
    return F.nullif(F.regexp_extract(_col(c), DOI_PATTERN, 0), F.lit(""))


def long_paragraphs(c, min_words: int) -> Column:
    """Paragraphs (split on 2+ newlines) with more than ``min_words`` words."""
    return F.filter(F.split(_col(c), "\n\n+"), lambda p: F.size(py_words(p)) > F.lit(min_words))


# --- entity decoding ---------------------------------------------------------
def _named_entities() -> dict[str, str]:
    """HTML 4 named entities (from the standard library) plus ``apos``."""
    table = {name: chr(cp) for name, cp in html.entities.name2codepoint.items()}
    table["apos"] = "'"
    return table


def sql_string(s: str) -> str:
    """A Spark SQL string literal for ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_ENTITY_MAP_SQL: str | None = None


def entity_map() -> Column:
    """``map<name, text>`` literal of the named entities (one JVM parse)."""
    global _ENTITY_MAP_SQL
    if _ENTITY_MAP_SQL is None:
        table = _named_entities()
        names = sorted(table)
        keys = ", ".join(sql_string(n) for n in names)
        vals = ", ".join(sql_string(table[n]) for n in names)
        _ENTITY_MAP_SQL = f"map_from_arrays(array({keys}), array({vals}))"
    return F.expr(_ENTITY_MAP_SQL)


def codepoint_char(n: Column) -> Column:
    """Unicode character of an integer code point (UTF-32 big-endian bytes)."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


# Markup tokens: CDATA, comment, declaration/tag, entity, plain text run.
MARKUP_TOKEN = "(?s)<!\\[CDATA\\[.*?\\]\\]>|<!--.*?-->|<[^>]*>|&#?[A-Za-z0-9]+;|[^<&]+|[<&]"


def _decode_token(t: Column, drop_tags: bool) -> Column:
    named = F.element_at(entity_map(), F.regexp_extract(t, "^&([A-Za-z0-9]+);$", 1))
    dec = F.regexp_extract(t, "^&#([0-9]+);$", 1)
    hexa = F.regexp_extract(t, "^&#[xX]([0-9A-Fa-f]+);$", 1)
    expr = F.when(t.startswith("<![CDATA["), t.substr(F.lit(10), F.length(t) - F.lit(12)))
    if drop_tags:
        expr = expr.when(t.startswith("<") & (F.length(t) > 1), F.lit(""))
    return (
        expr.when((dec != "") & (F.length(dec) <= 7), codepoint_char(dec.cast("bigint")))
        .when((hexa != "") & (F.length(hexa) <= 6), codepoint_char(F.conv(hexa, 16, 10).cast("bigint")))
        .when(t.startswith("&") & named.isNotNull(), named)
        .otherwise(t)
    )


def markup_text(c, drop_tags: bool = True) -> Column:
    """Text content of an XML/HTML fragment: tags and comments removed,
    CDATA kept verbatim, named and numeric character references decoded."""
    tokens = F.regexp_extract_all(_col(c), F.lit(MARKUP_TOKEN), 0)
    return F.array_join(F.transform(tokens, lambda t: _decode_token(t, drop_tags)), "")


def decode_entities(c) -> Column:
    """Decode character references in plain text (no tags expected)."""
    return markup_text(c, drop_tags=False)

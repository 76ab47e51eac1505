"""Elements of HTML pages as built-in expressions: one pass with a stack of open tags.

A page is cut into tokens (tags, comments, raw ``script``/``style`` elements, text) by one
regular expression.  A fold over the tags keeps the open elements and gives the token
ranges of those that are wanted, nested or not, so nothing is parsed once per tag name.
Nesting follows a plain tree builder: an end tag closes the innermost open element of
its name and everything in it, and is ignored if there is none; what is left open ends
with its parent (an unclosed ``li`` holds the next one); void and self-closed tags hold
nothing.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, decode_entities

#: attribute values in quotes may hold ``>``
TOKEN = ("(?is)<!--.*?-->|<(script|style)\\b[^>]*>.*?(?:</\\1\\s*>|\\z)|</?[a-z](?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>|<[^>]*>|[^<]+|<")
NAME = "^(?:</?)([a-zA-Z][^\\s/>]*)"
#: elements without content (fixed values)
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
RAW = ["script", "style"]
ID = "(?is)\\sid\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
RANGE = "array<struct<at:int,end:int,name:string>>"


def tokens(html) -> Column:
    """Tags, comments, raw elements and runs of text, in order; joined they are the page."""
    return F.regexp_extract_all(F.coalesce(_col(html), F.lit("")), F.lit(TOKEN), 0)


def tag_id(tag: Column) -> Column:
    """Value of a tag's ``id`` attribute, ``''`` without one."""
    return F.concat(*[F.regexp_extract(tag, ID, k) for k in (1, 2, 3)])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def elements(toks: Column, wanted: Callable[[Column, Column], Column], outermost: bool = False) -> Column:
    """Token ranges ``(at, end, name)`` of the wanted elements in page order, from the
    start tag on, the end excluded.

    ``wanted`` gets a start tag and its lower-case name.  With ``outermost``, wanted
    elements within wanted ones are left out."""

    def marked(t: Column, name: Column) -> Column:
        kind = F.when(t.startswith("</"), 2).when(name.isin(*VOID, *RAW) | t.endswith("/>"), 3).otherwise(1)
        return _let(kind, lambda k: F.struct(name.alias("name"), k.alias("kind"), F.when(k != 2, wanted(t, name)).otherwise(F.lit(False)).alias("want")))

    named = F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.when(t.startswith("<"), F.lower(F.regexp_extract(t, NAME, 1))).otherwise("").alias("name")))
    tags = F.transform(F.filter(named, lambda x: x["name"] != ""), lambda x: F.struct(marked(x["t"], x["name"]).alias("m"), x["i"].alias("i")))
    stack_type = "array<struct<name:string,at:int,want:boolean>>"

    def closed(stack: Column, keep: Column, end: Column) -> Column:
        gone = F.filter(F.slice(stack, keep + 1, F.size(stack)), lambda x: x["want"])
        return F.transform(gone, lambda x: F.struct(x["at"].alias("at"), end.alias("end"), x["name"].alias("name")))

    def state(stack: Column, found: Column) -> Column:
        return F.struct(stack.cast(stack_type).alias("stack"), found.cast(RANGE).alias("found"))

    def step(now: Column, x: Column) -> Column:
        stack, found, m, i = now["stack"], now["found"], x["m"], x["i"]

        def opens(want: Column) -> Column:
            alone = F.struct(i.alias("at"), (i + 1).alias("end"), m["name"].alias("name"))
            opened = F.struct(m["name"].alias("name"), i.alias("at"), want.alias("want"))
            return F.when(m["kind"] == 1, state(F.array_append(stack, opened), found)).when(want, state(stack, F.array_append(found, alone))).otherwise(now)

        def ends(last: Column) -> Column:
            keep = F.size(stack) - last
            return F.when(last > 0, state(F.slice(stack, F.lit(1), keep), F.concat(found, closed(stack, keep, i + 1)))).otherwise(now)

        want = m["want"] & ~F.exists(stack, lambda s: s["want"]) if outermost else m["want"]
        last = F.array_position(F.reverse(F.transform(stack, lambda s: s["name"])), m["name"]).cast("int")  # from the top, 0: none
        return F.when(m["kind"] == 2, _let(last, ends)).otherwise(_let(want, opens))

    start = F.struct(F.expr(f"CAST(array() AS {stack_type})").alias("stack"), F.expr(f"CAST(array() AS {RANGE})").alias("found"))
    return F.aggregate(tags, start, step, lambda s: F.sort_array(F.concat(s["found"], closed(s["stack"], F.lit(0), F.size(toks))).cast(RANGE)))


def text_of(toks: Column) -> Column:
    """Text of tokens: tags and comments dropped, what raw elements hold kept as it is,
    character references elsewhere decoded."""
    inner = "(?is)^<(?:script|style)\\b[^>]*>(.*?)(?:</(?:script|style)\\s*>)?$"

    def text(t: Column) -> Column:
        raw = F.replace(F.regexp_extract(t, inner, 1), F.lit("&"), F.lit("&amp;"))
        return F.when(~t.startswith("<") | (t == "<"), t).when(t.rlike("(?i)^<(script|style)\\b"), raw).otherwise("")

    return decode_entities(F.array_join(F.transform(toks, text), ""))


def text_without(html, names: list[str]) -> Column:
    """Text of the page without the elements of these names and their content."""

    def rest(toks: Column, ranges: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["end"]))
        starts = F.concat(F.transform(ranges, lambda r: r["at"]), F.array(F.size(toks)))
        return text_of(F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(toks, a + 1, b - a))))

    return _let(tokens(html), lambda toks: _let(elements(toks, lambda t, name: name.isin(*names), outermost=True), lambda ranges: rest(toks, ranges)))


def text_by_id(html, element_id) -> Column:
    """Text of the first element with that id; NULL without one."""

    def found(toks: Column) -> Column:
        first = F.get(elements(toks, lambda t, name: tag_id(t) == _col(element_id)), F.lit(0))
        return _let(first, lambda r: F.when(r.isNotNull(), text_of(F.slice(toks, r["at"] + 1, r["end"] - r["at"]))))

    return _let(tokens(html), found)


def table_cells(html) -> Column:
    """``array<array<string>>``: the text of each cell (``td``) of each row of the page's
    first table.  Rows and cells of tables within it count too, as a tree search finds
    them: in page order, and a nested cell also in the rows around it."""

    def inside(r: Column, outer: Column) -> Column:
        return (r["at"] > outer["at"]) & (r["end"] <= outer["end"])

    def rows(toks: Column, found: Column) -> Column:
        table = F.get(F.filter(found, lambda r: r["name"] == "table"), F.lit(0))
        trs = _let(table, lambda t: F.filter(found, lambda r: (r["name"] == "tr") & inside(r, t)))
        text = lambda c: text_of(F.slice(toks, c["at"] + 1, c["end"] - c["at"]))
        return F.transform(trs, lambda row: F.transform(F.filter(found, lambda c: (c["name"] == "td") & inside(c, row)), text))

    return _let(tokens(html), lambda toks: _let(elements(toks, lambda t, name: name.isin("table", "tr", "td")), lambda found: rows(toks, found)))

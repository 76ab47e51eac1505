"""Keyword queries in conjunctive normal form.

Matching rules (they decide which papers a review keeps):

* A query is a string such as ``(a OR b) AND (c OR d)``.  The text of every
  ``(...)`` group (no nested ``)``) is taken with outer blanks removed; each
  group is a disjunction, and the expression left after deleting every
  ``(group)`` is a conjunction.
* A disjunction is split on ``or`` in any case, **also inside words**
  (``orchestrat`` gives the pieces ``''`` and ``chestrat``); a conjunction is
  split on ``and`` the same way.  Pieces are stripped and lower-cased.
* A piece matches when it is a substring of the lower-cased text; the empty
  piece matches every text.  A disjunction needs one matching piece, the
  conjunction needs all.
* Keyword groups ``[[w, ...], ...]`` become ``(w1 OR w2 ...) AND (...)`` with
  duplicates removed inside each group; no groups accept everything, an
  empty group leaves a literal ``()`` the text must contain.

Two evaluation forms give the same answer:

* ``cnf_column(text, query)`` for a query known on the driver: the query is
  compiled once into an AND/OR tree of ``contains`` on ``lower(text)``,
  constant pieces folded away, so the filter stays in whole-stage codegen and
  next to the scan.
* ``cnf_match_expr(text, query_col)`` for a query held in a column (one per
  row, e.g. many studies at once): higher-order array functions evaluate it
  per row on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_WS, py_strip

_GROUP = re.compile(r"\(([^)]+)\)")
_OR = re.compile("or", re.IGNORECASE)
_AND = re.compile("and", re.IGNORECASE)


def _pystrip_lower(s: str) -> str:
    return s.strip().lower()


@dataclass(frozen=True)
class CompiledCnf:
    """Literal pieces of a query: every group needs one of its pieces, and
    every conjunct piece is needed.  Groups holding ``''`` are always true and
    have been dropped, as have empty conjunct pieces."""

    any_of: tuple[tuple[str, ...], ...]
    all_of: tuple[str, ...]

    @property
    def always_true(self) -> bool:
        return not self.any_of and not self.all_of

    def matches(self, text: str) -> bool:
        """Plain-Python evaluation (used by tests and small driver checks)."""
        low = text.lower()
        return all(any(p in low for p in g) for g in self.any_of) and all(p in low for p in self.all_of)


def compile_cnf(query: str) -> CompiledCnf:
    groups = [g.strip() for g in _GROUP.findall(query)]
    rest = query
    for g in groups:
        rest = rest.replace(f"({g})", "")
    any_of: list[tuple[str, ...]] = []
    for g in groups:
        pieces = {_pystrip_lower(p) for p in _OR.split(g)}
        if "" in pieces:
            continue
        group = tuple(sorted(pieces))
        if group not in any_of:
            any_of.append(group)
    all_of = tuple(sorted({_pystrip_lower(p) for p in _AND.split(rest)} - {""}))
    return CompiledCnf(tuple(any_of), all_of)


def query_from_groups(groups: Sequence[Sequence[str]] | None) -> str:
    """``[[a, b], [c]]`` → ``(a OR b) AND (c)``; duplicates inside a group are
    dropped and the words sorted so the string is deterministic."""
    if not groups:
        return ""
    return " AND ".join("(" + " OR ".join(sorted(set(g))) + ")" for g in groups)


def compile_groups(groups: Sequence[Sequence[str]] | None, split: str = "substring") -> CompiledCnf:
    """Compile keyword groups.

    ``split="substring"`` splits every word on ``or``/``and`` as a query string
    would; ``split="token"`` takes each listed word as one literal (an empty
    group then matches nothing).
    """
    if split == "substring":
        return compile_cnf(query_from_groups(groups))
    if split != "token":
        raise ValueError(f"split must be 'substring' or 'token', not {split!r}")
    any_of: list[tuple[str, ...]] = []
    for g in groups or []:
        pieces = {_pystrip_lower(w) for w in g}
        if "" in pieces:
            continue
        group = tuple(sorted(pieces))
        if not group:
            return CompiledCnf(((),), ())
        if group not in any_of:
            any_of.append(group)
    return CompiledCnf(tuple(any_of), ())


def compiled_column(text, compiled: CompiledCnf) -> Column:
    """AND/OR tree of ``contains`` over ``lower(text)``."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    terms: list[Column] = []
    for group in compiled.any_of:
        if not group:
            return F.lit(False)
        terms.append(reduce(or_, [low.contains(p) for p in group]))
    terms.extend(low.contains(p) for p in compiled.all_of)
    if not terms:
        # Still NULL for a NULL text, like the per-row form.
        return F.when(low.isNotNull(), F.lit(True))
    return reduce(and_, terms)


def cnf_column(text, query: str) -> Column:
    """Match ``text`` against a constant CNF query string."""
    return compiled_column(text, compile_cnf(query))


def keyword_groups_match(text, groups: Sequence[Sequence[str]] | None, split: str = "substring") -> Column:
    """Match ``text`` against constant keyword groups (see ``compile_groups``)."""
    return compiled_column(text, compile_groups(groups, split))


# --- per-row form ------------------------------------------------------------
def _lower_strip(c: Column) -> Column:
    return F.lower(py_strip(c))


def or_pieces(expr: Column) -> Column:
    """Stripped, lower-cased pieces of a disjunction (split on ``or``)."""
    return F.transform(F.split(expr, "(?i)or"), _lower_strip)


def and_pieces(expr: Column) -> Column:
    """Stripped, lower-cased pieces of a conjunction (split on ``and``)."""
    return F.transform(F.split(expr, "(?i)and"), _lower_strip)


def paren_groups(expr: Column) -> Column:
    """Stripped text of every ``(...)`` group, in order."""
    return F.transform(F.regexp_extract_all(expr, F.lit("\\(([^)]+)\\)"), 1), py_strip)


def remainder(expr: Column, groups: Column) -> Column:
    """The query with each ``(group)`` deleted, in group order."""
    return F.aggregate(groups, expr, lambda acc, g: F.replace(acc, F.concat(F.lit("("), g, F.lit(")")), F.lit("")))


def or_match_expr(text, expr) -> Column:
    """Disjunction held in a column."""
    low = F.lower(_c(text))
    return F.exists(or_pieces(_c(expr)), lambda p: low.contains(p))


def and_match_expr(text, expr) -> Column:
    """Conjunction held in a column."""
    low = F.lower(_c(text))
    return F.forall(and_pieces(_c(expr)), lambda p: low.contains(p))


def compile_query_expr(expr) -> Column:
    """Per-row compile: ``struct(any_of array<array<string>>, all_of array<string>)``.

    Evaluate it once per query row (e.g. on the small studies side of a join)
    and match many texts with ``match_compiled_expr``."""
    e = _c(expr)
    groups = paren_groups(e)
    return F.named_struct(
        F.lit("any_of"), F.transform(groups, or_pieces),
        F.lit("all_of"), and_pieces(remainder(e, groups)),
    )


def match_compiled_expr(text, compiled) -> Column:
    low = F.lower(_c(text))
    c = _c(compiled)
    return (F.forall(c["any_of"], lambda g: F.exists(g, lambda p: low.contains(p)))
            & F.forall(c["all_of"], lambda p: low.contains(p)))


def cnf_match_expr(text, expr) -> Column:
    """CNF query held in a column, evaluated per row."""
    return match_compiled_expr(text, compile_query_expr(expr))


def groups_query_expr(groups) -> Column:
    """Per-row ``query_from_groups`` for an ``array<array<string>>`` column."""
    g = _c(groups)
    parts = F.transform(g, lambda grp: F.concat(F.lit("("), F.array_join(F.array_sort(F.array_distinct(grp)), " OR "), F.lit(")")))
    return F.coalesce(F.array_join(parts, " AND "), F.lit(""))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_inside_parens(expr) -> Column:
    """The stripped text of each ``(...)`` group (operator exposed on its own)."""
    return paren_groups(_c(expr))


__all__ = [
    "CompiledCnf", "compile_cnf", "compile_groups", "query_from_groups", "compiled_column",
    "cnf_column", "keyword_groups_match", "or_match_expr", "and_match_expr", "cnf_match_expr",
    "compile_query_expr", "match_compiled_expr", "groups_query_expr", "text_inside_parens", "PY_WS",
]

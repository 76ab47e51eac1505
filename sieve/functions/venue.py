"""Venue Column expressions: key split, type and year filters, ranks, gate."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import VENUE_RANKS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def key_parts(key) -> Column:
    """``type/code/key`` → array of the segments (valid when it has 3)."""
    return F.split(_c(key), "/")


def venue_type_filter(key, accepted: Sequence[str] | None) -> Column:
    """Key starts with any accepted type (plain string prefix, so ``conf`` also
    accepts ``conference/...``).  ``None`` accepts all, ``[]`` accepts none."""
    k = _c(key)
    if accepted is None:
        return k.isNotNull()
    prefixes = sorted(set(accepted))
    if not prefixes:
        return F.lit(False)
    return reduce(or_, [k.startswith(p) for p in prefixes])


def prefix_any_expr(key, prefixes) -> Column:
    """Per-row form of ``venue_type_filter`` for an ``array<string>`` column;
    a NULL list accepts all."""
    k = _c(key)
    p = _c(prefixes)
    return F.when(p.isNull(), k.isNotNull()).otherwise(F.exists(p, lambda t: k.startswith(t)))


def year_filter(year, year_min: int, year_max: int) -> Column:
    """Both ends inclusive."""
    return _c(year).between(F.lit(year_min), F.lit(year_max))


def parse_rank(text) -> Column:
    """Rank text → rank name: ``A*`` → ``A_STAR``, a member name in any case
    → that name, anything else (``Australasian B``, NULL) → ``MISSING``."""
    t = _c(text)
    up = F.upper(t)
    return (F.when(t == "A*", F.lit("A_STAR"))
            .when(up.isin(*VENUE_RANKS), up)
            .otherwise(F.lit("MISSING")))


def rank_ordinal(rank) -> Column:
    """Rank name → ordinal (MISSING 0, A_STAR 1, A 2, B 3, C 4); unknown → 0."""
    r = _c(rank)
    expr = F.when(r == VENUE_RANKS[0], F.lit(0))
    for i, name in enumerate(VENUE_RANKS[1:], start=1):
        expr = expr.when(r == name, F.lit(i))
    return expr.otherwise(F.lit(0))


def threshold_rank(threshold) -> Column:
    """Spec threshold text (``A*``, ``A``, ``B``, ``C``) → rank name."""
    return parse_rank(threshold)


def rank_valid(rank, threshold, missing_passes: bool = True) -> Column:
    """Threshold NULL → valid; else ``ordinal(rank) <= ordinal(threshold)``.
    MISSING has ordinal 0 and passes unless ``missing_passes=False``."""
    r = F.coalesce(_c(rank), F.lit("MISSING"))
    th = _c(threshold)
    ok = rank_ordinal(r) <= rank_ordinal(threshold_rank(th))
    if not missing_passes:
        ok = ok & (r != "MISSING")
    return th.isNull() | ok


def venue_gate(key, rank, threshold, allow_prefixes, missing_passes: bool = True) -> Column:
    """Accept when the full key starts with an allow-listed prefix OR the rank
    is valid for the threshold.  ``allow_prefixes`` is a Python list or an
    ``array<string>`` column (NULL → empty)."""
    k = _c(key)
    if isinstance(allow_prefixes, (list, tuple)):
        allowed = reduce(or_, [k.startswith(p) for p in sorted(set(allow_prefixes))], F.lit(False))
    else:
        allowed = F.coalesce(F.exists(_c(allow_prefixes), lambda p: k.startswith(p)), F.lit(False))
    return allowed | rank_valid(rank, threshold, missing_passes)


def rank_kind(venue_type) -> Column:
    """Which rank table a venue type is looked up in (others: none)."""
    t = _c(venue_type)
    return F.when(t == "conf", F.lit("conference")).when(t == "journals", F.lit("journal"))

"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source x language x topic) are raked: scaled to one
marginal's target shares after the other until all hold.  A cell's weight over
its tokens is its ratio.

With an expected ``share`` of all tokens, chances are calibrated within bounds: a value
whose target exceeds all its tokens is taken whole, the other targets of its marginal
share what is left in proportion, and cells are raked to these targets with chances of
one at most (cells that reach one are certain, the others make up for them).  So the
sample grows with the table, however rare a cell is, and all marginals that tokens
without repetition can meet are met.  :func:`marginals` reports targets and expectation.

Without ``share`` a document is sampled with its ratio over the largest ratio (times
``rate``): the largest sample that meets every target without repeating documents, which
one rare cell with a huge ratio makes very small.  With ``full_ratio``, ratios are taken
over this number at most, and documents of cells beyond it come in several copies.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, lookup, quoted

#: cells up to which the driver rakes them; more are raked by Spark aggregates
MAX_CELLS = 100_000
ROUNDS = 200
TOLERANCE = 1e-9
Targets = Mapping[str, Mapping[object, float]]


def tokens_column(text: Column) -> Column:
    """Number of words between ASCII white space (null text: 0)."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def topic_column(text: Column) -> Column:
    """Stand-in topic where a table has none: its layout (``table`` with three
    bars or more) or else its size.  Callers with real topics pass their column."""
    text = F.coalesce(text, F.lit(""))
    size = F.octet_length(text)
    bars = size - F.octet_length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(bars >= 3, "table").when(size < 600, "note").when(size < 4000, "article").otherwise("long")


def shares(margin: Mapping[object, float], given: Mapping[object, float] | None, alpha: float) -> dict[object, float]:
    """Target shares of a marginal's values, summing to one.

    Without ``given``, tokens to the power ``alpha``.  Given shares of values that
    do not occur are left out; values without a given share split what is left of
    one in proportion to their tokens; all is scaled to sum to one."""
    live = {v: t for v, t in margin.items() if t > 0}
    if given is None:
        want = {v: t ** alpha for v, t in live.items()}
    else:
        want = {v: given[v] for v in live if v in given}
        rest = {v: t for v, t in live.items() if v not in given}
        left, of = max(0.0, 1 - sum(want.values())), sum(rest.values())
        want |= {v: left * t / of for v, t in rest.items()}
    total = sum(want.values())
    return {v: x / total for v, x in want.items()} if total else {}


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Cell weights with the marginal ``targets`` (arrays by code), from tokens."""
    w = cells / cells.sum()
    for _ in range(ROUNDS):
        worst = 0.0
        for code, target in zip(codes, targets):
            now = np.bincount(code, w, len(target))
            factor = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            worst = max(worst, np.abs(factor[now > 0] - 1).max(initial=0))
            w = w * factor[code]
        if worst < TOLERANCE:
            break
    return w


def attainable(tokens: np.ndarray, shares: np.ndarray, total: float) -> np.ndarray:
    """Expected tokens by value: target ``shares`` times one factor, but no more than the
    value's ``tokens``, ``total`` in all (or all tokens of the values with a share)."""
    live = shares > 0
    got = np.where(live, tokens, 0.0)
    if got.sum() <= total:
        return got
    full = np.zeros(len(tokens), bool)
    while True:  # a value that is full stays so, as the factor only grows
        factor = (total - got[full].sum()) / shares[live & ~full].sum()
        more = live & ~full & (factor * shares >= tokens)
        if not more.any():
            return np.where(full, tokens, factor * shares)
        full |= more


def calibrate(cells: np.ndarray, codes: list[np.ndarray], wanted: list[np.ndarray], share: float) -> tuple[np.ndarray, float]:
    """Chances of the cells, and the largest relative gap that is left between a
    marginal's expected tokens and its attainable target (``wanted``: target shares)."""
    bounds = [np.bincount(c, cells, len(w)) for c, w in zip(codes, wanted)]
    total = min(share * cells.sum(), *[b[w > 0].sum() for b, w in zip(bounds, wanted)])
    bounds = [attainable(b, w, total) for b, w in zip(bounds, wanted)]
    r, gap = np.full(len(cells), share), np.inf
    for _ in range(ROUNDS):
        for code, bound in zip(codes, bounds):
            r = r * _factors(cells, r, code, bound)[code]
        gap = 0.0
        for code, bound in zip(codes, bounds):
            now = np.bincount(code, cells * np.minimum(r, 1), len(bound))
            gap = max(gap, (np.abs(now - bound)[bound > 0] / bound[bound > 0]).max(initial=0))
        if gap < TOLERANCE:
            break
    return np.minimum(r, 1), float(gap)


def _factors(cells: np.ndarray, r: np.ndarray, code: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """By value, the factor ``f`` with sum(cells * min(1, f * r)) = bound: cells from the
    largest ``r`` on are full until the rest can hold what is left."""
    order = np.lexsort((-r, code))
    own, t, x = code[order], cells[order], r[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    sizes = np.diff(np.r_[starts, len(own)])

    def before(values: np.ndarray) -> np.ndarray:
        """Sums over the value's cells in front of each."""
        upto = np.cumsum(values) - values
        return upto - np.repeat(upto[starts], sizes)

    mass = t * x
    rest = np.repeat(np.add.reduceat(mass, starts), sizes) - before(mass)
    f = np.divide(bound[own] - before(t), rest, out=np.full(len(own), np.inf), where=rest > 0)
    spot = np.where(f * x <= 1 + 1e-12, np.arange(len(own)), len(own))
    first = np.minimum.reduceat(spot, starts)
    last = starts + sizes - 1  # where all are full, the factor that fills the last of them
    fills = np.divide(1.0, x[last], out=np.ones(len(starts)), where=x[last] > 0)
    out = np.zeros(len(bound))
    out[own[starts]] = np.maximum(np.where(first < len(own), f[np.minimum(first, len(own) - 1)], fills), 0.0)
    return np.where(bound > 0, out, 0.0)


def _arrays(table: DataFrame, dims: list[str], targets: Targets | None, alpha: float):
    """Cells on the driver: rows, tokens, and codes and target shares by marginal."""
    rows = table.collect()
    tokens, codes, wanted = np.array([r["tokens"] for r in rows], float), [], []
    for d in dims:
        values = list(dict.fromkeys(r[d] for r in rows))
        at = {v: k for k, v in enumerate(values)}
        codes.append(np.array([at[r[d]] for r in rows]))
        share = shares(dict(zip(values, np.bincount(codes[-1], tokens))), (targets or {}).get(d), alpha)
        wanted.append(np.array([share.get(v, 0.0) for v in values]))
    return rows, tokens, codes, wanted


def _framed(table: DataFrame, dims: list[str], rows, values, name: str) -> DataFrame:
    kinds = ", ".join(f"`{d}` {table.schema[d].dataType.simpleString()}" for d in dims)
    made = [(*[r[d] for d in dims], float(x)) for r, x in zip(rows, values)]
    return table.sparkSession.createDataFrame(made, f"{kinds}, {name} double")


def rake_cells(cells: DataFrame, dims: list[str], targets: Targets | None, alpha: float, max_cells: int = MAX_CELLS) -> DataFrame:
    """``dims`` and ``ratio`` per cell.  ``cells`` has ``dims`` and ``tokens``."""
    table, seen = materialize(cells.where("tokens > 0"), "cells", {"n": F.count(F.lit(1)), "t": F.sum("tokens")})
    if not seen["n"]:
        return table.select(*dims, F.lit(1.0).alias("ratio"))
    if seen["n"] <= max_cells:
        rows, tokens, codes, wanted = _arrays(table, dims, targets, alpha)
        return _framed(table, dims, rows, rake(tokens, codes, wanted) / (tokens / tokens.sum()), "ratio")
    return _rake_spark(table, dims, targets, alpha, seen["t"])


def calibrate_cells(cells: DataFrame, dims: list[str], targets: Targets | None, alpha: float, share: float,
                    max_cells: int = MAX_CELLS) -> tuple[DataFrame, float]:
    """``dims`` and ``chance`` per cell, and the gap left (see :func:`calibrate`)."""
    table, seen = materialize(cells.where("tokens > 0"), "cells", {"n": F.count(F.lit(1)), "t": F.sum("tokens")})
    if not seen["n"]:
        return table.select(*dims, F.lit(share).alias("chance")), 0.0
    if seen["n"] <= max_cells:
        rows, tokens, codes, wanted = _arrays(table, dims, targets, alpha)
        chance, gap = calibrate(tokens, codes, wanted, share)
        return _framed(table, dims, rows, chance, "chance"), gap
    return _calibrate_spark(table, dims, targets, alpha, share, seen["t"])


def _margins(table: DataFrame, dims: list[str], targets: Targets | None, alpha: float) -> dict[str, DataFrame]:
    """By marginal its values ``_v``, their tokens ``t`` and target shares ``target``;
    marginals with given shares have as many values as the caller named."""
    spark, margins = table.sparkSession, {}
    for d in dims:
        margin = table.groupBy(d).agg(F.sum("tokens").alias("t"))
        if targets and targets.get(d) is not None:
            given = dict(targets[d])
            kind = table.schema[d].dataType.simpleString()
            told = spark.createDataFrame([(v, float(x)) for v, x in given.items()], f"_given {kind}, given double")
            named = margin.join(F.broadcast(told), F.col(d).eqNullSafe(F.col("_given")), "left") \
                if given else margin.withColumn("given", F.lit(None).cast("double"))
            got, rest = named.agg(F.sum("given"), F.sum(F.when(F.col("given").isNull(), F.col("t")))).head()
            share = F.coalesce("given", F.lit(max(0.0, 1 - (got or 0)) / (rest or 1)) * F.col("t"))
        else:
            named, share = margin, F.pow(F.col("t"), F.lit(alpha))
        made = materialize(named.select(F.col(d).alias("_v"), "t", share.alias("target")), "margin")
        margins[d] = made.withColumn("target", F.col("target") / made.agg(F.sum("target")).head()[0])
    return margins


def _calibrate_spark(table: DataFrame, dims: list[str], targets: Targets | None, alpha: float, share: float, total: int) -> tuple[DataFrame, float]:
    """:func:`calibrate` by one grouped sum and join per marginal and round.  A marginal's
    factor takes the cells that are full so far as full."""
    margins = _margins(table, dims, targets, alpha)
    want = min([share * total] + [m.where("target > 0").agg(F.sum("t")).head()[0] or 0 for m in margins.values()])
    for d, margin in margins.items():
        factor = 0.0
        while True:  # the factor only grows, as in attainable
            full = F.col("target") * factor >= F.col("t")
            held, open_ = margin.where("target > 0").agg(F.sum(F.when(full, F.col("t"))), F.sum(F.when(~full, F.col("target")))).head()
            grown = (want - (held or 0)) / open_ if open_ else factor
            if grown <= factor * (1 + 1e-12):
                break
            factor = grown
        bound = F.when(F.col("target") > 0, F.least(F.col("t").cast("double"), F.col("target") * factor)).otherwise(0.0)
        margins[d] = materialize(margin.select(F.col("_v").alias("_m"), bound.alias("bound")), "bound")
    now, gap, full = table.withColumn("r", F.lit(share)), 0.0, F.col("r") >= 1
    for _ in range(ROUNDS):
        gap = 0.0
        for d in dims:
            sums = now.groupBy(F.col(d).alias("_v")).agg(
                F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).alias("held"),
                F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("r"))), F.lit(0.0)).alias("open"))
            is_, left = F.col("held") + F.col("open"), F.col("bound") - F.col("held")
            change = F.when(F.col("bound") <= 0, 0.0).when((F.col("open") > 0) & (left > 0), left / F.col("open")).when(is_ > 0, F.col("bound") / is_).otherwise(1.0)
            off = F.when(F.col("bound") > 0, F.abs(is_ - F.col("bound")) / F.col("bound"))
            factor = sums.join(margins[d], F.col("_v").eqNullSafe(F.col("_m")), "left").select("_v", change.alias("f"), off.alias("off"))
            next_ = now.join(factor, F.col(d).eqNullSafe(F.col("_v"))).withColumn("r", F.col("r") * F.col("f"))
            now, seen = materialize(next_, "calibrated", {"off": F.max("off")})
            now, gap = now.drop("_v", "f", "off"), max(gap, seen["off"] or 0.0)
        if gap < TOLERANCE:
            break
    return now.select(*dims, F.least("r", F.lit(1.0)).alias("chance")), gap


def _rake_spark(table: DataFrame, dims: list[str], targets: Targets | None, alpha: float, total: int) -> DataFrame:
    """The same updates as :func:`rake`, one grouped sum and join per marginal."""
    margins = _margins(table, dims, targets, alpha)
    now = table.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for _ in range(ROUNDS):
        worst = 0.0
        for d in dims:
            sums = now.groupBy(F.col(d).alias("_v")).agg(F.sum("w").alias("is"))
            factor = sums.join(margins[d].withColumnRenamed("_v", "_m"), F.col("_v").eqNullSafe(F.col("_m")), "left") \
                .select("_v", F.when(F.col("is") > 0, F.coalesce("target", F.lit(0.0)) / F.col("is")).otherwise(0.0).alias("f"))
            next_ = now.join(factor, F.col(d).eqNullSafe(F.col("_v"))).withColumn("w", F.col("w") * F.col("f"))
            now, seen = materialize(next_, "raked", {"worst": F.max(F.when(F.col("w") > 0, F.abs(F.col("f") - 1)))})
            now, worst = now.drop("_v", "f"), max(worst, seen["worst"] or 0.0)
        if worst < TOLERANCE:
            break
    return now.select(*dims, (F.col("w") / (F.col("tokens") / F.lit(float(total)))).alias("ratio"))


def uniform(seed: int, id_: Column, text: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the id (without an id, the text)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_, F.when(id_.isNull(), text)), 11) / F.lit(float(2 ** 53))


def mix(docs: DataFrame, dims: Mapping[str, Column], tokens: Column | None = None, targets: Targets | None = None,
        alpha: float = 0.7, share: float | None = None, rate: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
        out: tuple[str, ...] = ("weight", "probability", "sampled"), max_cells: int = MAX_CELLS,
        full_ratio: float | None = None, gap_col: str | None = None) -> DataFrame:
    """``docs`` with a weight, a chance and a decision for every row.

    ``dims`` names the marginals and gives their columns; a null value is a value
    of its own.  ``targets`` has target shares by marginal and value; a marginal
    without them is tempered: its tokens to the power ``alpha``.  A document has
    its cell's weight; cells without tokens have weight and chance 0.  Equal ids get equal decisions.  The columns
    named in ``out`` are added (an existing column of that name is replaced).

    With ``share`` that share of all tokens is expected in the sample, which meets all
    targets that can be met without repeating documents; the column ``gap_col`` then says
    how far the expected tokens of some value are off its attainable target, relatively
    (over 1e-9 if the rounds ended before, or no chances meet all marginals at once).

    Without ``share`` and ``full_ratio`` a sampled document counts once and the expected token shares
    of the sample are the targets.  With it, a fourth name in ``out`` gives the copies a
    document has to be taken in for that: the whole part of its ratio over the smaller
    of ``full_ratio`` and the largest ratio (times ``rate``), and one more with the rest
    as chance; chance and decision are those of at least one copy."""
    own, held = {}, docs
    for d, column in dims.items():
        own[d] = fresh(held, f"dim_{len(own)}")
        held = held.withColumn(own[d], column)
    names = list(own.values())
    counted = held.select(*names, (tokens_column(quoted(text_col)) if tokens is None else tokens).alias("_tokens"))
    cells = materialize(counted.groupBy(*names).agg(F.sum("_tokens").alias("tokens")), "token-cells")
    goals = {own[d]: t for d, t in (targets or {}).items()}
    ratio, chance = fresh(held, "ratio"), fresh(held, "chance")
    table, seen = materialize(rake_cells(cells, names, goals, alpha, max_cells).withColumnRenamed("ratio", ratio), "ratios", {"most": F.max(ratio)})
    gap = 0.0
    if share is not None:
        chances, gap = calibrate_cells(cells, names, goals, alpha, share, max_cells)
        told = chances.toDF(*[f"{n}_c" for n in names], chance)
        table = table.join(told, [F.col(n).eqNullSafe(F.col(f"{n}_c")) for n in names], "left").drop(*[f"{n}_c" for n in names])
    met = lookup(held, table, names, F.xxhash64(quoted(id_col)))
    weight = F.coalesce(F.col(ratio), F.lit(0.0))
    most = seen["most"] or 1.0
    times = F.coalesce(F.col(chance), F.lit(0.0)) if share is not None else weight * (rate / (most if full_ratio is None else min(most, full_ratio)))
    chances, drawn = F.least(times, F.lit(1.0)), uniform(seed, quoted(id_col), quoted(text_col))
    copies = F.floor(times) + (drawn < times - F.floor(times)).cast("long")
    spots = {n: fresh(held, f"out_{n}") for n in out}
    made = met.withColumns(dict(zip(spots.values(), (weight, chances, drawn < chances, copies)))).drop(ratio, chance, *names)
    made = made.drop(*[c for c in docs.columns if c.lower() in {o.lower() for o in out}]).withColumnsRenamed({v: k for k, v in spots.items()})
    return made if gap_col is None else made.withColumn(gap_col, F.lit(float(gap)))


def marginals(mixed: DataFrame, dims: Mapping[str, Column], tokens: Column, targets: Targets | None = None, alpha: float = 0.7,
              chance_col: str = "probability") -> DataFrame:
    """What a sample does to each marginal: ``dimension``, ``value``, ``tokens``,
    ``target`` and ``expected`` share of the sample, and ``taken``, the expected share of
    the value's tokens.  A target that cannot be met has ``taken`` of one and ``expected``
    below ``target``."""
    made = []
    for d, column in dims.items():
        sums = materialize(mixed.groupBy(column.cast("string").alias("value")).agg(
            F.sum(tokens).alias("tokens"), F.sum(tokens * F.col(chance_col)).alias("kept")).where("tokens > 0"), "marginal")
        wanted = _margins(sums.select(F.col("value").alias("_d"), "tokens"), ["_d"], {"_d": targets[d]} if targets and d in targets else None, alpha)["_d"]
        kept = sums.agg(F.sum("kept")).head()[0] or 1.0
        made.append(sums.join(wanted.select("_v", "target"), F.col("value").eqNullSafe(F.col("_v"))).select(
            F.lit(d).alias("dimension"), "value", "tokens", "target", (F.col("kept") / kept).alias("expected"), (F.col("kept") / F.col("tokens")).alias("taken")))
    return reduce(DataFrame.unionByName, made)

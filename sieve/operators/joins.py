"""Join helpers that keep joins safe at scale.

* ``bounded_broadcast``: write a side once to the shared checkpoint folder,
  counting its rows while writing, and broadcast it only when it holds at
  most ``max_rows`` rows (``sieve.broadcast.maxRows``, default 1,000,000;
  the sides broadcast here are narrow dimension rows); beyond that the plain
  shuffle join is kept, and AQE may still convert or split it at run time.
* ``left_join_nonnull``: rows whose join key is NULL can never match, yet a
  hash shuffle sends all of them to one reducer; their keys are spread over
  sentinels that match nothing, in the same single pass.
* ``unique_by``: reduce a lookup side to one row per key (partial
  aggregation before the shuffle), so a many-to-one join cannot multiply a
  hot left key.
* ``leading_rows``: reduce many rows of few texts before that, without sorting them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 1_000_000
_CONF_KEY = "sieve.broadcast.maxRows"


def broadcast_limit(df: DataFrame) -> int:
    try:
        return int(df.sparkSession.conf.get(_CONF_KEY, str(DEFAULT_BROADCAST_ROWS)))
    except Exception:  # pragma: no cover - conf unreadable
        return DEFAULT_BROADCAST_ROWS


def bounded_broadcast(df: DataFrame, max_rows: int | None = None, name: str = "dim") -> tuple[DataFrame, bool]:
    """``(broadcast(table), True)`` when ``df`` has at most ``max_rows`` rows,
    else ``(table, False)``, where ``table`` is ``df`` written once to the
    shared checkpoint folder (the rows are counted while writing, and the
    join reads the written rows instead of recomputing them)."""
    table, _, ok = bounded_broadcast_with(df, {}, max_rows, name)
    return table, ok


def bounded_broadcast_with(df: DataFrame, metrics: dict, max_rows: int | None = None, name: str = "dim"):
    """``bounded_broadcast`` that also observes ``metrics`` while the side is
    written; returns ``(table, values, broadcast?)``.  The row count is
    observed too, so the size check costs no extra job."""
    from ..session import materialize

    limit = broadcast_limit(df) if max_rows is None else max_rows
    table, values = materialize(df, name, {"_rows": F.count(F.lit(1)), **metrics})
    if values["_rows"] <= limit:
        return F.broadcast(table), values, True
    return table, values, False


def unique_by(df: DataFrame, keys: Sequence[str], order: Column | str, values: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the values of the row with the smallest ``order``.

    ``min_by`` is a partial aggregate, so each map task pre-reduces its rows
    before the shuffle and a hot key costs one row per task, not all its rows.
    """
    o = F.col(order) if isinstance(order, str) else order
    packed = F.struct(*[F.col(v) for v in values])
    agg = df.groupBy(*keys).agg(F.min_by(packed, o).alias("_v"))
    return agg.select(*keys, *[F.col("_v")[v].alias(v) for v in values])


def leading_rows(df: DataFrame, text: str, key: Column, name: str, first: str, only: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` with ``name``, a ``key`` made of the column ``text`` alone, before they
    are reduced to one per key by an order that ``first`` leads: of the rows of a text only
    those with the smallest ``first`` (NULL before any value).  Rows without a key, or with
    one that ``only`` doesn't have, are left out.

    ``unique_by`` alone would make every row's key and sort each task's rows, as they hold
    texts.  Here a hash aggregate takes the smallest ``first``, so a task holds a row per
    text, and keys are made once per text.  ``df`` is evaluated twice; with too many texts
    for a broadcast all rows are returned, as little would be saved."""
    def keyed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(name, key).where(F.col(name).isNotNull())
        return rows if only is None else rows.join(only, name, "left_semi")

    least = df.groupBy(text).agg(F.min(first).alias("_least"), F.max(F.col(first).isNull()).alias("_null"))
    # both tables are written: Spark would move or copy filters on a key to all rows of df
    texts, few = bounded_broadcast(least, name="least")
    if not few:
        return keyed(df)
    leads = F.when(F.col("_null"), F.col(first).isNull()).otherwise(F.col(first) == F.col("_least"))
    return df.join(bounded_broadcast(keyed(texts), name="keyed")[0], text).where(leads).drop("_least", "_null")


NULL_SALT_BUCKETS = 4096


def left_join_nonnull(left: DataFrame, right: DataFrame, left_keys: Sequence[str],
                      right_keys: Sequence[str] | None = None, broadcast_right: bool = False) -> DataFrame:
    """Left equi-join that keeps NULL keys off a single reducer.

    A NULL key can never match, yet a hash shuffle sends every such row to the
    same reducer.  String keys that are NULL are replaced, for the join only,
    by one of ``NULL_SALT_BUCKETS`` sentinels (a control character no real key
    starts with, plus a hash of the row), so they spread over all reducers
    and still match nothing.  ``right`` must be unique per key (see
    ``unique_by``); its key columns are dropped.  ``broadcast_right=True``
    broadcasts ``right`` when its size check passes (``bounded_broadcast``);
    otherwise both sides are shuffled on the key and AQE may still turn the
    join into a broadcast from the measured shuffle size.
    """
    right_keys = list(right_keys or left_keys)
    left_keys = list(left_keys)
    r, is_bc = bounded_broadcast(right) if broadcast_right else (right, False)
    tmp_l = [f"_lk{i}" for i in range(len(left_keys))]
    tmp_r = [f"_rk{i}" for i in range(len(right_keys))]
    row_hash = F.abs(F.xxhash64(*[F.col(c) for c in left.columns])) % NULL_SALT_BUCKETS
    lk_cols = []
    for k, t in zip(left_keys, tmp_l):
        c = F.col(k)
        if not is_bc and left.schema[k].dataType.simpleString() == "string":
            c = F.when(c.isNull(), F.concat(F.lit("\u0000"), row_hash.cast("string"))).otherwise(c)
        lk_cols.append(c.alias(t))
    keyed = left.select("*", *lk_cols)
    renamed = r
    for rk, t in zip(right_keys, tmp_r):
        renamed = renamed.withColumnRenamed(rk, t)
    cond = [keyed[a] == renamed[b] for a, b in zip(tmp_l, tmp_r)]
    return keyed.join(renamed, cond, "left").drop(*tmp_l, *tmp_r)

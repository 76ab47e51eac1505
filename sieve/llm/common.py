"""Helpers shared by the operators of this package."""

from __future__ import annotations

from typing import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: rows of a lookup side up to which it is broadcast; narrow rows only
BROADCAST_ROWS = 200_000
#: ids up to which a set of them is broadcast (8 bytes each)
BROADCAST_IDS = 1_000_000
#: rows of long texts in an Arrow batch, and its bytes
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20
#: rows of a key from which it is spread over several tasks
HOT_ROWS = 100_000
#: parts that rows without an id are dealt in
NULL_PARTS = 256


def lower_ascii_table() -> bytes:
    """``bytes.translate`` table: A-Z to a-z, all other bytes unchanged (UTF-8 safe)."""
    return bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_table() -> bytes:
    """``bytes.translate`` table after which ``split()`` gives the lower-cased
    words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text: digits, letters
    and every non-ASCII character are kept, all else becomes a space."""

    def of(c: int) -> int:
        if 65 <= c <= 90:
            return c + 32
        return c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32

    return bytes(of(c) for c in range(256))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare case-insensitively)."""
    have = {c.lower() for c in df.columns}
    name, k = f"_{stem}", 0
    while name.lower() in have:
        k += 1
        name = f"_{stem}{k}"
    return name


def quoted(name: str) -> Column:
    """Column by its literal name, also with dots or backquotes in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only.  For ASCII texts the built-in ``lower`` does just
    that and is much faster than ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(c: Column) -> Column:
    """Array of the words of :func:`word_table` (null text: empty array)."""
    parts = F.split(lower_ascii(F.coalesce(c, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Column,
           how: str = "left", max_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``left`` to ``right`` (unique per ``on``; null keys match null keys).

    ``right`` is written once and its rows are counted.  Up to ``max_rows`` it is
    broadcast, so ``left`` is not shuffled.  Beyond, the keys of ``left`` are counted: one
    with over ``hot_rows`` rows is dealt by ``spread`` (a hash of a column that varies within
    a key) into parts of about that size, and only such keys are copied in ``right``, once
    a part.  All ways give the same rows.  The key columns appear once.
    """
    table, seen = materialize(right, "lookup", {"rows": F.count(F.lit(1))})
    keys = [fresh(left, f"key{i}") for i in range(len(on))]
    table = table.select(*[quoted(k).alias(n) for k, n in zip(on, keys)],
                         *[quoted(c) for c in table.columns if c not in on])
    cond = [left[f"`{k}`"].eqNullSafe(F.col(n)) for k, n in zip(on, keys)]
    if seen["rows"] <= max_rows:
        return left.join(F.broadcast(table), cond, how).drop(*keys)
    parts = fresh(left, "parts")
    counted = left.groupBy(*[quoted(k).alias(f"{k}_h") for k, n in zip(on, keys)]).agg(F.count(F.lit(1)).alias(parts)).where(F.col(parts) > hot_rows)
    hot, found = materialize(counted.withColumn(parts, F.ceil(F.col(parts) / F.lit(hot_rows)).cast("int")), "hot-keys", {"rows": F.count(F.lit(1))})
    if not found["rows"]:
        return left.join(table, cond, how).drop(*keys)
    # a hot key has hot_rows rows at least, so there are few of them
    named = [hot.select(*[quoted(f"{k}_h").alias(f"{n}_h") for k, n in zip(on, keys)], parts) for _ in range(2)]
    few = [F.broadcast(h) if found["rows"] <= max_rows else h for h in named]
    salt, copy = fresh(left, "salt"), fresh(left, "copy")
    marks = [f"{n}_h" for n in keys]
    salted = left.join(few[0], [left[f"`{k}`"].eqNullSafe(F.col(m)) for k, m in zip(on, marks)], "left") \
        .withColumn(salt, F.when(F.col(parts).isNotNull(), F.pmod(spread, F.col(parts)).cast("int")).otherwise(0)).drop(parts, *marks)
    copies = table.join(few[1], [F.col(n).eqNullSafe(F.col(m)) for n, m in zip(keys, marks)], "left") \
        .withColumn(copy, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts, *marks)
    cond = [salted[f"`{k}`"].eqNullSafe(F.col(n)) for k, n in zip(on, keys)] + [F.col(salt) == F.col(copy)]
    return salted.join(copies, cond, how).drop(salt, copy, *keys)


def by_id(docs: DataFrame, id_col: str, info: DataFrame, key: str, how: str = "left") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` joined to ``info`` (unique per ``key``) by id, null ids to a null key.

    Rows without an id are dealt over :data:`NULL_PARTS` parts by a hash of the row, so
    that they and their texts don't meet in one task.  The columns of ``info`` get names
    that ``docs`` lacks; returns the join and the names by column.  Callers drop them."""
    names = {c: fresh(docs, c.lstrip("_")) for c in info.columns}
    renamed = info.select(*[quoted(c).alias(n) for c, n in names.items()])
    part, copy = fresh(docs, "part"), fresh(docs, "part_copy")
    own = F.when(quoted(id_col).isNull(), F.pmod(F.xxhash64(*[quoted(c) for c in docs.columns]), F.lit(NULL_PARTS)).cast("int")).otherwise(0)
    copies = F.when(F.col(names[key]).isNull(), F.sequence(F.lit(0), F.lit(NULL_PARTS - 1))).otherwise(F.array(F.lit(0)))
    renamed = renamed.withColumn(copy, F.explode(copies))
    met = docs.withColumn(part, own).join(renamed, quoted(id_col).eqNullSafe(F.col(names[key])) & (F.col(part) == F.col(copy)), how)
    return met.drop(part, copy), names


def without(docs: DataFrame, id_col: str, gone: DataFrame, max_rows: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``gone`` (distinct; a
    null there takes rows without an id).  Up to ``max_rows`` ids are broadcast, so the
    rows of ``docs`` are not shuffled; more are joined by shuffle."""
    ids, seen = materialize(gone, "gone", {"rows": F.count(F.lit(1))})
    name = fresh(docs, "gone")
    ids = ids.toDF(name)
    return docs.join(F.broadcast(ids) if seen["rows"] <= max_rows else ids, quoted(id_col).eqNullSafe(F.col(name)), "left_anti")


def bounded_batches(spark: SparkSession) -> None:
    """Set this session's Arrow batches to :data:`BATCH_ROWS` rows, if they are larger, and
    :data:`BATCH_BYTES`: documents and pages can be long, and a batch is held in a
    Python worker as a whole."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts_of(column) -> list:
    """An Arrow string column as UTF-8 bytes, null as None."""
    return column.cast(pa.large_binary()).to_pylist()

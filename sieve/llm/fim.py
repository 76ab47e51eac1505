"""Fill-in-the-middle transformation with Roaring-style boundary sets.

A text is cut into lines (units).  The code point offsets at which units end form
its boundary set, kept as a Roaring bitmap keeps integers: offsets with equal high
16 bits share a container, which holds their low 16 bits as a sorted array, a bitmap
or runs, whichever is smallest, and the containers' cumulative cardinalities say how
many offsets come before each.  The offset after *k* units is the *k*-th member: a
binary search over the cumulative cardinalities finds its container and a local
select finds it there.  A set is a few bytes per unit at most, so it can be stored
(:func:`boundaries`) and cut anew for other seeds (:func:`cuts`) without the texts.

Which units a text is cut after, its form and its output depend on its id, the seed
and the text alone.  Only offsets come back from Python; the pieces are put together
by Spark's own string functions, in the scan of the texts.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted

ARRAY, BITMAP, RUNS = range(3)
#: bytes of a bitmap container
BITMAP_BYTES = 8192
#: prefix, suffix and middle marks
MARKS = ("<P>", "<S>", "<M>")
CUTS = "units long, first long, second long"


def unit_ends(text: str) -> np.ndarray:
    """Ascending code point offsets at which the units ``[^\\n]*\\n|[^\\n]+`` end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    return ends if not len(points) or points[-1] == 10 else np.append(ends, len(points))


class BoundarySet:
    """A set of ascending offsets in containers by their high bits."""

    def __init__(self, keys: list[int], containers: list[tuple[int, np.ndarray]]):
        self.keys, self.containers = keys, containers
        self.before = np.cumsum([0] + [_cardinality(c) for c in containers])

    @classmethod
    def of(cls, offsets: np.ndarray) -> "BoundarySet":
        """From ascending distinct offsets."""
        high = offsets >> 16
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(offsets) else np.zeros(0, np.int64)
        parts = np.split((offsets & 0xFFFF).astype(np.uint16), starts[1:]) if len(offsets) else []
        return cls([int(high[s]) for s in starts], [_container(p) for p in parts])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The ``k``-th smallest offset, from 1; 0 for ``k`` = 0 (the start of the text)."""
        if k == 0:
            return 0
        if not 0 < k <= len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k)) - 1
        return self.keys[at] << 16 | _select(self.containers[at], k - int(self.before[at]))

    def to_bytes(self) -> bytes:
        """Number of containers, then key, kind, bytes and data of each (little-endian)."""
        out = [struct.pack("<I", len(self.keys))]
        for key, (kind, data) in zip(self.keys, self.containers):
            raw = data.tobytes()
            out += [struct.pack("<IBI", key, kind, len(raw)), raw]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "BoundarySet":
        (count,), at, keys, containers = struct.unpack_from("<I", raw), 4, [], []
        for _ in range(count):
            key, kind, size = struct.unpack_from("<IBI", raw, at)
            at += struct.calcsize("<IBI")
            keys.append(key)
            containers.append((kind, np.frombuffer(raw, "<u8" if kind == BITMAP else "<u2", size // (8 if kind == BITMAP else 2), at)))
            at += size
        return cls(keys, containers)


def _container(low: np.ndarray) -> tuple[int, np.ndarray]:
    """Ascending 16-bit values as the smallest kind of container.  Runs are pairs of
    first value and further values."""
    breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1)
    if 4 * (len(breaks) + 1) < min(2 * len(low), BITMAP_BYTES):
        first, last = low[np.r_[0, breaks + 1]], low[np.r_[breaks, len(low) - 1]]
        return RUNS, np.stack([first, last - first], 1).ravel()
    if 2 * len(low) <= BITMAP_BYTES:
        return ARRAY, low
    bits = np.zeros(1 << 16, np.uint8)
    bits[low] = 1
    return BITMAP, np.packbits(bits, bitorder="little").view("<u8")


def _cardinality(container: tuple[int, np.ndarray]) -> int:
    kind, data = container
    if kind == ARRAY:
        return len(data)
    if kind == RUNS:
        return int(data[1::2].sum(dtype=np.int64)) + len(data) // 2
    return int(np.bitwise_count(data).sum(dtype=np.int64))


def _select(container: tuple[int, np.ndarray], k: int) -> int:
    """The ``k``-th smallest value of a container, from 1."""
    kind, data = container
    if kind == ARRAY:
        return int(data[k - 1])
    sizes = data[1::2].astype(np.int64) + 1 if kind == RUNS else np.bitwise_count(data)
    upto = np.cumsum(sizes, dtype=np.int64)
    at = int(np.searchsorted(upto, k))
    left = k - (int(upto[at - 1]) if at else 0)
    if kind == RUNS:
        return int(data[2 * at]) + left - 1
    word = np.unpackbits(data[at:at + 1].view(np.uint8), bitorder="little")
    return at * 64 + int(np.flatnonzero(word)[left - 1])


def draws(seed: int, id_: Column) -> list[Column]:
    """Four unsigned 32-bit numbers per id: the first hex groups of the SHA-256 of
    seed, colon and decimal id (a null id: nothing after the colon)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _cut(found: BoundarySet, one: int, two: int) -> tuple[int, int, int]:
    n = len(found)
    first, second = sorted((one % (n + 1), two % (n + 1)))
    return n, found.select(first), found.select(second)


def text_cuts(text: Column, one: Column, two: Column) -> Column:
    """``units`` of a text and the code point offsets after ``one`` and ``two`` modulo
    (units + 1) of them, the smaller first."""

    def run(texts: pd.Series, ones: pd.Series, twos: pd.Series) -> pd.DataFrame:
        rows = [_cut(BoundarySet.of(unit_ends(t or "")), a, b) for t, a, b in zip(texts, ones, twos)]
        return pd.DataFrame(rows, columns=["units", "first", "second"], dtype="int64")

    return F.pandas_udf(run, CUTS)(text, one, two)


def boundaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``boundaries``, the text's boundary set as bytes, per row (null
    text: the empty set)."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([BoundarySet.of(unit_ends(t or "")).to_bytes() for t in texts], dtype=object)

    return docs.select(quoted(id_col), F.pandas_udf(run, "binary")(quoted(text_col)).alias("boundaries"))


def cuts(sets: DataFrame, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """``id_col, units, first, second`` from stored boundary sets, for a seed."""

    def run(raws: pd.Series, ones: pd.Series, twos: pd.Series) -> pd.DataFrame:
        rows = [_cut(BoundarySet.from_bytes(r), a, b) for r, a, b in zip(raws, ones, twos)]
        return pd.DataFrame(rows, columns=["units", "first", "second"], dtype="int64")

    one, two, *_ = draws(seed, quoted(id_col))
    told = sets.select(quoted(id_col), F.pandas_udf(run, CUTS)("boundaries", one, two).alias("_cut"))
    return told.select(quoted(id_col), "_cut.*")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7,
                   fim_percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS,
                   out: tuple[str, ...] = ("units", "form", "prefix_chars", "middle_chars", "output")) -> DataFrame:
    """``docs`` with the columns named in ``out``: number of units, form (``plain``,
    ``psm`` or ``spm``), code points of prefix and middle (null if plain) and the
    transformed text.

    A text is plain (its output is the text) if it is null (read as empty) or empty,
    holds one of the ``marks``, or is not among the ``fim_percent``; of the others
    ``spm_percent`` put the suffix first.  Rows with equal ids and texts have equal
    results; a null id counts as an empty one.  Pieces may be empty.  Columns named as
    in ``out`` are replaced, all others stay."""
    text, (one, two, three, four) = F.coalesce(quoted(text_col), F.lit("")), draws(seed, quoted(id_col))
    spot = fresh(docs, "cut")
    met = docs.withColumn(spot, text_cuts(text, one, two))
    first, second = F.col(spot)["first"].cast("int"), F.col(spot)["second"].cast("int")
    prefix, middle = F.substring(text, 1, first), F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.length(text))
    marked = [F.contains(text, F.lit(m)) for m in marks]
    plain = (text == "") | marked[0] | marked[1] | marked[2] | (three % 100 >= fim_percent)
    form = F.when(plain, "plain").when(four % 100 < spm_percent, "spm").otherwise("psm")
    p, s, m = map(F.lit, marks)
    output = F.when(plain, text).when(four % 100 < spm_percent, F.concat(s, suffix, p, prefix, m, middle)) \
        .otherwise(F.concat(p, prefix, s, suffix, m, middle))
    spots = {n: fresh(met, f"fim{k}") for k, n in enumerate(out)}
    values = (F.col(spot)["units"], form, F.when(~plain, first.cast("long")), F.when(~plain, (second - first).cast("long")), output)
    made = met.withColumns(dict(zip(spots.values(), values))).drop(spot)
    return made.drop(*[c for c in docs.columns if c.lower() in {o.lower() for o in out}]).withColumnsRenamed({v: k for k, v in spots.items()})


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from its output and form.  Texts with a mark are plain, and no mark can
    begin within a piece and end in a mark, so each mark stands once."""

    def pieces(one: str, two: str) -> Column:
        body = F.substring(output, len(marks[0 if one == marks[1] else 1]) + 1, F.length(output))
        return F.split(body, f"\\Q{one}\\E|\\Q{two}\\E", -1)

    psm, spm = pieces(marks[1], marks[2]), pieces(marks[0], marks[2])
    return F.when(form == "psm", F.concat(F.get(psm, F.lit(0)), F.get(psm, F.lit(2)), F.get(psm, F.lit(1)))) \
        .when(form == "spm", F.concat(F.get(spm, F.lit(1)), F.get(spm, F.lit(2)), F.get(spm, F.lit(0)))).otherwise(output)

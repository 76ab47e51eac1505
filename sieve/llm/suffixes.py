"""Sparse suffix arrays: passages that repeat across documents.

A passage repeats if ``MIN_WORDS`` consecutive words (split on ASCII white space, A-Z
lowered) also occur in another document.  Only suffixes at content-selected positions
are kept: of every window of ``MIN_WORDS`` words the place of its least hashed
``ANCHOR_WORDS``-gram (the minimiser), about one word in twenty.  Equal windows select
the same place, so equal passages always share a kept suffix.

1. Suffixes whose leading n-gram occurs in one document only are dropped (grouped count).
2. A kept suffix carries its words as far as the windows that select it reach, to the
   right (``after``, from the suffix on) and to the left (``before``); equal ones are
   summed before the shuffle to their least and largest document, so any number of
   copies is one row.
3. Spark deals the rows by their leading n-gram and sorts them by ``after``: a sparse
   suffix array.  Neighbours' common prefixes tell how far matches reach to the right;
   the same rows in the order of ``before``, read backwards, how far they reach to the
   left.  A window is shared by the rows that are together at its depth in both orders;
   if they come from two documents, it marks its words.  Only words are compared, no
   hashes.  The marked windows of a document are joined to spans.  An n-gram with very
   many different extensions has its windows compared one by one, dealt by their digests.
"""

from __future__ import annotations

import hashlib
import re
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import by_id, lookup, lower_ascii_table, quoted, texts_of

MIN_WORDS = 50
ANCHOR_WORDS = 10
LOWER = lower_ascii_table()
#: different extensions of one anchor that are compared within a task (about 20 MB of words)
CROWD = 20_000
#: rows of words that a task holds before it passes them on
HELD = 2_000
#: words of more bytes stand in extensions by a NUL and their SHA-256 (one byte longer, so
#: that no word is taken for another's stand-in)
LONG_WORD = 64
#: odd multipliers of the rolling and the mixing hash (fixed values)
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Mixed 64-bit hashes of all runs of ``n`` word hashes, from prefix sums."""
    inverse = pow(BASE, -1, 1 << 64)
    up = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes) - 1, BASE, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes) - n, inverse, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(hashes * up)]
    out = (sums[n:] - sums[:-n]) * down
    out = (out ^ (out >> np.uint64(31))) * np.uint64(MIX)
    return out ^ (out >> np.uint64(29))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def joined(words: list[bytes]) -> bytes:
    """The words, each with a space after it: sorting by bytes keeps runs that share
    their first words together."""
    if not words:
        return b""
    if max(map(len, words)) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"\0" + hashlib.sha256(w).hexdigest().encode() for w in words]
    return b" ".join(words) + b" "


def kept_suffixes(hashes: np.ndarray, min_words: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leading n-gram hash, place and first and last selecting window of every kept
    suffix of a text of at least ``min_words`` words."""
    grams = rolling(hashes, anchor_words)
    width = min_words - anchor_words + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(1) + np.arange(len(hashes) - min_words + 1)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return grams[place[first]], place[first], first, np.r_[first[1:] - 1, len(place) - 1]


def _anchors(min_words: int, anchor_words: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows, found = [], []
                for row, text in enumerate(texts_of(part.column(1))):
                    words = words_of(text)
                    if len(words) >= min_words:
                        hashes = word_hashes(words)
                        found.append(np.unique(kept_suffixes(hashes, min_words, anchor_words)[0]))
                        rows.append(np.full(len(found[-1]), row))
                if found:
                    ids = part.column(0).take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found).view(np.int64))], ["doc", "anchor"])

    return run


def _extensions(min_words: int, anchor_words: int):
    import xxhash

    names = ["doc", "first", "anchor", "mark", "before", "after"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2)):
                words = words_of(text)
                if len(words) < min_words:  # another row of the same id had the anchors
                    continue
                anchors, place, first, last = kept_suffixes(word_hashes(words), min_words, anchor_words)
                anchors = anchors.view(np.int64)
                for k in np.flatnonzero(np.isin(anchors, wanted.values.to_numpy())):
                    before, after = joined(words[first[k]:place[k]]), joined(words[place[k]:last[k] + min_words])
                    mark = xxhash.xxh64_intdigest(before + b"\n" + after) - (1 << 63)
                    rows.append((doc, first[k], anchors[k], mark, before, after))
                    if len(rows) == HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def word_codes(texts: list[bytes], backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of word numbers, a row per text and -1 after its last word, and the
    numbers of words."""
    split = [t.split(b" ")[:-1] for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = [w for ws in split for w in (reversed(ws) if backwards else ws)]
    codes = np.full((len(texts), max(int(sizes.max()), 1)), -1, np.int64)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = pd.factorize(np.array(flat, dtype=object))[0]
    return codes, sizes


def common_prefixes(codes: np.ndarray) -> np.ndarray:
    """Words that each row shares with the row before it, from the first on."""
    same = (codes[1:] == codes[:-1]) & (codes[1:] >= 0)
    return np.r_[0, np.logical_and.accumulate(same, axis=1).sum(1)]


def window_groups(before: list[bytes], after: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of every row (``sizes`` of them, from the left), numbered so that equal
    numbers are equal words.  Rows come sorted by ``after``."""
    right, ahead = word_codes(after)
    left, behind = word_codes(before, backwards=True)
    order = np.lexsort(left.T[::-1])
    reach_right, reach_left = common_prefixes(right), common_prefixes(left[order])
    depth = np.arange(behind.max() + 1)  # words of a window to the left of the suffix
    by_right = np.cumsum(reach_right[:, None] < min_words - depth, axis=0)
    by_left = np.empty_like(by_right)
    by_left[order] = np.cumsum(reach_left[:, None] < depth, axis=0)
    sizes = behind + ahead - min_words + 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.repeat(behind, sizes) - (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    n = len(sizes) + 1
    return sizes, (at * n + by_right[row, at]) * n + by_left[row, at]


def compare_neighbours(anchor, mark, low, high, sizes, windows):
    """Rows with a window that two documents have: ``keep`` (their indices), the bits
    of those windows, of those that a document before ``low`` has, and the least
    document of any.  Rows are sorted by anchor; equal windows have equal anchors."""
    alone = np.r_[True, anchor[1:] != anchor[:-1]] & np.r_[anchor[1:] != anchor[:-1], True]
    rows = np.flatnonzero(~alone | (low < high))
    if not len(rows):
        return rows, rows, rows, rows
    sizes_, ends = sizes[rows], np.cumsum(sizes)
    starts = np.cumsum(sizes_) - sizes_
    offset = np.arange(sizes_.sum()) - np.repeat(starts, sizes_)
    own = np.repeat(np.arange(len(rows)), sizes_)
    values = windows[np.repeat(ends[rows] - sizes_, sizes_) + offset]
    order = np.argsort(values, kind="stable")
    head = np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]])
    group = np.empty(len(values), np.int64)
    group[order] = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(values)]))
    least = np.minimum.reduceat(low[rows][own][order], head)[group]
    most = np.maximum.reduceat(high[rows][own][order], head)[group]
    shared = least < most
    bit = np.left_shift(np.int64(1), offset)
    bits = np.add.reduceat(np.where(shared, bit, 0), starts)
    lower = np.add.reduceat(np.where(shared & (least < low[rows][own]), bit, 0), starts)
    first = np.minimum.reduceat(np.where(shared, least, np.iinfo(np.int64).max), starts)
    hit = bits != 0
    return rows[hit], bits[hit], lower[hit], first[hit]


def _compare(min_words: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        return _compare_sorted(batches, min_words)

    return run


def _compare_sorted(batches, min_words: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # rows of the last anchor so far

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        col = {n: t.column(n).to_numpy() for n in ("anchor", "mark", "low", "high")}
        sizes, windows = window_groups(t.column("before").to_pylist(), t.column("after").to_pylist(), min_words)
        keep, bits, lower, first = compare_neighbours(*col.values(), sizes, windows)
        out = [pa.array(col["anchor"][keep]), pa.array(col["mark"][keep]), pa.array(col["low"][keep]), pa.array(bits, pa.int64()),
               pa.array(lower, pa.int64()), pa.array(first, pa.int64())]
        return pa.RecordBatch.from_arrays(out, ["anchor", "mark", "low", "bits", "lower", "first_doc"])

    for batch in batches:
        if not len(batch):
            continue
        anchor = batch.column(0).to_numpy()
        if held and held[-1].column(0)[0].as_py() != anchor[0]:
            yield done(held)
            held = []
        if anchor[0] == anchor[-1]:
            held.append(batch)
            continue
        cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1
        yield done([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield done(held)


def _distinct(runs: DataFrame) -> DataFrame:
    """Equal extensions (all words equal) as one row, summed per task before the shuffle."""
    return runs.groupBy("anchor", "mark", "before", "after").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))


def compare_sorted(distinct: DataFrame, min_words: int) -> DataFrame:
    """The suffix array of every anchor, compared within tasks; a task holds one anchor's
    rows at a time, at most :data:`CROWD`."""
    return distinct.select("anchor", "mark", "low", "high", "before", "after").repartition("anchor").sortWithinPartitions("anchor", "after") \
        .mapInArrow(_compare(min_words), "anchor long, mark long, low long, bits long, lower long, first_doc long")


def compare_windows(distinct: DataFrame, min_words: int) -> DataFrame:
    """The same for anchors with more rows: the digests of their windows one by one,
    owners summed per task before the shuffle, so that no anchor's rows come together."""
    both = F.split(F.concat("before", "after").cast("string"), " ")  # ends with an empty piece
    digests = F.transform(F.sequence(F.lit(1), F.size("words") - min_words), lambda i: F.md5(F.array_join(F.slice("words", i, min_words), " ")))
    windows = distinct.withColumn("words", both).select("anchor", "mark", "low", "high", F.posexplode(digests).alias("i", "w"))
    owners = windows.groupBy("anchor", "w").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))
    return windows.join(owners, ["anchor", "w"]).groupBy("anchor", "mark") \
        .agg(F.min("low").alias("low"), F.bit_or(bit).alias("bits"),
             F.bit_or(F.when(F.col("least") < F.col("low"), bit).otherwise(F.lit(0).cast("long"))).alias("lower"), F.min("least").alias("first_doc"))


def shared_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``doc, first, bits, drop, first_doc``: runs of windows, the first at word
    ``first``; bit ``i`` is set if the window ``i`` words on is in another document too
    (``bits``), and if that is one with a smaller id (``drop``)."""
    if not 1 <= anchor_words <= min_words <= anchor_words + 62:
        raise ValueError("a window must have 1 to 63 places for its anchor")
    rows = docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text_col).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    anchors = materialize(rows.mapInArrow(_anchors(min_words, anchor_words), "doc long, anchor long"), "anchors")
    common = anchors.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor")
    wanted = anchors.join(materialize(common, "common-anchors"), "anchor", "left_semi").groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("anchor").alias("wanted"))
    met = rows.join(materialize(wanted, "wanted"), F.col("doc") == F.col("_doc")).select("doc", "text", "wanted")
    runs = materialize(met.mapInArrow(_extensions(min_words, anchor_words), "doc long, first int, anchor long, mark long, before binary, after binary"), "extensions")
    distinct = materialize(_distinct(runs), "distinct")
    crowded, seen = materialize(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
                                .select("anchor", F.lit(True).alias("crowded")), "crowded", {"n": F.count(F.lit(1))})
    if seen["n"]:
        told = lookup(distinct, crowded, ["anchor"], F.xxhash64("mark"))
        compared = compare_sorted(told.where("crowded IS NULL"), min_words).unionByName(compare_windows(told.where("crowded"), min_words))
    else:
        compared = compare_sorted(distinct, min_words)
    shared = materialize(compared, "shared")
    drop = F.when(F.col("doc") > F.col("low"), F.col("bits")).otherwise(F.col("lower"))
    return runs.select("doc", "first", "anchor", "mark").join(shared, ["anchor", "mark"]).select("doc", "first", "bits", drop.alias("drop"), "first_doc")


def _spans(min_words: int):
    def merge(starts: np.ndarray) -> list[dict]:
        starts = np.unique(starts)
        if not len(starts):
            return []
        gap = np.flatnonzero(starts[1:] > starts[:-1] + min_words)
        return [{"start": int(a), "end": int(b) + min_words} for a, b in zip(starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]])]

    def places(first: np.ndarray, bits: np.ndarray) -> np.ndarray:
        at = (bits[:, None] >> np.arange(63)) & 1
        return (first[:, None] + np.arange(63))[at == 1]

    def run(first: pd.Series, bits: pd.Series, drop: pd.Series) -> pd.DataFrame:
        found = [(merge(places(np.asarray(f, np.int64), np.asarray(b, np.int64))), merge(places(np.asarray(f, np.int64), np.asarray(d, np.int64))))
                 for f, b, d in zip(first, bits, drop)]
        return pd.DataFrame(found, columns=["spans", "drops"])

    return F.pandas_udf(run, "spans array<struct<start:int,end:int>>, drops array<struct<start:int,end:int>>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """One row per document with a passage of at least ``min_words`` words that another
    document has too: ``id_col, n_repeated`` (words in such passages), ``spans`` (word
    ranges, the end excluded), ``drops`` (those that a document with a smaller id has)
    and ``first_doc`` (the smallest id that has any of them).

    Ids are integers; rows without an id or text are left out.  Rows with equal ids are
    one document: what repeats only among them doesn't count, and spans of different
    texts under one id are joined.  Texts with fewer words have no passage."""
    runs = shared_windows(docs, id_col, text_col, min_words, anchor_words)
    by = runs.groupBy("doc").agg(F.collect_list(F.struct("first", "bits", "drop")).alias("runs"), F.min("first_doc").alias("first_doc"))
    made = by.withColumn("made", _spans(min_words)(F.col("runs.first"), F.col("runs.bits"), F.col("runs.drop")))
    n = F.aggregate("made.spans", F.lit(0), lambda total, s: total + s["end"] - s["start"])
    return made.select(F.col("doc").alias(id_col), n.alias("n_repeated"), F.col("made.spans").alias("spans"), F.col("made.drops").alias("drops"), "first_doc")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                 anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``docs`` without the passages that a document with a smaller id has too; the
    text before and after a passage stays as it is.  All rows and columns are kept."""
    found = repeated_passages(docs, id_col, text_col, min_words, anchor_words).where(F.size("drops") > 0)
    found = materialize(found.select(quoted(id_col).alias("id"), "drops"), "drops")

    def cut(text: pd.Series, drops: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(text, drops):
            if t is None or spans is None:
                out.append(t)
                continue
            words = list(re.finditer(r"[^\x20\x09-\x0D]+", t))
            kept, at = [], 0
            for s in spans:
                if s["start"] < len(words):
                    kept.append(t[at:words[s["start"]].start()])
                    at = words[min(s["end"], len(words)) - 1].end()
            out.append("".join([*kept, t[at:]]))
        return pd.Series(out, dtype="object")

    met, names = by_id(docs, id_col, found, "id")
    return met.withColumn(text_col, F.pandas_udf(cut, "string")(quoted(text_col), F.col(names["drops"]))).drop(*names.values())

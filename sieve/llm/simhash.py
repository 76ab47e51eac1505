"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each
read as a word of the perfect binary Golay code [23, 12, 7] (zero-padded).
Every word lies within three bits of exactly one codeword, whose 12-bit index
is its key; the indices of the word's one-bit neighbours are further keys (one
key when the word is within two bits of its codeword, up to six otherwise).
Two words that differ in at most one bit therefore share a key.

Pigeonhole for at most three differing bits over three segments: either some
segment is equal and another differs in at most one bit, or each segment
differs in exactly one bit.  The first case is covered by keys (equal segment,
Golay key of a second one) of 34 bits for the six ordered pairs, the second by
the three Golay keys together (36 bits).  One side of a comparison needs all
neighbour keys of a segment, the other only its own; rows say which side they
can take.  Every candidate is verified by its bit distance.
"""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import BROADCAST_ROWS, by_id, fresh, lookup, lower_ascii_table, quoted, without
from .graph import components

SHINGLE = 3
MAX_BITS = 3
#: first bit and width of the segments
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the Golay code (fixed value)
GOLAY = 0xC75
#: fingerprints of a key group that one task compares (at worst each with each)
GROUP = 8_192
LOWER = lower_ascii_table()


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Signed 64-bit SimHash: words split on ASCII white space, A-Z lowered,
    shingles with repeats hashed by XXH64; a bit is set if more than half the
    hashes have it.  No words: zero."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        pieces, total = iter([b" ".join(words)]), 1
    else:
        pieces, total = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    hashes, ones = map(xxhash.xxh64_digest, pieces, repeat(seed)), np.zeros(64, np.int64)
    while block := b"".join(islice(hashes, 32_768)):  # big-endian: most significant bit first
        ones += np.unpackbits(np.frombuffer(block, np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big", signed=True)


def simhash_column(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a long."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")(text)


def golay_tables():
    """``(syndrome of the low 12 bits, of the high 11 bits, error by syndrome,
    per width the index changes that lead to the keys by syndrome)``."""

    def mod(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    low = np.array([mod(x) for x in range(1 << 12)], np.uint16)
    high = np.array([mod(x << 12) for x in range(1 << 11)], np.uint16)
    error = np.zeros(2048, np.uint32)
    ones = [1 << b for b in range(23)]
    patterns = [0, *ones]
    patterns += [ones[a] | ones[b] for a in range(23) for b in range(a)]
    patterns += [ones[a] | ones[b] | ones[c] for a in range(23) for b in range(a) for c in range(b)]
    for e in patterns:
        error[mod(e)] = e
    single = [mod(b) for b in ones]
    changes = {}
    for width in {w for _, w in SEGMENTS}:
        rows = []
        for s in range(2048):
            found = {0}
            for b in range(width):
                found.add((ones[b] ^ int(error[s ^ single[b]]) ^ int(error[s])) >> 11)
            rows.append(sorted(found))
        most = max(map(len, rows))
        changes[width] = np.array([r + [r[0]] * (most - len(r)) for r in rows], np.int64), np.array([len(r) for r in rows])
    return low, high, error, changes


def golay_keys(words: np.ndarray, width: int, tables) -> tuple[np.ndarray, np.ndarray]:
    """For each word the index of its codeword, first, and of its one-bit
    neighbours' codewords: an array with a row per word, and the keys in use."""
    low, high, error, changes = tables
    s = low[words & 0xFFF] ^ high[words >> 12]
    own = (words ^ error[s].astype(np.int64)) >> 11
    delta, used = changes[width]
    return own[:, None] ^ delta[s], used[s]


def key_rows(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``(key, side, position in fps)``: side 1 is a neighbour key, 2 the
    fingerprint's own key in the second role, 3 both."""
    fps = fps.view(np.uint64)
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    coded = [golay_keys(p, width, tables) for p, (_, width) in zip(parts, SEGMENTS)]
    keys, sides, rows = [], [], []
    every = np.arange(len(fps))

    def put(tag: int, key: np.ndarray, live: np.ndarray, side: np.ndarray) -> None:
        at = np.nonzero(live)
        keys.append(key[at] | tag << 48)
        sides.append(side[at])
        rows.append(every[at[0]])

    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                k, used = coded[j]
                slot = np.arange(k.shape[1])
                live = slot < used[:, None]
                put(tag, parts[i][:, None] << 12 | k, live, np.broadcast_to(np.where(slot == 0, 3, 1), k.shape))
                tag += 1
    (a, na), (b, nb), (c, nc) = coded
    sa, sc = np.arange(a.shape[1]), np.arange(c.shape[1])
    left = a[:, :, None] << 24 | b[:, :1, None] << 12 | c[:, None, :]
    live = (sa < na[:, None])[:, :, None] & (sc < nc[:, None])[:, None, :]
    put(tag, left, live, np.broadcast_to(np.where((sa == 0)[:, None] & (sc == 0)[None, :], 3, 1), left.shape))
    sb = np.arange(1, b.shape[1])
    put(tag, a[:, :1] << 24 | b[:, 1:] << 12 | c[:, :1], sb < nb[:, None], np.full((len(fps), len(sb)), 2))
    return np.concatenate(keys), np.concatenate(sides).astype(np.int8), np.concatenate(rows)


def linked_in_group(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(a, smallest of its piece)`` of the pieces of distinct
    fingerprints that hang together by at most ``max_bits`` differing bits.
    Reached fingerprints leave the set still to be compared, so a dense group
    costs little more than one pass."""
    rest, a, b = np.unique(fps), [], []
    while len(rest) > 1:
        piece, wave, rest = [rest[:1]], rest[:1], rest[1:]
        while len(wave) and len(rest):
            hit = np.zeros(len(rest), bool)
            for x in wave:
                hit |= np.bitwise_count((rest ^ x).view(np.uint64)) <= max_bits
                if hit.all():
                    break
            wave, rest = rest[hit], rest[~hit]
            piece.append(wave)
        if len(members := np.concatenate(piece)) > 1:
            members.sort()
            a.append(members[1:])
            b.append(np.full(len(members) - 1, members[0]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _emit_keys(batches):
    tables = golay_tables()
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(whole), 4096):
            fps = whole[at:at + 4096]
            key, side, row = key_rows(fps, tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(fps[row])], ["key", "side", "fp"])


def _link_groups(max_bits: int, bound: int):
    def links(key, side, fp):
        """Links within the groups of equal keys; keys are sorted."""
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        # a group needs a row for either side and two rows at least
        ok = (sizes > 1) & (np.bitwise_or.reduceat(side, starts) == 3) if len(key) else np.zeros(0, bool)
        large = ok & (sizes > bound)
        twos = starts[ok & (sizes == 2)]
        x, y = fp[twos], fp[twos + 1]
        near = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= max_bits)
        out = [(np.maximum(x, y)[near], np.minimum(x, y)[near])]
        some = ok & ~large & (sizes > 2)
        out += [linked_in_group(fp[s:s + n], max_bits) for s, n in zip(starts[some], sizes[some])]
        yield rows(*(np.concatenate([o[k] for o in out]) for k in (0, 1)), False)
        for s, n in zip(starts[large], sizes[large]):
            yield rows(fp[s:s + n], key[s:s + n], True)

    def rows(a, b, large: bool):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), large))], ["a", "b", "large"])

    def run(batches):
        held: list[tuple] = []  # rows of the last key so far
        size, passed = 0, None  # passed: the key whose rows are too many and go on
        for batch in batches:
            if not len(batch):
                continue
            now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if passed is not None:
                cut = int(np.searchsorted(now[0], passed, "right"))
                yield rows(now[2][:cut], now[0][:cut], True)
                now = tuple(x[cut:] for x in now)
                if not len(now[0]):
                    continue
                passed = None
            if held and now[0][0] != held[-1][0][0]:
                yield from links(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))
            if cut:
                yield from links(*(np.concatenate(c) for c in zip(*held, tuple(x[:cut] for x in now))))
                held, size = [], 0
            held.append(tuple(x[cut:] for x in now))
            size += len(held[-1][0])
            if size > bound:
                for h in held:
                    yield rows(h[2], h[0], True)
                passed, held, size = held[-1][0][0], [], 0
        if held:
            yield from links(*(np.concatenate(c) for c in zip(*held)))

    return run


#: parts that a crowded group's varying bits are dealt in, and how many of them make a
#: key: three differing bits leave two of five parts equal
PARTS, EQUAL = 5, 2


def varying_masks(bits: int) -> list[int]:
    """Masks of every ``EQUAL`` of ``PARTS`` parts of the set ``bits``."""
    ones = [1 << k for k in range(64) if bits >> k & 1]
    parts = [sum(ones[k::PARTS]) for k in range(PARTS)]
    return [sum(c) for c in combinations(parts, EQUAL)]


def _narrower_keys(batches):
    """The fingerprints of crowded groups under keys of their varying bits."""
    import xxhash

    masks: dict[int, list[int]] = {}
    for batch in batches:
        key, fp, varies = (batch.column(c).to_numpy() for c in ("key", "fp", "varies"))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for own in np.unique(key):
            rows = key == own
            bits = int(varies[rows][0]) & (1 << 64) - 1
            if bits not in masks:
                masks[bits] = varying_masks(bits)
            for k, mask in enumerate(masks[bits]):
                seed = xxhash.xxh64_intdigest(f"{own}:{k}")
                h = ((fp[rows].view(np.uint64) & np.uint64(mask)) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append(((h ^ (h >> np.uint64(29))).view(np.int64), fp[rows]))
        if out:
            keys, fps = (np.concatenate([o[k] for o in out]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), 3, np.int8)), pa.array(fps)], ["key", "side", "fp"])


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, bound: int | None = None) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints of column ``fp``
    exactly as all pairs within ``max_bits`` (at most 3) bits would; within a
    key group each piece is given as a star, never as all its pairs.

    A group of more than ``bound`` fingerprints is not compared: its task passes its rows
    on as they come, and they are dealt again by keys of the bits in which the group
    varies (two of five parts of them, which any pair within three bits has equal).  As
    every round fixes two fifths of those bits, groups come below the bound."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the Golay keys cover at most three differing bits")
    bound = GROUP if bound is None else bound
    keys, found = fps.select("fp").mapInArrow(_emit_keys, "key long, side byte, fp long"), None
    while True:
        out, seen = materialize(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_link_groups(max_bits, bound), "a long, b long, large boolean"),
                                "near-links", {"large": F.count_if("large")})
        links = out.where("not large").select("a", "b")
        found = links if found is None else found.unionByName(links)
        if not seen["large"]:
            return found.distinct()
        rows = out.where("large").select(F.col("a").alias("fp"), F.col("b").alias("key"))
        varies = rows.groupBy(F.col("key").alias("_key")).agg((F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))).alias("varies"))
        told, count = materialize(varies, "varying-bits", {"n": F.count(F.lit(1))})
        met = rows.join(F.broadcast(told) if count["n"] <= BROADCAST_ROWS else told, F.col("key") == F.col("_key"))
        keys = met.select("key", "fp", "varies").mapInArrow(_narrower_keys, "key long, side byte, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fp`` (long) and ``component``,
    the smallest id reachable over fingerprints at most ``max_bits`` apart.

    Texts are hashed once and only ids and fingerprints go on.  Copies share a
    fingerprint, so candidate search sees each fingerprint once, however many
    documents have it.  A null or empty text has fingerprint zero and is linked
    like any other.  Rows repeat as given; a null id never is a component's
    name unless all ids of the component are null.  Other columns are ignored.
    """
    return _rooted(docs, id_col, text_col, shingle, max_bits).drop("root")


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """:func:`near_duplicates` with ``root``, a fingerprint that names the component: an
    id with several texts can be the smallest of several components."""
    prints = materialize(docs.select(quoted(id_col).alias("_id"), simhash_column(quoted(text_col), shingle).alias("fp")), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("_id").alias("least")), "distinct-prints")
    roots = components(near_links(distinct, max_bits))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component"))
    by_print = lookup(named.select("fp", "root"), best, ["root"], F.xxhash64("fp")).select("fp", "component", "root")
    return lookup(prints, by_print, ["fp"], F.xxhash64("_id")).select(F.col("_id").alias(id_col), "fp", "component", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Rows without an id can't be named by a component and stay.  If an id occurs
    in several rows, each is judged by its own text: one of them stays for each
    component with other ids, and one for those without (the least by a hash of all
    columns)."""
    found = _rooted(docs, id_col, text_col, shingle, max_bits).where(quoted(id_col).isNotNull())
    stays = F.col("component") == F.col("_id")
    ids, seen = materialize(
        found.withColumnRenamed(id_col, "_id").groupBy("_id")
             .agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n"),
                  F.collect_set(F.when(stays, F.struct("fp", "root"))).alias("prints")),
        "stays", {"most": F.max("n")})
    kept = without(docs, id_col, ids.where("not stays").select("_id"))
    if (seen["most"] or 1) == 1:
        return kept
    # of the ids that repeat, the texts whose component they name; is it of other ids too?
    shared = found.groupBy("root").agg((F.min(quoted(id_col)) < F.max(quoted(id_col))).alias("shared"))
    named = ids.where("n > 1").select("_id", F.explode("prints").alias("p")).select("_id", "p.fp", "p.root") \
        .join(shared, "root").groupBy("_id").agg(F.collect_list(F.struct("fp", "root", "shared")).alias("prints"))
    told, names = by_id(kept, id_col, materialize(named, "repeated-ids"), "_id")
    spot, own, place = (fresh(told, n) for n in ("fp", "own", "place"))
    prints = F.col(names["prints"])
    told = told.withColumn(spot, F.when(prints.isNotNull(), simhash_column(quoted(text_col), shingle)))
    told = told.withColumn(own, F.get(F.filter(prints, lambda p: p["fp"] == F.col(spot)), F.lit(0))) \
        .where(prints.isNull() | F.col(own).isNotNull())
    order = F.xxhash64(*[quoted(c) for c in docs.columns])
    within = Window.partitionBy(quoted(id_col), F.when(F.col(own)["shared"], F.col(own)["root"]), F.when(prints.isNull(), order)).orderBy(order)
    numbered = told.withColumn(place, F.row_number().over(within))
    return numbered.where((F.col(place) == 1) | prints.isNull()).select(*[quoted(c) for c in docs.columns])

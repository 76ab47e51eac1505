"""MinHash near-duplicates by min-max hashing.

A document's set holds the 64-bit hashes of its distinct word shingles.  Every
permutation of the hash space gives two signature values, the least and the greatest
member under it, so a signature of 128 values takes 64 evaluations per shingle.  Both
agree between two sets with the sets' Jaccard similarity as chance, and as they tend
to disagree on different pairs, their mean varies less than that of two minimums.
Bands of values are hashed to keys; sets with a key in common are candidates.  At the
least similarity of 0.8, bands of 4 in 32 miss a pair with a chance of 5e-8.

Equal sets are one node from the start.  Keys only gather nodes into loose clusters, by
sketches (a byte of each signature value) that agree as those of similar sets do:

1. every node is compared with one pivot of each of its keys;
2. keys whose nodes don't hang together by then go on.  Very crowded ones are compared
   with further pivots; of the rest all nodes of a key are compared in one task, which
   gives a spanning forest, not pairs.  Keys that stay too crowded for that are split by
   longer bands, and at the last level dealt in blocks.

Then each node's full set is made anew from its text and sent to its cluster once.  There
every set is counted against all others by an index of the cluster's items, so links are
exact; again only what spans them goes on.  Clusters too large for one task are dealt in
blocks, every two of which meet.  So a key that a third of all rows have (copies, or one
very common passage) costs a few rows per row, never its pairs, and all that is shuffled
for every document is keys.
"""

from __future__ import annotations

from itertools import repeat
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BROADCAST_IDS, lookup, lower_ascii_table, quoted, texts_of
from .graph import components

SHINGLE = 4
PERCENT = 80
#: values in a band and bands, by level; a level splits the crowded keys of the one before
LEVELS = ((4, 32), (8, 96), (16, 512))
#: signature values in a sketch, which has a byte of each
SKETCH = 128
#: bytes of two sketches that agree at least for a link that sets may confirm: a pair of
#: 80 % has 102.5 on average, with a standard deviation of 4.5
AGREE = 78
#: nodes of a key or cluster, and items of a cluster's sets, up to which one task has them
GROUP, ITEMS = 2_000, 1_000_000
#: times that keys of more nodes are compared with a pivot
TURNS = 4
#: bytes of sets that a task passes on at once, and rows of a table that is broadcast
SET_BYTES, BROADCAST = 4 << 20, 200_000
LOWER = lower_ascii_table()


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles; fewer words than a shingle
    has make one, no words none."""
    import xxhash

    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(7)), np.uint64))


def digest(items: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; none for the empty one."""
    import xxhash

    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


class Signer:
    """Signatures of one level.  The permutations of a level begin with those of the
    levels before, so sketches are equal at all of them."""

    def __init__(self, rows: int, bands: int):
        rng = np.random.default_rng(20)
        draw = rng.integers(0, 1 << 64, (rows * bands // 2, 2), np.uint64, endpoint=False)
        self.times, self.plus = draw[:, :1] | np.uint64(1), draw[:, 1:]
        self.mix = np.random.default_rng([rows, bands]).integers(0, 1 << 64, (bands, rows), np.uint64, endpoint=False) | np.uint64(1)
        self.at = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def values(self, items: np.ndarray) -> np.ndarray:
        """Least and greatest member under each permutation, in turn."""
        low = np.full(len(self.times), ~np.uint64(0))
        high = np.zeros(len(self.times), np.uint64)
        for k in range(0, len(self.times), 64):
            times, plus, own = self.times[k:k + 64], self.plus[k:k + 64], slice(k, k + 64)
            for at in range(0, len(items), 2048):
                seen = items[at:at + 2048] * times + plus
                np.minimum(low[own], seen.min(1), out=low[own])
                np.maximum(high[own], seen.max(1), out=high[own])
        return np.stack([low, high], 1).ravel()

    def sign(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys, and the sketch as bytes."""
        values = self.values(items)
        keys = (values.reshape(self.mix.shape) * self.mix).sum(1, dtype=np.uint64) + self.at
        keys ^= keys >> np.uint64(29)
        return (keys * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64), (values[:SKETCH] >> np.uint64(20)).astype(np.uint8)


SIGNED = "sketch binary, keys array<long>"


def _items(column) -> Iterator[np.ndarray]:
    """Sets of a binary column, one by one and without a copy."""
    for x in column:
        yield np.frombuffer(x.as_buffer(), np.uint64)


class _Signed:
    """Columns of :data:`SIGNED`, set by set."""

    def __init__(self, level: tuple[int, int]):
        self.signer, self.rows = Signer(*level), []

    def add(self, items: np.ndarray) -> None:
        if not len(items):
            self.rows.append((None, None))
            return
        keys, sketch = self.signer.sign(items)
        self.rows.append((sketch.tobytes(), keys))

    def arrays(self) -> list[pa.Array]:
        columns, self.rows = list(zip(*self.rows)) or [(), ()], []
        return [pa.array(c, kind) for c, kind in zip(columns, (pa.binary(), pa.list_(pa.int64())))]


def _first_pass(shingle: int, level: tuple[int, int]):
    def run(batches):
        signed = _Signed(level)
        for batch in batches:
            sizes, names = [], []
            for text in texts_of(batch.column("text")):
                items = shingle_set(text, shingle)
                sizes.append(len(items))
                names.append(digest(items))
                signed.add(items)
            arrays = [*(batch.column(c) for c in ("row", "_id", "place")), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), *signed.arrays()]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "_id", "place", "n", "digest", "sketch", "keys"])

    return run


def _sign_sets(level: tuple[int, int]):
    def run(batches):
        signed = _Signed(level)
        for batch in batches:
            for items in _items(batch.column("items")):
                signed.add(items)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *signed.arrays()], ["node", "sketch", "keys"])

    return run


def _make_sets(shingle: int):
    def rows(made):
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.binary()) for k in (0, 1)], ["digest", "items"])

    def run(batches):
        for batch in batches:
            made, size = [], 0
            for text in texts_of(batch.column("text")):
                items = shingle_set(text, shingle)
                made.append((digest(items), items.tobytes()))
                size += items.nbytes
                if size > SET_BYTES:
                    yield rows(made)
                    made, size = [], 0
            yield rows(made)

    return run


def _agreeing(batches):
    """The pairs whose sketches ``x`` and ``y`` agree in ``AGREE`` bytes or more."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("x", "y"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREE))


def _groups(batches, columns: list[str]):
    """Lists of each group's columns; rows are sorted by ``g``."""
    held: list = []

    def rows(parts):
        whole = pa.Table.from_batches(parts)
        return [whole.column(c).to_numpy() if pa.types.is_integer(whole.column(c).type) else whole.column(c).to_pylist() for c in columns]

    for batch in batches:
        g = batch.column("g").to_numpy()
        starts = [*np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)] if len(g) else []
        for s, e in zip(starts, starts[1:]):
            if held and held[-1].column("g")[0].as_py() != g[s]:
                yield rows(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield rows(held)


class _Pieces:
    """Pieces of nodes that hang together."""

    def __init__(self, nodes: np.ndarray, roots: np.ndarray):
        """Nodes of equal ``roots`` hang together from the start."""
        self.nodes, self.roots = nodes, roots
        self.piece = np.unique(roots, return_inverse=True)[1]

    def join(self, i: int, others: np.ndarray) -> None:
        other = np.unique(self.piece[others])
        other = other[other != self.piece[i]]
        if len(other):
            self.piece[np.isin(self.piece, other)] = self.piece[i]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A link from each root to the least root of its piece."""
        order = np.lexsort((self.roots, self.piece))
        first = np.r_[True, np.diff(self.piece[order]) != 0]
        least = self.roots[order][np.flatnonzero(first)[np.cumsum(first) - 1]]
        own = self.roots[order]
        near = np.flatnonzero(own != least)
        at = np.unique(np.stack([own[near], least[near]], 1), axis=0) if len(near) else np.zeros((0, 2), np.int64)
        return at[:, 0], at[:, 1]


def _link_batches(found, rows: int = 10_000):
    """Batches of links from pairs of arrays."""
    held, size = [], 0
    for a, b in found:
        if len(a):
            held.append((a, b))
            size += len(a)
        if size >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[k] for h in held])) for k in (0, 1)], ["a", "b"])
            held, size = [], 0
    ends = [np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], ["a", "b"])


def _spanning(batches):
    """Links between roots of a key that hang together by agreeing sketches."""

    def links(nodes, roots, sketches):
        seen, pieces = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(nodes), SKETCH), _Pieces(nodes, roots)
        for i in range(len(nodes) - 1):
            rest = i + 1 + np.flatnonzero(pieces.piece[i + 1:] != pieces.piece[i])
            if len(rest):
                pieces.join(i, rest[(seen[rest] == seen[i]).sum(1) >= AGREE])
        return pieces.links()

    return _link_batches(links(*g) for g in _groups(batches, ["node", "root", "sketch"]))


def _exact(percent: int):
    """Links between nodes of a cluster that hang together by similar sets."""

    def links(nodes, items):
        sets = [np.frombuffer(x, np.uint64) for x in items]
        sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(len(sets)), sizes)[order]  # of each place of the index
        every = every[order]
        starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        ends, every = np.r_[starts[1:], len(order)], every[starts]
        pieces = _Pieces(nodes, nodes)
        for i, own in enumerate(sets):
            if (pieces.piece == pieces.piece[0]).all():
                break
            at = np.searchsorted(every, own)
            at = at[ends[at] - starts[at] > 1]
            if len(at):
                common = np.bincount(np.concatenate([owner[s:e] for s, e in zip(starts[at], ends[at])]), minlength=len(sets))
                pieces.join(i, np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common)))
        return pieces.links()

    return lambda batches: _link_batches(links(*g) for g in _groups(batches, ["node", "items"]))


def _in_blocks(rows: DataFrame, blocks, name: str) -> DataFrame:
    """``rows`` with a group ``g``: the column ``name``, or, for ``blocks`` over one, two
    blocks of it, every two of which meet in a group."""
    own = F.pmod(F.xxhash64("node", F.lit(5)), blocks).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    g = F.when(blocks <= 1, F.col(name)).otherwise(F.xxhash64(name, F.least("_own", "_other"), F.greatest("_own", "_other")))
    return dealt.withColumn("g", g).drop("_own", "_other")


def only(df: DataFrame, column: str, wanted: DataFrame, max_rows: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``df`` whose long ``column`` is in the one column of ``wanted``
    (distinct), which is broadcast up to ``max_rows``."""
    ids, seen = materialize(wanted.toDF("_wanted"), "wanted", {"rows": F.count(F.lit(1))})
    return df.join(F.broadcast(ids) if seen["rows"] <= max_rows else ids, F.col(column) == F.col("_wanted"), "left_semi")


def _agree(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct ``pairs`` of nodes whose sketches agree, written."""
    for end, side in (("a", "x"), ("b", "y")):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("sketch").alias(side)), end)
    return materialize(pairs.select("a", "b", "x", "y").mapInArrow(_agreeing, "a long, b long"), "agreeing")


def _unsettled(rows: DataFrame, links: DataFrame, turn: int) -> tuple[DataFrame, dict]:
    """The rows of keys with nodes in different components: the node's component, the
    key's nodes, a pivot of the key and its component."""
    told = rows.select("key", "node").join(components(links), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    order = F.xxhash64(F.lit(turn), "node")
    keys = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"),
                                   F.min_by("node", order).alias("pivot"), F.min_by("root", order).alias("pivot_root"))
    return materialize(told.join(keys.where("low < high").drop("low", "high"), "key"), "unsettled",
                       {"rows": F.count(F.lit(1)), "large": F.count_if(F.col("members") > GROUP)})


def loose_links(nodes: DataFrame, rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], level: int = 0) -> DataFrame:
    """``a``, ``b`` that connect the nodes as all their agreeing pairs with a key in
    common would.  ``rows`` has ``key`` and ``node``, ``nodes`` the sketches."""
    ends = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = materialize(rows.join(ends, "key").select("key", "node", "low"), "shared-keys")
    links = _agree(nodes, shared.where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    open_, seen = _unsettled(shared, links, 0)
    for turn in range(1, TURNS + 1):
        if not seen["large"]:
            break
        more = open_.where(f"members > {GROUP} and root <> pivot_root") \
            .select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
        links = links.unionByName(_agree(nodes, more))
        open_, seen = _unsettled(open_, links, turn)
    if not seen["rows"]:
        return links
    last = level + 1 == len(LEVELS)
    small = open_ if last else open_.where(f"members <= {GROUP}")
    met = _in_blocks(small, F.ceil(F.col("members") / F.lit(GROUP)).cast("int"), "key").join(nodes.select("node", "sketch"), "node")
    links = links.unionByName(materialize(met.select("g", "node", "root", "sketch").repartition("g").sortWithinPartitions("g")
                                          .mapInArrow(_spanning, "a long, b long").distinct(), "spanning"))
    if seen["large"] and not last:
        crowded = sets_of(open_.where(f"members > {GROUP}").select("node").distinct())
        signed = crowded.select("node", "items").mapInArrow(_sign_sets(LEVELS[level + 1]), f"node long, {SIGNED}")
        links = links.unionByName(loose_links(nodes, signed.select("node", F.explode("keys").alias("key")), sets_of, level + 1))
    return links


def exact_links(nodes: DataFrame, loose: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``a``, ``b`` that connect the nodes of each loose cluster as all their pairs of
    ``percent`` on full sets would."""
    clusters = components(loose).join(nodes.select("node", "n"), "node")
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("items"))
    sized = clusters.select("node", "root").join(sizes, "root")
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(GROUP), F.col("items") / F.lit(ITEMS))).cast("int")
    met = _in_blocks(sets_of(sized.select("node", "root", blocks.alias("blocks"))), F.col("blocks"), "root")
    return materialize(met.select("g", "node", "items").repartition("g").sortWithinPartitions("g").mapInArrow(_exact(percent), "a long, b long").distinct(), "exact")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles`` and ``component``, the
    smallest id reachable over texts whose shingle sets are similar to ``percent`` (80 at
    least: the bands' chances are made for it).

    Texts without words (and null texts) have an empty set and are linked with nothing,
    not with each other either: their component is their id.  Rows repeat as given.  An
    id that occurs with several texts is judged by each text; a null id is never a
    component's name unless all its ids are null.  Other columns are ignored."""
    if not PERCENT <= percent <= 100:
        raise ValueError("bands and sketches are made for similarities from 80 to 100 percent")
    place = F.xxhash64(quoted(id_col), quoted(text_col))  # finds a node's text again; the digest tells if it is the one
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).alias("_id"), place.alias("place"), quoted(text_col).alias("text"))
    prints = materialize(given.mapInArrow(_first_pass(shingle, LEVELS[0]), f"row long, _id {kind}, place long, n long, digest binary, {SIGNED}"), "minmax")
    least = materialize(prints.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("_id").alias("least")), "distinct-sets")
    nodes = materialize(prints.join(least.select("node"), F.col("row") == F.col("node"), "left_semi")
                        .select(F.col("row").alias("node"), "n", "place", "digest", "sketch", "keys"), "minmax-nodes")
    # rows that repeat with their id have one place and give one node; its text is read once
    repeats = bool(prints.where("n > 0").groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """``wanted`` (distinct ``node``, and other columns) with ``items``, made from the texts."""
        asked, seen = materialize(nodes.select("node", "place", "digest").join(wanted, "node"), "asked", {"rows": F.count(F.lit(1))})
        texts = only(docs.select(place.alias("place"), quoted(text_col).alias("text")), "place", asked.select("place").distinct())
        texts = texts.dropDuplicates(["place"]) if repeats else texts
        asked = asked.drop("place")
        return texts.select("text").mapInArrow(_make_sets(shingle), "digest binary, items binary") \
            .join(F.broadcast(asked) if seen["rows"] <= BROADCAST else asked, "digest").drop("digest")

    loose = loose_links(nodes, nodes.select("node", F.explode("keys").alias("key")), sets_of)
    links = exact_links(nodes, loose, sets_of, percent)
    named = least.join(components(links).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left") \
        .select("digest", "least", F.coalesce("root", "node").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component"))
    by_digest = lookup(named.select("digest", "root"), best, ["root"], F.xxhash64("digest")).select("digest", "component")
    told = lookup(prints.select("_id", "n", "digest"), by_digest, ["digest"], F.xxhash64("_id"))
    return told.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id")).alias("component"))

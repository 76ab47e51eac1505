"""Conversation prefix tries in double arrays.

Conversations that begin with the same turns share a path from the root of one trie; a
node is a distinct sequence of first turns.  A turn is known by a 128-bit hash of its
role and text, a node by a 128-bit hash chained over its turns, so no text is shuffled.

Equal conversations are one sequence with a weight.  Sequences are dealt to shards by
their prefix: by the first turn, or, below prefixes that more than ``CROWD`` sequences
share, by as many turns as it takes to tell them apart.  So a first turn that a third of
all conversations have is spread over many shards, and every node below the shared
(*upper*) ones lies in one shard alone.  Each shard numbers its turns densely, packs its
sequences into a double array (a child of node ``s`` by turn ``c`` is slot
``BASE[s] + c``, if ``CHECK`` of that slot is ``s``) and walks all of them through it.
Nodes below the upper ones come out whole; the upper ones' parts are summed over the
shards.  What an upper node adds to the ones above it is joined along one of its
conversations.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import lookup, quoted

#: distinct sequences with a prefix in common from which they may go to several shards
CROWD = 20_000
#: turns of a shard, about
SHARD_ROWS = 100_000
#: bytes of decimal ids that are hashed as one piece
PIECE = 1 << 16
#: the textless root's path
ROOT = bytes(16)


class DoubleArray:
    """A trie over dense codes from 1.  Slot 0 is the root."""

    TRIES = 64

    def __init__(self):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = -2  # taken, and nobody's child
        self.low = self.top = 1  # the least slot that can be free, the end of the taken ones

    def place(self, parent: int, codes: np.ndarray) -> None:
        """Give ``parent`` children by the ascending distinct ``codes``: at the least free
        slots that suit all of them, or else beyond the taken ones."""
        apart = codes - codes[0]
        while self.low < self.top and self.check[self.low] != -1:
            self.low += 1
        spot = self.low
        if len(codes) > 1:
            self._grow(self.top + int(apart[-1]) + 1)
            free = self.low + np.flatnonzero(self.check[self.low:min(self.top, self.low + 4096)] == -1)[:self.TRIES]
            suits = (self.check[np.minimum(free[:, None] + apart, len(self.check) - 1)] == -1).all(1) if len(codes) <= 256 else np.zeros(0, bool)
            spot = int(free[suits.argmax()]) if suits.any() else self.top
        self._grow(spot + int(apart[-1]) + 1)
        self.base[parent] = spot - int(codes[0])
        self.check[spot + apart] = parent
        self.top = max(self.top, spot + int(apart[-1]) + 1)

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of ``states`` by ``codes``, -1 where there is none."""
        slots = self.base[states] + codes
        inside = (slots > 0) & (slots < len(self.check))
        return np.where(inside & (self.check[np.where(inside, slots, 0)] == states), slots, -1)


def pack(seq: np.ndarray, depth: np.ndarray, code: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of sequences (rows: number of the sequence, depth from 1, code),
    and the slot that each row reaches."""
    trie, state, reached = DoubleArray(), np.zeros(int(seq.max(initial=-1)) + 1, np.int64), np.zeros(len(seq), np.int64)
    order = np.argsort(depth, kind="stable")
    width = int(code.max(initial=0)) + 1
    for rows in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        own = np.unique(state[seq[rows]] * width + code[rows])
        parents, codes = own // width, own % width
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if len(own) else []
        for s, e in zip(starts, [*starts[1:], len(own)]):
            trie.place(int(parents[s]), codes[s:e])
        reached[rows] = state[seq[rows]] = trie.step(state[seq[rows]], code[rows])
    return trie, reached


NODE = "path binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, chars long, upper boolean, parent_conv_id long"


def shard_nodes(conv, depth, key, chars, path, weight, upper) -> pa.RecordBatch:
    """Nodes of a shard from its sequences' turns (sorted by conversation and depth).

    A node is upper if its depth is at most its rows' ``upper``.  Upper nodes get the sums
    of what the shard has below them, without their own and other upper nodes' parts; the
    root is one of them."""
    seq = np.cumsum(np.r_[False, conv[1:] != conv[:-1]])
    ids = {k: n for n, (k, _) in enumerate(Counter(key).most_common(), 1)}
    trie, reached = pack(seq, depth, np.array([ids[k] for k in key], np.int64))
    size = trie.top
    convs, least, row = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    np.add.at(convs, reached, weight)
    np.minimum.at(least, reached, conv)
    row[reached] = np.arange(len(reached))
    slots = np.unique(reached)
    above, of = trie.check[slots], row[slots]
    shared = depth[of] <= upper[of]
    is_upper = np.zeros(size, bool)
    is_upper[slots[shared]] = is_upper[0] = True
    kids = np.bincount(above[~shared], minlength=size)
    leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
    leaves[slots] = ~shared & (kids[slots] == 0)
    saved[slots] = np.where(shared, 0, (convs[slots] - 1) * chars[of])
    down = np.argsort(-depth[of], kind="stable")
    for some in np.split(down, np.flatnonzero(np.diff(depth[of][down])) + 1):
        np.add.at(leaves, above[some], leaves[slots[some]])
        np.add.at(saved, above[some], saved[slots[some]])
    whole = np.r_[0, slots]
    up = np.r_[0, above]
    names = [ROOT, *(path[r] for r in of)]
    at = np.zeros(size, np.int64)
    at[whole] = np.arange(len(whole))
    told = ~is_upper[up]  # the parent is whole in this shard
    return pa.RecordBatch.from_arrays([
        pa.array(names, pa.binary()), pa.array([None, *(names[a] for a in at[above])], pa.binary()), pa.array(np.r_[0, depth[of]]),
        pa.array(least[whole], mask=whole == 0), pa.array(convs[whole]), pa.array(kids[whole]), pa.array(leaves[whole]), pa.array(saved[whole]),
        pa.array(np.r_[0, chars[of]]), pa.array(is_upper[whole]), pa.array(least[up], mask=~told),
    ], [c.split()[0] for c in NODE.split(", ")])


def _shards(batches):
    """Nodes of each shard; rows are sorted by shard, conversation and depth."""
    held: list = []

    def out():
        rows = pa.Table.from_batches(held)
        numbers = {c: rows.column(c).to_numpy() for c in ("conv_id", "depth", "chars", "weight", "upper")}
        return shard_nodes(numbers["conv_id"], numbers["depth"], rows.column("key").to_pylist(), numbers["chars"],
                           rows.column("path").to_pylist(), numbers["weight"], numbers["upper"])

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        starts = [*np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)] if len(shard) else []
        for s, e in zip(starts, starts[1:]):
            if held and held[-1].column("shard")[0].as_py() != shard[s]:
                yield out()
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield out()


def _paths(batches):
    """Adds each row's path; rows are sorted by conversation and depth."""
    import xxhash

    conv, path = None, ROOT
    for batch in batches:
        paths = []
        for own, key in zip(batch.column("conv_id").to_pylist(), batch.column("key").to_pylist()):
            path = xxhash.xxh3_128_digest((path if own == conv else ROOT) + key)
            conv = own
            paths.append(path)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.binary())], [*batch.schema.names, "path"])


def _pieces(batches):
    """Comma-joined decimal ids of each path, in pieces; rows are sorted by path and id."""
    last, first, held, size = None, 0, [], 0
    for batch in batches:
        out = []
        for path, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (path != last or size > PIECE):
                out.append((last, first, ",".join(held)))
                held, size = [], 0
            if not held:
                last, first = path, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
        yield _piece_rows(out)
    yield _piece_rows([(last, first, ",".join(held))] if held else [])


def _piece_rows(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.string())], ["path", "first", "piece"])


def _digests(batches):
    """SHA-256 of each path's pieces; rows are sorted by path and first id."""
    last, sha = None, None
    for batch in batches:
        out = []
        for path, piece in zip(batch.column("path").to_pylist(), batch.column("piece").to_pylist()):
            if path != last:
                if sha is not None:
                    out.append((last, sha.hexdigest()))
                last, sha = path, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.encode())
        yield _digest_rows(out)
    yield _digest_rows([(last, sha.hexdigest())] if sha is not None else [])


def _digest_rows(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["path", "ends_sha256"])


def numbered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, depth, key, chars`` of every turn: its place from 1 by turn (null
    first; ties by the hash of role and text), that hash and its text's code points.

    Ids must be integers; rows without an id belong to no conversation and go.  A null
    role or text is an empty one.  Rows that repeat are turns that repeat."""
    role, text = (F.coalesce(quoted(c), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.select(quoted(id_col).cast("long").alias("conv_id"), quoted(turn_col).alias("_turn"),
                                 key.alias("key"), F.length(text).cast("long").alias("chars")).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_turn"), "key")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("depth"), "key", "chars")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like others: the first ``h`` turns of conversation ``c``
    are those of ``c - c % every`` (fewer if it has fewer, none if there is none), then
    come ``c``'s own after its first ``h``; ``h`` is the CRC-32 of decimal ``c`` modulo
    ``most``; ``%`` has the sign of ``c``, as in SQL.  Returns the turns, with ``length``, and all conversations with theirs."""
    turns = materialize(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.max("depth").alias("n"))
    heads = sizes.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
                         (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")).join(heads, "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    own = turns.join(convs, "conv_id").where("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("taken"))
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("depth") < most)).withColumnRenamed("conv_id", "base") \
        .join(convs, "base").where("depth <= h")
    columns = ("conv_id", "depth", "key", "chars", "length")
    return own.select(*columns).unionByName(first.select(*columns)), convs.select("conv_id", "length")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are, in the form of :func:`rebuilt`."""
    turns = materialize(turns, "turns")
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("length"))
    return turns.join(convs, "conv_id"), convs


def prefix_nodes(turns: DataFrame, convs: DataFrame, crowd: int | None = None, shard_rows: int | None = None) -> DataFrame:
    """One row per trie node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of its subtree, and
    ``ends_sha256`` of the ids that end there.

    ``turns`` has ``conv_id, depth, key, chars, length`` (depths from 1 to ``length``),
    ``convs`` all ids and lengths, also 0.  No conversations: no nodes."""
    crowd, shard_rows = crowd or CROWD, shard_rows or SHARD_ROWS
    named = turns.select("conv_id", "depth", "key", "chars", "length").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    paths = materialize(named.mapInArrow(_paths, "conv_id long, depth long, key binary, chars long, length long, path binary"), "paths")
    root = F.lit(bytearray(ROOT))
    ends = materialize(paths.where("depth = length").select("path", "conv_id")
                       .unionByName(convs.where("length = 0").select(root.alias("path"), "conv_id")), "ends")
    # equal conversations: one sequence, named by the smallest id
    sequences = ends.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")).select("conv_id", "weight")
    rows, seen = materialize(paths.join(sequences, "conv_id"), "sequences", {"n": F.count(F.lit(1))})
    crowded = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("path", F.lit(True).alias("crowded"))
    told = lookup(rows, crowded, ["path"], F.xxhash64("conv_id"))
    of = Window.partitionBy("conv_id")
    told = told.withColumn("upper", F.coalesce(F.max(F.when(F.col("crowded"), F.col("depth"))).over(of), F.lit(0).cast("long")))
    split = F.max(F.when(F.col("depth") == F.least(F.col("upper") + 1, F.col("length")), F.xxhash64("path"))).over(of)
    shards = max(1, -(-(seen["n"] or 0) // shard_rows))
    rows = told.withColumn("shard", F.pmod(split, F.lit(shards)))
    dealt = rows.select("shard", "conv_id", "depth", "key", "chars", "path", "weight", "upper").repartition("shard").sortWithinPartitions("shard", "conv_id", "depth")
    nodes = materialize(dealt.mapInArrow(_shards, NODE), "shard-nodes")
    upper = _upper_nodes(nodes, rows, convs, root)
    below = nodes.where("not upper").drop("upper", "chars")
    names = upper.select(F.col("path").alias("parent"), F.col("conv_id").alias("upper_conv_id"))
    below = lookup(below, names, ["parent"], F.xxhash64("path")).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper_conv_id"))
    columns = ("path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")
    made = below.select(*columns).unionByName(upper.select(*columns))
    digests = ends.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_pieces, "path binary, first long, piece string") \
        .repartition("path").sortWithinPartitions("path", "first").mapInArrow(_digests, "path binary, ends_sha256 string")
    return made.join(digests, "path", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def _upper_nodes(nodes: DataFrame, rows: DataFrame, convs: DataFrame, root) -> DataFrame:
    """The shared upper nodes, with their parts summed over the shards."""
    every = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "n_children", "n_leaves", "saved", "chars")]
    parts = nodes.where("upper").drop("upper", "parent_conv_id")
    parts = parts.unionByName(every.select(root.alias("path"), F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", *zero))
    merged = materialize(parts.groupBy("path").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]), "upper-parts")
    kids = merged.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("upper_children"))
    full = merged.join(kids, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("upper_children", F.lit(0))) \
        .withColumn("own_saved", (F.col("n_convs") - 1) * F.col("chars")).withColumn("own_leaf", (F.col("n_children") == 0).cast("long"))
    full = materialize(full, "upper")
    # an upper node adds to itself and all above it, which one of its conversations passes
    adding = full.where("depth > 0 and (own_saved > 0 or own_leaf > 0)").select("conv_id", F.col("depth").alias("of"), "own_saved", "own_leaf")
    above = rows.where("depth <= upper").select("conv_id", "depth", F.col("path").alias("above")).join(adding, "conv_id").where("depth <= of")
    sums = above.select("above", "own_saved", "own_leaf").unionByName(full.select(root.alias("above"), "own_saved", "own_leaf")) \
        .groupBy("above").agg(F.sum("own_saved").alias("more_saved"), F.sum("own_leaf").alias("more_leaves"))
    parents = full.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    made = full.join(sums, F.col("path") == F.col("above"), "left").join(parents, "parent", "left")
    return materialize(made.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)))
                       .withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
                       .select("path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"), "upper-nodes")

"""Reversible, incremental line dedup.

A line's key is the line without ASCII white space at its ends, A-Z lowered.
Keys of at least ``min_chars`` code points that at least ``min_docs`` documents
hold are *repeated*: all their lines go, except in the document with the
largest id that holds the key.

:class:`LineIndex` keeps three tables in a folder:

``refs``     the exact references: each (key digest, document id) once;
``counts``   per key digest its number of documents and largest id, made from
             ``refs`` by grouped aggregation;
``filters``  sharded cuckoo filters with the digests of the repeated keys:
             16-bit fingerprints, four to a bucket, two buckets a key.

Inserting documents adds references and inserts keys that become repeated into
their shard's filter; deleting documents takes references away and deletes keys
that stop being repeated, which a cuckoo filter allows.  Each change writes a
new generation beside the old one, so any change can be undone by opening the
older generation.  Cleaning asks the filters first; only lines that may be
repeated meet the exact counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import by_id, fresh, lookup, lower_ascii_table, quoted, texts_of

MIN_CHARS = 20
MIN_DOCS = 3
#: repeated keys a filter shard is laid out for
SHARD_KEYS = 65_536
#: bytes of all filters up to which they are sent to the executors; beyond, rows of a
#: shard that ask one copy of its filter
FILTER_BYTES, PART_ROWS = 64 << 20, 1_000_000
SPACE = b" \t\n\x0b\x0c\r"
LOWER = lower_ascii_table()
SLOTS = 4


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of a line's key, or None for keys of fewer code points."""
    key = line.strip(SPACE).translate(LOWER)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode(errors="replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


# --- cuckoo filter ----------------------------------------------------------------
def places(digests: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints and both buckets of digests given as rows of two uint64."""
    print_ = ((digests[:, 1] >> np.uint64(32)) & np.uint64(0xFFFF)) | np.uint64(1)
    mask = np.uint64(buckets - 1)
    first = (digests[:, 1] & np.uint64(0xFFFFFFFF)) & mask
    return print_.astype(np.uint16), first.astype(np.int64), (first ^ (print_ * np.uint64(0x5BD1E995) & mask)).astype(np.int64)


def as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


class Cuckoo:
    """Cuckoo filter: ``table`` of fingerprints (0: free slot) and a ``stash``
    of whole digests that found no slot, so no key is ever refused."""

    KICKS = 200

    def __init__(self, table: np.ndarray, stash: set[bytes]):
        self.table, self.stash = table, stash

    @classmethod
    def sized(cls, keys: int) -> "Cuckoo":
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.5))))
        return cls(np.zeros((buckets, SLOTS), np.uint16), set())

    @classmethod
    def load(cls, blob: bytes) -> "Cuckoo":
        buckets = int.from_bytes(blob[:8], "little")
        end = 8 + buckets * SLOTS * 2
        table = np.frombuffer(blob[8:end], np.uint16).reshape(buckets, SLOTS).copy()
        return cls(table, {blob[i:i + 16] for i in range(end, len(blob), 16)})

    def dump(self) -> bytes:
        return len(self.table).to_bytes(8, "little") + self.table.tobytes() + b"".join(sorted(self.stash))

    def insert(self, digests: list[bytes]) -> None:
        """Each digest must not be in the filter yet."""
        if not digests:
            return
        prints, first, second = places(as_words(digests), len(self.table))
        for digest, p, a, b in zip(digests, prints, first, second):
            if not (self._put(a, p) or self._put(b, p)) and not self._kick(int(b), p):
                self.stash.add(digest)

    def _put(self, bucket: int, p) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = p
        return bool(len(free))

    def _kick(self, bucket: int, p) -> bool:
        moved = []
        for n in range(self.KICKS):
            slot = n % SLOTS
            moved.append((bucket, slot, self.table[bucket, slot]))
            p, self.table[bucket, slot] = self.table[bucket, slot], p
            bucket ^= int(np.uint64(p) * np.uint64(0x5BD1E995) & np.uint64(len(self.table) - 1))
            if self._put(bucket, p):
                return True
        for bucket, slot, old in reversed(moved):
            self.table[bucket, slot] = old
        return False

    def delete(self, digests: list[bytes]) -> None:
        """Each digest must have been inserted."""
        if not digests:
            return
        prints, first, second = places(as_words(digests), len(self.table))
        for digest, p, a, b in zip(digests, prints, first, second):
            if digest in self.stash:
                self.stash.remove(digest)
                continue
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == p)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def may_have(self, digests: list[bytes]) -> np.ndarray:
        prints, first, second = places(as_words(digests), len(self.table))
        hit = (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)
        if self.stash:
            hit |= np.array([d in self.stash for d in digests], bool)
        return hit


def shard_of(digests: np.ndarray, shards: int) -> np.ndarray:
    return (digests[:, 0] % np.uint64(shards)).astype(np.int64)


# --- the index --------------------------------------------------------------------
def line_refs(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``doc_id, key``: the digests of the long enough lines, once per row of
    ``docs``.  Lines are split at ``\\n``; a null text is one empty line."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                ids, keys = [], []
                for row, text in enumerate(texts_of(part.column(1))):
                    own = {k for line in (text or b"").split(b"\n") if (k := line_key(line, min_chars))}
                    ids += [row] * len(own)
                    keys += own
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids, pa.int32())), pa.array(keys, pa.binary())], ["doc_id", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, f"doc_id {kind}, key binary")


class LineIndex:
    """Exact line references of a corpus, in generations below ``path``."""

    def __init__(self, spark: SparkSession, path: str, generation: int, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.path, self.generation = spark, path, generation
        self.min_chars, self.min_docs = min_chars, min_docs

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/generation={self.generation}/{name}")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        target = f"{self.path}/generation={self.generation}/{name}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
              min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> "LineIndex":
        """Generation 0 from ``docs``.  Rows with equal ids are one document;
        null ids are one document too, smaller than any other."""
        spark = docs.sparkSession
        index = cls(spark, path or scratch_path(spark, "line-index"), 0, min_chars, min_docs)
        refs = index._write(line_refs(docs, id_col, text_col, min_chars).distinct(), "refs")
        counts = index._write(index._counted(refs), "counts")
        index._fill(counts.where(F.col("n_docs") >= min_docs).select("key"))
        return index

    def _counted(self, refs: DataFrame) -> DataFrame:
        return refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def _fill(self, keys: DataFrame) -> None:
        """New filters for repeated ``keys``, a task per shard at most."""
        n = keys.count()
        shards = max(1, -(-n // SHARD_KEYS))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            cuckoo = Cuckoo.sized(max(len(pdf), 64))
            cuckoo.insert(sorted(map(bytes, pdf["key"])))
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [shards], "filter": [cuckoo.dump()]})

        sharded = keys.withColumn("shard", _shard_column(shards))
        self._write(sharded.groupBy("shard").applyInPandas(run, "shard long, n long, filter binary"), "filters")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "LineIndex":
        """The next generation, with ``docs`` added; references it has are kept once."""
        new = materialize(line_refs(docs, id_col, text_col, self.min_chars).distinct()
                          .join(self.part("refs").withColumnRenamed("doc_id", "_d").withColumnRenamed("key", "_k"),
                                F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left_anti"), "new-refs")
        return self._next(self.part("refs").unionByName(new), new.select("key").distinct())

    def delete(self, ids: DataFrame) -> "LineIndex":
        """The next generation, without the documents whose ids are in the one column of ``ids``."""
        gone = ids.select(quoted(ids.columns[0]).alias("_d")).distinct()
        refs = self.part("refs")
        touched = materialize(refs.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").select("key").distinct(), "touched")
        return self._next(refs.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti"), touched)

    def _next(self, refs: DataFrame, touched: DataFrame) -> "LineIndex":
        """Only ``touched`` keys are counted again; filters change by the keys
        that cross the threshold."""
        old, index = self.part("counts"), LineIndex(self.spark, self.path, self.generation + 1, self.min_chars, self.min_docs)
        refs = index._write(refs, "refs")
        again = index._counted(refs.join(touched, "key", "left_semi"))
        counts = index._write(old.join(touched, "key", "left_anti").unionByName(again), "counts")
        was, now = (c.where(F.col("n_docs") >= self.min_docs).select("key") for c in (old, counts))
        change = now.join(was, "key", "left_anti").withColumn("up", F.lit(True)) \
            .unionByName(was.join(now, "key", "left_anti").withColumn("up", F.lit(False)))
        filters = self.part("filters")
        head = filters.select("n").head()
        if head is None or (shards := head["n"]) * SHARD_KEYS * 2 < now.count():
            index._fill(now)
            return index

        def run(held: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
            shard = int((held if len(held) else change)["shard"].iloc[0])
            cuckoo = Cuckoo.load(bytes(held["filter"].iloc[0])) if len(held) else Cuckoo.sized(max(len(change), 64))
            cuckoo.insert(sorted(map(bytes, change["key"][change["up"].astype(bool)])))
            cuckoo.delete(sorted(map(bytes, change["key"][~change["up"].astype(bool)])))
            return pd.DataFrame({"shard": [shard], "n": [shards], "filter": [cuckoo.dump()]})

        index._write(filters.groupBy("shard").cogroup(change.withColumn("shard", _shard_column(shards)).groupBy("shard"))
                     .applyInPandas(run, "shard long, n long, filter binary"), "filters")
        return index

    def maybe_repeated(self, refs: DataFrame) -> DataFrame:
        """The rows of ``refs`` (``doc_id, key``) whose key a filter may have.

        The filters are sent to the executors if they take ``FILTER_BYTES`` at most;
        beyond, the rows are dealt to the filters, with the same result."""
        filters = self.part("filters")
        size, shards = filters.agg(F.sum(F.length("filter")), F.max("n")).head()
        if size is None:
            return refs.limit(0)
        if size > FILTER_BYTES:
            return self._dealt_by_shard(refs, filters, shards)
        sent = self.spark.sparkContext.broadcast([tuple(r) for r in filters.select("shard", "n", "filter").collect()])

        def run(batches):
            cuckoos = {shard: Cuckoo.load(bytes(blob)) for shard, _, blob in sent.value}
            shards = sent.value[0][1]
            for batch in batches:
                if not len(batch):
                    continue
                keys = batch.column("key").to_pylist()
                of, hit = shard_of(as_words(keys), shards), np.zeros(len(keys), bool)
                for shard, cuckoo in cuckoos.items():
                    at = np.flatnonzero(of == shard)
                    if len(at):
                        hit[at] = cuckoo.may_have([keys[i] for i in at])
                yield batch.filter(pa.array(hit))

        return refs.mapInArrow(run, refs.schema)

    def _dealt_by_shard(self, refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
        """Every row asks its own shard's filter only: rows are dealt by shard, one with
        many rows (a hot line's) in parts of ``PART_ROWS``, behind a copy of the filter a
        part.  A task holds one filter at a time and streams its rows past it."""
        table = materialize(refs.withColumn("shard", _shard_column(shards)), "sharded-refs")
        parts = materialize(table.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_ROWS)).cast("int").alias("parts")), "shard-parts")
        parts = F.broadcast(parts)  # a row per filter
        rows = table.join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"),
                                                 F.lit(None).cast("binary").alias("filter"), "doc_id", "key")
        kind = refs.schema["doc_id"].dataType
        copies = filters.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "filter",
                                                     F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("binary").alias("key"))

        def run(batches):
            at = cuckoo = None
            for batch in batches:
                place = [batch.column(c).to_numpy() for c in ("shard", "part")]
                blobs, keys = batch.column("filter"), batch.column("key").to_pylist()
                hit = np.zeros(len(batch), bool)
                change = np.r_[True, (place[0][1:] != place[0][:-1]) | (place[1][1:] != place[1][:-1])] if len(batch) else []
                starts = [*np.flatnonzero(change), len(batch)]
                for s, e in zip(starts, starts[1:]):
                    if at != (at := (int(place[0][s]), int(place[1][s]))):
                        cuckoo = None
                    if blobs[s].is_valid:  # the filter comes before the rows
                        cuckoo, s = Cuckoo.load(blobs[s].as_py()), s + 1
                    if cuckoo is not None and s < e:
                        hit[s:e] = cuckoo.may_have(keys[s:e])
                yield batch.select(["doc_id", "key"]).filter(pa.array(hit))

        dealt = copies.unionByName(rows).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())
        return dealt.mapInArrow(run, refs.schema)

    def drops(self, refs: DataFrame) -> DataFrame:
        """``doc_id, keys``: per document of ``refs`` the keys whose lines go."""
        repeated = self.part("counts").where(F.col("n_docs") >= self.min_docs).select("key", "last_doc")
        held = lookup(self.maybe_repeated(refs), repeated, ["key"], F.xxhash64("doc_id"), how="inner")
        lost = held.where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", indexed: bool = False,
              out: str = "text", n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
        """``docs`` with the repeated lines dropped from the text.

        Lines that stay are joined by ``\\n``; a null or empty text, or one
        without lines that stay, becomes empty.  ``indexed`` says that exactly
        ``docs`` were indexed, so their references need not be made again.
        ``out`` names the cleaned text (the text column itself, or a new one);
        ``n_lines`` and ``n_dropped`` name counts to add.  All columns are kept."""
        refs = self.part("refs") if indexed else line_refs(docs, id_col, text_col, self.min_chars).distinct()
        joined, names = by_id(docs, id_col, materialize(self.drops(refs), "line-drops"), "doc_id")
        keys, answer = names["keys"], fresh(joined, "cleaned")
        min_chars = self.min_chars

        def run(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
            rows = []
            for text, gone in zip(texts, lost):
                if gone is None or text is None:
                    rows.append((text or "", (text or "").count("\n") + 1, 0))
                    continue
                lines, gone = text.encode().split(b"\n"), {bytes(g) for g in gone}
                kept = [x for x in lines if line_key(x, min_chars) not in gone]
                rows.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
            return pd.DataFrame(rows, columns=["text", "lines", "dropped"])

        made = joined.withColumn(answer, F.pandas_udf(run, "text string, lines long, dropped long")(quoted(text_col), F.col(keys)))
        values = {out: made[answer]["text"]} | {n: made[answer][k] for n, k in ((n_lines, "lines"), (n_dropped, "dropped")) if n}
        return made.withColumns(values).drop(answer, *names.values())


def _shard_column(shards: int):
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(shard_of(as_words([bytes(k) for k in keys]), shards)) if len(keys) else pd.Series([], dtype="int64")

    return F.pandas_udf(run, "long")(F.col("key"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                        min_docs: int = MIN_DOCS, **counts) -> DataFrame:
    """Index ``docs`` and clean them by that index (see :meth:`LineIndex.clean`)."""
    return LineIndex.build(docs, id_col, text_col, None, min_chars, min_docs).clean(docs, id_col, text_col, indexed=True, **counts)

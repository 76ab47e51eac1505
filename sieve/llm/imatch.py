"""I-Match document fingerprints.

A text's terms are its distinct words.  Those within a band of inverse document
frequency, ``ln(documents / documents with the term)``, form the lexicon.  A
fingerprint hashes the sorted lexicon terms of a text and, for robustness, its
sorted terms within each of ``SUBSETS`` randomised subsets of the lexicon; two
texts are as alike as the share of subset hashes they have in common.  Small subsets
say nothing of short texts and large ones nothing of long texts, of which any edit
changes all.  So there are subsets of several shares of the lexicon, and those count
that suit the texts' size.

The band has a lower bound on document frequency as a share of all documents, so
the lexicon's size is bounded by the mean number of distinct words over that share,
whatever the corpus size.  Each task counts the terms of its documents chunk by chunk,
Spark sums the counts, and only the terms within the band come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, texts_of, word_table

MIN_IDF = math.log(1 / 0.2)     # terms in more than a fifth of the documents say little
MAX_IDF = math.log(1 / 0.0005)  # rarer ones than one in 2,000 are typos and names
#: subsets of each share of the lexicon
LEVEL = 32
SHARES = (1 / 8, 1 / 32, 1 / 128, 1 / 512, 1 / 2048)
SUBSETS = LEVEL * len(SHARES)
#: share of a level's subsets that two texts may have for the level to count
LIVE = 0.95
#: documents, bytes and terms of a chunk whose terms a task counts before it passes them on
CHUNK_DOCS, CHUNK_BYTES, SLICE = 4_096, 16 << 20, 1_000_000
#: terms and bytes of a lexicon that a worker can hold: at one document in 2,000, documents
#: would need 1,000 distinct terms of the band each, on average, to reach the first
MAX_TERMS, MAX_BYTES = 2_000_000, 64 << 20
WORDS = word_table()
#: hex digits of a subset's hash, and what stands for a subset without a term
DIGITS = 4
NONE = "0" * DIGITS


def terms(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(WORDS).split())


def subset_mask(term: bytes, subsets: int, share: float) -> int:
    """Bits of the subsets that hold the term, from its hash alone."""
    h = hashlib.shake_128(term).digest(2 * subsets)
    return sum(1 << k for k in range(subsets) if int.from_bytes(h[2 * k:2 * k + 2], "big") < share * 65_536)


def level_mask(term: bytes) -> int:
    """Bits of the subsets of :data:`SHARES`, level by level.  A level is made of
    disjoint subsets, several times over if they are fewer than :data:`LEVEL`, else some
    of them: a term is in one subset or more of each level up to that share."""
    h, mask = hashlib.shake_128(term).digest(4 * SUBSETS // 8), 0
    for k, share in enumerate(SHARES):
        parts = round(1 / share)
        for j in range(max(1, LEVEL // parts)):
            at = int.from_bytes(h[4 * (4 * k + j):][:4], "big") % parts
            if at < LEVEL:
                mask |= 1 << (LEVEL * k + min(parts, LEVEL) * j + at)
    return mask


def short_hash(parts, size: int) -> str:
    """Hash of sorted terms."""
    return hashlib.blake2b(b" ".join(parts), digest_size=size).hexdigest()


def likeness(a: str, b: str) -> float:
    """Share of subset hashes in common, of those that either text has; equal
    fingerprints are 1, texts without any other than by equal terms 0.

    Of fingerprints with several levels, the first level counts of which the texts have
    at most :data:`LIVE`, with all smaller shares after it (or the last one)."""
    if a == b:
        return 1.0
    one = [a[k:k + DIGITS] for k in range(16, len(a), DIGITS)]
    two = [b[k:k + DIGITS] for k in range(16, len(b), DIGITS)]
    pairs = list(zip(one, two))
    if len(pairs) == SUBSETS:
        while len(pairs) > LEVEL and sum(x != NONE or y != NONE for x, y in pairs[:LEVEL]) > LIVE * LEVEL:
            del pairs[:LEVEL]
    live = [(x, y) for x, y in pairs if x != NONE or y != NONE]
    return sum(x == y for x, y in live) / len(live) if live else 0.0


@dataclass
class Lexicon:
    """Lexicon terms with the mask of their subsets."""

    masks: dict[bytes, int]
    subsets: int = SUBSETS

    def places(self) -> dict[bytes, tuple[int, ...]]:
        """The subsets of each term, as plain values."""
        return {t: tuple(k for k in range(m.bit_length()) if m >> k & 1) for t, m in self.masks.items()}

    def fingerprint(self, text: bytes | None) -> str:
        return fingerprint(text, self.places(), self.subsets)

    def column(self, text: Column) -> Column:
        """Fingerprint of a text column (a null text is an empty one)."""
        places, subsets = self.places(), self.subsets

        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([fingerprint((t or "").encode(), places, subsets) for t in texts], dtype="object")

        return F.pandas_udf(run, "string")(text)


def fingerprint(text: bytes | None, places: dict[bytes, tuple[int, ...]], subsets: int) -> str:
    """16 hex digits for all lexicon terms (for a text with none of them, all its terms),
    then DIGITS for each subset, zeros where it has no term."""
    own = terms(text)
    held = sorted(own & places.keys())
    by: list[list[bytes]] = [[] for _ in range(subsets)]
    for t in held:  # in order, so every subset's terms are sorted too
        for k in places[t]:
            by[k].append(t)
    return short_hash(held or sorted(own), 8) + "".join([short_hash(p, DIGITS // 2) if p else NONE for p in by])


def build_lexicon(docs: DataFrame, text_col: str = "text", min_idf: float = MIN_IDF, max_idf: float = MAX_IDF,
                  subsets: int = SUBSETS, share: float | None = None) -> Lexicon:
    """The terms of all rows' texts within the band; empty without documents.  With
    ``share``, its subsets hold that share of the lexicon each, else those of SHARES."""
    texts = docs.select(quoted(text_col).alias("text"))
    total = texts.count()
    if not total:
        return Lexicon({}, subsets)

    def count(batches):
        found, n, size = Counter(), 0, 0

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for text in texts_of(batch.column(0)):
                found.update(terms(text))
                n, size = n + 1, size + len(text or b"")
                if n >= CHUNK_DOCS or size >= CHUNK_BYTES or len(found) >= SLICE:
                    yield counted()
                    found, n, size = Counter(), 0, 0
        yield counted()

    # a term at the very bound is in
    idf = F.log(F.lit(float(total)) / F.col("n"))
    band = texts.mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")) \
        .where((idf >= min_idf - 1e-12) & (idf <= max_idf + 1e-12)).select("term")
    held = [bytes(r["term"]) for r in band.limit(MAX_TERMS + 1).collect()]
    if len(held) > MAX_TERMS or sum(map(len, held)) > MAX_BYTES:
        raise ValueError(f"the band holds more than {MAX_TERMS} terms or {MAX_BYTES} bytes: choose a smaller max_idf")
    return Lexicon({t: level_mask(t) if share is None else subset_mask(t, subsets, share) for t in held}, subsets)


# --- a document beside the next one -------------------------------------------------
def beside_next(docs: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """``docs`` dealt by ranges of ascending ids, each range followed by the first
    document of the next one (the last by the very first), as rows ``bucket, guest,
    some, id, text`` sorted in this order within partitions.

    Only the text goes through one shuffle; range bounds come from an approximate
    quantile of the ids and just decide how even the ranges are.  Null ids come
    first, equal ids are ordered by text."""
    ids, buckets = docs.select(quoted(id_col).alias("id")), 8 * partitions
    cuts = ids.agg(F.percentile_approx("id", [k / buckets for k in range(1, buckets)], 100_000)).head()[0] if buckets > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    def bucket_of(ids: pd.Series) -> np.ndarray:
        return np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).astype("int64"), "right"))

    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(ids), dtype="int32")

    order = F.struct(F.col("id").isNotNull().alias("some"), "id")
    heads = sorted((r["b"], r["head"]["id"]) for r in ids.groupBy(F.pandas_udf(number, "int")("id").alias("b")).agg(F.min(order).alias("head")).collect())
    before = {b: heads[k - 1][0] for k, (b, _) in enumerate(heads)}
    first = dict(heads)

    def places(ids: pd.Series) -> pd.Series:
        out = []
        for i, b in zip(ids, bucket_of(ids)):
            own = None if pd.isna(i) else int(i)
            out.append([{"bucket": int(b), "guest": False}] + ([{"bucket": before[b], "guest": True}] if first[b] == own else []))
        return pd.Series(out, dtype="object")

    kind = "array<struct<bucket:int,guest:boolean>>"
    dealt = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text")) \
        .select("id", "text", F.explode(F.pandas_udf(places, kind)("id")).alias("at"))
    return dealt.select("at.bucket", "at.guest", F.col("id").isNotNull().alias("some"), "id", "text") \
        .repartition(partitions, "bucket").sortWithinPartitions("bucket", "guest", "some", "id", "text")


def edited_and_next(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    The edited text is the text whose last half (rounded down) of code points is
    replaced by the first as many, or all, of the next document in ascending id,
    after the last document the first.  Null texts are empty ones."""
    # plain values: workers may lack this package
    sent, subsets = docs.sparkSession.sparkContext.broadcast(lexicon.places()), lexicon.subsets
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        bucket = held = None
        own = ""
        for batch in batches:
            rows = []
            for b, guest, i, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if b != bucket:
                    bucket, held = b, None
                elif held is None:  # a further guest: the range is done
                    continue
                mark = fingerprint(text.encode(), sent.value, subsets)
                if held is not None:
                    doc, was = held
                    half = len(was) // 2
                    edited = (was[:len(was) - half] + text[:half]).encode()
                    other = fingerprint(edited, sent.value, subsets)
                    rows.append((doc, len(was), hashlib.sha256(edited).hexdigest(), own, other, likeness(own, other), likeness(own, mark)))
                held, own = (None if guest else (i, text)), mark
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs, id_col, text_col, partitions).mapInArrow(run, schema).withColumnRenamed("id", id_col)

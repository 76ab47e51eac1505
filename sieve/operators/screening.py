"""Screening of bibliography records for one review.

Order of work, cheapest first (Spark keeps conjunct order inside a Filter and
pushes the key-prefix and year predicates into the Parquet scan):

1. venue type: key prefix (``venue_type_filter``)
2. year range
3. keyword query on the title (compiled CNF, whole-stage codegen)
4. key split into type / code / key, DOI from the ``ee`` URL
5. optional batch limit on the candidates, in dump order
6. venue rank lookup (size-checked broadcast join)
7. venue gate: allow-listed key prefix OR rank within the threshold
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cnf import keyword_groups_match
from ..functions.text import extract_doi
from ..functions.venue import key_parts, venue_gate, venue_type_filter, year_filter
from .ranks import lookup_ranks


@dataclass(frozen=True)
class Study:
    """The screening part of a study spec."""

    year_min: int
    year_max: int
    search_word_groups: Sequence[Sequence[str]] | None = None
    accepted_venue_types: Sequence[str] | None = None
    venue_rank_threshold: str | None = None
    manually_accepted_venue_codes: Sequence[str] | None = None
    inclusion_criteria: Sequence[str] = field(default_factory=tuple)
    study_id: int = 1

    @classmethod
    def from_spec(cls, spec: dict, study_id: int = 1) -> "Study":
        return cls(
            year_min=int(spec["year_min"]), year_max=int(spec["year_max"]),
            search_word_groups=spec.get("search_word_groups"),
            accepted_venue_types=spec.get("accepted_venue_types"),
            venue_rank_threshold=spec.get("venue_rank_threshold"),
            manually_accepted_venue_codes=spec.get("manually_accepted_venue_codes"),
            inclusion_criteria=tuple(spec.get("inclusion_criteria") or ()),
            study_id=study_id,
        )


def candidate_filter(study: Study, split: str = "substring") -> Column:
    """Venue type, then year, then title query."""
    return (venue_type_filter("key", study.accepted_venue_types)
            & year_filter("year", study.year_min, study.year_max)
            & keyword_groups_match("title", study.search_word_groups, split))


def partition_prune(records: DataFrame, types) -> DataFrame:
    """Add the venue-type test on the ``ktype`` partition column of records
    stored by ``write_records``.  For types without ``/`` a key starts with a
    type exactly when its first segment does, so this only prunes
    directories; it changes no result."""
    if types is None or "ktype" not in records.columns or any("/" in t for t in types):
        return records
    return records.where(venue_type_filter("ktype", list(types)))


def candidates(records: DataFrame, study: Study, split: str = "substring") -> DataFrame:
    """Records passing venue type, year and keyword query."""
    return partition_prune(records, study.accepted_venue_types).where(candidate_filter(study, split))


# Up to this many rows the batch limit is Spark's top-n (each task keeps n
# rows, one task merges them); above it, the exact distributed cut is used.
TOP_N_SINGLE_TASK_MAX = 1_000_000


def batch_limit(cands: DataFrame, n: int | None, order: str = "ord",
                single_task_max: int = TOP_N_SINGLE_TASK_MAX) -> DataFrame:
    """First ``n`` candidates in dump order; ``None``, 0 or -1 mean no limit.

    Small ``n``: ``orderBy(order).limit(n)`` (a per-partition top-n merged in
    one task of at most ``n`` rows per partition).  Large ``n``: the rows are
    range-partitioned on ``order`` and sorted inside each partition, written
    once with their partition and position, counted per partition (one row
    per partition), and kept while ``offset(partition) + position < n``; no
    task ever holds more than its own partition."""
    if n is None or n in (0, -1):
        return cands
    if n < 0:
        raise ValueError("batch size must be positive, 0, -1 or None")
    if n <= single_task_max:
        return cands.orderBy(order).limit(n)
    return _distributed_head(cands, n, order)


def _distributed_head(df: DataFrame, n: int, order: str) -> DataFrame:
    from ..session import materialize

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order) \
        .withColumn("_mid", F.monotonically_increasing_id())
    placed = materialize(ranged.withColumn("_pid", F.shiftright("_mid", 33))
                         .withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid"), "batch-head")
    counts = sorted((r["_pid"], r["n"]) for r in placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offset, offsets = 0, {}
    for pid, cnt in counts:
        offsets[pid] = offset
        offset += cnt
    if not offsets:
        return placed.drop("_pid", "_pos")
    start = F.element_at(F.create_map(*[x for pid in sorted(offsets) for x in (F.lit(pid), F.lit(offsets[pid]))]),
                         F.col("_pid"))
    return placed.where(start + F.col("_pos") < F.lit(n)).drop("_pid", "_pos")


def split_venue(cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``key`` into venue type / code / key and take the DOI of ``ee``.

    Returns ``(papers, rejects)``; a key without exactly three segments goes to
    ``rejects`` with its reason instead of stopping the run."""
    parts = key_parts("key")
    shaped = cands.withColumn("_parts", parts)
    ok = F.size("_parts") == 3
    papers = shaped.where(ok).select(
        "rec_id", "ord", "key",
        extract_doi("ee").alias("doi"),
        F.lit(None).cast("string").alias("semantic_scholar_id"),
        "title", "year",
        F.col("_parts")[0].alias("venue_type"),
        F.col("_parts")[1].alias("venue_code"),
        F.col("_parts")[2].alias("venue_key"),
        F.col("ee").alias("publisher_source"),
        F.lit(None).cast("string").alias("pdf_source"),
    )
    rejects = shaped.where(~ok).select("rec_id", "key", F.lit("key_not_three_segments").alias("reason"))
    return papers, rejects


def gate(papers: DataFrame, study: Study, missing_passes: bool = True) -> DataFrame:
    """Venue gate: allow-listed full-key prefix OR rank within the threshold."""
    allow = list(study.manually_accepted_venue_codes or [])
    th = F.lit(study.venue_rank_threshold).cast("string")
    return papers.where(venue_gate("key", "venue_rank", th, allow, missing_passes))


PAPER_COLUMNS = ["study_id", "rec_id", "doi", "semantic_scholar_id", "title", "year", "venue_type",
                 "venue_code", "venue_key", "venue_rank", "publisher_source", "pdf_source"]


def screen(records: DataFrame, study: Study, rank_table: DataFrame, *, batch_size: int | None = None,
           split: str = "substring", missing_passes: bool = True) -> DataFrame:
    """Accepted papers of one review (``PAPERS`` columns)."""
    cands = batch_limit(candidates(records, study, split), batch_size)
    papers, _ = split_venue(cands)
    ranked = lookup_ranks(papers, rank_table)
    accepted = gate(ranked, study, missing_passes)
    return accepted.select(F.lit(study.study_id).cast("bigint").alias("study_id"), *PAPER_COLUMNS[1:])


def screen_rejects(records: DataFrame, study: Study, split: str = "substring") -> DataFrame:
    """Candidates that could not become papers, with the reason."""
    _, rejects = split_venue(candidates(records, study, split))
    return rejects

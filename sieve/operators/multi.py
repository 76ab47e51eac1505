"""Many reviews over one scan of the bibliography.

Each study row carries its own year range, venue types, keyword groups,
threshold and allow-list.  The studies are expanded to ``(study, year)``
rows (bounded by the number of studies times their year spans, checked
before broadcasting) and equi-joined to the records on ``year``: every record
meets only the studies whose range holds its year, no record is shuffled,
and the overall year range is pushed into the scan.  Venue type and keyword
query are then evaluated per row from the study's own columns (the query is
split into literal pieces once per study, on the small side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cnf import compile_query_expr, groups_query_expr, match_compiled_expr
from ..functions.text import extract_doi
from ..functions.venue import prefix_any_expr, venue_gate
from .enrich import resolve_ids
from .joins import bounded_broadcast_with
from .ranks import lookup_ranks
from .screening import PAPER_COLUMNS, partition_prune

STUDY_COLUMNS = ["study_id", "year_min", "year_max", "search_word_groups", "accepted_venue_types",
                 "venue_rank_threshold", "manually_accepted_venue_codes"]


def study_queries(studies: DataFrame) -> DataFrame:
    """``(study_id, types, compiled query, threshold, allow-list, year range)`` rows."""
    return studies.select(
        "study_id",
        F.col("accepted_venue_types").alias("_types"),
        compile_query_expr(groups_query_expr("search_word_groups")).alias("_q"),
        F.col("venue_rank_threshold").alias("_th"),
        F.coalesce(F.col("manually_accepted_venue_codes"), F.array().cast("array<string>")).alias("_allow"),
        F.col("year_min").cast("int").alias("_lo"), F.col("year_max").cast("int").alias("_hi"),
    )


def study_years(queries: DataFrame) -> DataFrame:
    """The rows of ``study_queries`` once for every ``year`` of their ranges."""
    return queries.withColumn("year", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def limit_per_study(cands: DataFrame, batch_size: int | None) -> DataFrame:
    """The first ``batch_size`` candidates of every study in dump order (all if None, 0 or -1)."""
    if batch_size is None or batch_size in (0, -1):
        return cands
    # Spark inserts a per-partition group limit before the shuffle, so at most n
    # rows per study and task move.
    w = Window.partitionBy("study_id").orderBy("ord")
    return cands.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= batch_size).drop("_n")


def multi_candidates(records: DataFrame, studies: DataFrame, batch_size: int | None = None) -> DataFrame:
    """``records`` columns + study columns for every (record, study) pair that
    passes the study's venue type, year range and keyword query.  The
    overall year range and the union of the studies' venue types (observed
    while the study years are written) are pushed into the records scan."""
    missing = [c for c in STUDY_COLUMNS if c not in studies.columns]
    if missing:
        raise ValueError(f"studies table lacks columns {missing}")
    sy = study_years(study_queries(studies.where(F.col("year_min") <= F.col("year_max"))))
    # the overall year range is observed while the study years are written,
    # and pushed into the scan of the records
    side, seen, _ = bounded_broadcast_with(sy, {
        "lo": F.min("year"), "hi": F.max("year"),
        "all_types": F.max(F.col("_types").isNull().cast("int")),
        "types": F.array_distinct(F.flatten(F.collect_set(F.coalesce("_types", F.array().cast("array<string>"))))),
    }, name="study-years")
    recs = records
    if seen.get("lo") is not None:
        recs = records.where(F.col("year").between(int(seen["lo"]), int(seen["hi"])))
        if not seen.get("all_types"):
            recs = partition_prune(recs, sorted(seen.get("types") or []))
    joined = recs.join(side, "year")
    cands = joined.where(prefix_any_expr("key", "_types") & match_compiled_expr("title", "_q"))
    return limit_per_study(cands, batch_size)


def gate_flags(cands: DataFrame, rank_table: DataFrame, missing_passes: bool = True) -> DataFrame:
    """Candidate pairs whose key splits into three segments, with their rank
    and ``passed_gate`` (allow-listed key prefix OR rank within threshold)."""
    ranked = lookup_ranks(_split_keep(cands), rank_table)
    return ranked.withColumn("passed_gate", F.coalesce(
        venue_gate("key", "venue_rank", "_th", "_allow", missing_passes), F.lit(False)))


def screen_many(records: DataFrame, studies: DataFrame, rank_table: DataFrame, *,
                batch_size: int | None = None, missing_passes: bool = True,
                title_index: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Accepted papers of every study (``PAPERS`` columns).

    ``candidates`` may pass precomputed ``multi_candidates`` output.  With
    ``title_index``, papers without DOI get identifiers by title; rank and
    gate do not depend on identifiers, so this runs after the gate, on
    accepted papers only."""
    cands = candidates if candidates is not None else multi_candidates(records, studies, batch_size)
    accepted = gate_flags(cands, rank_table, missing_passes).where("passed_gate").select(*PAPER_COLUMNS)
    if title_index is not None:
        accepted = resolve_ids(accepted, title_index)
    return accepted


def _split_keep(cands: DataFrame) -> DataFrame:
    """``split_venue`` that keeps the per-study gate columns."""
    parts = F.split("key", "/")
    return cands.where(F.size(parts) == 3).select(
        "study_id", "rec_id", "ord", "key",
        extract_doi("ee").alias("doi"),
        F.lit(None).cast("string").alias("semantic_scholar_id"),
        "title", "year",
        parts[0].alias("venue_type"), parts[1].alias("venue_code"), parts[2].alias("venue_key"),
        F.col("ee").alias("publisher_source"),
        F.lit(None).cast("string").alias("pdf_source"),
        "_th", "_allow",
    )

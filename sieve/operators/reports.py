"""Queries over the stored review tables, recall against a pilot set, and
per-study counters.  Filters, semi/anti/left equi-joins and partial
aggregates only."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import pdf_link_line, study_line

PAPER_KEY = ["study_id", "rec_id"]


def study_by_id(studies: DataFrame, study_id: int) -> DataFrame:
    """Zero or one study."""
    return studies.where(F.col("study_id") == F.lit(study_id))


def studies_of_date(studies: DataFrame, date: str | _dt.date | None = None) -> DataFrame:
    """Studies run on ``date`` (default: today)."""
    d = F.current_date() if date is None else F.lit(date).cast("date")
    return studies.where(F.col("study_date") == d)


def study_papers(papers: DataFrame, study_id: int) -> DataFrame:
    """Papers of one study (empty for an unknown study)."""
    return papers.where(F.col("study_id") == F.lit(study_id))


def paper_reports(reports: DataFrame, study_id: int, rec_id: int) -> DataFrame:
    """Reports of one paper (a paper may have several)."""
    return reports.where((F.col("study_id") == study_id) & (F.col("rec_id") == rec_id))


def report_assessments(assessments: DataFrame, study_id: int, rec_id: int) -> DataFrame:
    return assessments.where((F.col("study_id") == study_id) & (F.col("rec_id") == rec_id))


def passed_papers(papers: DataFrame, reports: DataFrame, study_id: int) -> DataFrame:
    """Papers of a study with a report whose ``passed_criteria`` is true
    (NULL excluded); each paper once however many reports passed."""
    ok = reports.where((F.col("study_id") == study_id) & (F.col("passed_criteria") == F.lit(True)))
    return study_papers(papers, study_id).join(ok, PAPER_KEY, "left_semi")


def study_reports(papers: DataFrame, reports: DataFrame, study_id: int) -> DataFrame:
    """Reports of the papers of one study."""
    return reports.where(F.col("study_id") == study_id).join(
        study_papers(papers, study_id).select(*PAPER_KEY), PAPER_KEY, "left_semi")


def pdf_links(papers: DataFrame, study_id: int) -> DataFrame:
    return study_papers(papers, study_id).select(*PAPER_KEY, pdf_link_line().alias("line"))


def study_lines(studies: DataFrame) -> DataFrame:
    return studies.select("study_id", study_line().alias("line"))


# --- recall ------------------------------------------------------------------
def recall_flags(pilots: DataFrame, exported: DataFrame, pilot_col: str = "doi", export_col: str = "doi") -> DataFrame:
    """Every pilot row with ``found``: exact, case-sensitive membership in the
    exported column.  The exported side is de-duplicated by a partial
    aggregate first, so the join is many-to-one."""
    ex = exported.select(F.col(export_col).alias("_e")).where(F.col("_e").isNotNull()).distinct() \
        .withColumn("_hit", F.lit(True))
    j = pilots.join(ex, pilots[pilot_col] == ex["_e"], "left")
    return j.select(*[pilots[c] for c in pilots.columns], F.coalesce(F.col("_hit"), F.lit(False)).alias("found"))


def recall_found(pilots: DataFrame, exported: DataFrame, pilot_col="doi", export_col="doi") -> DataFrame:
    return pilots.join(exported.select(F.col(export_col).alias("_e")), F.col(pilot_col) == F.col("_e"), "left_semi")


def recall_missing(pilots: DataFrame, exported: DataFrame, pilot_col="doi", export_col="doi") -> DataFrame:
    ex = exported.select(F.col(export_col).alias("_e")).where(F.col("_e").isNotNull())
    return pilots.join(ex, F.col(pilot_col) == F.col("_e"), "left_anti")


def recall(pilots: DataFrame, exported: DataFrame, pilot_col="doi", export_col="doi") -> DataFrame:
    """One row: pilots, found, recall (found / pilots)."""
    flags = recall_flags(pilots, exported, pilot_col, export_col)
    return flags.agg(F.count(F.lit(1)).alias("pilots"),
                     F.count_if("found").alias("found"),
                     F.round(F.avg(F.col("found").cast("double")), 6).alias("recall"))


# --- table statistics ----------------------------------------------------------
def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: name, row count, attribute names (comma-joined)."""
    parts = [df.agg(F.count(F.lit(1)).alias("entries")).select(
        F.lit(name).alias("table_name"), "entries", F.lit(",".join(df.columns)).alias("attributes"))
        for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def study_counters(studies: DataFrame, candidates: DataFrame, reports: DataFrame, assessments: DataFrame,
                   run_date: str | None, dump_name: str, runtime_seconds: float = 0.0) -> DataFrame:
    """Stored study rows: ``papers_collected`` = candidates seen (accepted or
    not), ``reports_collected`` = reports with at least one assessment;
    ``study_date`` is ``run_date`` (default: today)."""
    seen = candidates.groupBy("study_id").agg(F.count(F.lit(1)).alias("papers_collected"))
    assessed = assessments.select(*PAPER_KEY).distinct()
    done = reports.join(assessed, PAPER_KEY, "left_semi").groupBy("study_id") \
        .agg(F.count(F.lit(1)).alias("reports_collected"))
    return (studies.select("study_id", "study_name")
            .join(seen, "study_id", "left").join(done, "study_id", "left")
            .select("study_id", "study_name",
                    (F.lit(run_date).cast("date") if run_date else F.current_date()).alias("study_date"),
                    F.lit(dump_name).alias("dblp_used"),
                    F.coalesce("papers_collected", F.lit(0)).cast("int").alias("papers_collected"),
                    F.coalesce("reports_collected", F.lit(0)).cast("int").alias("reports_collected"),
                    F.lit(None).cast("int").alias("total_tokens_used_llm"),
                    F.lit(float(runtime_seconds)).alias("total_runtime")))

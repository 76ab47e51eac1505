"""PRISMA flow counts per study.

Every record of the dump gets one status per study, first match wins:

``duplicate``       its DOI (non-NULL) already appeared at an earlier ``ord``
``auto_filtered``   fails venue type, year range or keyword query (or its key
                    does not split into three segments)
``aux_filtered``    fails the venue gate
``screened``        otherwise

Counters (one row per study): ``total_papers_collected`` = all records,
``duplicate_records_removed``, ``records_refused_by_automated_filters``,
``records_refused_by_aux_filters`` and ``records_screened`` are counts by
status; ``records_excluded_manually`` = 0 (no manual step);
``records_excluded_automatically`` = screened papers whose verdict is false;
``report_construction_attempts`` = screened; ``report_construction_failures``
= screened papers with neither tldr nor abstract;
``report_assessment_attempts`` = screened papers with a rating response;
``report_assessment_exclusions`` = screened papers whose verdict is false;
``report_assessment_exclusion_summaries`` = distinct criteria rated below the
passing rating in screened papers.

Scale: duplicates come from one partial aggregate per DOI over the dump (a
hot DOI costs one row per map task), written once while the dump totals are
observed; only the (record, study) candidate pairs are joined to it, with
NULL DOIs kept off a single reducer; the per-study work runs only over those
pairs; everything ends in grouped partial aggregates.  No window over a hot
key, no cross product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_doi
from ..schemas import PRISMA_COUNTERS
from ..session import materialize
from .joins import left_join_nonnull


def doi_groups(records: DataFrame) -> DataFrame:
    """``(doi, n, first_ord)`` per DOI (NULL DOI is one group).  A partial
    aggregate: a hot DOI, or the NULL group, costs one row per map task."""
    return records.select("ord", extract_doi("ee").alias("doi")).groupBy("doi").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def prisma_flow(records: DataFrame, studies: DataFrame, gated: DataFrame, contents: DataFrame,
                responses: DataFrame, reports: DataFrame, assessments: DataFrame,
                min_rating: int = 5) -> DataFrame:
    """One row per study with the twelve counters (see module doc).

    ``gated`` holds the candidate pairs with ``passed_gate``
    (``multi.gate_flags``), so the dump is not screened a second time.
    Duplicates: the dump is aggregated once per DOI; only the candidate pairs
    are joined to that aggregate (which is already partitioned on the DOI)."""
    # the per-DOI aggregate is written once; the two dump totals are observed
    # while it is written, so they need neither a second pass nor a join
    groups, totals = materialize(doi_groups(records), "doi-groups", {
        "total": F.sum("n"),
        "dup": F.sum(F.when(F.col("doi").isNotNull(), F.col("n") - 1).otherwise(0)),
    })
    total, dup = int(totals.get("total") or 0), int(totals.get("dup") or 0)
    firsts = groups.where(F.col("doi").isNotNull()).select(F.col("doi").alias("_d"), "first_ord")
    cand = gated.select("study_id", "rec_id", "ord", "passed_gate", F.col("doi").alias("_cd"))
    flagged = left_join_nonnull(cand, firsts, ["_cd"], ["_d"]) \
        .where(F.col("first_ord").isNull() | (F.col("ord") <= F.col("first_ord"))) \
        .select("study_id", "rec_id", "passed_gate")

    key = ["study_id", "rec_id"]
    text = contents.select(*key, ((F.coalesce("tldr", F.lit("")) != "") | (F.coalesce("abstract", F.lit("")) != ""))
                           .alias("has_text"))
    info = (flagged.where("passed_gate")
            .join(text, key, "left")
            .join(responses.select(*key).distinct().withColumn("has_response", F.lit(True)), key, "left")
            .join(reports.groupBy(*key).agg(F.max(F.col("passed_criteria") == F.lit(False)).alias("failed")),
                  key, "left"))
    per_rec = info.select("study_id",
                          F.lit("paper").alias("_kind"),
                          F.lit(None).cast("string").alias("_crit"),
                          F.coalesce("has_text", F.lit(False)).alias("has_text"),
                          F.coalesce("has_response", F.lit(False)).alias("has_response"),
                          F.coalesce("failed", F.lit(False)).alias("failed"),
                          F.lit(True).alias("passed_gate"))
    refused = flagged.where(~F.col("passed_gate")).select(
        "study_id", F.lit("aux").alias("_kind"), F.lit(None).cast("string").alias("_crit"),
        F.lit(False).alias("has_text"), F.lit(False).alias("has_response"), F.lit(False).alias("failed"),
        F.lit(False).alias("passed_gate"))
    screened_keys = flagged.where("passed_gate").select(*key)
    low = (assessments.where(F.col("rating") < min_rating).join(screened_keys, key, "left_semi")
           .select("study_id", F.lit("crit").alias("_kind"), F.col("criteria").alias("_crit"),
                   F.lit(False).alias("has_text"), F.lit(False).alias("has_response"), F.lit(False).alias("failed"),
                   F.lit(False).alias("passed_gate")))
    allrows = per_rec.unionByName(refused).unionByName(low)
    paper = F.col("_kind") == "paper"
    per_study = allrows.groupBy("study_id").agg(
        F.count_if(paper).alias("records_screened"),
        F.count_if(F.col("_kind") == "aux").alias("records_refused_by_aux_filters"),
        F.count_if(paper & F.col("failed")).alias("records_excluded_automatically"),
        F.count_if(paper & ~F.col("has_text")).alias("report_construction_failures"),
        F.count_if(paper & F.col("has_response")).alias("report_assessment_attempts"),
        F.count_distinct(F.when(F.col("_kind") == "crit", F.col("_crit"))).alias("report_assessment_exclusion_summaries"),
    )
    out = studies.select("study_id").join(per_study, "study_id", "left")
    c = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("bigint")
    screened = c("records_screened")
    aux = c("records_refused_by_aux_filters")
    cols = {
        "total_papers_collected": F.lit(total).cast("bigint"),
        "duplicate_records_removed": F.lit(dup).cast("bigint"),
        "records_refused_by_aux_filters": aux,
        "records_refused_by_automated_filters": F.lit(total - dup).cast("bigint") - aux - screened,
        "records_screened": screened,
        "records_excluded_manually": F.lit(0).cast("bigint"),
        "records_excluded_automatically": c("records_excluded_automatically"),
        "report_construction_attempts": screened,
        "report_construction_failures": c("report_construction_failures"),
        "report_assessment_attempts": c("report_assessment_attempts"),
        "report_assessment_exclusions": c("records_excluded_automatically"),
        "report_assessment_exclusion_summaries": c("report_assessment_exclusion_summaries"),
    }
    return out.select("study_id", *[cols[n].alias(n) for n in PRISMA_COUNTERS])

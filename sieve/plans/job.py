"""A review run as one Spark job (``spark-submit --py-files sieve.zip
run_review.py ...`` or ``python -m sieve.plans.job ...``).

Flags follow the reviewed tool's command line; the network lookups it made
are replaced by tables:

  --study FILE         study spec JSON (repeat for several studies; each gets the next free id)
  --dblp PATH          bibliography XML dump (file or directory), or with
                       --records a records Parquet table
  --ranks PATH         rank pages Parquet (page_id, html, kind=conference|journal)
  --batch N            screen only the first N candidates of each study
  --collect_content    enrich with --meta (and --title_index, --pages)
  --title_threshold T  papers without DOI take the best hit in --title_index whose
                       score is T or more (0 to 1), not only one of an equal title
  --generate_report    build assessment requests; with --responses
                       (study_id, rec_id, response) also assessments
  --export_all         CSV export of the papers, one per study of this run
  --export_summary     CSV of the study rows and a PRISMA flow table per study
  --out DIR            study store the tables go to; all tables of a run appear at
                       once, or none if it fails, and earlier runs' studies stay
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assess import validate_specs
from ..operators.prisma import prisma_flow
from ..operators.ranks import rank_rows
from ..sources.bibliography import read_bibliography
from ..sources.commit import StudyStore
from ..sources.store import export_studies
from ..sources.studies import studies_from_json
from .review import ReviewRun


def parse_args(argv=None):
    ap = argparse.ArgumentParser(description="Run a systematic-review screening as a Spark job.")
    ap.add_argument("--study", action="append", required=True)
    ap.add_argument("--dblp", required=True)
    ap.add_argument("--records", action="store_true", help="--dblp is a records Parquet table")
    ap.add_argument("--ranks", required=True)
    ap.add_argument("--batch", type=int)
    ap.add_argument("--collect_content", action="store_true")
    ap.add_argument("--meta")
    ap.add_argument("--title_index")
    ap.add_argument("--title_threshold", type=float)
    ap.add_argument("--pages")
    ap.add_argument("--generate_report", action="store_true")
    ap.add_argument("--responses")
    ap.add_argument("--export_all", action="store_true")
    ap.add_argument("--export_summary", action="store_true")
    ap.add_argument("--out", required=True)
    return ap.parse_args(argv)


def load_specs(spark: SparkSession, paths: list[str], first_id: int = 1) -> DataFrame:
    """Whole-file JSON specs, ids in argument order."""
    parts = [spark.read.text(p, wholetext=True).select(F.lit(i + first_id).cast("bigint").alias("study_id"),
                                                       F.col("value").alias("doc"))
             for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_table_of(pages: DataFrame) -> DataFrame:
    """Rank rows of conference and journal pages, in one pass over the pages."""
    return rank_rows(pages, F.col("kind"))


def run(spark: SparkSession, args) -> dict[str, str]:
    """Run the review; returns table name → path of what this run wrote."""
    start = time.time()
    bad = validate_specs(load_specs(spark, args.study), "study_id").where(~F.col("valid")).collect()  # one row per study at most
    if bad:
        raise ValueError("invalid study spec: " + "; ".join(f"{r.study_id}: {','.join(r.errors)}" for r in bad))
    out = StudyStore(spark, args.out)
    first = out.reserve(len(args.study))
    ids, run_id = list(range(first, first + len(args.study))), uuid.uuid4().hex
    studies = studies_from_json(load_specs(spark, args.study, first))
    written: dict[str, str] = {}
    if args.records:
        records = spark.read.parquet(args.dblp)
    else:
        records, rejects = read_bibliography(spark, args.dblp)
        written["rejects"] = os.path.join(args.out, "rejects", f"gen={run_id}")
        rejects.write.mode("overwrite").parquet(written["rejects"])
    meta = spark.read.parquet(args.meta) if args.collect_content and args.meta else None
    index = spark.read.parquet(args.title_index) if args.title_index else None
    pages = spark.read.parquet(args.pages) if args.collect_content and args.pages else None
    responses = spark.read.parquet(args.responses) if args.generate_report and args.responses else None
    review = ReviewRun(records, studies, rank_table_of(spark.read.parquet(args.ranks)), title_index=index,
                       meta=meta, landing=pages, responses=responses, batch_size=args.batch,
                       dump_name=os.path.basename(args.dblp.rstrip("/")), title_threshold=args.title_threshold)
    names = ["papers"]
    if args.collect_content:
        names += ["contents", "metrics"]
    if args.generate_report:
        names += ["requests", "reports", "criteria_assessments"]
    tables = {name: getattr(review, name) for name in names}
    if args.export_summary:
        tables["prisma"] = prisma_flow(records, studies, review.gated, review.contents, review.responses, review.reports,
                                       review.criteria_assessments, review.min_rating)
    for name, df in tables.items():
        written[name] = out.write(name, df, run_id)
    review.runtime_seconds = time.time() - start
    tables["studies"] = review.studies
    written["studies"] = out.write("studies", tables["studies"], run_id)
    out.commit({name: df.schema for name, df in tables.items()}, ids, run_id)
    if args.export_all:
        written["export_csv"] = os.path.join(args.out, "export_csv", f"gen={run_id}")
        export_studies(out.read("papers", ids), written["export_csv"])
    if args.export_summary:
        written["summary_csv"] = os.path.join(args.out, "summary_csv", f"gen={run_id}")
        out.read("studies", ids).write.mode("overwrite").option("header", True).csv(written["summary_csv"])
    return written


def main(argv=None) -> int:
    args = parse_args(argv)
    spark = SparkSession.builder.appName("sieve-review").getOrCreate()
    written = run(spark, args)
    for row in spark.read.parquet(written["studies"]).orderBy("study_id").collect():  # a row per study of this run
        print(f"study {row.study_id}: {row.papers_collected} candidates, {row.reports_collected} reports")
    return 0


if __name__ == "__main__":
    sys.exit(main())

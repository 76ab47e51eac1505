"""Composed review runs over the derived inputs.

``ReviewInputs`` gives the stand-in tables for one ``(spark, sf_dir)``;
``run_review`` chains the library operators the way a review run does and
returns the stored tables (studies, papers, contents, metrics, reports,
criteria assessments) as lazy DataFrames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assess import assessment_requests, criteria_assessments, response_ratings, verdict
from ..operators.enrich import abstract_fallback, enrich_wide, resolve_ids
from ..operators.multi import gate_flags, multi_candidates
from ..operators.ranks import rank_rows
from ..operators.reports import study_counters
from ..operators.screening import PAPER_COLUMNS, Study, screen
from ..operators.titles import resolve_ids_ranked
from ..session import materialize
from ..sources.studies import studies_from_json
from . import fixtures

KEY = ["study_id", "rec_id"]


class ReviewInputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def view(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return fixtures.base_table(self.spark, self.sf_dir, name)

    @cached_property
    def bib(self) -> DataFrame:
        return self.view("bib")

    @cached_property
    def rank_table(self) -> DataFrame:
        """Conference and journal rank rows read from the rank pages."""
        pages = self.view("rank_html")
        return rank_rows(pages, "conference").unionByName(rank_rows(pages, "journal"))

    @cached_property
    def studies(self) -> DataFrame:
        """The review specs of ``fixtures.REVIEW_SPECS`` as a studies table."""
        docs = self.spark.createDataFrame(fixtures.spec_rows(), "study_id bigint, doc string")
        return studies_from_json(docs)

    def study(self, i: int) -> Study:
        """Review ``i`` (1-based) of ``fixtures.REVIEW_SPECS``."""
        return Study.from_spec(fixtures.REVIEW_SPECS[i - 1], study_id=i)


def screen_study(inp: ReviewInputs, i: int, **kw) -> DataFrame:
    return screen(inp.bib, inp.study(i), inp.rank_table, **kw)


class ReviewRun:
    """The stored tables of one review run over many studies, built lazily:
    a query that needs only ``papers`` never plans contents or assessments.

    Inputs are DataFrames: ``records`` (the dump), ``studies`` (studies
    table), ``rank_table`` (``ranks.rank_rows`` output); optionally
    ``title_index`` (identifier resolution; by equal titles, or by the best hit of
    ``title_threshold`` or more if that is given), ``meta`` (metadata enrichment),
    ``landing`` (pages for the abstract fallback) and ``responses``: a
    ``(study_id, rec_id, response)`` table, or a function that maps the
    requested papers ``(study_id, rec_id, meta_id)`` to one."""

    def __init__(self, records: DataFrame, studies: DataFrame, rank_table: DataFrame, *,
                 title_index: DataFrame | None = None, meta: DataFrame | None = None,
                 landing: DataFrame | None = None, responses=None, batch_size: int | None = None,
                 run_date: str | None = None, dump_name: str = "", min_rating: int = 5,
                 runtime_seconds: float = 0.0, title_threshold: float | None = None):
        self.title_threshold = title_threshold
        self.records, self.study_table, self.rank_table = records, studies, rank_table
        self.title_index, self.meta, self.landing, self._responses_in = title_index, meta, landing, responses
        self.batch_size, self.run_date, self.dump_name = batch_size, run_date, dump_name
        self.min_rating, self.runtime_seconds = min_rating, runtime_seconds

    @cached_property
    def _criteria(self) -> DataFrame:
        return self.study_table.select("study_id", "inclusion_criteria")

    @cached_property
    def candidates(self) -> DataFrame:
        """(record, study) pairs passing venue type, year and keyword query,
        written once to the shared folder: the single scan of the dump."""
        cands = multi_candidates(self.records, self.study_table, self.batch_size)
        return materialize(cands.select("study_id", "rec_id", "ord", "key", "title", "year", "ee", "_th", "_allow"),
                           "candidates")

    @cached_property
    def gated(self) -> DataFrame:
        """Candidates with a three-segment key, their rank and ``passed_gate``."""
        return gate_flags(self.candidates, self.rank_table)

    @cached_property
    def _accepted(self) -> DataFrame:
        """Accepted papers (type, year, query, key split, rank, gate)."""
        return self.gated.where("passed_gate").select(*PAPER_COLUMNS)

    @cached_property
    def _wide(self) -> DataFrame:
        """Accepted papers with identifiers resolved and their metadata
        columns, written once (papers, contents, metrics, requests and
        responses all read it)."""
        # the accepted papers come from the written candidates, so the lookup
        # sides can be cut to the keys they need at little cost
        papers = self._accepted
        if self.title_index is not None and self.title_threshold is not None:
            papers = resolve_ids_ranked(papers, self.title_index, threshold=self.title_threshold).select(*papers.columns)
        elif self.title_index is not None:
            papers = resolve_ids(papers, self.title_index, cut=True)
        if self.meta is not None:
            wide = enrich_wide(papers, self.meta, cut=True)
        else:
            wide = papers.select("*", F.lit(False).alias("meta_found"),
                                 *[F.lit(None).cast(t).alias(c) for c, t in
                                   [("tldr", "string"), ("abstract", "string"), ("citations", "int"),
                                    ("influential_citations", "int"), ("meta_id", "string")]])
        return materialize(wide, "enriched")

    @cached_property
    def papers(self) -> DataFrame:
        return self._wide.select(*PAPER_COLUMNS)

    @cached_property
    def contents(self) -> DataFrame:
        """tldr and abstract of papers with metadata; empty abstracts filled
        from the landing page when landing pages are given."""
        found = self._wide.where("meta_found").select(*KEY, "publisher_source", "tldr", "abstract")
        if self.landing is None:
            return found.select(*KEY, "tldr", "abstract")
        # the fallback parses pages: written once, read by
        # requests, PRISMA and the statistics
        return materialize(abstract_fallback(found, self.landing, cut=True).select(*KEY, "tldr", "abstract"),
                           "contents")

    @cached_property
    def metrics(self) -> DataFrame:
        return self._wide.where("meta_found").select(
            *KEY, "citations", "influential_citations", F.lit(None).cast("int").alias("paper_length"))

    @cached_property
    def requests(self) -> DataFrame:
        """One assessment request per accepted paper, from its own content."""
        with_content = self._wide.select(*KEY, "meta_id").join(self.contents, KEY, "left").join(self._criteria, "study_id")
        return assessment_requests(with_content, KEY + ["meta_id"])

    @cached_property
    def responses(self) -> DataFrame:
        r = self._responses_in
        if r is None:
            return self.requests.select(*KEY, F.lit(None).cast("string").alias("response")).limit(0)
        if callable(r):
            r = r(self._wide.select(*KEY, "meta_id"))
        return r.select(*KEY, "response")

    @cached_property
    def _rated(self) -> DataFrame:
        return self.responses.join(self._criteria, "study_id")

    @cached_property
    def criteria_assessments(self) -> DataFrame:
        return criteria_assessments(self._rated, KEY)

    @cached_property
    def reports(self) -> DataFrame:
        r = self._rated.select(*KEY, response_ratings("response").alias("_r"), "inclusion_criteria")
        return (self.papers.select(*KEY).join(r, KEY, "left")
                .select(*KEY, verdict("_r", "inclusion_criteria", self.min_rating).alias("passed_criteria")))

    @cached_property
    def studies(self) -> DataFrame:
        return study_counters(self.study_table, self.candidates, self.reports, self.criteria_assessments,
                              self.run_date, self.dump_name, self.runtime_seconds)


# the table names a run stores, in write order
RUN_TABLES = ["studies", "papers", "contents", "metrics", "requests", "reports", "criteria_assessments"]


def run_review(inp: ReviewInputs, min_rating: int = 5, runtime_seconds: float = 0.0) -> ReviewRun:
    """All four reviews of the fixtures over one bibliography scan.

    screen (type, year, query, key split, rank, gate, identifier resolution)
    → metadata enrichment → abstract fallback from landing pages →
    assessment requests → rating responses → criteria assessments, verdicts
    → study counters.  Tables are planned on first access."""
    llm = inp.view("responses").select(F.col("doc_id").cast("string").alias("meta_id"), "response")

    def recorded_responses(requested: DataFrame) -> DataFrame:
        # stand-in for the batch-inference output: the response recorded for
        # the paper's metadata id (papers without metadata get none)
        return requested.join(llm, "meta_id")

    return ReviewRun(inp.bib, inp.studies, inp.rank_table, title_index=inp.view("title_index"),
                     meta=inp.view("meta"), landing=inp.view("landing"), responses=recorded_responses,
                     run_date=fixtures.RUN_DATE, dump_name=fixtures.DUMP_NAME, min_rating=min_rating,
                     runtime_seconds=runtime_seconds)

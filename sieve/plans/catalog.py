"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)``, reads the test tables (through the
derived views of ``fixtures``) and returns a DataFrame whose column names
match the DuckDB oracle of the same name.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cnf, formats, markup, text, venue
from ..operators import abstracts, assess, enrich, index, multi, prisma, reports, screening, titles
from ..operators import ranks as rank_ops
from ..schemas import PAPERS
from ..session import scratch_path
from ..sources import bibliography, commit, store
from ..sources import studies as studies_src
from . import fixtures
from .review import ReviewInputs, run_review, screen_study

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# constants the single-operator queries use
CNF_QUERY = "(ring OR anvil OR gizmo) AND (economy or promo) AND workload"
TYPES = ["conf", "journals"]


# --- flagship -------------------------------------------------------------------
@query("screen")
def q_screen(spark, sf_dir):
    """Accepted papers of review 1: type, year, title query, key split, DOI,
    rank lookup, venue gate."""
    return screen_study(ReviewInputs(spark, sf_dir), 1)


# --- filters --------------------------------------------------------------------
@query("venue_type_filter")
def q_venue_type_filter(spark, sf_dir):
    """Bibliography records whose key starts with conf or journals."""
    bib = ReviewInputs(spark, sf_dir).bib
    return bib.where(venue.venue_type_filter("key", TYPES)).select("rec_id", "key")


@query("year_filter")
def q_year_filter(spark, sf_dir):
    """Bibliography records published 1996 to 1998."""
    bib = ReviewInputs(spark, sf_dir).bib
    return bib.where(venue.year_filter("year", 1996, 1998)).select("rec_id", "year")


@query("cnf_match")
def q_cnf_match(spark, sf_dir):
    """Every title matched against one constant CNF query."""
    bib = ReviewInputs(spark, sf_dir).bib
    return bib.select("rec_id", cnf.cnf_column("title", CNF_QUERY).alias("matched"))


@query("cnf_match_column")
def q_cnf_match_column(spark, sf_dir):
    """Every title matched against its own CNF query string."""
    ex = ReviewInputs(spark, sf_dir).view("exprs")
    return ex.select("rec_id", cnf.cnf_match_expr("title", "cnf_expr").alias("matched"))


@query("or_match")
def q_or_match(spark, sf_dir):
    """Every title matched against its own disjunction."""
    ex = ReviewInputs(spark, sf_dir).view("exprs")
    return ex.select("rec_id", cnf.or_match_expr("title", "or_expr").alias("matched"))


@query("and_match")
def q_and_match(spark, sf_dir):
    """Every title matched against its own conjunction."""
    ex = ReviewInputs(spark, sf_dir).view("exprs")
    return ex.select("rec_id", cnf.and_match_expr("title", "and_expr").alias("matched"))


@query("paren_groups")
def q_paren_groups(spark, sf_dir):
    """The stripped text of each parenthesised group of every query string."""
    ex = ReviewInputs(spark, sf_dir).view("exprs")
    return ex.select("rec_id", F.array_join(cnf.text_inside_parens("cnf_expr"), "|").alias("groups"))


def _doc_groups(spark, sf_dir, split):
    inp = ReviewInputs(spark, sf_dir)
    groups = inp.study(1).search_word_groups
    docs = inp.table("documents")
    return docs.select("doc_id", cnf.keyword_groups_match("text", groups, split).alias("matched"))


@query("keyword_groups")
def q_keyword_groups(spark, sf_dir):
    """Review 1's keyword groups over whole document texts (substring split)."""
    return _doc_groups(spark, sf_dir, "substring")


@query("keyword_groups_token")
def q_keyword_groups_token(spark, sf_dir):
    """Review 1's keyword groups over whole document texts, one literal per word."""
    return _doc_groups(spark, sf_dir, "token")


@query("batch_limit")
def q_batch_limit(spark, sf_dir):
    """First 100 candidates of review 2 in dump order."""
    inp = ReviewInputs(spark, sf_dir)
    c = screening.candidates(inp.bib, inp.study(2))
    return screening.batch_limit(c, 100).select("rec_id")


# --- projections ----------------------------------------------------------------
@query("split_key")
def q_split_key(spark, sf_dir):
    """Venue type, code and key of every record with a three-segment key."""
    bib = ReviewInputs(spark, sf_dir).bib
    papers, _ = screening.split_venue(bib)
    return papers.select("rec_id", "venue_type", "venue_code", "venue_key")


@query("extract_doi")
def q_extract_doi(spark, sf_dir):
    """The DOI of every record's link (NULL without one)."""
    bib = ReviewInputs(spark, sf_dir).bib
    return bib.select("rec_id", text.extract_doi("ee").alias("doi"))


@query("parse_rank")
def q_parse_rank(spark, sf_dir):
    """Rank name of every rank text."""
    r = ReviewInputs(spark, sf_dir).view("ranks")
    return r.select("venue_code", "rank_text", venue.parse_rank("rank_text").alias("venue_rank"))


# --- ranks ----------------------------------------------------------------------
@query("rank_rows")
def q_rank_rows(spark, sf_dir):
    """Conference rank rows read from the first table of every rank page."""
    pages = ReviewInputs(spark, sf_dir).view("rank_html")
    return rank_ops.rank_rows(pages, "conference")


def _ranked_candidates(spark, sf_dir, i):
    inp = ReviewInputs(spark, sf_dir)
    papers, _ = screening.split_venue(screening.candidates(inp.bib, inp.study(i)))
    return inp, rank_ops.lookup_ranks(papers, inp.rank_table)


@query("venue_rank_join")
def q_venue_rank_join(spark, sf_dir):
    """Rank of every candidate of review 2 (conf and phd venues)."""
    _, ranked = _ranked_candidates(spark, sf_dir, 2)
    return ranked.select("rec_id", "venue_type", "venue_code", "venue_rank")


@query("venue_gate")
def q_venue_gate(spark, sf_dir):
    """Gate decision for every ranked candidate of review 1."""
    inp, ranked = _ranked_candidates(spark, sf_dir, 1)
    st = inp.study(1)
    ok = venue.venue_gate("key", "venue_rank", F.lit(st.venue_rank_threshold),
                          list(st.manually_accepted_venue_codes or []))
    return ranked.select("rec_id", "venue_rank", ok.alias("accepted"))


@query("venue_gate_strict")
def q_venue_gate_strict(spark, sf_dir):
    """Gate decision for every ranked candidate of review 1, MISSING not passing."""
    inp, ranked = _ranked_candidates(spark, sf_dir, 1)
    st = inp.study(1)
    ok = venue.venue_gate("key", "venue_rank", F.lit(st.venue_rank_threshold),
                          list(st.manually_accepted_venue_codes or []), missing_passes=False)
    return ranked.select("rec_id", "venue_rank", ok.alias("accepted"))


# --- many reviews at once ----------------------------------------------------------
@query("screen_many")
def q_screen_many(spark, sf_dir):
    """Accepted papers of all four reviews from one scan."""
    inp = ReviewInputs(spark, sf_dir)
    return multi.screen_many(inp.bib, inp.studies, inp.rank_table)


@query("screen_indexed")
def q_screen_indexed(spark, sf_dir):
    """Accepted papers of all four reviews by the inverted index of their queries."""
    inp = ReviewInputs(spark, sf_dir)
    return index.screen_indexed(inp.bib, inp.studies, inp.rank_table)


@query("screen_part_studies")
def q_screen_part_studies(spark, sf_dir):
    """One small review per name and type of parts: accepted papers by the index, allow-lists as a table."""
    inp = ReviewInputs(spark, sf_dir)
    return index.screen_indexed(inp.bib, part_studies(inp), inp.rank_table, allow=inp.view("part_allow")) \
        .select("study_id", "rec_id", "venue_rank")


def part_studies(inp: ReviewInputs):
    """The view ``part_studies`` as a studies table."""
    return inp.view("part_studies").select(
        "study_id", "year_min", "year_max", F.array(F.array("w1", "w2"), F.array("w3")).alias("search_word_groups"),
        F.array("venue_type").alias("accepted_venue_types"), "venue_rank_threshold",
        F.lit(None).cast("array<string>").alias("manually_accepted_venue_codes"))


# --- text functions -----------------------------------------------------------------
@query("clean_text")
def q_clean_text(spark, sf_dir):
    """Every document text stripped, line breaks deleted."""
    docs = ReviewInputs(spark, sf_dir).table("documents")
    return docs.select("doc_id", text.clean_text("text").alias("cleaned"))


@query("long_paragraphs")
def q_long_paragraphs(spark, sf_dir):
    """Paragraphs of more than 40 words; the documents' single line breaks are
    doubled into paragraph breaks first."""
    docs = ReviewInputs(spark, sf_dir).table("documents")
    paged = docs.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    paras = text.long_paragraphs("text", 40)
    return paged.select("doc_id", F.size(paras).alias("n_long"), F.array_join(paras, "").alias("long_text"))


@query("meta_description")
def q_meta_description(spark, sf_dir):
    """The og:description content of every web page (NULL without one)."""
    web = ReviewInputs(spark, sf_dir).view("web")
    return web.select("page_id", abstracts.meta_description("html").alias("description"))


@query("fallback_abstract")
def q_fallback_abstract(spark, sf_dir):
    """Fallback abstract of every raw page (long paragraphs of the page text)."""
    pages = ReviewInputs(spark, sf_dir).table("pages")
    return pages.select("page_id", abstracts.fallback_abstract("html").alias("abstract"))


@query("abstract_route")
def q_abstract_route(spark, sf_dir):
    """Extraction route and element id chosen by every page URL."""
    web = ReviewInputs(spark, sf_dir).view("web")
    r = abstracts.abstract_route("url")
    return web.select("page_id", r["route"].alias("route"), r["element_id"].alias("element_id"))


@query("text_by_id")
def q_text_by_id(spark, sf_dir):
    """Text of the element with id ``abs`` on every page ('' when absent)."""
    web = ReviewInputs(spark, sf_dir).view("web").withColumn("element_id", F.lit("abs"))
    return abstracts.text_by_id(web, out="text").select("page_id", "text")


@query("extract_abstract")
def q_extract_abstract(spark, sf_dir):
    """Abstract of every page by its URL route."""
    web = ReviewInputs(spark, sf_dir).view("web")
    return abstracts.extract_abstracts(web, ["page_id"]).select("page_id", "route", "abstract")


@query("nested_markup")
def q_nested_markup(spark, sf_dir):
    """Pages with nested lists, blocks and tables: text without lists and scripts, text of
    an element by id, and cells of the first table's rows."""
    pages = ReviewInputs(spark, sf_dir).view("nested")
    rows = markup.table_cells("html")
    return pages.select("doc_id", abstracts.page_text_without("html").alias("rest"), abstracts.id_text("html", F.lit("abs")).alias("abs"),
                        F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), ";").alias("cells"))


@query("likert_label")
def q_likert_label(spark, sf_dir):
    """Likert label of every line number (1..7)."""
    li = ReviewInputs(spark, sf_dir).table("lineitem")
    return li.select("l_orderkey", "l_linenumber", formats.likert_label("l_linenumber").alias("label"))


@query("section_text")
def q_section_text(spark, sf_dir):
    """The tldr/abstract section text of every metadata row."""
    meta = ReviewInputs(spark, sf_dir).view("meta")
    return meta.select("doi", formats.section_text(("abstract", "title", "tldr")).alias("text"))


# --- enrichment ------------------------------------------------------------------------
@query("resolve_ids")
def q_resolve_ids(spark, sf_dir):
    """Candidates of review 2; those without DOI get id and DOI by title."""
    inp = ReviewInputs(spark, sf_dir)
    papers, _ = screening.split_venue(screening.candidates(inp.bib, inp.study(2)))
    out = enrich.resolve_ids(papers, inp.view("title_index"))
    return out.select("rec_id", "doi", "semantic_scholar_id")


@query("resolve_ids_ranked")
def q_resolve_ids_ranked(spark, sf_dir):
    """Records cited by changed titles; those without DOI get id and DOI of the best title hit."""
    inp = ReviewInputs(spark, sf_dir)
    out = titles.resolve_ids_ranked(inp.view("cited"), inp.view("title_index"))
    return out.select("rec_id", "doi", "semantic_scholar_id", "title_score")


def _accepted_enriched(spark, sf_dir):
    """Review 1's accepted papers with their metadata columns, in one pass."""
    inp = ReviewInputs(spark, sf_dir)
    return inp, enrich.enrich_wide(screen_study(inp, 1), inp.view("meta"))


@query("enrich_papers")
def q_enrich_papers(spark, sf_dir):
    """Accepted papers of review 1 with pdf link, tldr and abstract."""
    _, wide = _accepted_enriched(spark, sf_dir)
    return wide.select("rec_id", "doi", "pdf_source", "tldr", "abstract")


@query("paper_metrics")
def q_paper_metrics(spark, sf_dir):
    """Citation metrics of review 1's accepted papers that have metadata."""
    _, wide = _accepted_enriched(spark, sf_dir)
    return wide.where("meta_found").select("rec_id", "citations", "influential_citations")


@query("abstract_coalesce")
def q_abstract_coalesce(spark, sf_dir):
    """Contents of review 1's papers; empty abstracts filled from landing pages."""
    inp, wide = _accepted_enriched(spark, sf_dir)
    c = wide.where("meta_found").select("study_id", "rec_id", "publisher_source", "tldr", "abstract")
    filled = enrich.abstract_fallback(c, inp.view("landing"))
    return filled.select("rec_id", "abstract")


@query("match_known_papers")
def q_match_known_papers(spark, sf_dir):
    """Review 2's candidates (ids resolved) matched against review 1's stored papers."""
    inp = ReviewInputs(spark, sf_dir)
    stored = screen_study(inp, 1)
    papers, _ = screening.split_venue(screening.candidates(inp.bib, inp.study(2)))
    incoming = rank_ops.lookup_ranks(enrich.resolve_ids(papers, inp.view("title_index")), inp.rank_table)
    out = enrich.match_known(incoming.select(*screening.PAPER_COLUMNS[1:]).withColumn("incoming_id", F.col("rec_id")),
                             stored.select(*screening.PAPER_COLUMNS[1:]))
    return out.select("incoming_id", "rec_id", "doi", "title", "venue_rank", "known")


# --- assessments -------------------------------------------------------------------------
@query("valid_responses")
def q_valid_responses(spark, sf_dir):
    """Shape check of every rating response."""
    raw = ReviewInputs(spark, sf_dir).view("raw_responses")
    return raw.select("doc_id", assess.response_valid("response").alias("valid"))


@query("validate_studies")
def q_validate_studies(spark, sf_dir):
    """Errors of every study spec document."""
    docs = ReviewInputs(spark, sf_dir).view("spec_docs")
    v = assess.validate_specs(docs, "doc_id")
    return v.select("doc_id", "valid", F.array_join("errors", ";").alias("errors"))


def _review(spark, sf_dir):
    return run_review(ReviewInputs(spark, sf_dir))


@query("criteria_assessments")
def q_criteria_assessments(spark, sf_dir):
    """Per-criterion ratings of the whole review run."""
    return _review(spark, sf_dir).criteria_assessments


@query("assessment_requests")
def q_assessment_requests(spark, sf_dir):
    """Assessment request of every accepted paper of the review run."""
    return _review(spark, sf_dir).requests.select("study_id", "rec_id", "system_prompt", "user_content")


# --- stored-table queries -----------------------------------------------------------------
@query("all_papers")
def q_all_papers(spark, sf_dir):
    """Accepted papers of the whole review run (all reviews)."""
    return _review(spark, sf_dir).papers


@query("study_summary")
def q_study_summary(spark, sf_dir):
    """Stored study rows with their counters."""
    return _review(spark, sf_dir).studies


@query("study_by_id")
def q_study_by_id(spark, sf_dir):
    """Study 3 of the stored studies."""
    return reports.study_by_id(_review(spark, sf_dir).studies, 3)


@query("studies_of_date")
def q_studies_of_date(spark, sf_dir):
    """Studies run on the run date."""
    return reports.studies_of_date(_review(spark, sf_dir).studies, fixtures.RUN_DATE)


@query("study_lines")
def q_study_lines(spark, sf_dir):
    """The printed line of every stored study."""
    return reports.study_lines(_review(spark, sf_dir).studies)


@query("study_papers")
def q_study_papers(spark, sf_dir):
    """Papers of study 2."""
    return reports.study_papers(_review(spark, sf_dir).papers, 2)


@query("pdf_links")
def q_pdf_links(spark, sf_dir):
    """Link lines of study 1's papers."""
    return reports.pdf_links(_review(spark, sf_dir).papers, 1)


@query("passed_papers")
def q_passed_papers(spark, sf_dir):
    """Papers of study 1 whose report passed the criteria."""
    r = _review(spark, sf_dir)
    return reports.passed_papers(r.papers, r.reports, 1).select("study_id", "rec_id", "title")


@query("study_reports")
def q_study_reports(spark, sf_dir):
    """Reports of study 1's papers."""
    r = _review(spark, sf_dir)
    return reports.study_reports(r.papers, r.reports, 1)


def _first_assessed(r):
    """The paper of review 1 with the smallest id among those assessed."""
    return r.criteria_assessments.where(F.col("study_id") == 1).agg(F.min("rec_id").alias("rec_id"))


@query("paper_report")
def q_paper_report(spark, sf_dir):
    """Reports of one paper (review 1's first assessed paper)."""
    r = _review(spark, sf_dir)
    return r.reports.where(F.col("study_id") == 1).join(_first_assessed(r), "rec_id", "left_semi")


@query("report_assessments")
def q_report_assessments(spark, sf_dir):
    """Criteria assessments of one report (review 1's first assessed paper)."""
    r = _review(spark, sf_dir)
    return r.criteria_assessments.where(F.col("study_id") == 1).join(_first_assessed(r), "rec_id", "left_semi")


@query("table_stats")
def q_table_stats(spark, sf_dir):
    """Row count and attributes of every stored table."""
    r = _review(spark, sf_dir)
    return reports.table_stats({"studies": r.studies, "papers": r.papers, "reports": r.reports,
                                "contents": r.contents, "metrics": r.metrics,
                                "criteria_assessments": r.criteria_assessments})


def _exported(spark, sf_dir):
    return _review(spark, sf_dir).papers.select("doi")


@query("recall_found")
def q_recall_found(spark, sf_dir):
    """Pilot DOIs found among the accepted papers."""
    pilots = ReviewInputs(spark, sf_dir).view("pilots")
    return reports.recall_found(pilots, _exported(spark, sf_dir))


@query("recall_missing")
def q_recall_missing(spark, sf_dir):
    """Pilot DOIs not found among the accepted papers."""
    pilots = ReviewInputs(spark, sf_dir).view("pilots")
    return reports.recall_missing(pilots, _exported(spark, sf_dir))


@query("recall")
def q_recall(spark, sf_dir):
    """Pilots, pilots found, and recall."""
    pilots = ReviewInputs(spark, sf_dir).view("pilots")
    return reports.recall(pilots, _exported(spark, sf_dir))


@query("prisma_flow")
def q_prisma_flow(spark, sf_dir):
    """PRISMA counters of every review after the whole run."""
    inp = ReviewInputs(spark, sf_dir)
    r = run_review(inp)
    return prisma.prisma_flow(inp.bib, inp.studies, r.gated, r.contents, r.responses, r.reports,
                              r.criteria_assessments)


# --- sources and sinks ------------------------------------------------------------------------
@query("ingest_records")
def q_ingest_records(spark, sf_dir):
    """The bibliography written as an XML dump, then read back by the text-split scan."""
    path = scratch_path(spark, "bib-xml")
    bibliography.write_dump(ReviewInputs(spark, sf_dir).bib, path)
    records, _ = bibliography.read_bibliography(spark, path)
    return records.select("key", "title", "year", "ee")


@query("ingest_varied")
def q_ingest_varied(spark, sf_dir):
    """The bibliography in dump order, its start tags written in several ways and beside
    comments and CDATA that hold others; read back and numbered."""
    path = scratch_path(spark, "bib-varied")
    bib = ReviewInputs(spark, sf_dir).bib
    bibliography.write_dump(bib.repartitionByRange("ord").sortWithinPartitions("ord"), path, bibliography.varied_xml())
    records, _ = bibliography.read_bibliography(spark, path)
    return records.select("ord", "key", "title", "year", "ee")


@query("write_papers")
def q_write_papers(spark, sf_dir):
    """Papers of all reviews written partitioned by study, read back."""
    path = scratch_path(spark, "papers")
    store.write_table(_review(spark, sf_dir).papers, path)
    return store.read_table(spark, path, PAPERS).select(*screening.PAPER_COLUMNS)


@query("commit_runs")
def q_commit_runs(spark, sf_dir):
    """Two runs in one study store: all reviews; then review 2 without papers and review 3
    under a new id.  The papers of the latest version."""
    papers = _review(spark, sf_dir).papers
    out = commit.StudyStore(spark, scratch_path(spark, "study-store"))
    first = out.reserve(4)
    out.write_run({"papers": papers, "studies": papers.groupBy("study_id").count()}, range(first, first + 4))
    new = out.reserve(1)
    again = papers.where("study_id = 3").withColumn("study_id", F.lit(new).cast("long"))
    out.write_run({"papers": again, "studies": again.groupBy("study_id").count()}, [2, new])
    return out.read("papers").select(*screening.PAPER_COLUMNS)


@query("export_csv")
def q_export_csv(spark, sf_dir):
    """The papers of every review exported as CSV with CRLF; all lines read back."""
    path = scratch_path(spark, "export")
    store.export_studies(_review(spark, sf_dir).papers, path)
    lines = spark.read.schema("value string, study_id long").option("lineSep", "\r\n").text(path)
    return lines.select("study_id", F.col("value").alias("line"))


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """Review 1's papers exported to CSV; the DOI column read back."""
    path = scratch_path(spark, "export-csv")
    store.export_csv(reports.study_papers(_review(spark, sf_dir).papers, 1), path)
    return store.csv_column(spark, path, "doi")


@query("load_study")
def q_load_study(spark, sf_dir):
    """Study spec documents written as JSON lines, loaded with the spec schema."""
    path = scratch_path(spark, "specs-json")
    docs = ReviewInputs(spark, sf_dir).view("spec_docs")
    docs.select(F.regexp_replace("doc", "^\\{", F.concat(F.lit('{"study_id": '), F.col("doc_id").cast("string"),
                                                          F.lit(", "))).alias("value")).write.text(path)
    loaded = studies_src.load_studies(spark, path)
    # list fields as JSON text, so the comparison does not depend on how a
    # client represents arrays
    return loaded.select(*[F.to_json(c).alias(c) if loaded.schema[c].dataType.typeName() == "array" else F.col(c)
                           for c in loaded.columns])

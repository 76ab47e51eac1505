"""Table schemas and the fixed values every result depends on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reviewed tool's, in its order) -----------
# Venue rank names and their ordinals; MISSING sorts first, so an unranked
# venue passes every threshold unless ``missing_passes=False``.
VENUE_RANKS = ["MISSING", "A_STAR", "A", "B", "C"]
# Likert scale 1..7 and their labels.
LIKERT_LABELS = [
    "strongly_disagree",
    "disagree",
    "somewhat_disagree",
    "neither_agree_or_disagree",
    "somewhat_agree",
    "agree",
    "strongly_agree",
]
# Paper content sections, in their fixed order (the order used when sections
# are printed).  Only those that are columns of ``contents`` can be printed.
CONTENT_SECTIONS = ["tldr", "title", "abstract", "introduction", "methods",
                    "results", "discussion", "references"]
CONTENT_COLUMNS = ["tldr", "abstract", "introduction", "methods", "results", "discussion"]
# Study spec: allowed threshold texts and venue types.
RANK_THRESHOLDS = ["A*", "A", "B", "C"]
VENUE_TYPES = ["conf", "journals", "workshops", "informal", "phd", "books"]
# Instruction sent with every assessment request, before and after the
# numbered criteria list.
ASSESSMENT_HEAD = (
    "Assume you are a software engineering researcher conducting a systematic literature review (SLR). \n"
    "Consider the title and abstract of a primary study.\n"
    "Using a 1-7 Likert scale (1 - Strongly disagree, 2 - Disagree, 3 - Somewhat disagree, "
    "4 - Neither agree nor disagree, 5 - Somewhat agree, 6 - Agree, and 7 - Strongly agree) "
    "rate your agreement with each of the following statements:\n\n"
)
ASSESSMENT_TAIL = (
    "\n\nYour should only provide a RFC8259 compliant JSON response following this format without deviation:\n"
    '{\n    "ratings": [\n        "2",\n        "4",\n        "1",\n        ...\n    ]\n}\n\n'
    "Lastly, keep the same order in your ratings as the order of the provided statements."
)
# PRISMA counters, in declaration order.
PRISMA_COUNTERS = [
    "total_papers_collected",
    "duplicate_records_removed",
    "records_refused_by_aux_filters",
    "records_refused_by_automated_filters",
    "records_screened",
    "records_excluded_manually",
    "records_excluded_automatically",
    "report_construction_attempts",
    "report_construction_failures",
    "report_assessment_attempts",
    "report_assessment_exclusions",
    "report_assessment_exclusion_summaries",
]
# ---------------------------------------------------------------------------

STR_ARRAY = T.ArrayType(T.StringType())

RECORDS = T.StructType([
    T.StructField("rec_id", T.LongType()),
    T.StructField("ord", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("ee", T.StringType()),
])

STUDY_SPEC = T.StructType([
    T.StructField("study_name", T.StringType()),
    T.StructField("research_goal", T.StringType()),
    T.StructField("research_questions", STR_ARRAY),
    T.StructField("inclusion_criteria", STR_ARRAY),
    T.StructField("year_min", T.LongType()),
    T.StructField("year_max", T.LongType()),
    T.StructField("search_word_groups", T.ArrayType(STR_ARRAY)),
    T.StructField("venue_rank_threshold", T.StringType()),
    T.StructField("accepted_venue_types", STR_ARRAY),
    T.StructField("manually_accepted_venue_codes", STR_ARRAY),
])

STUDIES = T.StructType([T.StructField("study_id", T.LongType())] + list(STUDY_SPEC.fields))

PAPERS = T.StructType([
    T.StructField("study_id", T.LongType()),
    T.StructField("rec_id", T.LongType()),
    T.StructField("doi", T.StringType()),
    T.StructField("semantic_scholar_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("venue_type", T.StringType()),
    T.StructField("venue_code", T.StringType()),
    T.StructField("venue_key", T.StringType()),
    T.StructField("venue_rank", T.StringType()),
    T.StructField("publisher_source", T.StringType()),
    T.StructField("pdf_source", T.StringType()),
])

VENUE_RANK_ROWS = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("lookup_key", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("rank_text", T.StringType()),
])

PAPER_META = T.StructType([
    T.StructField("doi", T.StringType()),
    T.StructField("semantic_scholar_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("is_open_access", T.BooleanType()),
    T.StructField("pdf_url", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("tldr", T.StringType()),
    T.StructField("citations", T.IntegerType()),
    T.StructField("influential_citations", T.IntegerType()),
])

RATING_RESPONSE = T.StructType([T.StructField("ratings", STR_ARRAY)])

"""Assessment requests, rating responses, criteria assessments, verdicts, and
study-spec validation.  All built-in expressions; one row in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import assessment_instruction, likert_label, section_text
from ..schemas import RANK_THRESHOLDS, VENUE_TYPES

# JSON string token and the only accepted response shape:
# {"ratings": [<string>, ...]} with no other key.
_JSON_WS = "[ \\t\\n\\r]*"
_JSON_STR = "\"(?:[^\"\\\\]|\\\\.)*\""
RESPONSE_SHAPE = (f"^{_JSON_WS}\\{{{_JSON_WS}\"ratings\"{_JSON_WS}:{_JSON_WS}\\[{_JSON_WS}"
                  f"(?:{_JSON_STR}(?:{_JSON_WS},{_JSON_WS}{_JSON_STR})*)?{_JSON_WS}\\]{_JSON_WS}\\}}{_JSON_WS}$")
VALID_RATINGS = ["1", "2", "3", "4", "5", "6", "7"]
MIN_PASSING_RATING = 5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def response_valid(response) -> Column:
    """A JSON object whose only key is ``ratings``, an array of strings."""
    r = _c(response)
    keys = F.json_object_keys(r)
    return F.coalesce((F.size(keys) == 1) & (keys[0] == "ratings") & r.rlike(RESPONSE_SHAPE), F.lit(False))


def response_ratings(response) -> Column:
    """The ratings array of a valid response, else NULL."""
    parsed = F.from_json(_c(response), "ratings array<string>")
    return F.when(response_valid(response), parsed["ratings"])


def ratings_usable(ratings, criteria) -> Column:
    """Every rating is one of ``1``..``7`` and there are no more ratings than
    criteria; otherwise the whole response is void."""
    r = _c(ratings)
    return (r.isNotNull()
            & F.forall(r, lambda x: x.isin(*VALID_RATINGS))
            & (F.size(r) <= F.size(_c(criteria))))


def criteria_assessments(responses: DataFrame, keys: list[str], response: str = "response",
                         criteria: str = "inclusion_criteria") -> DataFrame:
    """Rating ``i`` pairs with criterion ``i``: ``keys`` + ``pos`` (1-based),
    ``criteria``, ``rating``, ``label``.  Invalid or void responses give no
    rows; fewer ratings than criteria give fewer rows."""
    rated = responses.select(*keys, F.col(criteria).alias("_crit"), response_ratings(response).alias("_r"))
    usable = rated.where(ratings_usable("_r", "_crit"))
    ex = usable.select(*keys, "_crit", F.posexplode("_r").alias("_i", "_v"))
    return ex.select(*keys, (F.col("_i") + 1).alias("pos"),
                     F.element_at("_crit", F.col("_i") + 1).alias("criteria"),
                     F.col("_v").cast("int").alias("rating"),
                     likert_label(F.col("_v").cast("int")).alias("label"))


def verdict(ratings, criteria, min_rating: int = MIN_PASSING_RATING) -> Column:
    """``passed_criteria``: NULL without usable ratings; true when every
    criterion has a rating and all ratings are at least ``min_rating``."""
    r = _c(ratings)
    ok = ratings_usable(r, criteria)
    passed = (F.size(r) == F.size(_c(criteria))) & F.forall(r, lambda x: x.cast("int") >= min_rating)
    return F.when(ok & (F.size(r) > 0), passed)


def assessment_requests(papers: DataFrame, keys: list[str], criteria: str = "inclusion_criteria") -> DataFrame:
    """One request per paper: the fixed instruction with the numbered criteria
    (system part) and the tldr/abstract section text (user part)."""
    return papers.select(*keys, assessment_instruction(criteria).alias("system_prompt"),
                         section_text(("tldr", "abstract")).alias("user_content"))


# --- study spec validation -------------------------------------------------------
REQUIRED = ["search_word_groups", "inclusion_criteria", "year_min", "year_max"]
STRING_FIELDS = ["study_name", "research_goal", "venue_rank_threshold"]
STRING_LIST_FIELDS = ["research_questions", "inclusion_criteria", "accepted_venue_types",
                      "manually_accepted_venue_codes"]
INT_FIELDS = ["year_min", "year_max"]


def _type_of(v: Column, field: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, f"$.{field}", "variant"))


def spec_errors(doc) -> Column:
    """Sorted error codes of a study spec document (empty when valid):
    ``invalid_json``, ``not_object``, ``missing:<f>``, ``type:<f>``,
    ``minimum:<f>``, ``enum:<f>``.  Extra keys are allowed."""
    v = F.try_parse_json(_c(doc))
    top = F.schema_of_variant(v)
    keys = F.json_object_keys(_c(doc))
    checks: list[Column] = []
    for f in REQUIRED:
        checks.append(F.when(~F.array_contains(keys, f), F.lit(f"missing:{f}")))
    for f in STRING_FIELDS:
        t = _type_of(v, f)
        checks.append(F.when(t.isNotNull() & (t != "STRING"), F.lit(f"type:{f}")))
    for f in STRING_LIST_FIELDS:
        t = _type_of(v, f)
        arr = F.try_variant_get(v, f"$.{f}", "array<string>")
        bad = ~t.isin("ARRAY<STRING>", "ARRAY<VOID>") | F.exists(arr, lambda x: x.isNull())
        checks.append(F.when(t.isNotNull() & bad, F.lit(f"type:{f}")))
    t = _type_of(v, "search_word_groups")
    groups = F.try_variant_get(v, "$.search_word_groups", "array<array<string>>")
    bad = (~t.rlike("^ARRAY<(ARRAY<(STRING|VOID)>|VOID)>$")
           | F.exists(groups, lambda g: g.isNull() | F.exists(g, lambda x: x.isNull())))
    checks.append(F.when(t.isNotNull() & bad, F.lit("type:search_word_groups")))
    for f in INT_FIELDS:
        t = _type_of(v, f)
        checks.append(F.when(t.isNotNull() & ~t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(f"type:{f}")))
        val = F.try_variant_get(v, f"$.{f}", "bigint")
        checks.append(F.when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT") & (val < 0), F.lit(f"minimum:{f}")))
    th = F.try_variant_get(v, "$.venue_rank_threshold", "string")
    checks.append(F.when((_type_of(v, "venue_rank_threshold") == "STRING") & ~th.isin(*RANK_THRESHOLDS),
                         F.lit("enum:venue_rank_threshold")))
    types = F.try_variant_get(v, "$.accepted_venue_types", "array<string>")
    checks.append(F.when((_type_of(v, "accepted_venue_types") == "ARRAY<STRING>")
                         & F.exists(types, lambda x: ~x.isin(*VENUE_TYPES)), F.lit("enum:accepted_venue_types")))
    errs = F.array_sort(F.filter(F.array(*checks), lambda e: e.isNotNull()))
    return (F.when(v.isNull(), F.array(F.lit("invalid_json")))
            .when(~top.startswith("OBJECT"), F.array(F.lit("not_object")))
            .otherwise(errs))


def validate_specs(docs: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """``key``, ``valid``, ``errors`` per spec document."""
    e = spec_errors(doc)
    return docs.select(key, (F.size(e) == 0).alias("valid"), e.alias("errors"))

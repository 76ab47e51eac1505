"""DataFrame operators: rank lookup, enrichment joins, known-paper match,
recall, assessments and spec validation."""

import json

from pyspark.sql import functions as F

from sieve.operators import assess, enrich, joins, ranks, reports


def test_rank_rows_and_first_row_wins(spark):
    page = ("<html><table><tr><th>T</th><th>A</th><th>S</th><th>R</th></tr>"
            "<tr><td>Venue One</td><td> ICSE </td><td>x</td><td>A*</td></tr>"
            "<tr><td>Other</td><td>icse</td><td>x</td><td>B</td></tr>"
            "<tr><td>Short</td><td>x</td></tr></table><table><tr><td>no</td></tr></table></html>")
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    rows = ranks.rank_rows(pages, "conference").collect()
    assert [(r.lookup_key, r.pos, r.rank_text) for r in rows] == [("ICSE", 1, "A*"), ("icse", 2, "B")]
    papers = spark.createDataFrame([(1, "conf", "IcSe"), (2, "conf", "nope"), (3, "phd", "icse"),
                                    (4, "journals", "Venue One")], "rec_id long, venue_type string, venue_code string")
    table = ranks.rank_rows(pages, "conference").unionByName(ranks.rank_rows(pages, "journal"))
    got = {r.rec_id: r.venue_rank for r in ranks.lookup_ranks(papers, table).collect()}
    assert got == {1: "A_STAR", 2: "MISSING", 3: "MISSING", 4: "A_STAR"}


def test_bounded_broadcast_falls_back(spark):
    df = spark.range(100)
    _, small = joins.bounded_broadcast(df, 1000)
    _, big = joins.bounded_broadcast(df, 10)
    assert small and not big


def test_left_join_nonnull_spreads_null_keys(spark):
    left = spark.createDataFrame([(i, None if i % 3 else f"k{i % 2}") for i in range(30)], "id long, k string")
    right = spark.createDataFrame([("k0", 10), ("k1", 11)], "k string, v int")
    out = {r.id: r.v for r in joins.left_join_nonnull(left, right, ["k"]).collect()}
    assert len(out) == 30
    assert all(out[i] is None for i in range(30) if i % 3)
    assert all(out[i] == 10 + (i % 2) for i in range(30) if i % 3 == 0)


def test_unique_by_first_wins(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, o int, v string")
    got = {r.k: r.v for r in joins.unique_by(df, ["k"], "o", ["v"]).collect()}
    assert got == {"a": "y", "b": "z"}


def test_resolve_ids(spark):
    papers = spark.createDataFrame([(1, None, None, "A  Title "), (2, "10.1/x", None, "A Title"), (3, None, None, "zzz")],
                                   "rec_id long, doi string, semantic_scholar_id string, title string")
    index = spark.createDataFrame([("a title", "s2", "10.9/b", 5), ("A TITLE", "s1", None, 1)],
                                  "title string, semantic_scholar_id string, doi string, hit_rank long")
    got = {r.rec_id: (r.doi, r.semantic_scholar_id) for r in enrich.resolve_ids(papers, index).collect()}
    assert got == {1: (None, "s1"), 2: ("10.1/x", None), 3: (None, None)}


def test_enrich_by_id_then_doi(spark):
    papers = spark.createDataFrame([(1, "10.1/a", None, None), (2, "10.1/b", "S-unknown", None), (3, None, "S3", None)],
                                   "rec_id long, doi string, semantic_scholar_id string, pdf_source string")
    meta = spark.createDataFrame([("10.1/a", "S1", "", "tl", True, "http://p1", 5, 1),
                                  ("10.1/b", "S2", "ab", None, True, "", 6, 2),
                                  (None, "S3", "ab3", "t3", False, "http://p3", 7, 3)],
                                 "doi string, semantic_scholar_id string, abstract string, tldr string, "
                                 "is_open_access boolean, pdf_url string, citations int, influential_citations int")
    p, contents, metrics = enrich.enrich(papers, meta)
    pdf = {r.rec_id: r.pdf_source for r in p.collect()}
    assert pdf == {1: "http://p1", 2: None, 3: None}
    c = {r.rec_id: (r.tldr, r.abstract) for r in contents.collect()}
    # paper 2 has an unknown id: no fallback to its DOI, so no contents
    assert c == {1: ("tl", None), 3: ("t3", "ab3")}
    assert sorted(r.rec_id for r in metrics.collect()) == [1, 3]


def test_abstract_fallback_only_when_empty(spark):
    contents = spark.createDataFrame([(1, "u1", "keep"), (2, "u2", None), (3, "u3", "")],
                                     "rec_id long, publisher_source string, abstract string")
    pages = spark.createDataFrame([("u1", "https://arxiv.org/abs/1", '<div id="abs">no</div>'),
                                   ("u2", "https://arxiv.org/abs/2", '<div id="abs">Two</div>')],
                                  "url string, final_url string, html string")
    got = {r.rec_id: r.abstract for r in enrich.abstract_fallback(contents, pages).collect()}
    assert got == {1: "keep", 2: "Two", 3: ""}


def test_match_known(spark):
    stored = spark.createDataFrame([(10, "10.1/a", None, "stored a"), (11, None, "S9", "stored s")],
                                   "rec_id long, doi string, semantic_scholar_id string, title string")
    incoming = spark.createDataFrame([(1, "10.1/a", None, "new a"), (2, "10.1/zz", "S9", "new b"), (3, None, "S9", "new c")],
                                     "rec_id long, doi string, semantic_scholar_id string, title string")
    got = {r.title: r.known for r in enrich.match_known(incoming, stored).collect()}
    # DOI set but unknown: the id is not tried
    assert got == {"stored a": True, "new b": False, "stored s": True}


def test_recall_case_sensitive_and_repeats(spark):
    pilots = spark.createDataFrame([("10.1/A",), ("10.1/a",), ("10.1/a",), ("10.2/x",)], "doi string")
    exported = spark.createDataFrame([("10.1/a",), (None,), ("10.1/a",)], "doi string")
    assert reports.recall_found(pilots, exported).count() == 2
    assert sorted(r.doi for r in reports.recall_missing(pilots, exported).collect()) == ["10.1/A", "10.2/x"]
    r = reports.recall(pilots, exported).first()
    assert (r.pilots, r.found, r.recall) == (4, 2, 0.5)


def test_response_validation(spark):
    cases = ['{"ratings":[2]}', '{"ratings":["2"],"x":1}', '{"ratings":["a\\"b"]}', '{"ratings": []}',
             '["1"]', '{bad', None]
    df = spark.createDataFrame([(c,) for c in cases], "r string")
    assert [r[0] for r in df.select(assess.response_valid("r")).collect()] == [False, False, True, True, False, False, False]


def test_criteria_assessments_and_verdict(spark):
    rows = [(1, '{"ratings":["8","1"]}', ["c1", "c2"]), (2, '{"ratings":["5","6","7"]}', ["c1", "c2"]),
            (3, '{"ratings":["6"]}', ["c1", "c2"]), (4, '{"ratings":["5","7"]}', ["c1", "c2"]),
            (5, '{"ratings":["5","2"]}', ["c1", "c2"])]
    df = spark.createDataFrame(rows, "id long, response string, inclusion_criteria array<string>")
    out = assess.criteria_assessments(df, ["id"]).collect()
    assert sorted((r.id, r.pos, r.criteria, r.rating, r.label) for r in out) == [
        (3, 1, "c1", 6, "agree"), (4, 1, "c1", 5, "somewhat_agree"), (4, 2, "c2", 7, "strongly_agree"),
        (5, 1, "c1", 5, "somewhat_agree"), (5, 2, "c2", 2, "disagree")]
    v = {r.id: r.v for r in df.select("id", assess.verdict(assess.response_ratings("response"),
                                                           "inclusion_criteria").alias("v")).collect()}
    assert v == {1: None, 2: None, 3: False, 4: True, 5: False}


def test_spec_validation(spark):
    good = {"search_word_groups": [["a"]], "inclusion_criteria": ["x"], "year_min": 2019, "year_max": 2024,
            "venue_rank_threshold": "A*", "accepted_venue_types": ["conf"], "extra": 1}
    bad = {"search_word_groups": [["a", 1]], "year_min": -1, "year_max": "2024", "venue_rank_threshold": "D",
           "accepted_venue_types": ["blog"], "study_name": 3}
    docs = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "{oops"), (4, "[1]")],
                                 "id long, doc string")
    got = {r.id: (r.valid, r.errors) for r in assess.validate_specs(docs, "id").collect()}
    assert got[1] == (True, [])
    assert got[2] == (False, ["enum:accepted_venue_types", "enum:venue_rank_threshold", "minimum:year_min",
                              "missing:inclusion_criteria", "type:search_word_groups", "type:study_name",
                              "type:year_max"])
    assert got[3] == (False, ["invalid_json"])
    assert got[4] == (False, ["not_object"])


def test_requests(spark):
    df = spark.createDataFrame([(1, ["A", "B"], "t", None)], "id long, inclusion_criteria array<string>, tldr string, abstract string")
    r = assess.assessment_requests(df, ["id"]).first()
    assert "\n\n1. A\n2. B\n\n" in r.system_prompt
    assert r.user_content == "tldr:\nt\n\nabstract:\nNone\n"


def test_hot_keys_stay_correct(spark):
    """A third of the papers share one DOI and a third have none: the lookup
    side is reduced per key before the join and NULL keys are salted, and the
    results are those of a plain join."""
    n = 3000
    rows = [(i, "10.1/hot" if i % 3 == 0 else (None if i % 3 == 1 else f"10.1/k{i}"), None, None)
            for i in range(n)]
    papers = spark.createDataFrame(rows, "rec_id long, doi string, semantic_scholar_id string, pdf_source string")
    meta = spark.createDataFrame([("10.1/hot", "H", "a", "t", True, "http://h", 1, 1)] +
                                 [(f"10.1/k{i}", f"K{i}", "a", "t", False, "", 2, 0) for i in range(2, n, 3)],
                                 "doi string, semantic_scholar_id string, abstract string, tldr string, "
                                 "is_open_access boolean, pdf_url string, citations int, influential_citations int")
    wide = enrich.enrich_wide(papers, meta)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    got = {r.rec_id: (r.meta_found, r.pdf_source) for r in wide.collect()}
    assert len(got) == n
    assert all(got[i] == (True, "http://h") for i in range(0, n, 3))
    assert all(got[i] == (False, None) for i in range(1, n, 3))
    assert all(got[i] == (True, None) for i in range(2, n, 3))


def test_cut_lookups_give_same_results(spark):
    from sieve.plans.review import ReviewInputs
    from sieve.operators.screening import candidates, split_venue
    from sieve.session import materialize

    inp = ReviewInputs(spark, "/root/testdata/sf0.001")
    papers = materialize(split_venue(candidates(inp.bib, inp.study(2)))[0], "test-papers")
    for fn, args in [(enrich.resolve_ids, (inp.view("title_index"),)), (enrich.enrich_wide, (inp.view("meta"),)),
                     (enrich.match_known, (papers.where("rec_id % 2 = 0"),))]:
        plain = {tuple(r) for r in fn(papers, *args).collect()}
        cut = {tuple(r) for r in fn(papers, *args, cut=True).collect()}
        assert plain == cut and plain
    contents = enrich.enrich_wide(papers, inp.view("meta")).where("meta_found") \
        .select("rec_id", "publisher_source", "tldr", "abstract")
    contents = materialize(contents, "test-contents")
    a = {tuple(r) for r in enrich.abstract_fallback(contents, inp.view("landing")).collect()}
    b = {tuple(r) for r in enrich.abstract_fallback(contents, inp.view("landing"), cut=True).collect()}
    assert a == b and a


def _py_response_ok(text):
    """Plain check: a JSON object whose only key is 'ratings', a list of strings."""
    import json as _json

    try:
        obj = _json.loads(text)
    except (ValueError, TypeError):
        return False
    return (isinstance(obj, dict) and set(obj) == {"ratings"} and isinstance(obj["ratings"], list)
            and all(isinstance(x, str) for x in obj["ratings"]))


def test_property_response_shape(spark):
    import json as _json

    from hypothesis import given, settings
    from hypothesis import strategies as st

    strings = st.text(alphabet=st.sampled_from(list('ab1"\\é \n/')), max_size=4)
    items = st.one_of(strings, st.integers(-3, 9), st.none(), st.lists(strings, max_size=2))
    objs = st.one_of(
        st.fixed_dictionaries({"ratings": st.lists(items, max_size=4)}),
        st.fixed_dictionaries({"ratings": st.lists(strings, max_size=3), "x": st.integers()}),
        st.lists(strings, max_size=2),
        st.dictionaries(st.sampled_from(["ratings", "rating", "r"]), st.lists(strings, max_size=2), max_size=2),
    )
    texts = st.one_of(objs.map(_json.dumps), objs.map(lambda o: _json.dumps(o, indent=1)),
                      objs.map(lambda o: _json.dumps(o)[:-1]), strings)

    @settings(max_examples=30, deadline=None)
    @given(st.lists(texts, min_size=1, max_size=30))
    def check(cases):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, r string")
        got = {r.i: r.v for r in df.select("i", assess.response_valid("r").alias("v")).collect()}
        for i, c in enumerate(cases):
            assert got[i] is _py_response_ok(c), c

    check()

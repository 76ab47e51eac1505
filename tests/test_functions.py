"""Scalar Column functions: venue filters, ranks, gate, DOI, text cleanup,
entities, HTML extraction, formats."""

from pyspark.sql import functions as F

from sieve.functions import formats, text, venue
from sieve.operators import abstracts
from sieve.operators.screening import split_venue


def one(spark, value, build, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(build(F.col(schema.split()[0]))).first()[0]


def test_venue_type_prefix(spark):
    df = spark.createDataFrame([("conference/x/y",), ("journals/a/b",), ("phd/c/d",)], "key string")
    got = [r[0] for r in df.select(venue.venue_type_filter("key", ["conf"])).collect()]
    assert got == [True, False, False]
    assert [r[0] for r in df.select(venue.venue_type_filter("key", [])).collect()] == [False] * 3
    assert [r[0] for r in df.select(venue.venue_type_filter("key", None)).collect()] == [True] * 3


def test_year_range_inclusive(spark):
    df = spark.createDataFrame([(2018,), (2019,), (2024,), (2025,)], "y int")
    assert [r[0] for r in df.select(venue.year_filter("y", 2019, 2024)).collect()] == [False, True, True, False]


def test_key_split_rejects(spark):
    df = spark.createDataFrame([(1, 1, "a/b", "t", 2000, None), (2, 2, "a/b/c", "t", 2000, None),
                                (3, 3, "a/b/c/d", "t", 2000, None)],
                               "rec_id long, ord long, key string, title string, year int, ee string")
    papers, rejects = split_venue(df)
    assert [r.rec_id for r in papers.collect()] == [2]
    assert sorted(r.rec_id for r in rejects.collect()) == [1, 3]
    p = papers.first()
    assert (p.venue_type, p.venue_code, p.venue_key) == ("a", "b", "c")


def test_doi_extraction(spark):
    df = spark.createDataFrame([("https://doi.org/10.1234/AbC.5?x",), ("10.12/x",), (None,)], "u string")
    assert [r[0] for r in df.select(text.extract_doi("u")).collect()] == ["10.1234/AbC.5?x".split("?")[0], None, None]


def test_parse_rank(spark):
    df = spark.createDataFrame([("A*",), ("a",), ("Australasian B",), ("missing",), (None,)], "r string")
    assert [r[0] for r in df.select(venue.parse_rank("r")).collect()] == ["A_STAR", "A", "MISSING", "MISSING", "MISSING"]


def test_gate(spark):
    df = spark.createDataFrame([("conf/x/1", "MISSING", "C"), ("conf/x/2", "A", "A*"), ("conf/x/3", "A_STAR", "A*"),
                                ("conf/kbse/4", "C", "A"), ("conf/x/5", "C", None)],
                               "key string, rank string, th string")
    got = [r[0] for r in df.select(venue.venue_gate("key", "rank", "th", ["conf/kbse"])).collect()]
    assert got == [True, False, True, True, True]
    strict = [r[0] for r in df.select(venue.venue_gate("key", "rank", "th", [], missing_passes=False)).collect()]
    assert strict == [False, False, True, False, True]


def test_clean_text_and_words(spark):
    assert one(spark, "  a\nb 　", text.clean_text) == "ab"
    assert one(spark, None, text.clean_text) == ""
    assert one(spark, " a  b\tc ", lambda c: F.size(text.py_words(c))) == 3


def test_long_paragraphs(spark):
    t = "one two three\n\nfour five\n\n\nsix seven eight nine"
    assert one(spark, t, lambda c: text.long_paragraphs(c, 2)) == ["one two three", "six seven eight nine"]


def test_entities_and_markup(spark):
    assert one(spark, "M&uuml;ller &#233;t&#xE9; <i>x</i><!-- c -->y &amp; z", text.markup_text) == "Müller été xy & z"
    assert one(spark, "<![CDATA[a<b]]>c", text.markup_text) == "a<bc"
    assert one(spark, "&unknown; &lt;", text.decode_entities) == "&unknown; <"


def test_meta_description(spark):
    html = '<head><meta content="A &amp; B" property="og:description"></head>'
    assert one(spark, html, abstracts.meta_description) == "A & B"
    assert one(spark, "<p>none</p>", abstracts.meta_description) is None


def test_fallback_abstract(spark):
    words = " ".join(f"w{i}" for i in range(250))
    html = (f"<html><script>var a='</p>';</script><style>p{{}}</style><ul><li>{words}</li></ul>"
            f"<p>intro {words} Abstract: the point {words}</p></html>")
    got = one(spark, html, abstracts.fallback_abstract)
    assert got.startswith("Abstract: the point")
    assert "var a" not in got
    short = one(spark, "<p>too short</p>", abstracts.fallback_abstract)
    assert short == ""


def test_text_by_id_nested_and_missing(spark):
    rows = [('<div id="abs">A <div>nested</div> end</div><div>after</div>', "abs", "A nested end"), ("<p>x</p>", "abs", ""),
            ('<p id="abstract">\n x &amp; y \n</p>', "abstract", "x & y"), (None, "abs", ""), ("<p id=abs>open", "abs", "open"),
            ("<i data-id='abs'>no</i><b class='a>b' ID = 'abs'>yes</b><b id=abs>later</b>", "abs", "yes"), ('<br id="abs">after', "abs", "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, html string, element_id string, want string")
    out = abstracts.text_by_id(df)
    assert out.columns == ["k", "element_id", "want", "text"]
    assert all(r.text == r.want for r in out.collect())
    assert abstracts.text_by_id(df, keep_html=True).columns == ["k", "html", "element_id", "want", "text"]


def test_routes(spark):
    df = spark.createDataFrame([("https://www.sciencedirect.com/x",), ("https://ieeexplore.ieee.org/d",),
                                ("https://arxiv.org/abs/1",), ("https://dl.acm.org/doi/1",),
                                ("https://www.emerald.com/x",), ("https://link.springer.com/x",), ("https://x.org",)],
                               "u string")
    r = abstracts.abstract_route("u")
    got = [(x[0], x[1]) for x in df.select(r["route"], r["element_id"]).collect()]
    assert got == [("id", "abstracts"), ("meta", None), ("id", "abs"), ("id", "abstract"), ("id", "abstract"),
                   ("id", "Abs1-content"), ("fallback", None)]


def test_extract_abstracts_single_pass(spark):
    df = spark.createDataFrame([(1, "https://arxiv.org/abs/1", '<div id="abs">Hello</div>'),
                                (2, "https://ieeexplore.ieee.org/1", '<meta property="og:description" content="S">')],
                               "pid int, url string, html string")
    got = {r.pid: r.abstract for r in abstracts.extract_abstracts(df, ["pid"]).collect()}
    assert got == {1: "Hello", 2: "S"}


def test_formats(spark):
    df = spark.createDataFrame([(None, "t")], "tldr string, abstract string")
    assert df.select(formats.section_text(("abstract", "tldr", "title"))).first()[0] == "tldr:\nNone\n\nabstract:\nt\n"
    df2 = spark.createDataFrame([("T", "", "pub"), ("T", None, None)], "title string, pdf_source string, publisher_source string")
    assert [r[0] for r in df2.select(formats.pdf_link_line()).collect()] == [
        "Paper Title: T | Link: pub", "Paper Title: T | Link: None"]
    df3 = spark.createDataFrame([(["a", "b"],)], "c array<string>")
    assert df3.select(formats.numbered("c")).first()[0] == "1. a\n2. b"
    df4 = spark.range(0, 9).select(formats.likert_label(F.col("id")))
    assert [r[0] for r in df4.collect()][1:8] == ["strongly_disagree", "disagree", "somewhat_disagree",
                                                  "neither_agree_or_disagree", "somewhat_agree", "agree",
                                                  "strongly_agree"]

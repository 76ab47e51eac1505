"""Keyword-query semantics: edge rows, quirks, and a property check of both
Column forms against a plain-Python evaluation."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieve.functions import cnf


def py_cnf(text: str, query: str) -> bool:
    """Plain evaluation of the matching rules (see sieve.functions.cnf)."""
    low = text.lower()
    groups = [g.strip() for g in re.findall(r"\(([^)]+)\)", query)]
    for g in groups:
        if not any(p.strip().lower() in low for p in re.split("or", g, flags=re.I)):
            return False
    rest = query
    for g in groups:
        rest = rest.replace(f"({g})", "")
    return all(p.strip().lower() in low for p in re.split("and", rest, flags=re.I))


def evaluate(spark, rows, col_builder):
    df = spark.createDataFrame(rows, "id int, text string, q string")
    return {r.id: r.m for r in df.select("id", col_builder().alias("m")).collect()}


# --- the reference's own test shapes (parenthesised text, or/and/cnf truths) ---
@pytest.mark.parametrize("expr,first", [("(container)", "container"), ("( energy aware )", "energy aware"),
                                        ("x (a b c) y", "a b c")])
def test_text_inside_parens_single(spark, expr, first):
    df = spark.createDataFrame([(expr,)], "e string")
    assert df.select(cnf.text_inside_parens("e")[0]).first()[0] == first


def test_text_inside_parens_multiple(spark):
    df = spark.createDataFrame([("(a) AND (b) AND (c)",)], "e string")
    assert df.select(cnf.text_inside_parens("e")).first()[0] == ["a", "b", "c"]


def test_or_and_cnf_truths(spark):
    rows = [(1, "Energy aware container scheduling", "cloud or container"),
            (2, "Energy aware container scheduling", "energy and container"),
            (3, "Energy aware container scheduling", "(energy OR power) AND (container OR vm)")]
    df = spark.createDataFrame(rows, "id int, text string, q string")
    out = df.select(cnf.or_match_expr("text", "q").alias("o"), cnf.and_match_expr("text", "q").alias("a"),
                    cnf.cnf_match_expr("text", "q").alias("c")).collect()
    assert out[0].o and out[1].a and out[2].c


# --- edge rows (FIXTURES §5) and quirks ----------------------------------------------
def test_mid_word_or_split_matches_everything(spark):
    df = spark.createDataFrame([("red bolt",)], "t string")
    sub = df.select(cnf.keyword_groups_match("t", [["orchestrat", "zzz"]])).first()[0]
    tok = df.select(cnf.keyword_groups_match("t", [["orchestrat", "zzz"]], split="token")).first()[0]
    assert sub is True and tok is False


def test_empty_groups(spark):
    df = spark.createDataFrame([("x",)], "t string")
    assert df.select(cnf.keyword_groups_match("t", [])).first()[0] is True
    assert df.select(cnf.keyword_groups_match("t", [[]])).first()[0] is False
    assert df.select(cnf.keyword_groups_match("t", [[]], split="token")).first()[0] is False


def test_blank_inside_parens_stays_literal(spark):
    df = spark.createDataFrame([("ab",)], "t string")
    assert df.select(cnf.cnf_column("t", "( a ) AND (b)")).first()[0] is False
    assert py_cnf("ab", "( a ) AND (b)") is False
    assert df.select(cnf.cnf_column("t", "(a) AND (b)")).first()[0] is True


def test_compile_folds_constant_pieces():
    c = cnf.compile_groups([["orchestrat", "task"], ["workload"], ["edge", "cloud"]])
    # 'orchestrat' gives an empty piece, so its group is always true;
    # 'workload' splits into 'w' and 'kload'
    assert c.any_of == (("kload", "w"), ("cloud", "edge"))
    assert c.all_of == ()


def test_query_from_groups_dedups():
    assert cnf.query_from_groups([["b", "a", "b"], ["c"]]) == "(a OR b) AND (c)"
    assert cnf.query_from_groups(None) == ""


def test_constant_form_stays_in_codegen(spark):
    df = spark.range(10).select(F.concat(F.lit("ring "), F.col("id").cast("string")).alias("title"))
    plan = df.where(cnf.cnf_column("title", "(ring OR bolt) AND (1 or 2)"))._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan


# --- property: both Column forms equal the plain evaluation ------------------------------
WORDS = ["or", "and", "OR", "AND", "ring", "bolt", "order", "sand", "a", "b", " ", "(", ")", "x y", "Or"]
texts = st.lists(st.sampled_from(["ring", "bolt", "order", "sand", "andor", "x", "y", "Ring", "b"]), max_size=5) \
    .map(" ".join)
queries = st.lists(st.sampled_from(WORDS), max_size=8).map(" ".join)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(texts, queries), min_size=1, max_size=25))
def test_property_cnf_forms(spark, cases):
    rows = [(i, t, q) for i, (t, q) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, text string, q string")
    consts = [cnf.cnf_column("text", q).alias(f"c{i}") for i, _, q in rows]
    out = {r.id: r for r in df.select("id", cnf.cnf_match_expr("text", "q").alias("m"), *consts).collect()}
    for i, t, q in rows:
        expected = py_cnf(t, q)
        assert out[i].m is expected, (t, q)
        assert out[i][f"c{i}"] is expected, (t, q)

"""Raking and calibrated sampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sieve.llm import mixing


def plain_rake(cells, targets, rounds=500):
    """{cell: weight} of {cell: tokens} for target shares by dimension."""
    w = {c: t / sum(cells.values()) for c, t in cells.items()}
    for _ in range(rounds):
        for d, target in enumerate(targets):
            sums = {}
            for c, x in w.items():
                sums[c[d]] = sums.get(c[d], 0) + x
            w = {c: x * target[c[d]] / sums[c[d]] for c, x in w.items()}
    return w


@pytest.fixture()
def docs(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 40))), ["a", "a", "a", "b", None][k % 5], ["en", "fr", "en"][k % 3]) for k in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def dims():
    return {"source": F.col("source"), "lang": F.col("lang")}


@pytest.mark.parametrize("max_cells", [1000, 0])
@pytest.mark.parametrize("targets", [None, {"source": {"a": 0.2, "b": 0.5, "gone": 0.2}, "lang": {"en": 0.5, "fr": 0.5}}])
def test_weights_match_plain_raking(docs, targets, max_cells):
    if targets and not max_cells:
        targets = {"source": targets["source"]}
    out = mixing.mix(docs, dims(), targets=targets, max_cells=max_cells, full_ratio=1.5).collect()
    cells, margin = {}, [{}, {}]
    for r in out:
        n, cell = len(r["text"].split()), (r["source"], r["lang"])
        cells[cell] = cells.get(cell, 0) + n
        for d in (0, 1):
            margin[d][cell[d]] = margin[d].get(cell[d], 0) + n
    want = [mixing.shares(margin[d], (targets or {}).get(name), 0.7) for d, name in enumerate(("source", "lang"))]
    assert all(abs(sum(s.values()) - 1) < 1e-9 for s in want)
    raked, total = plain_rake(cells, want), sum(cells.values())
    ratio = {c: raked[c] / (cells[c] / total) for c in cells}
    for r in out:
        cell = (r["source"], r["lang"])
        assert r["weight"] == pytest.approx(ratio[cell], rel=1e-6)
        assert r["probability"] == pytest.approx(min(1, ratio[cell] / min(1.5, max(ratio.values()))), rel=1e-6)


@pytest.mark.parametrize("given", [{None: 0.5, "a": 0.3}, {}])
def test_given_shares_of_null_by_either_way(docs, given):
    rows = [mixing.mix(docs, dims(), targets={"source": given}, max_cells=n).collect() for n in (1000, 0)]
    one, two = ({r["doc_id"]: r["weight"] for r in some} for some in rows)
    assert two == pytest.approx(one, rel=1e-6)
    if given:
        total = sum(len(r["text"].split()) * r["weight"] for r in rows[1])
        assert sum(len(r["text"].split()) * r["weight"] for r in rows[1] if r["source"] is None) == pytest.approx(0.5 * total)


def test_given_shares():
    assert mixing.shares({"a": 60, "b": 20, "c": 20}, {"a": 0.5, "x": 0.3}, 1) == pytest.approx({"a": 0.5, "b": 0.25, "c": 0.25})
    assert mixing.shares({"a": 1, "b": 0}, None, 0.5) == {"a": 1.0}
    assert mixing.shares({}, None, 0.5) == {}


def test_sample_follows_its_chances(docs):
    out = mixing.mix(docs, dims(), targets={"source": {"a": 0.2, "b": 0.4}}).collect()
    assert out == mixing.mix(docs, dims(), targets={"source": {"a": 0.2, "b": 0.4}}).collect()
    expected = sum(r["probability"] for r in out)
    assert abs(sum(r["sampled"] for r in out) - expected) < 4 * expected ** 0.5
    other = mixing.mix(docs, dims(), seed=18).collect()
    assert {r["doc_id"] for r in other if r["sampled"]} != {r["doc_id"] for r in out if r["sampled"]}


def expected_shares(rows, name, times):
    """Token shares by value of a dimension, each row taken ``times(row)`` times."""
    got = {}
    for r in rows:
        got[r[name]] = got.get(r[name], 0) + len(r["text"].split()) * times(r)
    return {v: x / sum(got.values()) for v, x in got.items()}


@pytest.fixture()
def skewed(spark):
    """A source with a thousandth of the tokens."""
    rows = [(k, "w " * 20, "rare" if k % 1000 == 0 else "ab"[k % 2], ["en", "fr", "en"][k % 3]) for k in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


SKEWED = {"source": {"rare": 0.1, "a": 0.45, "b": 0.45}, "lang": {"en": 0.4, "fr": 0.6}}


@pytest.mark.parametrize("targets", [None, SKEWED])
def test_expected_sample_meets_the_marginals(skewed, targets):
    rows = mixing.mix(skewed, dims(), targets=targets).collect()
    for d in ("source", "lang"):
        base = {}
        for r in rows:
            base[r[d]] = base.get(r[d], 0) + len(r["text"].split())
        want = mixing.shares(base, (targets or {}).get(d), 0.7)
        assert expected_shares(rows, d, lambda r: r["probability"]) == pytest.approx(want, rel=1e-6)
    assert all(r["probability"] <= 1 for r in rows) and max(r["probability"] for r in rows) == pytest.approx(1)


def test_copies_meet_the_marginals(skewed):
    """A larger sample, by repeating documents of cells beyond the ratio."""
    out = ("weight", "probability", "sampled", "copies")
    rows = mixing.mix(skewed, dims(), targets=SKEWED, out=out, full_ratio=3).collect()
    assert max(r["weight"] for r in rows) > 30
    for r in rows:
        times = r["weight"] / 3
        assert int(times) <= r["copies"] <= int(times) + 1 and r["sampled"] == (r["copies"] > 0)
        assert r["probability"] == pytest.approx(min(1, times))
    expected = sum(r["weight"] / 3 for r in rows)
    assert abs(sum(r["copies"] for r in rows) - expected) < 4 * expected ** 0.5
    for d in ("source", "lang"):
        assert expected_shares(rows, d, lambda r: r["copies"]) == pytest.approx(SKEWED[d], abs=0.05)
    once = mixing.mix(skewed, dims(), targets=SKEWED, out=out).collect()
    assert all(r["copies"] == r["sampled"] for r in once if r["probability"] < 1 - 1e-9)


def plain_bounds(base, want, total):
    """{value: expected tokens} for target shares, none over its tokens, by bisection."""
    low, high = 0.0, 1e18
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(base[v], mid * x) for v, x in want.items()) < total else (low, mid)
    return {v: min(base[v], high * x) for v, x in want.items()}


def check_calibrated(rows, names, share, targets=None, rel=1e-6, tokens=lambda r: len(r["text"].split())):
    """Expected tokens by value equal the attainable targets, and share in all."""
    total = sum(map(tokens, rows))
    assert sum(tokens(r) * r["probability"] for r in rows) == pytest.approx(share * total, rel=rel)
    for d in names:
        got, base = {}, {}
        for r in rows:
            got[r[d]] = got.get(r[d], 0) + tokens(r) * r["probability"]
            base[r[d]] = base.get(r[d], 0) + tokens(r)
        want = mixing.shares(base, (targets or {}).get(d), 0.7)
        assert got == pytest.approx(plain_bounds(base, want, share * total), rel=rel)


@pytest.mark.parametrize("max_cells", [1000, 0])
@pytest.mark.parametrize("share, targets", [(0.5, None), (0.9, None), (0.3, {"source": {"a": 0.2, "b": 0.7}, "lang": {"en": 0.6, "fr": 0.4}})])
def test_calibrated_chances_meet_attainable_marginals(docs, max_cells, share, targets):
    rows = mixing.mix(docs, dims(), targets=targets, share=share, max_cells=max_cells, gap_col="gap").collect()
    check_calibrated(rows, ("source", "lang"), share, targets)
    assert rows[0]["gap"] < 1e-6 and all(0 <= r["probability"] <= 1 for r in rows)
    report = mixing.marginals(mixing.mix(docs, dims(), targets=targets, share=share), dims(), mixing.tokens_column(F.col("text")), targets).collect()
    assert sum(r["expected"] for r in report) == pytest.approx(2) and sum(r["target"] for r in report) == pytest.approx(2)
    assert all(r["taken"] == pytest.approx(1) for r in report if r["expected"] < r["target"] * 0.999)


def test_sample_grows_with_the_table_and_not_with_rare_cells(spark, docs):
    """One rare document hardly changes the sample; ten times the table gives ten times of it."""

    def sampled(table):
        return mixing.mix(table, dims(), share=0.5).where("sampled").count()

    rare = spark.createDataFrame([(10 ** 6, "five words in this one", "rare", "xx")], docs.schema)
    more = spark.range(10).join(docs).select((F.col("doc_id") + F.col("id") * 1000).alias("doc_id"), "text", "source", "lang")
    one = sampled(docs)
    assert abs(sampled(docs.unionByName(rare)) - one) <= 0.02 * one
    assert 9.3 * one < sampled(more) < 10.7 * one
    row = mixing.mix(docs.unionByName(rare), dims(), share=0.5).where("doc_id = 1000000").head()
    assert row["probability"] == pytest.approx(1)


def test_gap_tells_of_marginals_that_exclude_each_other(spark, monkeypatch):
    """All of source b is in fr: b at 0.6 of the sample and fr at 0.2 can't both hold."""
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    docs = spark.createDataFrame([(k, "w " * 10, "ab"[k % 2], ["en", "fr"][k % 2]) for k in range(100)], "doc_id long, text string, source string, lang string")
    for max_cells in (100, 0):
        row = mixing.mix(docs, dims(), targets={"source": {"a": 0.4, "b": 0.6}, "lang": {"en": 0.8, "fr": 0.2}}, share=0.2, gap_col="gap", max_cells=max_cells).head()
        assert row["gap"] > 0.1


def test_pipeline_and_query_sample_the_targets(spark):
    """The registered query and the pipeline's stage give chances that meet the marginals."""
    import corpus_pipeline
    from sieve.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op9_source_mixing"](spark, sf).collect()
    check_calibrated(rows, ("source", "lang", "topic"), 0.5, rel=1e-5, tokens=lambda r: r["n_tokens"])
    assert rows[0]["gap"] < 1e-6
    by = {r["doc_id"]: r["probability"] for r in rows}
    kept = corpus_pipeline.source_mixing(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    assert kept and all(r["mix_probability"] == pytest.approx(by[r["doc_id"]]) for r in kept)


def test_odd_rows(odd_docs, no_docs):
    out = mixing.mix(odd_docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_column(F.col("text"))}, out=("p", "probability", "sampled"))
    assert out.columns == [c for c in odd_docs.columns if c != "p"] + ["p", "probability", "sampled"]
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["probability"] <= 1 for r in rows)
    assert [r["probability"] for r in rows if r["doc_id"] == 3] == [0]  # the only row of its cell, without tokens
    assert mixing.mix(no_docs, dims()).count() == 0


def test_registered_query(spark):
    from sieve.llm import queries

    rows = queries.QUERIES["op9_source_mixing"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    for d in ("source", "lang", "topic"):
        got, base = {}, {}
        for r in rows:
            got[r[d]] = got.get(r[d], 0) + r["n_tokens"] * r["weight"]
            base[r[d]] = base.get(r[d], 0) + r["n_tokens"]
        want = mixing.shares(base, None, 0.7)
        assert {v: x / sum(got.values()) for v, x in got.items()} == pytest.approx(want, rel=1e-5)

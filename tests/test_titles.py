"""Ranked title search against all pairs."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sieve.operators import titles


def words(title):
    return sorted({w for w in re.split(r"[\W_]+", (title or "").lower()) if w})


def plain_best(queries, index, threshold):
    """{query key: (score, keys)} over all pairs."""
    keys = {" ".join(words(t)) for t in index} - {""}
    df = {}
    for k in keys:
        for w in k.split():
            df[w] = df.get(w, 0) + 1
    weight = lambda ws: sum(math.floor(1000.0 * math.log(1.0 + len(keys) / df.get(w, 1))) for w in ws)
    out = {}
    for q in {" ".join(words(t)) for t in queries} - {""}:
        scored = {}
        for k in keys:
            a, b = set(q.split()), set(k.split())
            both, every = weight(a & b), weight(a | b)
            if both * titles.FULL >= every * round(threshold * titles.FULL):
                scored[k] = both * titles.FULL // every
        if scored:
            out[q] = max(scored.values()), sorted(k for k, s in scored.items() if s == max(scored.values()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    common, rare = ["a", "study", "of", "the", "systems"], [f"r{k}" for k in range(120)]
    make = lambda: " ".join(rng.sample(common, rng.randrange(0, 5)) + [rng.choice(rare) for _ in range(rng.randrange(0, 7))])
    index = [make() for _ in range(250)] + ["the study", "A Study", ""]
    queries = [make() for _ in range(40)] + index[:60] + [t + " r1 x y" for t in index[60:120]] + ["of the", "unseen words only", None]
    return queries, index


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_best_titles_equal_all_pairs(spark, threshold):
    queries, index = corpus(int(threshold * 10))
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "t string").select(titles.title_key("t").alias("key")).where("key is not null").distinct()
    got = {}
    for r in titles.best_titles(frame(queries), frame(index), threshold).collect():
        got.setdefault(r["query"], (r["score"], []))[1].append(r["key"])
    assert {q: (s, sorted(k)) for q, (s, k) in got.items()} == plain_best(queries, index, threshold)


def test_one_hit_per_paper_with_defined_ties(spark):
    index = spark.createDataFrame([("Deep Ring Nets", "s9", "10.1/a", 5), ("nets, deep: ring", "s1", "10.1/b", 3), ("Deep ring nets", "s0", None, 3),
                                   ("Other work", "s3", "10.1/c", 1), (None, "s4", "10.1/d", 0)],
                                  "title string, semantic_scholar_id string, doi string, hit_rank int")
    papers = spark.createDataFrame([(1, "deep ring nets!", None, None), (2, "Deep Ring Nets", "10.9/own", "own"), (3, "nothing alike", None, "kept"),
                                    (4, None, None, None), (5, "?!", None, None), (6, "Other WORK", None, None), (6, "Other WORK", None, None)],
                                   "rec_id int, title string, doi string, semantic_scholar_id string")
    out = titles.resolve_ids_ranked(papers, index)
    assert out.columns == ["rec_id", "title", "doi", "semantic_scholar_id", "title_score"]
    got = sorted((tuple(r) for r in out.drop("title").collect()), key=repr)
    assert got == [(1, None, "s0", 1_000_000), (2, "10.9/own", "own", None), (3, None, "kept", None), (4, None, None, None),
                   (5, None, None, None), (6, "10.1/c", "s3", 1_000_000), (6, "10.1/c", "s3", 1_000_000)]
    empty = titles.resolve_ids_ranked(papers, index.where("false"))
    assert sorted(r["rec_id"] for r in empty.collect()) == [1, 2, 3, 4, 5, 6, 6]
    with pytest.raises(ValueError):
        titles.best_titles(papers, papers, 0)


def test_frequent_words_are_in_no_prefix(spark):
    """A word that most titles have isn't probed by titles with rarer ones."""
    keys = spark.range(400).select(titles.title_key(F.concat(F.lit("the workload of r"), "id", F.lit(" s"), F.col("id") % 50)).alias("key"))
    weights = keys.select(F.explode(F.split("key", " ")).alias("word")).groupBy("word").count() \
        .select("word", F.floor(1000 * F.log(1 + 400 / F.col("count"))).cast("long").alias("w"))
    prefix = titles._prefix(titles._weighed(keys, weights, 6000), 500_000, "t")
    assert {r["word"][0] for r in prefix.select("word").distinct().collect()} <= {"r", "s"}
    assert prefix.count() <= 2 * 400


def test_no_cross_join(spark):
    queries, index = corpus(1)
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "t string").select(titles.title_key("t").alias("key")).distinct()
    plan = titles.best_titles(frame(queries), frame(index))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_review_run_takes_the_best_hit(spark):
    """Papers without DOI get the identifiers of a title that only resembles theirs."""
    from sieve.plans.review import ReviewInputs, ReviewRun

    inp = ReviewInputs(spark, "/root/testdata/sf0.001")
    changed = inp.view("title_index").withColumn("title", F.concat(F.lit("Revisited: "), F.col("title")))
    runs = [ReviewRun(inp.bib, inp.studies.where("study_id = 2"), inp.rank_table, title_index=changed, title_threshold=t) for t in (None, 0.5)]
    exact, ranked = ({r["rec_id"]: r["semantic_scholar_id"] for r in run.papers.collect()} for run in runs)
    assert set(exact) == set(ranked) and not any(exact.values())
    assert sum(v is not None for v in ranked.values()) > 0

"""Keyword screening by an inverted index, and allow-lists as a table."""

import random

import pytest
from pyspark.sql import functions as F

from sieve.functions.venue import venue_gate
from sieve.operators import index, joins, multi
from sieve.plans.catalog import part_studies
from sieve.plans.review import ReviewInputs

SF = "/root/testdata/sf0.001"
STUDY = ("study_id bigint, year_min bigint, year_max bigint, search_word_groups array<array<string>>, "
         "accepted_venue_types array<string>, venue_rank_threshold string, manually_accepted_venue_codes array<string>")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def made_studies(n, seed=3):
    rng = random.Random(seed)
    words = ["ring", "gizmo", "RED", "small", "work", "anvil", "g", "load medium", "orchid", "for", "", "sand", " blue ", "hot gear", "é", "İ"]
    rows = []
    for k in range(n):
        groups = [[rng.choice(words) for _ in range(rng.randrange(0 if k % 50 == 0 else 1, 4))] for _ in range(rng.randrange(0, 4))]
        lo = rng.randrange(1994, 1999)
        rows.append((k, lo, lo + rng.randrange(-1, 3), None if k % 41 == 0 else groups, rng.choice([None, ["conf"], ["phd", "journals"], []]),
                     rng.choice([None, "A*", "B"]), rng.choice([None, [], ["conf/v3", "conf/v3", "conf/v37/K1"]])))
    return rows


def small_records(spark):
    rows = [(10 ** 6 + k, k, f"conf/v{k % 9}/K{k}", t, 1994 + k % 6, "ee") for k, t in enumerate(
        ["Red ring for small work", "", None, "g", "İstanbul é gizmo", "hot gear () sand", "ANVIL load medium", "or", "blue"] * 4)]
    return spark.createDataFrame([*rows, (10 ** 7, 900, None, "ring", 1995, None), (10 ** 7 + 1, 901, "phd/a/b", "gizmo anvil", None, "x")],
                                 "rec_id bigint, ord bigint, key string, title string, year int, ee string")


@pytest.mark.parametrize("limit", [None, 0])
def test_index_equals_every_study_asked(spark, limit):
    """Also beyond the broadcast limit."""
    records = ReviewInputs(spark, SF).bib.unionByName(small_records(spark))
    studies = spark.createDataFrame(made_studies(300), STUDY)
    pairs = lambda df: sorted((r.study_id, r.rec_id) for r in df.collect())
    want = pairs(multi.multi_candidates(records, studies))
    if limit is not None:
        spark.conf.set(joins._CONF_KEY, str(limit))
    try:
        got = index.indexed_candidates(records, studies)
        assert set(got.columns) == set(multi.multi_candidates(records, studies).columns)
        assert pairs(got) == want and len(want) > 1000
    finally:
        spark.conf.unset(joins._CONF_KEY)


def test_batch_limit(spark):
    records, studies = ReviewInputs(spark, SF).bib, spark.createDataFrame(made_studies(60), STUDY)
    pairs = lambda df: {(r.study_id, r.rec_id) for r in df.collect()}
    assert pairs(index.indexed_candidates(records, studies, 3)) == pairs(multi.multi_candidates(records, studies, 3))


def test_ten_thousand_studies_verify_few_pairs(spark):
    """Pairs that meet a whole query are those that match, not all of a record's years."""
    rng = random.Random(1)
    records = ReviewInputs(spark, SF).bib
    names = [f"topic{k}" for k in range(3000)]
    rows = [(k, 1990, 2005, [[rng.choice(names), rng.choice(names)], ["ring", "gear"]] if k % 100 else [["ring"], ["red", "hot"], [rng.choice(names), "work"]],
             None, None, None) for k in range(10_000)]
    studies = spark.createDataFrame(rows, STUDY).repartition(4)
    needed = multi.study_queries(studies)
    verified = index.matching_pairs(records, needed).count()
    got = index.indexed_candidates(records, studies).select("study_id", "rec_id")
    few = studies.where("study_id % 100 = 0")
    want = multi.multi_candidates(records, few).select("study_id", "rec_id")
    assert sorted(got.collect()) == sorted(want.collect())
    assert verified == want.count() > 0  # of 10,000 x all records
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_pieces_are_filed_under_rare_grams(spark):
    needed = spark.createDataFrame([(1, 10, ["network", "net"]), (2, 20, ["networks"]), (3, 30, ["g"])], "study_id int, conjunct long, pieces array<string>")
    rows = {r.piece: (r.gram, sorted(r.conjuncts)) for r in index.piece_index(needed).collect()}
    assert rows["net"] == ("net", [10]) and rows["g"] == ("g", [30])
    assert rows["networks"] == ("orks", [20])


def test_least_prefixes(spark):
    rows = [(1, "conf/v3"), (1, "conf/v37"), (1, "conf/v3"), (2, "conf/v37"), (2, ""), (3, None), (None, "x"), (4, "a"), (4, "b")]
    out = index.least_prefixes(spark.createDataFrame(rows, "study_id int, prefix string"))
    assert sorted(map(tuple, out.collect())) == [(1, "conf/v3"), (2, ""), (4, "a"), (4, "b")]


@pytest.mark.parametrize("missing", [True, False])
def test_gate_by_table_equals_lists(spark, missing):
    rng = random.Random(5)
    keys = [None, "", "conf", *[f"{rng.choice(['conf', 'journals'])}/v{rng.randrange(60)}/K{k}" for k in range(300)]]
    lists = {s: [rng.choice([f"conf/v{rng.randrange(60)}", f"journals/v{rng.randrange(9)}", f"conf/v1/K{rng.randrange(300)}"]) for _ in range(n)]
             for s, n in enumerate([0, 1, 5, 40, 0])}
    lists[4] = [""]
    rows = [(s, k, rng.choice(["MISSING", "A", "C", None]), rng.choice([None, "A*", "B"]), lists[s]) for s in lists for k in keys]
    ranked = spark.createDataFrame(rows, "study_id int, key string, venue_rank string, _th string, _allow array<string>")
    allow = ranked.select("study_id", F.explode("_allow").alias("prefix"))
    want = ranked.where(F.coalesce(venue_gate("key", "venue_rank", "_th", "_allow", missing), F.lit(False)))
    assert sorted(map(repr, index.gate_by_table(ranked, allow, missing).collect())) == sorted(map(repr, want.collect()))
    assert index.gate_by_table(ranked, allow.limit(0), False).where("venue_rank = 'MISSING' AND _th IS NOT NULL").count() == 0


def test_hundred_thousand_prefixes_are_joined(spark):
    inp = ReviewInputs(spark, SF)
    allow = spark.range(100_000).select((F.col("id") % 4 + 1).alias("study_id"), F.concat(F.lit("conf/x"), F.col("id").cast("string"), F.lit("/")).alias("prefix"))
    own = index.allow_rows(inp.studies)
    got = index.screen_indexed(inp.bib, inp.studies, inp.rank_table, allow=own.unionByName(allow))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, multi.screen_many(inp.bib, inp.studies, inp.rank_table).collect()))
    assert "exists(" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_part_studies(spark):
    inp = ReviewInputs(spark, SF)
    studies = part_studies(inp)
    allow = inp.view("part_allow").groupBy("study_id").agg(F.collect_list("prefix").alias("manually_accepted_venue_codes"))
    listed = studies.drop("manually_accepted_venue_codes").join(allow, "study_id")
    want = multi.screen_many(inp.bib, listed, inp.rank_table).select("study_id", "rec_id", "venue_rank")
    got = index.screen_indexed(inp.bib, studies, inp.rank_table, allow=inp.view("part_allow")).select("study_id", "rec_id", "venue_rank")
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 0

"""Shared helpers: joins that spread hot keys and rows without ids, and workers."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from sieve.llm import common

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("max_rows, hot_rows", [(100, 10), (0, 10), (0, 7), (0, 10_000)])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_gives_the_same_rows_by_any_way(spark, max_rows, hot_rows, how):
    left = spark.createDataFrame([(k, "hot" if k % 3 == 0 else None if k % 3 == 1 else f"k{k % 20}", k % 2) for k in range(120)], "id int, a string, b int")
    right = spark.createDataFrame([("hot", 0, 1.0), ("hot", 1, 2.0), (None, 0, 3.0), ("k5", 1, 4.0), ("unused", 1, 5.0)], "a string, b int, v double")
    got = common.lookup(left, right, ["a", "b"], F.xxhash64("id"), how, max_rows, hot_rows)
    assert got.columns == ["id", "a", "b", "v"]
    by = {(r["a"], r["b"]): r["v"] for r in right.collect()}
    want = [(r["id"], r["a"], r["b"], by.get((r["a"], r["b"]))) for r in left.collect()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(w) for w in want if how == "left" or w[3] is not None)


def test_only_hot_keys_are_copied(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 400, F.lit(1)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = common.lookup(left, right, ["k"], F.xxhash64("id"), max_rows=0, hot_rows=100)
    assert joined.count() == 1000 and joined.where("v <> k * 2").count() == 0
    assert "Generate explode" in joined._jdf.queryExecution().optimizedPlan().toString()
    plain = common.lookup(left, right, ["k"], F.xxhash64("id"), max_rows=0, hot_rows=1000)
    assert "Generate" not in plain._jdf.queryExecution().optimizedPlan().toString() and plain.count() == 1000


def test_rows_without_an_id_are_spread(spark):
    docs = spark.createDataFrame([(None if k % 2 else k, f"text {k}", k) for k in range(400)], "doc_id int, text string, part int")
    info = spark.createDataFrame([(None, "n"), (2, "two"), (900, "x")], "_id int, _v string")
    met, names = common.by_id(docs, "doc_id", info, "_id")
    rows = met.collect()
    assert len(rows) == 400 and [c for c in met.columns if c not in names.values()] == docs.columns
    assert {r[names["_v"]] for r in rows if r["doc_id"] is None} == {"n"} and [r["doc_id"] for r in rows if r[names["_v"]] == "two"] == [2]
    keys = met._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64" in keys


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The driver alone has the package on its path; every operator that runs Python in
    tasks ships what it needs."""
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
probe = spark.range(1).rdd.map(lambda _: __import__('importlib.util').util.find_spec('sieve') is None).collect()
assert probe == [True], 'workers can import the package'
sys.path.insert(0, {REPO!r})
from sieve.llm import fim, imatch, minmax, trie, simhash
docs = spark.createDataFrame([(k, f'text {{k % 3}} of some words and more words') for k in range(9)], 'doc_id long, text string')
assert imatch.edited_and_next(docs, imatch.build_lexicon(docs)).count() == 9
assert docs.select(imatch.build_lexicon(docs).column(docs.text)).distinct().count() == 3
assert fim.fill_in_middle(docs).where('output is not null').count() == 9
assert minmax.near_duplicates(docs).select('component').distinct().count() == 3
assert simhash.near_duplicates(docs).count() == 9
turns = spark.createDataFrame([(k, 0, 'user', 'hello') for k in range(4)], 'conv_id long, turn long, role string, text string')
assert trie.prefix_nodes(*trie.whole(trie.numbered(turns))).count() == 2
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]

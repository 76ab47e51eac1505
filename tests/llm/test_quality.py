"""Quality classifier: training, posteriors and decisions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sieve.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    """Trained on three quarters of the labels, right on the rest."""
    docs, labels = tables
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.train(docs, labels.where(~out))
    rows = quality.classify(docs, model).join(labels.where(out), "doc_id").collect()
    junk = [r["keep"] for r in rows if r["quality"] == 0]
    clean = [r["keep"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.15


def test_training_sample_is_bounded(spark, tables):
    docs, labels = tables
    assert quality.train(docs, labels, max_train=50).lexicon == {}
    assert 0 < quality.train(docs, labels, max_train=50).prior < 1


def plain_posterior(rows, prior):
    """The documented formulas over [(id, host, path, p)]."""
    def strength(groups, parent):
        n = sum(map(len, groups.values()))
        within = max(sum(sum(x * x for x in g) - sum(g) ** 2 / len(g) for g in groups.values()) / max(n - len(groups), 1), 1e-9)
        spread = sum(len(g) * (sum(g) / len(g) - parent(k)) ** 2 for k, g in groups.items()) - (len(groups) - 1) * within
        between = spread / max(n - sum(len(g) ** 2 for g in groups.values()) / n, 1)
        return min(max(within / max(between, 1e-9), 1.0), 1e6)

    hosts, paths = {}, {}
    for _, h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    rate = sum(r[3] for r in rows) / len(rows)
    k_host, k_path = strength(hosts, lambda _: rate), strength(paths, lambda k: sum(hosts[k[0]]) / len(hosts[k[0]]))
    inside = lambda x: min(max(x, quality.EDGE), 1 - quality.EDGE)
    logit = lambda x: math.log(x / (1 - x))
    out = {}
    for i, h, q, p in rows:
        of_host = inside((sum(hosts[h]) - p + k_host * rate) / (len(hosts[h]) - 1 + k_host))
        of_path = inside((sum(paths[h, q]) - p + k_path * of_host) / (len(paths[h, q]) - 1 + k_path))
        out[i] = of_host, of_path, 1 / (1 + math.exp(-(logit(of_path) + logit(p) - logit(prior))))
    return out


def test_posterior_matches_the_formulas(spark):
    rng = np.random.default_rng(1)
    rows = [(k, ["a", "b", "c", None][min(3, k % 7 // 2)], ["x", "y", None][k % 3], float(np.clip(rng.beta(8, 2) * (0.5 if k % 7 < 2 else 1), 0.01, 0.99))) for k in range(300)]
    rows.append((300, "lonely", "x", 0.3))
    scored = spark.createDataFrame(rows, "id long, host string, path string, p double")
    out = quality.with_posterior(scored, 0.7, F.xxhash64("id"), "host", "path", "p", {c: c for c in ("host_rate", "path_rate", "posterior")}).collect()
    want = plain_posterior(rows, 0.7)
    assert len(out) == len(rows)
    for r in out:
        assert (r["host_rate"], r["path_rate"], r["posterior"]) == pytest.approx(want[r["id"]], rel=1e-6)
    lonely = want[300]
    assert abs(lonely[0] - sum(r[3] for r in rows) / len(rows)) < 0.02  # a sparse site gets the global rate


def test_sites_of_urls(spark):
    rows = [("https://A.org/x/y?z", "en"), ("http://b.com", "de"), ("src7", "fr"), (None, "en"), ("src7", None)]
    host, path = quality.site_columns(F.col("s"), F.col("l"))
    assert [tuple(r) for r in spark.createDataFrame(rows, "s string, l string").select(host, path).collect()] == \
        [("a.org", "x"), ("b.com", ""), ("src7", "fr"), (None, "en"), ("src7", None)]


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(None, 1, 0), (1, None, 1)], [(1, 0, 0), (2, 0, None)]])
def test_labels_of_one_class(spark, odd_docs, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = quality.train(odd_docs, labels)
    p = {r["evidence"] for r in quality.classify(odd_docs, model).where("doc_id IN (1, 2, 5, 8)").collect()}
    assert len(p) == 1


def test_contradicting_labels_take_the_worst(spark):
    docs = spark.createDataFrame([(k, "good words only" if k % 2 else "BAD!!! SHOUT!!!") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(k, 0, 0) for k in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert model.prior == 0.5
    scored = docs.select("doc_id", model.column(F.col("text")).alias("p")).collect()
    assert all((r["p"] > 0.5) == bool(r["doc_id"] % 2) for r in scored)


def test_odd_rows(spark, tables, odd_docs, no_docs):
    model = quality.train(*tables)
    out = quality.classify(odd_docs, model)
    assert out.columns == ["doc_id", "evidence", "host_rate", "path_rate", "posterior", "keep"] and out.count() == odd_docs.count()
    assert {r["evidence"] for r in out.where("doc_id IN (3, 4, 7)").collect()} == {quality.EDGE}
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns
    by_row = sorted(map(str, (r["doc_id"] for r in out.where("keep").collect())))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == by_row
    assert quality.classify(no_docs, model).count() == quality.keep_good(no_docs, model).count() == 0

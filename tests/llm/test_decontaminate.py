"""Benchmark decontamination."""

import random
import re

import pytest
from sieve.llm import decontaminate


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(docs, bench):
    """[(id, number of words, hit places, items)]."""
    grams = {}
    for item, text in bench:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out.append((i, len(w), len(hit), sorted(str(x) for x in items if x is not None)))
    return sorted(out, key=repr)


def got(rows):
    return sorted(((r[0], r["n_words"], r["n_hit"], r["items"]) for r in rows.collect()), key=repr)


@pytest.fixture(scope="module")
def bench_rows():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Ünd", "x9", "lorem", "ipsum"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([25, 14, 10, 9, 4, 2, 1, 0, 12])]
    return [*rows, (20, rows[1][1].upper()), (None, rows[8][1] + " tail"), (21, None), (22, "-- ; ..")]


@pytest.fixture(scope="module")
def doc_rows(bench_rows):
    rng = random.Random(6)
    texts = [t for _, t in bench_rows if t]
    rows = []
    for k in range(80):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            w = rng.choice(texts).split(" ")
            a = rng.randrange(len(w))
            parts.append(rng.choice(["filler words here", rng.choice([", ", " -- ", "\n"]).join(w[a:a + rng.randrange(1, 15)])]))
        rows.append((k, ". ".join(parts)))
    return [*rows, (1000, None), (1001, ""), (None, texts[0]), (None, "clean words"), (3, rows[3][1]), (4, texts[1])]


@pytest.mark.parametrize("max_grams", [10 ** 6, 0])
def test_matches_brute_force(spark, bench_rows, doc_rows, max_grams):
    docs = spark.createDataFrame(doc_rows, "doc_id long, text string")
    bench = spark.createDataFrame(bench_rows, "item_id long, text string")
    assert got(decontaminate.contamination(docs, bench, max_grams=max_grams)) == plain(doc_rows, bench_rows)


def test_full_bit_table_changes_nothing(spark, bench_rows, doc_rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BIT_WORDS", 1)
    docs = spark.createDataFrame(doc_rows[:30], "doc_id long, text string")
    bench = spark.createDataFrame(bench_rows, "item_id long, text string")
    assert got(decontaminate.contamination(docs, bench)) == plain(doc_rows[:30], bench_rows)


def test_removal(spark, bench_rows, doc_rows):
    docs = spark.createDataFrame(doc_rows, "doc_id long, text string")
    bench = spark.createDataFrame([r for r in bench_rows if len(words(r[1])) >= 10], "item_id long, text string")
    dirty = {r[0] for r in plain(doc_rows, [r for r in bench_rows if len(words(r[1])) >= 10]) if r[2]}
    assert dirty and {r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench).collect()} == {i for i, _ in doc_rows} - dirty
    spans = decontaminate.remove_spans(docs, bench).collect()
    assert len(spans) == len(doc_rows)
    for r in spans:
        if r["doc_id"] not in dirty:
            assert r["kept_words"] == " ".join(words(r["text"]))
        elif r["doc_id"] is not None:
            assert len(r["kept_words"].split()) < len(words(r["text"]))


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(decontaminate.contamination(odd_docs, bench)) == plain(rows, [(1, bench.head()["text"])])
    kept = decontaminate.remove_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7, 8}
    spans = decontaminate.remove_spans(odd_docs, bench)
    assert spans.columns == [*odd_docs.columns, "kept_words"]
    assert {r["kept_words"] for r in spans.where("doc_id = 1").collect()} == {"one twelve"}
    assert decontaminate.contamination(no_docs, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_contaminated(odd_docs, none).count() == odd_docs.count()


def test_main_path_is_native(spark, docs):
    from sieve.llm import queries

    plan = queries.QUERIES["op3_benchmark_decontamination"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan) and "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_registered_query(oracle):
    assert oracle("op3_benchmark_decontamination") == 200

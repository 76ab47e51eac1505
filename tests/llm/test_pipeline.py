"""The corpus pipeline: every stage against a plain version on its own input."""

import pytest
import corpus_pipeline
from sieve.llm import quality
from test_decontaminate import plain as plain_contamination
from test_lines import plain_clean
from test_simhash import plain_components, plain_simhash

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept_by_stage(spark, tmp_path_factory):
    """Rows before the first stage and after each, written and read again."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{len(out)}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "source mixing"]


def test_all_but_the_last_keep_the_columns(kept_by_stage):
    assert all(d.columns == kept_by_stage[0].columns for d in kept_by_stage[:-1])
    assert kept_by_stage[-1].columns == [*kept_by_stage[0].columns, "mix_weight", "mix_probability"]
    assert all(d.schema == kept_by_stage[0].schema for d in kept_by_stage[1:-1])


def test_quality_stage(spark, kept_by_stage):
    before, after = kept_by_stage[:2]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r["doc_id"] for r in quality.classify(before, quality.train(before, labels)).where("keep").collect()}
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in before.collect() if r["doc_id"] in want}
    lab = {r["doc_id"]: r for r in labels.collect()}
    clean = [i for i, r in lab.items() if r["quality"] == 1 and r["toxic"] == 0]
    junk = [i for i, r in lab.items() if r["quality"] == 0]
    assert sum(i in want for i in clean) > 0.95 * len(clean) and sum(i in want for i in junk) < 0.3 * len(junk)


def test_line_stage(kept_by_stage):
    before, after = kept_by_stage[1:3]
    want = plain_clean([(r["doc_id"], r["text"]) for r in before.collect()])
    rows = after.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want and len(rows) == before.count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_simhash_stage(kept_by_stage):
    before, after = kept_by_stage[2:4]
    groups = plain_components({r["doc_id"]: {plain_simhash(r["text"])} for r in before.collect()})
    assert sorted(tuple(r) for r in after.collect()) == sorted(tuple(r) for r in before.collect() if groups[r["doc_id"]] == r["doc_id"])


def test_decontamination_stage(spark, kept_by_stage):
    before, after = kept_by_stage[3:5]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r[0] for r in plain_contamination([(r["doc_id"], r["text"]) for r in before.collect()], bench) if r[2]}
    assert sorted(tuple(r) for r in after.collect()) == sorted(tuple(r) for r in before.collect() if r["doc_id"] not in dirty)


def test_mixing_stage(kept_by_stage):
    before, after = kept_by_stage[4:6]
    rows, texts = after.collect(), {r["doc_id"]: r["text"] for r in before.collect()}
    assert 0 < len(rows) < len(texts) and all(r["text"] == texts[r["doc_id"]] and 0 < r["mix_probability"] <= 1 for r in rows)


def test_run_gives_the_stages_rows(spark, kept_by_stage):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(tuple(r)[:5] for r in kept_by_stage[-1].collect())


def test_registered(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert queries["pipeline"] is corpus_pipeline.run
    assert {n for n in queries if n[:2] == "op" and n[2].isdigit()} == {
        "op1_quality_classifier", "op2_warc", "op3_benchmark_decontamination", "op4_line_dedup", "op5_language_id", "op6_imatch_fingerprints",
        "op7_main_text", "op8_simhash_near_dedup", "op9_source_mixing", "op10_suffix_array_dedup",
        "op11_conversation_trie", "op12_minmax_near_dedup", "op13_fill_in_middle"}
    assert {"op2_warc", "op3_benchmark_decontamination", "op4_line_dedup", "op11_conversation_trie", "op12_minmax_near_dedup", "op13_fill_in_middle"} <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(STAGE))
def test_odd_rows(spark, odd_docs, no_docs, name):
    out = STAGE[name](spark, odd_docs, SF)
    rows = out.collect()
    assert 0 < len(rows) <= odd_docs.count() and out.columns[:len(odd_docs.columns)] == odd_docs.columns
    assert STAGE[name](spark, no_docs, SF).count() == 0

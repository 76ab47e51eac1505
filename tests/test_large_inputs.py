"""Steps that must not gather whole tables in a few tasks."""

import pytest
from pyspark.sql import functions as F

from sieve.operators.enrich import normalize_title, resolve_ids
from sieve.operators.joins import leading_rows, unique_by
from sieve.operators import index
from sieve.plans import catalog, fixtures

INDEX = [("Ring  Anvil", "b", None, 2), ("ring anvil", "a", "10.1000/x", 2), ("ring\tanvil ", "c", "10.1000/y", 3), ("Gizmo", "d", None, None),
         ("gizmo", "e", None, 1), ("Bolt", None, None, 5), ("Bolt", "f", None, 5), (None, "g", None, 0), ("Rod", "h", None, 4), ("Rod", "z", None, 9), ("", "i", None, 1)]


@pytest.fixture()
def setting(spark):
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)
    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("rows", [1_000_000, 1])
def test_leading_rows_keep_the_first_of_every_key(spark, setting, rows):
    setting("sieve.broadcast.maxRows", str(rows))  # 1: too many texts for a broadcast
    idx = spark.createDataFrame(INDEX, "title string, semantic_scholar_id string, doi string, hit_rank int")
    order = F.struct("hit_rank", F.coalesce("semantic_scholar_id", F.lit("")), F.coalesce("doi", F.lit("")))
    values = ["semantic_scholar_id", "doi"]
    key = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    want = unique_by(idx.withColumn("k", key).where("k is not null"), ["k"], order, values)
    led = leading_rows(idx, "title", key, "k", "hit_rank")
    assert sorted(unique_by(led, ["k"], order, values).collect()) == sorted(want.collect())
    assert led.count() == (9 if rows > 1 else 10)
    only = spark.createDataFrame([("bolt",), ("none",)], "k string")
    assert {r["k"] for r in leading_rows(idx, "title", key, "k", "hit_rank", only).collect()} == {"bolt"}


def test_resolved_papers_are_not_shuffled(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    idx = spark.createDataFrame(INDEX, "title string, semantic_scholar_id string, doi string, hit_rank int")
    papers = spark.createDataFrame([(1, "RING anvil", None, None), (2, "bolt", None, None), (3, "gizmo", "10.1000/z", None), (4, None, None, None), (5, "gizmo", None, "s")],
                                   "rec_id int, title string, doi string, semantic_scholar_id string")
    for cut in (False, True):
        out = resolve_ids(papers, idx, cut=cut)
        assert sorted(out.select("rec_id", "doi", "semantic_scholar_id").collect()) == [
            (1, "10.1000/x", "a"), (2, None, None), (3, "10.1000/z", None), (4, None, None), (5, None, "d")]
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_title_key_of_odd_blanks(spark):
    titles = ["A  b", " a b ", "a\tb", "a b", " a b\n", "a 　 b", "a b", None]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(normalize_title("t")).collect()
    assert [r[0] for r in got] == ["a b"] * 7 + [None]


def test_parts_by_remainder_are_broadcast(spark, setting, tmpdir_path):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    part = [(k, f"n{k}", f"T{k}") for k in (-199, -3, 0, 3, 3, 199, 200, 100_200, None)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmpdir_path}/part.parquet")
    orders = spark.sql("select id - 500 o_orderkey, id o_custkey, 'F' o_orderstatus, '1-URGENT' o_orderpriority, date'1996-01-01' o_orderdate from range(100000)") \
        .unionByName(spark.sql("select cast(null as long) o_orderkey, 1L o_custkey, 'F' o_orderstatus, '1-URGENT' o_orderpriority, date'1996-01-01' o_orderdate"))
    orders.write.parquet(f"{tmpdir_path}/orders.parquet")
    got = fixtures.view(spark, tmpdir_path, "bib")
    raw = {t: spark.read.parquet(f"{tmpdir_path}/{t}.parquet") for t in ("orders", "part")}
    want = spark.sql(fixtures.view_sql("bib"), **raw)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 0
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_file_with_a_row_group_for_every_core_is_not_shuffled(spark, tmpdir_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    cores = spark.sparkContext.defaultParallelism
    for n in (1, cores):
        pq.write_table(pa.table({"r_regionkey": list(range(cores))}), f"{tmpdir_path}/region.parquet", row_group_size=-(-cores // n))
        plan = fixtures.base_table(spark, tmpdir_path, "region")._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" in plan) == (n == 1 and cores > 1)


@pytest.mark.parametrize("few", [64, 2, 0])
def test_few_grams_are_asked_in_the_row(spark, monkeypatch, few):
    monkeypatch.setattr(index, "FEW_GRAMS", few)
    titles = [(1, 1999, "conf/a/1", "Rings of Anvils"), (2, 1999, "conf/a/2", "wo"), (3, 2000, "x", None), (4, 2000, "y", "STRING and rod"), (5, 2000, "z", "")]
    records = spark.createDataFrame(titles, "rec_id long, year int, key string, title string")
    needed = spark.createDataFrame([(7, ["anvil", "rod"]), (8, ["ring"]), (9, ["w", "anvilx"])], "conjunct long, pieces array<string>")
    pieces = index.piece_index(needed)
    hits = index.conjunct_hits(records, pieces)
    assert {r["rec_id"]: sorted(r["hits"]) for r in hits.collect()} == {1: [7, 8], 2: [9], 4: [7, 8]}
    plan = index.conjunct_hits(records, pieces)._jdf.queryExecution().optimizedPlan().toString()
    assert ("sequence(" in plan) == (few < 6)


def test_varied_dump_is_written_by_as_many_tasks_as_set(spark, setting, monkeypatch):
    setting("spark.sql.adaptive.enabled", "false")
    seen = []
    write = catalog.bibliography.write_dump
    monkeypatch.setattr(catalog.bibliography, "write_dump", lambda df, *a: (seen.append(df.rdd.getNumPartitions()), write(df, *a)))
    rows = catalog.QUERIES["ingest_varied"](spark, "/root/testdata/sf0.001")
    assert rows.agg(F.max("ord") + 1 - F.count(F.lit(1))).head()[0] == 0
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


@pytest.mark.parametrize("sample,passes", [(2_000, 1), (1, 2)])
def test_a_dump_with_cut_sections_is_parsed_once(spark, monkeypatch, tmpdir_path, sample, passes):
    bibliography = catalog.bibliography
    monkeypatch.setattr(bibliography, "OPEN_SAMPLE", sample)
    rows = spark.sql("select id ord, concat('conf/v/', id) key, concat('Title ', id) title, 1999 year, 'https://x.org' ee from range(60)")
    bibliography.write_dump(rows.coalesce(1).sortWithinPartitions("ord"), f"{tmpdir_path}/dump", bibliography.varied_xml())
    seen = []
    parse = bibliography.parse_chunks
    monkeypatch.setattr(bibliography, "parse_chunks", lambda *a: (seen.append(1), parse(*a))[1])
    records, rejects = bibliography.read_bibliography(spark, f"{tmpdir_path}/dump")
    assert [(r["ord"], r["key"], r["title"]) for r in records.orderBy("ord").collect()] == [(i, f"conf/v/{i}", f"Title {i}") for i in range(60)]
    assert len(seen) == passes

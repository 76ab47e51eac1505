"""Sources and sinks: XML dump scan, study specs, Parquet store, CSV export,
incremental (streaming) screening."""

import json
import os

from pyspark.sql import functions as F

from sieve.operators.screening import Study
from sieve.plans import fixtures
from sieve.sources import bibliography, store, studies
from sieve.streaming.incremental import screen_stream

DUMP = """<?xml version="1.0" encoding="ISO-8859-1"?>
<!DOCTYPE dblp SYSTEM "dblp.dtd">
<dblp>
<article mdate="2020-01-01" key="journals/tse/M1">
<author>A</author><title>M&uuml;ller's <i>green</i> containers</title><year>2020</year>
<ee>https://doi.org/10.1109/TSE.2020.1</ee><ee>https://second.example/x</ee>
</article>
<inproceedings mdate="2021-01-01" key="conf/icse/N2" publtype="x">
<title>Caf&#233; <!-- note --> scheduling</title><year> 2021 </year>
</inproceedings>
<inproceedings mdate="2021-01-01" key="conf/icse/NoYear">
<title>No year here</title>
</inproceedings>
<article mdate="2020-01-01" key="journals/x/Before"><title>swallows the next</title><year>2019</year></article>
<article mdate="2020-01-01"\tkey="journals/x/Merged"><title>merged</title><year>2019</year></article>
<phdthesis mdate="2020-01-01" key="phd/Someone"><title>A thesis &amp; more</title><year>2019</year><ee>http://a.b/c?x=1&amp;y=2</ee></phdthesis>
</dblp>
"""


def test_xml_dump_scan(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "dblp.xml")
    with open(path, "w") as f:
        f.write(DUMP)
    records, rejects = bibliography.read_bibliography(spark, path)
    got = {r.key: (r.title, r.year, r.ee) for r in records.collect()}
    assert got["journals/tse/M1"] == ("Müller's green containers", 2020, "https://doi.org/10.1109/TSE.2020.1")
    assert got["conf/icse/N2"] == ("Café  scheduling", 2021, None)
    # a key after a tab is split off the record before it
    assert got["journals/x/Before"] == ("swallows the next", 2019, None) and got["journals/x/Merged"] == ("merged", 2019, None)
    assert got["phd/Someone"] == ("A thesis & more", 2019, "http://a.b/c?x=1&y=2")
    reasons = sorted(r.reason for r in rejects.collect())
    assert reasons == ["no_key", "no_year"]


def test_dump_round_trip(spark, tmpdir_path):
    bib = fixtures.view(spark, "/root/testdata/sf0.001", "bib")
    path = os.path.join(tmpdir_path, "dump")
    bibliography.write_dump(bib, path)
    records, rejects = bibliography.read_bibliography(spark, path)
    a = {(r.key, r.title, r.year, r.ee) for r in records.collect()}
    b = {(r.key, r.title, r.year, r.ee) for r in bib.collect()}
    assert a == b
    assert {r.reason for r in rejects.collect()} <= {"no_key"}


def test_write_records_partitioned(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 1, "conf/a/1", "t", 2020, None), (2, 2, "journals/b/2", "t", 2019, None)],
                               "rec_id long, ord long, key string, title string, year int, ee string")
    path = os.path.join(tmpdir_path, "records")
    bibliography.write_records(df, path)
    back = spark.read.parquet(path)
    plan = back.where(F.col("ktype") == "conf")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ktype" in plan
    assert back.count() == 2


def test_load_study_multiline(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "study.json")
    with open(path, "w") as f:
        json.dump(fixtures.REVIEW_SPECS[0], f, indent=4)
    s = studies.load_study(spark, path, study_id=7).first()
    assert s.study_id == 7 and s.year_min == 1996 and s.search_word_groups[0] == ["ring", "anvil", "gizmo"]


def test_csv_export_and_column(spark, tmpdir_path):
    papers = spark.createDataFrame([(1, 1, "10.1/a", "T, with comma"), (1, 2, None, "U")],
                                   "study_id long, rec_id long, doi string, title string")
    path = os.path.join(tmpdir_path, "csv")
    store.export_csv(papers, path)
    assert sorted(r.doi for r in store.csv_column(spark, path, "doi").collect()) == ["", "10.1/a"]
    assert store.csv_column(spark, path, "nope").count() == 0


def test_partitioned_store_rerun_replaces_study(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "papers")
    a = spark.createDataFrame([(1, 1), (2, 2)], "study_id long, rec_id long")
    store.write_table(a, path)
    store.write_table(spark.createDataFrame([(1, 9)], "study_id long, rec_id long"), path)
    got = sorted((r.study_id, r.rec_id) for r in store.read_table(spark, path).collect())
    assert got == [(1, 9), (2, 2)]


def test_incremental_screening(spark, tmpdir_path):
    dump_dir = os.path.join(tmpdir_path, "incoming")
    os.makedirs(dump_dir)
    with open(os.path.join(dump_dir, "part1.xml"), "w") as f:
        f.write(DUMP)
    ranks = spark.createDataFrame([("conference", "icse", 1, 1, "A*")],
                                  "kind string, lookup_key string, page_id long, pos int, rank_text string")
    study = Study(year_min=2019, year_max=2021, search_word_groups=[["contain", "schedul", "thesis"]],
                  accepted_venue_types=["conf", "journals", "phd"], venue_rank_threshold="B")
    out = os.path.join(tmpdir_path, "out")
    q = screen_stream(spark, dump_dir, study, ranks, out, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    papers = spark.read.parquet(os.path.join(out, "papers"))
    got = {r.venue_key: r.venue_rank for r in papers.collect()}
    assert got == {"M1": "MISSING", "N2": "A_STAR"}
    rejects = spark.read.parquet(os.path.join(out, "rejects"))
    assert sorted(r.reason for r in rejects.collect()) == ["key_not_three_segments", "no_key", "no_year"]


def test_incremental_screening_picks_up_only_new_files(spark, tmpdir_path):
    dump_dir = os.path.join(tmpdir_path, "incoming")
    os.makedirs(dump_dir)
    ranks = spark.createDataFrame([("conference", "icse", 1, 1, "A")],
                                  "kind string, lookup_key string, page_id long, pos int, rank_text string")
    study = Study(year_min=2019, year_max=2021, search_word_groups=[["contain", "schedul"]],
                  accepted_venue_types=["conf", "journals"], venue_rank_threshold="B")
    out, ckpt = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt")
    first = ('<dblp>\n<article mdate="x" key="journals/tse/A1"><title>Container one</title><year>2020</year>'
             '</article>\n</dblp>\n')
    second = ('<dblp>\n<inproceedings mdate="x" key="conf/icse/B2"><title>Scheduling two</title><year>2021</year>'
              '</inproceedings>\n</dblp>\n')
    with open(os.path.join(dump_dir, "a.xml"), "w") as f:
        f.write(first)
    screen_stream(spark, dump_dir, study, ranks, out, ckpt).awaitTermination(120)
    with open(os.path.join(dump_dir, "b.xml"), "w") as f:
        f.write(second)
    screen_stream(spark, dump_dir, study, ranks, out, ckpt).awaitTermination(120)
    papers = spark.read.parquet(os.path.join(out, "papers"))
    got = sorted((r.batch_id, r.venue_key, r.venue_rank) for r in papers.collect())
    assert got == [(0, "A1", "MISSING"), (1, "B2", "A")]

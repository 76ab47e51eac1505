"""All-or-nothing runs, study ids and byte-exact exports."""

import csv
import glob
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from sieve.sources import store
from sieve.sources.commit import StudyStore

NAMES = ["papers", "contents", "metrics", "requests", "reports", "criteria_assessments", "studies"]


def tables(spark, ids, text="x", names=NAMES):
    rows = [(i, k, f"{text}{k}") for i in ids for k in range(3)]
    return {n: spark.createDataFrame(rows, "study_id long, rec_id long, title string") for n in names}


def seen(out, name="papers"):
    return sorted((r["study_id"], r["title"]) for r in out.read(name).collect())


def test_a_failing_run_changes_nothing(spark, tmpdir_path):
    out = StudyStore(spark, f"{tmpdir_path}/store")
    out.write_run(tables(spark, [1, 2]), [1, 2])
    before, version = {n: seen(out, n) for n in NAMES}, out.state()["version"]
    broken = tables(spark, [1, 2], "new")
    broken["criteria_assessments"] = broken["criteria_assessments"].withColumn("title", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        out.write_run(broken, [1, 2])
    assert {n: seen(out, n) for n in NAMES} == before and out.state()["version"] == version
    out.write_run(tables(spark, [1, 2], "new"), [1, 2])
    assert all(seen(out, n) == [(i, f"new{k}") for i in (1, 2) for k in range(3)] for n in NAMES)


def test_a_rerun_without_papers_leaves_none(spark, tmpdir_path):
    out = StudyStore(spark, f"{tmpdir_path}/store")
    out.write_run(tables(spark, [1, 2]), [1, 2])
    held = out.read("papers")
    none = {n: df.where("study_id > 5") for n, df in tables(spark, [1]).items()}
    out.write_run(none, [1])
    assert {s for s, _ in seen(out)} == {2} and out.read("papers", [1]).count() == 0
    assert out.read("papers", [1]).columns == ["study_id", "rec_id", "title"]
    assert held.count() == 6  # a reader keeps the version it began with
    assert len(out.read("papers", version=1).collect()) == 6
    out.write_run({n: df.where("study_id > 5") for n, df in tables(spark, [2]).items()}, [2])
    assert out.read("papers").count() == 0


def test_runs_keep_each_others_studies(spark, tmpdir_path):
    one, two = (StudyStore(spark, f"{tmpdir_path}/store") for _ in range(2))
    a, b = one.reserve(2), two.reserve(1)
    assert (a, b) == (1, 3)
    runs = {s: f"run{s}" for s in (a, b)}
    for n, df in tables(spark, [a, a + 1], "a").items():
        one.write(n, df, runs[a])
    two.write_run(tables(spark, [b], "b"), [b], runs[b])  # commits while the other run writes
    one.commit({n: df.schema for n, df in tables(spark, [a]).items()}, [a, a + 1], runs[a])
    assert {s for s, _ in seen(two)} == {1, 2, 3} and one.reserve(1) == 4
    with pytest.raises(ValueError, match="other studies"):
        one.write_run(tables(spark, [9]), [8])


def test_manifests_that_were_not_finished_count_for_nothing(spark, tmpdir_path):
    out = StudyStore(spark, f"{tmpdir_path}/store")
    out.write_run(tables(spark, [1], names=["papers"]), [1])
    with open(f"{tmpdir_path}/store/manifest/000000000002.json", "w") as f:
        f.write('{"version": 2, "tab')
    assert out.state()["version"] == 1
    out.write_run(tables(spark, [2], names=["papers"]), [2])
    assert out.state()["version"] == 3 and {s for s, _ in seen(out)} == {1, 2}
    with pytest.raises(ValueError):
        out.state(2)
    # a run that committed on an older state than the one that was finished meanwhile
    late = dict(out.state(1), version=4, base=1, end=True)
    with open(f"{tmpdir_path}/store/manifest/000000000004.json", "w") as f:
        json.dump(late, f)
    assert out._stands(1) and not out._stands(3)


def test_a_taken_number_is_built_upon(spark, tmpdir_path, monkeypatch):
    out, other = (StudyStore(spark, f"{tmpdir_path}/store") for _ in range(2))
    create, raced = StudyStore._create, []

    def slow(self, manifest):
        if self is out and not raced:
            raced.append(other.reserve(5))  # takes the number first
        return create(self, manifest)

    monkeypatch.setattr(StudyStore, "_create", slow)
    assert out.reserve(2) == 6 and raced == [1] and out.reserve(1) == 8


def test_write_table_removes_what_a_rerun_no_longer_has(spark, tmpdir_path):
    path = f"{tmpdir_path}/papers"
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    df = tables(spark, [1, 2])["papers"]
    store.write_table(df, path)
    store.write_table(df.where("study_id = 2").withColumn("title", F.lit("again")), path, study_ids=[1, 2])
    assert {(r["study_id"], r["title"]) for r in store.read_table(spark, path).collect()} == {(2, "again")}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "static"
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


def test_exports_equal_the_csv_module_byte_by_byte(spark, tmpdir_path):
    odd = ["plain", 'with "quotes"', "comma, here", "line\nbreak", "cr\rhere", "both\r\n", "", None, " space ", "'single'", "é\U0001f600", '"', "tab\t"]
    rows = [(1 + k % 2, k, odd[k % len(odd)], odd[(k * 5 + 3) % len(odd)], k) for k in range(60)]
    papers = spark.createDataFrame(rows, "study_id long, rec_id long, title string, doi string, year int").repartition(7)
    path = f"{tmpdir_path}/export"
    store.export_studies(papers, path, ["study_id", "rec_id", "title", "doi", "year"])
    for study in (1, 2):
        want = io.StringIO()
        writer = csv.writer(want)
        writer.writerow(["study_id", "rec_id", "title", "doi", "year"])
        writer.writerows(r for r in rows if r[0] == study)
        files = sorted(glob.glob(os.path.join(path, f"study_id={study}", "part-*")))
        assert b"".join(open(f, "rb").read() for f in files) == want.getvalue().encode()
    one = f"{tmpdir_path}/one"
    store.export_studies(papers, one, ["doi"])
    want = io.StringIO()
    csv.writer(want).writerows([["doi"], *([r[3]] for r in rows if r[0] == 1)])
    assert b"".join(open(f, "rb").read() for f in sorted(glob.glob(os.path.join(one, "study_id=1", "part-*")))) == want.getvalue().encode()


def test_two_job_runs_into_one_folder(spark, tmpdir_path):
    from sieve.plans import fixtures
    from sieve.plans.job import parse_args, run
    from sieve.plans.review import ReviewInputs

    d = tmpdir_path
    inp = ReviewInputs(spark, "/root/testdata/sf0.001")
    inp.bib.write.parquet(f"{d}/records")
    inp.view("rank_html").withColumn("kind", F.lit("conference")).write.parquet(f"{d}/ranks")
    written = []
    for i in (1, 2):
        with open(f"{d}/s{i}.json", "w") as f:
            json.dump(fixtures.REVIEW_SPECS[i], f)
        written.append(run(spark, parse_args(["--study", f"{d}/s{i}.json", "--dblp", f"{d}/records", "--records", "--ranks", f"{d}/ranks",
                                              "--export_all", "--out", f"{d}/out"])))
    out = StudyStore(spark, f"{d}/out")
    assert sorted(r["study_id"] for r in out.read("studies").collect()) == [1, 2]
    counts = {r["study_id"]: r["count"] for r in out.read("papers").groupBy("study_id").count().collect()}
    assert counts[1] > 0 and counts.get(2, 0) == out.read("papers", [2]).count()
    assert os.listdir(written[0]["export_csv"]) != os.listdir(written[1]["export_csv"])
    lines = b"".join(open(f, "rb").read() for f in glob.glob(f"{written[0]['export_csv']}/study_id=1/part-*"))
    assert lines.count(b"\r\n") == counts[1] + 1 and lines.startswith(b"study_id,rec_id,doi")

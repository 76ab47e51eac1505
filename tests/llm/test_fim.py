"""Boundary sets and the fill-in-the-middle transformation."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from sieve.llm import fim

TEXTS = ["", "a", "\n", "\n\n", "one\ntwo\nthree", "é\n\U0001f600x\n", "\n" * 70_000, "ab\n" * 30_000, "a\n" * 40_000 + "\n" * 9_000 + "tail",
         "x" * 200_000 + "\ny", "with <S> in it\nand more", "<", "<\nP>", "<S\n><P\n>\n<M"]


def plain(doc_id, text, seed=7, fim_percent=100, spm_percent=50):
    """The transformation by regular expression and slices."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= fim_percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_select_gives_every_unit_end(text):
    ends = np.cumsum([len(u) for u in re.findall(r"[^\n]*\n|[^\n]+", text)], dtype=np.int64)
    found = fim.BoundarySet.of(fim.unit_ends(text))
    again = fim.BoundarySet.from_bytes(found.to_bytes())
    assert len(found) == len(again) == len(ends) and found.select(0) == 0
    for k in {1, 2, 3, len(ends) // 2, 4096, 4097, 65_535, 65_536, len(ends) - 1, len(ends)}:
        if 0 < k <= len(ends):
            assert found.select(k) == again.select(k) == ends[k - 1]
    with pytest.raises(IndexError):
        found.select(len(ends) + 1)


def test_kinds_of_containers():
    kinds = [{kind for kind, _ in fim.BoundarySet.of(fim.unit_ends(t)).containers} for t in ("\n" * 70_000, "a\n" * 35_000, "abc\n" * 10)]
    assert kinds == [{fim.RUNS}, {fim.BITMAP, fim.ARRAY}, {fim.ARRAY}]
    rng = np.random.default_rng(3)
    for share in (0.0005, 0.03, 0.5, 0.97):
        offsets = np.flatnonzero(rng.random(300_000) < share)
        found = fim.BoundarySet.of(offsets)
        assert [found.select(k) for k in range(1, len(offsets) + 1, 97)] == offsets[::97].tolist()
        assert all(len(data.tobytes()) <= fim.BITMAP_BYTES for _, data in found.containers)


@pytest.mark.parametrize("fim_percent, spm_percent", [(100, 50), (60, 30), (0, 0)])
def test_transformation_equals_a_plain_one(spark, fim_percent, spm_percent):
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(None, "no\nid\n"), (5, None), (5, None), (2 ** 40, "a\nb\nc\n")]
    made = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), fim_percent=fim_percent, spm_percent=spm_percent)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"], 7, fim_percent, spm_percent)
        assert r["back"] == (r["text"] or "")


def test_stored_boundaries_cut_for_another_seed(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: (r["units"], r["first"], r["second"]) for r in fim.cuts(fim.boundaries(docs), seed=11).collect()}
    for k, text in enumerate(TEXTS):
        n, form, pre, mid, _ = plain(k, text, 11)
        assert got[k][0] == n and (form == "plain" or got[k][1:] == (pre, pre + mid))


def test_odd_rows(odd_docs, no_docs):
    made = fim.fill_in_middle(odd_docs, out=("p", "form", "hits", "_cut", "output"))
    assert made.columns == [c for c in odd_docs.columns if c not in ("p", "hits")] + ["p", "form", "hits", "_cut", "output"]
    rows = made.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r["p"], r["form"], r["hits"], r["_cut"], r["output"]) == plain(r["doc_id"], r["text"])
    assert fim.fill_in_middle(no_docs).count() == 0


def test_registered_query(oracle):
    assert oracle("op13_fill_in_middle") == 200

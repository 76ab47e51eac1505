"""Repeated passages against all windows."""

import random
import re

import pytest
from sieve.llm import suffixes


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def merged(places, n):
    out = []
    for p in sorted(set(places)):
        if out and p <= out[-1][1]:
            out[-1][1] = p + n
        else:
            out.append([p, p + n])
    return [tuple(x) for x in out]


def plain(rows, n):
    """{id: (spans, drops, first)} by comparing all windows of n words."""
    owners, texts = {}, [(i, words(t)) for i, t in rows if i is not None]
    for i, w in texts:
        for k in range(len(w) - n + 1):
            owners.setdefault(tuple(w[k:k + n]), set()).add(i)
    found = {}
    for i, w in texts:
        for k in range(len(w) - n + 1):
            own = owners[tuple(w[k:k + n])]
            if len(own) > 1:
                spans, drops, first = found.setdefault(i, ([], [], []))
                spans.append(k)
                first.append(min(own))
                if min(own) < i:
                    drops.append(k)
    return {i: (merged(s, n), merged(d, n), min(f)) for i, (s, d, f) in found.items()}


def got(rows):
    return {r["doc_id"]: ([tuple(s) for s in r["spans"]], [tuple(s) for s in r["drops"]], r["first_doc"]) for r in rows.collect()}


def made_rows(seed, n=70, small=False):
    """Texts that share passages, with small edits, at any place."""
    rng = random.Random(seed)
    word = (lambda: rng.choice("abc")) if small else (lambda: f"w{rng.randrange(400)}")
    pool = [[word() for _ in range(rng.randrange(20, 140))] for _ in range(6)]
    rows = []
    for k in range(n):
        w = []
        for _ in range(rng.randrange(0, 4)):
            p = list(rng.choice(pool))
            a = rng.randrange(len(p))
            p = p[a:a + rng.randrange(1, 140)]
            if p and rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edited"
            w += p + [f"only{k}x{j}" for j in range(rng.randrange(0, 30))]
        rows.append((k * 3, "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w)))
    return rows


@pytest.mark.parametrize("seed,n,k,small", [(1, 50, 10, False), (2, 20, 5, False), (3, 8, 8, True), (4, 63, 1, False), (5, 12, 3, True)])
def test_matches_all_windows(spark, seed, n, k, small):
    rows = made_rows(seed, small=small)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(suffixes.repeated_passages(docs, min_words=n, anchor_words=k)) == plain(rows, n)


@pytest.mark.parametrize("crowd", [0, 2])
def test_crowded_anchors_change_nothing(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rows = made_rows(1)
    assert got(suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), min_words=20, anchor_words=5)) == plain(rows, 20)


def test_window_numbers_tell_words_apart():
    """Rows under one anchor hash whose words differ anywhere, the anchor's too."""
    rng = random.Random(4)
    n = 6
    rows = set()
    for _ in range(400):
        b, a = rng.randrange(0, 5), rng.randrange(2, 7)
        if a + b >= n:
            rows.add((tuple(rng.choice("ab") for _ in range(b)), tuple(rng.choice("ab") for _ in range(a))))
    rows = sorted(rows, key=lambda r: suffixes.joined([w.encode() for w in r[1]]))
    pack = lambda side: [suffixes.joined([w.encode() for w in r[side]]) for r in rows]
    sizes, numbers = suffixes.window_groups(pack(0), pack(1), n)
    want = [(len(b) - i, (b + a)[i:i + n]) for b, a in rows for i in range(len(b) + len(a) - n + 1)]
    assert sizes.sum() == len(want) == len(numbers) > 400
    pairs = set(zip(numbers.tolist(), want))
    assert len(pairs) == len(set(want)) == len(set(numbers.tolist()))


def test_long_words_are_told_apart_by_their_digest(spark):
    long = ["x" * 70 + str(k) for k in range(3)]
    stand_in = suffixes.joined([long[0].encode()])[:-1].decode()
    assert len(stand_in) == suffixes.LONG_WORD + 1
    passage = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{long[0]} {passage} {long[1]}"), (2, f"{long[0]} {passage} {long[2]}"), (3, f"{stand_in} {passage} {long[1]}")]
    got_ = got(suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), min_words=13, anchor_words=3))
    assert got_ == plain(rows, 13)


def test_copies_and_long_texts(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(25_000))
    rows = [(k, long if k % 5 == 0 else " ".join(f"d{k}x{j}" for j in range(60))) for k in range(40)]
    assert got(suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows, 50)


def test_one_document_repeating_itself_is_left_alone(spark):
    text = " ".join(f"w{k}" for k in range(60))
    assert got(suffixes.repeated_passages(spark.createDataFrame([(1, f"{text} {text}"), (2, "else")], "doc_id long, text string"))) == {}


def test_first_holder_keeps_its_passage(spark):
    passage = " ".join(f"P{k}" for k in range(55))
    rows = [(5, f"start  of five\n{passage}\n end of five"), (3, f"{passage}"), (9, f"x {passage.lower()}"), (10, "clean"), (11, None)]
    out = suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {5: "start  of five\n\n end of five", 3: passage, 9: "x ", 10: "clean", 11: None}


def test_a_group_may_span_batches(spark):
    rows = made_rows(7, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(suffixes.repeated_passages(docs, min_words=20, anchor_words=5)) == plain(rows, 20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_odd_rows(spark, odd_docs, no_docs):
    out = suffixes.repeated_passages(odd_docs, min_words=12, anchor_words=4)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(out) == plain(rows, 12) and {r["n_repeated"] for r in out.where("doc_id IN (1, 2)").collect()} == {12}
    kept = suffixes.drop_repeats(odd_docs, min_words=12, anchor_words=4)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert {r["text"] for r in kept.where("doc_id = 2").collect()} == {""}
    assert suffixes.repeated_passages(no_docs).count() == suffixes.drop_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        suffixes.shared_windows(no_docs, min_words=80, anchor_words=10)


def test_registered_query(spark):
    from sieve.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got(queries.QUERIES["op10_suffix_array_dedup"](spark, "/root/testdata/sf0.001")) == plain([(r["doc_id"], r["text"]) for r in rows], 50)

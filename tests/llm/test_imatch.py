"""I-Match fingerprints."""

import hashlib
import math
import re
from collections import Counter

import pytest
from sieve.llm import imatch

SF = "/root/testdata/sf0.001"


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return {w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)}


@pytest.mark.parametrize("chunk,least", [(4096, 0.05), (7, 0.05), (30, 0.005)])
def test_lexicon_is_the_exact_band(spark, monkeypatch, chunk, least):
    """Also a term held by exactly the least share, small chunks and several slices."""
    monkeypatch.setattr(imatch, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(imatch, "SLICE", 10_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs.collect()]
    df = Counter(w for t in texts for w in words(t))
    want = {w for w, n in df.items() if least * len(texts) - 1e-9 <= n <= 0.2 * len(texts) + 1e-9}
    assert set(imatch.build_lexicon(docs, max_idf=math.log(1 / least)).masks) == want


def test_only_the_lexicon_comes_to_the_driver(spark, monkeypatch):
    """Also from chunks so small that every word could be in the band."""
    monkeypatch.setattr(imatch, "CHUNK_DOCS", 3)
    got, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: got.append(collect(self)) or got[-1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lexicon = imatch.build_lexicon(docs, max_idf=math.log(1 / 0.05))
    assert 0 < sum(map(len, got)) == len(lexicon.masks)


def test_masks_are_fixed_by_the_term():
    masks = [imatch.subset_mask(f"term{k}".encode(), 64, 1 / 64) for k in range(3000)]
    assert masks[:5] == [imatch.subset_mask(f"term{k}".encode(), 64, 1 / 64) for k in range(5)]
    assert 0.8 < sum(m.bit_count() for m in masks) / 3000 < 1.2
    assert len({m for m in masks if m}) > 100


def test_fingerprint_and_likeness():
    lexicon = imatch.Lexicon({w: imatch.subset_mask(w, 64, 1 / 8) for w in (f"w{k}".encode() for k in range(200))}, 64)
    a = " ".join(f"w{k}" for k in range(100))
    mark = lambda t: lexicon.fingerprint(t.encode())
    assert mark(a) == mark(a.upper() + " unknown words, more of them") == mark(" ".join(reversed(a.split())))
    near, far = mark(a.replace("w50 ", "w150 ")), mark(" ".join(f"w{k}" for k in range(100, 200)))
    assert 1 > imatch.likeness(mark(a), near) > 0.6 > imatch.likeness(mark(a), far)
    assert imatch.likeness(near, mark(a)) == imatch.likeness(mark(a), near)
    assert imatch.likeness(mark(""), mark("")) == 1 and mark("x y") != mark("x z") and imatch.likeness(mark("x y"), mark("x z")) == 0
    assert len(mark("")) == len(mark(a))


def test_each_term_is_in_subsets_of_several_shares():
    masks = [imatch.level_mask(f"term{k}".encode()) for k in range(20_000)]
    assert masks[:5] == [imatch.level_mask(f"term{k}".encode()) for k in range(5)]
    for k, share in enumerate(imatch.SHARES):
        level = [m >> imatch.LEVEL * k & (1 << imatch.LEVEL) - 1 for m in masks]
        assert sum(m.bit_count() for m in level) / 20_000 / imatch.LEVEL == pytest.approx(share, rel=0.2)
        assert share * imatch.LEVEL < 1 or all(level)


@pytest.mark.parametrize("n", [2, 5, 10, 30, 100, 300, 1000, 3000])
def test_half_a_text_shows_at_any_size(n):
    lexicon = imatch.Lexicon({w: imatch.level_mask(w) for w in (b"w%d" % k for k in range(12_000))})
    mark = lambda *at: lexicon.fingerprint(b" ".join(b"w%d" % k for a, b in at for k in range(a, b)))
    for start in range(0, 12_000 - 2 * n, max(2 * n, 1200)):
        own, after = mark((start, start + n)), mark((start + n, start + 2 * n))
        edited = mark((start, start + n - n // 2), (start + n, start + n + n // 2))
        assert imatch.likeness(own, edited) > 0.08 and imatch.likeness(own, edited) > imatch.likeness(own, after)


def test_near_edited_by_text_length(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = imatch.edited_and_next(docs, imatch.build_lexicon(docs)).collect()
    for low, high in ((100, 300), (300, 1000), (1000, 3000), (3000, 8000), (8000, 10**9)):
        some = [r for r in rows if low <= r["n_chars"] < high]
        assert some and sum(r["near_edited"] > r["near_next"] for r in some) >= 0.97 * len(some)
        assert sum(r["near_edited"] for r in some) > 0.2 * len(some)


def test_rare_languages_have_lexicon_terms(spark):
    """Words of three of a thousand documents."""
    rows = [(k, f"common text number {k % 50} with some words") for k in range(997)] + [(2000 + k, " ".join(f"rare{j}" for j in range(40))) for k in range(3)]
    lexicon = imatch.build_lexicon(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(w.startswith(b"rare") for w in lexicon.masks) == 40


def plain_edit(rows):
    """{id: sha256 of the edited text} in ascending id, nulls first, ties by text."""
    rows = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    out = []
    for k, (some, i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        half = len(t) // 2
        out.append((i if some else None, len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=repr)


def edited(rows):
    return sorted(((r[0], r["n_chars"], r["edited_sha256"]) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_next_documents(spark, n):
    rows = [(k * 7 % 101 - 20, "ä€𝄞x" * (k % 5) + str(k)) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = imatch.edited_and_next(docs, imatch.build_lexicon(docs))
    assert edited(out) == plain_edit(rows)


def test_odd_rows(odd_docs, no_docs):
    out = imatch.edited_and_next(odd_docs, imatch.build_lexicon(odd_docs))
    assert edited(out) == plain_edit([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert imatch.edited_and_next(no_docs, imatch.build_lexicon(no_docs)).count() == 0
    marks = {}
    for r in out.collect():
        marks.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert marks[1] == marks[2] and marks[3] == marks[4] and marks[5] == marks[6] != marks[1]


def test_registered_query(spark):
    from sieve.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op6_imatch_fingerprints"](spark, SF)
    assert edited(rows) == plain_edit([(r["doc_id"], r["text"]) for r in docs.collect()])
    lexicon = imatch.build_lexicon(docs)
    by = {r["doc_id"]: r for r in rows.collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    for k, (i, t) in enumerate(texts):
        own, after = lexicon.fingerprint(t.encode()), lexicon.fingerprint(texts[(k + 1) % len(texts)][1].encode())
        assert by[i]["fingerprint"] == own and by[i]["near_next"] == imatch.likeness(own, after)
        assert by[i]["near_edited"] == imatch.likeness(own, by[i]["edited_fingerprint"])
    assert sum(r["near_edited"] for r in by.values()) > 5 * sum(r["near_next"] for r in by.values())

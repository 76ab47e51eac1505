"""Language identification by rank-order profiles."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from sieve.llm import language

SF = "/root/testdata/sf0.01"


def plain_ranked(text, top):
    letters = "".join(c if c.isalpha() else " " for c in text)
    letters = "".join(c.lower() if len(c.lower()) == 1 else c for c in letters)
    s = " " + " ".join(letters.split()) + " "
    counts = Counter(s[k:k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1))
    counts.pop(" ")
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return counts, [code(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:top]


@pytest.mark.parametrize("text", ["Hello, World! hello", "Äpfel ßtraße 123 x", "été ÉTÉ", "a", "日本語 テキスト 日本", "𝔘𝔫𝔦 𝔠𝔬𝔡𝔢", "İstanbul ΣΊΣΥΦΟΣ", " -- b --  c"])
def test_ranked_grams_are_the_plain_ones(text):
    table = language.letter_table()
    counts, want = plain_ranked(text, 10)
    codes, n = language.grams(text, table)
    assert sum(n) == sum(counts.values()) and len(codes) == len(counts)
    assert language.ranked(codes, n, 10).tolist() == want


def test_distance_by_hand():
    import numpy as np

    p = language.Profiles(["x"], [np.array([10, 20, 30])], [np.array([2, 0, 1])], size=5, top=3)
    # 20 in place, 10 one rank off, 99 not in the profile
    assert p.distances(np.array([20, 10, 99]))[0] == pytest.approx((0 + 1 + 5) / (5 * 3))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.held_out(F.col("doc_id"))
    profiles = language.learn(docs.where(~out))
    assert profiles.names == ["de", "en", "es", "fr"] and all(len(c) == language.PROFILE for c in profiles.codes)
    rows = language.predict(docs.where(out), profiles).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_profiles_hold_the_most_frequent(spark):
    rows = [("aab aab", "x"), ("ab", "x"), ("zz", "y"), ("zz", None), (None, "x"), ("", "y")]
    p = language.learn(spark.createDataFrame(rows, "text string, lang string"), size=4)
    counts = plain_ranked("aab aab", 99)[0] + plain_ranked("ab", 99)[0]
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    want = [code(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:4]
    got = dict(zip(p.codes[0].tolist(), p.ranks[0].tolist()))
    assert p.names == ["x", "y"] and sorted(got, key=got.get) == want


def test_odd_rows(spark, odd_docs, no_docs):
    profiles = language.learn(odd_docs)
    out = language.predict(odd_docs, profiles, out=("lang_pred", "p"))
    assert out.columns == [*odd_docs.columns, "lang_pred"] and out.count() == odd_docs.count()
    assert {(r["lang_pred"], r["p"]) for r in out.where("doc_id IN (3, 4, 7)").collect()} == {("und", 0.0)}
    assert {r["lang_pred"] for r in out.where("doc_id IN (5, 6)").collect()} == {"fr"}
    empty = language.learn(no_docs)
    assert {r["lang_pred"] for r in language.predict(odd_docs, empty).collect()} == {"und"}
    assert language.predict(no_docs, profiles).count() == 0


def test_registered_query(spark):
    import zlib

    from sieve.llm import queries

    rows = queries.QUERIES["op5_language_id"](spark, SF).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)

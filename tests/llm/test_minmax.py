"""Min-max hashing against all pairs of sets."""

import random

import numpy as np
import pytest
from sieve.llm import minmax


def plain_sets(rows):
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets.append({" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    return sets


def plain_components(rows, percent=80):
    """Smallest id reachable per row, over all pairs."""
    sets = plain_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        r = find(k)
        least[r] = min((v for v in (least.get(r), doc_id) if v is not None), default=None)
    return [(doc_id, len(s), least[find(k)]) for k, ((doc_id, _), s) in enumerate(zip(rows, sets))]


def corpus():
    """Near copies whose original is missing, texts that share half their words, chains
    and ordinary texts."""
    rng, rows = random.Random(8), []
    vocabulary = [f"w{k}" for k in range(5000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    base = text(120)
    for _ in range(90):  # 76 to 86 % of each other
        copy = list(base)
        for spot in rng.sample(range(120), 3):
            copy[spot] = rng.choice(vocabulary)
        rows.append(copy)
    passage = text(60)
    rows += [passage + text(rng.randrange(20, 60)) for _ in range(80)]
    chain = text(100)
    for _ in range(12):
        chain = chain[2:] + text(2)
        rows.append(chain)
    rows += [rows[0]] * 5 + [text(rng.randrange(1, 30)) for _ in range(40)] + [["a", "b"], ["A", "b"], ["b", "a"], [], []]
    rng.shuffle(rows)
    return [(k * 3 + 1, rng.choice([" ", "\n", "\t "]).join(r)) for k, r in enumerate(rows)]


@pytest.mark.parametrize("group, items, turns", [(minmax.GROUP, minmax.ITEMS, minmax.TURNS), (12, 3000, 1), (5, 500, 0)])
def test_components_equal_all_pairs(spark, monkeypatch, group, items, turns):
    """Also with keys split by longer bands, and keys and clusters dealt in blocks."""
    monkeypatch.setattr(minmax, "GROUP", group)
    monkeypatch.setattr(minmax, "ITEMS", items)
    monkeypatch.setattr(minmax, "TURNS", turns)
    if group < 100:
        monkeypatch.setattr(minmax, "LEVELS", ((4, 32), (6, 64)))
    rows = corpus()
    found = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(plain_components(rows))


def test_signature_agrees_with_similarity():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 63, 3000, np.uint64))
    signer = minmax.Signer(16, 512)
    x, y = pool[:1800], pool[600:2400]
    agree = (signer.values(x) == signer.values(y)).mean()
    assert agree == pytest.approx(0.5, abs=0.03)
    assert (signer.values(x)[:128] == minmax.Signer(*minmax.LEVELS[0]).values(x)).all()
    assert signer.values(x)[0] == (x * signer.times[0] + signer.plus[0]).min() and signer.values(x)[1] == (x * signer.times[0] + signer.plus[0]).max()


def test_pieces_give_a_spanning_forest():
    pieces = minmax._Pieces(np.arange(6), np.array([10, 10, 12, 13, 14, 15]))
    pieces.join(2, np.array([3]))
    pieces.join(0, np.array([3, 0]))
    pieces.join(5, np.array([], int))
    assert [x.tolist() for x in pieces.links()] == [[12, 13], [10, 10]]


def test_odd_rows(odd_docs, no_docs, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = minmax.near_duplicates(odd_docs)
    assert got.columns == ["doc_id", "n_shingles", "component"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_components(rows)))
    assert minmax.near_duplicates(no_docs).count() == 0
    blank = spark.createDataFrame([(None, None), (None, ""), (3, " \n"), (4, "\t")], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, minmax.near_duplicates(blank).collect()))) == ["(3, 0, 3)", "(4, 0, 4)", "(None, 0, None)", "(None, 0, None)"]
    with pytest.raises(ValueError):
        minmax.near_duplicates(no_docs, percent=70)


def test_only_by_either_join(spark):
    rows, ids = spark.range(100), spark.range(3, 7)
    for most in (10, 0):
        assert sorted(r[0] for r in minmax.only(rows, "id", ids, most).collect()) == [3, 4, 5, 6]


def test_registered_query(oracle):
    assert oracle("op12_minmax_near_dedup") == 200

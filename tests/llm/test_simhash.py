"""SimHash near-dedup against brute force."""

import random
import re

import numpy as np
import pytest
from sieve.llm import simhash
from sieve.llm.graph import components


def plain_simhash(text):
    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    pieces = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, max_bits=3):
    """Smallest id reachable, from {id: set of fingerprints}."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if any((x ^ y).bit_count() <= max_bits for x in prints[a] for y in prints[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    texts = ["", None, " \t\n", "a", "A b", "Ä ß ç", "one Two three", "x y z w v", "same same same same same same"]
    texts += [" ".join(rng.choice(["the", "of", "And", "x1", "É"]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    for t in texts:
        assert simhash.simhash(t) & (1 << 64) - 1 == plain_simhash(t)


def test_long_texts_are_hashed_in_blocks():
    text = " ".join(f"w{k}" for k in range(40_000))
    assert simhash.simhash(text) & (1 << 64) - 1 == plain_simhash(text)


def test_golay_code_is_perfect():
    low, high, error, _ = simhash.golay_tables()
    assert len(set(error.tolist())) == 2048 and max(int(e).bit_count() for e in error) == 3
    words = np.arange(1 << 23, dtype=np.int64)[:: 997]
    code = words ^ error[low[words & 0xFFF] ^ high[words >> 12]].astype(np.int64)
    assert not (low[code & 0xFFF] ^ high[code >> 12]).any()


def test_keys_meet_for_every_pair_within_three_bits():
    tables, rng = simhash.golay_tables(), np.random.default_rng(3)
    a = rng.integers(-2 ** 63, 2 ** 63 - 1, 150, dtype=np.int64)
    for bits in range(4):
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, bits, replace=False):
                b[i] ^= np.uint64(1 << int(bit)).astype(np.int64)
        sides = []
        for f in (a, b):
            by = [(set(), set()) for _ in f]
            for key, side, row in zip(*simhash.key_rows(f, tables)):
                for s in (0, 1):
                    if side >> s & 1:
                        by[row][s].add(int(key))
            sides.append(by)
        for x, y in zip(*sides):
            assert x[0] & y[1] and y[0] & x[1]


def test_group_links_connect_as_all_pairs_do():
    rng = np.random.default_rng(5)
    for _ in range(20):
        center = rng.integers(-2 ** 62, 2 ** 62, 3)
        fps = np.unique([int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in center for _ in range(30)])
        a, b = simhash.linked_in_group(fps.astype(np.int64), 3)
        want = plain_components({int(f): {int(f) & (1 << 64) - 1} for f in fps})
        root = {int(f): int(f) for f in fps} | {int(x): int(y) for x, y in zip(a, b)}
        assert root == want


@pytest.mark.parametrize("bound", [simhash.GROUP, 300, 40])
def test_crowded_groups_are_split(spark, bound):
    """Fingerprints equal in bits 0 to 42 and free above, near ones among them, meet under
    common keys: no task compares more than the bound, and no link is lost."""
    rng = np.random.default_rng(6)
    free = rng.choice(1 << 21, 1500, replace=False).astype(np.int64)
    near = free[:400] ^ (1 << rng.integers(0, 21, 400)) ^ (1 << rng.integers(0, 21, 400))
    fps = np.unique(np.concatenate([free, near]) << 43 | 0x3A5A5A5A5A5)
    want = plain_components({int(f): {int(f) & (1 << 64) - 1} for f in fps})
    table = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    links = simhash.near_links(table, bound=bound)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    groups = {}
    for f, root in want.items():
        groups.setdefault(root, set()).add(f)
    got = {}
    for f in want:
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert links.where("a <= b").count() == 0 and links.count() < 40 * len(fps)


def test_tasks_pass_on_what_is_over_the_bound():
    """Rows of a crowded key go on as they come, over batch ends too; others are compared."""
    import pyarrow as pa

    key = np.repeat([1, 2, 3], [2, 50, 3])
    fp = np.arange(len(key)) * 1_000_003 + 5
    fp[1], fp[-1] = fp[0] ^ 1, fp[-2] ^ 3
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), 3, np.int8)), pa.array(fp)], ["key", "side", "fp"])
    for size in (1, 7, 100):
        out = pa.Table.from_batches(list(simhash._link_groups(3, 10)(batch.slice(k, size) for k in range(0, len(batch), size)))).to_pandas()
        assert sorted(out[out.large].a) == fp[key == 2].tolist() and set(out[out.large].b) == {2}
        assert sorted(zip(out[~out.large].a, out[~out.large].b)) == sorted([(max(fp[:2]), min(fp[:2])), (max(fp[-2:]), min(fp[-2:]))])


def test_three_bits_leave_a_key_equal():
    rng = np.random.default_rng(8)
    for _ in range(200):
        bits = int(rng.integers(1, 1 << 62))
        ones = [k for k in range(64) if bits >> k & 1]
        wrong = sum(1 << int(k) for k in rng.choice(ones, min(3, len(ones)), replace=False))
        assert any(wrong & m == 0 for m in simhash.varying_masks(bits))


def test_components_of_chains_stars_and_nulls(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (200, None), (300, 301)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(got) == len(rows)
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark, docs):
    rng = random.Random(2)
    base = [r["text"] for r in docs.limit(40).collect()]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(120):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 - k, " ".join(words)))
    rows += [(5000, ""), (5001, None), (5002, " \n")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_components({i: {plain_simhash(t)} for i, t in rows})
    assert {r["doc_id"]: r["component"] for r in found} == want and len(found) == len(rows)
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in found} == {i: plain_simhash(t) for i, t in rows}


def test_odd_rows(spark, odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs)
    assert found.columns == ["doc_id", "fp", "component"] and found.count() == odd_docs.count()
    by = {(r["doc_id"], r["fp"]): r["component"] for r in found.collect()}
    assert by[3, 0] == by[4, 0] == 3
    assert {c for (i, _), c in by.items() if i in (1, 2, None)} == {1} and {c for (i, _), c in by.items() if i in (5, 6)} == {5}
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert simhash.near_duplicates(no_docs).count() == simhash.drop_near_duplicates(no_docs).count() == 0


def test_ids_with_several_texts(spark):
    """Each text is judged by its own component; every component keeps one row."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(5, a), (7, a), (3, b), (5, b), (8, c), (8, d), (8, d), (9, d), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in simhash.drop_near_duplicates(docs).collect()), key=repr)
    assert kept == sorted([(5, a), (3, b), (8, c), (8, d), (None, a), (None, a)], key=repr)


def test_registered_query(spark):
    from sieve.llm import queries

    rows = queries.QUERIES["op8_simhash_near_dedup"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "fingerprint", "component_id"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = plain_components({i: {plain_simhash(t)} for i, t in texts.items()})
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows.collect()} == {(i, f"{plain_simhash(t):016x}", want[i]) for i, t in texts.items()}

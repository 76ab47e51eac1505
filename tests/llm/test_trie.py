"""Double arrays and the conversation prefix trie."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from sieve.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_turns(rows):
    """{conv_id: [(role, text)]} in order."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            pair = role or "", text or ""
            key = hashlib.md5(f"{len(pair[0])}:{pair[0]}{pair[1]}".encode()).digest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, key, pair))
    return {c: [t[3] for t in sorted(ts)] for c, ts in convs.items()}


def plain_rebuilt(convs):
    made = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return made


def plain_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)

    def total(path):
        below = [total(k) for k in kids.get(path, [])]
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        return sum(b[0] for b in below) + (not below), sum(b[1] for b in below) + own

    rows = []
    for path, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(path))))
        rows.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids.get(path, [])), *total(path),
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, rows))


def conversations(seed=5):
    """A first turn that a third has, whole copies, and shared beginnings of any length."""
    rng, rows = random.Random(seed), []
    for c in [*range(0, 260), 1000, 1001, 2305, 10 ** 12]:
        kind = rng.random()
        start = ["hello"] if kind < 0.35 else ["copy", "of", "a", "whole"] if kind < 0.5 else []
        turns = start + [rng.choice("abcde") * rng.randrange(4) for _ in range(0 if len(start) == 4 else rng.randrange(1, 9))]
        rows += [(c, k, rng.choice(["user", "assistant"]) if k > 1 else "user", t) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("crowd, shard_rows", [(None, None), (3, 20), (1, 5)])
@pytest.mark.parametrize("form", ["whole", "rebuilt"])
def test_nodes_equal_plain_ones(spark, crowd, shard_rows, form):
    rows = conversations()
    turns = trie.numbered(spark.createDataFrame(rows, SCHEMA))
    got = trie.prefix_nodes(*getattr(trie, form)(turns), crowd=crowd, shard_rows=shard_rows)
    assert got.columns == COLUMNS
    convs = plain_turns(rows)
    assert sorted(map(repr, map(tuple, got.collect()))) == plain_nodes(convs if form == "whole" else plain_rebuilt(convs))


def test_odd_rows(spark):
    """Nulls in every column, ties, repeated rows, empty texts, a long conversation, turnless
    rebuilt conversations (101 has none of its own after those it would take), clashing names."""
    rows = [(1, None, None, None), (1, 2, "user", None), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, None, "user", ""), (None, 1, "user", "lost"),
            (101, 0, "user", "x"), (-5, 0, "user", "n"), (-5, 1, None, "m"), (-5, 1, "a", "m"), (0, 0, "user", "é\U0001f600"), (300, 7, "r", "t" * 50_000)]
    rows += [(500, k, "user", f"turn {k}") for k in range(1500)] + [(700 + k, 0, "user", "same") for k in range(3)]
    made = spark.createDataFrame([(*r, k, "x", k, True, b"k") for k, r in enumerate(rows)],
                                 SCHEMA + ", depth long, path string, n_convs long, upper boolean, key binary")
    convs = plain_turns(rows)
    for form, want in (("whole", convs), ("rebuilt", plain_rebuilt(convs))):
        some = {c: t for c, t in want.items() if len(t) < 900}  # the plain version's recursion
        got = trie.prefix_nodes(*getattr(trie, form)(trie.numbered(made.where("conv_id is null or conv_id <> 500"))), crowd=2)
        assert sorted(map(repr, map(tuple, got.collect()))) == plain_nodes({c: t for c, t in some.items() if c != 500})
    assert any(not t for t in plain_rebuilt(convs).values())
    long = trie.prefix_nodes(*trie.whole(trie.numbered(made.where("conv_id = 500")))).collect()
    assert len(long) == 1501 and {r["n_leaves"] for r in long} == {1} and {r["saved_tokens"] for r in long} == {0}
    assert trie.prefix_nodes(*trie.rebuilt(trie.numbered(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_ends_in_pieces(spark, monkeypatch):
    """Many equal conversations: their ids are hashed over pieces from several tasks."""
    monkeypatch.setattr(trie, "PIECE", 10)
    rows = [(c, 0, "user", "same") for c in range(3000)]
    got = trie.prefix_nodes(*trie.whole(trie.numbered(spark.createDataFrame(rows, SCHEMA)))).collect()
    want = hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    assert sorted((r["depth"], r["n_convs"], r["ends_sha256"] == want) for r in got) == [(0, 3000, False), (1, 3000, True)]


def test_double_array_holds_just_its_sequences():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 7, 400)
    seq = np.repeat(np.arange(400), lengths)
    depth = np.concatenate([np.arange(1, n + 1) for n in lengths])
    code = np.where(rng.random(len(seq)) < 0.7, rng.integers(1, 6, len(seq)), rng.integers(1, 900, len(seq)))
    code[seq < 300] = np.where(depth[seq < 300] == 1, seq[seq < 300] + 1, code[seq < 300])  # a root with many children
    array, reached = trie.pack(seq, depth, code)
    paths = {}
    for s in range(400):
        own, state = tuple(code[seq == s]), 0
        for d in range(1, len(own) + 1):
            state = int(array.step(np.array([state]), np.array([own[d - 1]]))[0])
            assert paths.setdefault(own[:d], state) == state == reached[seq == s][d - 1]
    assert len(set(paths.values())) == len(paths) == (array.check >= 0).sum()  # a slot for each node, no others
    for path, state in list(paths.items())[:200]:
        for c in (1, 2, 3, 4, 5, 77, 899, 5000):
            assert (array.step(np.array([state]), np.array([c]))[0] >= 0) == ((*path, c) in paths)
    assert array.top < 2.5 * len(paths)


def test_registered_query(oracle):
    assert oracle("op11_conversation_trie") > 40

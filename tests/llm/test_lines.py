"""Reversible line dedup: cuckoo filters, the index, and the registered query."""

import random

import pytest
from sieve.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def plain_key(line, min_chars=20):
    key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    return key if len(key) >= min_chars else None


def plain_clean(rows, min_docs=3):
    """{id: kept text} for rows with distinct ids."""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if plain_key(line):
                holders.setdefault(plain_key(line), set()).add(i)
    out = {}
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not ((k := plain_key(x)) and len(holders[k]) >= min_docs and max(holders[k]) != i)]
        out[i] = "\n".join(kept)
    return out


def made_rows(n=60, seed=1):
    rng = random.Random(seed)
    common = ["A line that many documents have", "  a LINE that many documents have\t", "zwölf große Wörter für ähnliche Zeilen", "short", ""]
    return [(k, "\n".join(rng.choice([*common, f"only document {k} has this line {j}"]) for j in range(rng.randrange(0, 7)))) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def cleaned(index, docs, **options):
    return {r["doc_id"]: r["text"] for r in index.clean(docs, **options).collect()}


def keys(n, seed=0):
    return [random.Random(f"{seed} {k}").randbytes(16) for k in range(n)]


@pytest.mark.parametrize("load", [0.3, 1.3])
def test_cuckoo_filter_never_forgets(load):
    cuckoo = lines.Cuckoo.sized(500)
    mine = keys(int(load * cuckoo.table.size))
    cuckoo.insert(mine)
    assert cuckoo.may_have(mine).all() and bool(cuckoo.stash) == (load > 1)
    again = lines.Cuckoo.load(cuckoo.dump())
    assert again.may_have(mine).all() and again.stash == cuckoo.stash
    assert again.may_have(keys(4000, 1)).mean() < 0.01
    gone, stay = mine[::2], mine[1::2]
    again.delete(gone)
    assert again.may_have(stay).all() and again.may_have(gone).mean() < 0.05
    again.insert(gone)
    assert again.may_have(mine).all()
    again.delete(mine)
    assert not again.table.any() and not again.stash


def test_line_keys():
    same = {lines.line_key(x.encode(), 20) for x in ("Twelve ÄÖÜ characters", " \t\rtWELVE ÄÖÜ CHARACTERS\x0b\x0c ")}
    assert len(same) == 1 and None not in same
    assert lines.line_key(b"x" * 19, 20) is None and lines.line_key(b"x" * 20, 20)
    assert lines.line_key("ü".encode() * 19, 20) is None and lines.line_key("ü".encode() * 20, 20)
    assert lines.line_key(" ".encode() * 20, 20)  # other white space is not stripped
    assert lines.line_key(b"", 20) is None


def test_clean_matches_brute_force(spark):
    rows = made_rows()
    assert cleaned(lines.LineIndex.build(frame(spark, rows)), frame(spark, rows), indexed=True) == plain_clean(rows)


def test_insert_and_delete_are_reversible(spark):
    rows, more = made_rows(20), [(100 + i, t) for i, t in made_rows(25, 2)]
    first = lines.LineIndex.build(frame(spark, rows))
    second = first.insert(frame(spark, more))
    assert cleaned(second, frame(spark, rows + more)) == plain_clean(rows + more)
    gone = [i for i, _ in more] + [0, 1]
    third = second.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
    left = [r for r in rows if r[0] > 1]
    assert cleaned(third, frame(spark, left)) == plain_clean(left)
    back = third.insert(frame(spark, rows[:2])).insert(frame(spark, rows[:2]))
    assert cleaned(back, frame(spark, rows)) == plain_clean(rows)
    for name in ("counts", "refs"):
        assert sorted(map(repr, back.part(name).collect())) == sorted(map(repr, first.part(name).collect()))
    assert cleaned(first, frame(spark, rows)) == plain_clean(rows)  # the old generation still stands


def test_filters_only_spare_work(spark, monkeypatch):
    rows = made_rows(40, 3)
    index = lines.LineIndex.build(frame(spark, rows))
    refs = index.part("refs")
    asked = index.maybe_repeated(refs)
    repeated = {bytes(r["key"]) for r in index.part("counts").where("n_docs >= 3").collect()}
    assert repeated <= {bytes(r["key"]) for r in asked.select("key").distinct().collect()} and asked.count() < refs.count()
    want = sorted(map(repr, asked.collect()))
    monkeypatch.setattr(lines, "FILTER_BYTES", 0)
    for part_rows in (1_000_000, 5):  # rows dealt to the filters, hot shards in parts
        monkeypatch.setattr(lines, "PART_ROWS", part_rows)
        assert sorted(map(repr, index.maybe_repeated(refs).collect())) == want
    assert cleaned(index, frame(spark, rows), indexed=True) == plain_clean(rows)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)
    rows = [(k, "\n".join(f"repeated line number {j} of this test" for j in range(30))) for k in range(4)]
    index = lines.LineIndex.build(frame(spark, rows))
    assert index.part("filters").count() > 4
    assert cleaned(index, frame(spark, rows)) == plain_clean(rows)
    monkeypatch.setattr(lines, "FILTER_BYTES", 0)
    monkeypatch.setattr(lines, "PART_ROWS", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert cleaned(index, frame(spark, rows)) == plain_clean(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(odd_docs.withColumnsRenamed({}).selectExpr("doc_id + 100 AS doc_id", *[f"`{c}`" for c in odd_docs.columns[1:]]))
    out = lines.drop_repeated_lines(docs, n_lines="n_lines", n_dropped="n_dropped")
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"] and out.count() == docs.count()
    base = "one two three four five six seven eight nine ten eleven twelve"
    # documents 1, 2, null, 9 and 101, 102, 109 hold the base line; the null ids are one document
    for r in out.where(out.text.contains(base)).collect():
        assert r["doc_id"] == 109
    assert {(r["n_lines"], r["n_dropped"], r["text"]) for r in out.where("doc_id IN (3, 4)").collect()} == {(1, 0, "")}
    assert lines.drop_repeated_lines(no_docs).count() == 0


def test_registered_query(oracle):
    assert oracle("op4_line_dedup") == 200

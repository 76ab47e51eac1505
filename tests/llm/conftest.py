import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    """The fixtures are small: fewer tasks, the same plans."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def oracle(spark):
    """Compares a registered query with its DuckDB SQL at sf0.001."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")

    def same(name):
        from sieve.llm import queries

        rows = queries.QUERIES[name](spark, SF)
        want = con.execute(queries.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(rows.columns)
        got = sorted(map(repr, (tuple(r) for r in rows.select(*names).collect())))
        assert got == sorted(map(repr, want.fetchall()))
        return len(got)

    return same


@pytest.fixture()
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids with
    other texts, and extra columns whose names clash with the operators' own."""
    long_text = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, base, "en", "src0"), (1, base, "en", "src0"), (2, base, None, "src0"), (3, "", "en", None), (4, None, "en", "src1"),
            (None, base, "en", "src1"), (5, long_text, "fr", "src0"), (6, long_text, "fr", "src0"), (7, "!!! ??? ...", "de", "src1"),
            (8, "x", "en", "src1"), (8, "another text under the same id", "en", "src1"), (9, "a\n\nb\r\n \t\n" + base, "es", None)]
    made = spark.createDataFrame([(*r, len(r[1] or ""), 10 * k, f"h{k}", k, 0.5, "t", k) for k, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, key long, host string, p long, posterior double, _id string, hits long")
    return made


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Each linked node with the smallest node it reaches.

    ``links`` has two columns ``a``, ``b`` of one ordered type; null ends and
    self links are ignored.  Alternates the large-star and small-star steps
    (every node links its larger, then its smaller, neighbours to the smallest
    node around it) until nothing changes: O(log n) rounds in practice, each
    two grouped minimums and joins over links, written to the shared folder so
    that lineage stays one round deep.  Returns ``node, root``; nodes without
    links are not in it.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state, before = _write(edges), None
    for _ in range(max_rounds):
        table, seen = state
        if seen == before:
            return table.select(F.col("a").alias("node"), F.col("b").alias("root")) \
                .unionByName(table.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = seen
        both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the large star's links are read twice by the small star: write them once
        state = _write(_small_star(materialize(_large_star(both), "large-star")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(both: DataFrame) -> DataFrame:
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    joined = edges.join(least, F.col("a") == F.col("n"))
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
        .unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def _write(edges: DataFrame):
    metrics = {"n": F.count(F.lit(1)), "h": F.bit_xor(F.xxhash64("a", "b"))}
    table, seen = materialize(edges, "links", metrics)
    return table, (seen["n"], seen["h"])

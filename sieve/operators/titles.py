"""Ranked title search: the best hit of every title by weighted word overlap.

A title is the set of its words.  A word weighs ``ln(1 + titles / titles with it)`` in
thousandths, so scores are exact integers, and the score of two titles is the weight
of their common words over that of all their words.  Titles whose score reaches a
threshold are found without comparing all pairs, by a prefix filter: with words in
one global order, rarest first, two titles that reach the threshold share a word among
those after which the rest of either title could not reach it any more.  Only these
*prefix* words go into the inverted index.  Frequent words stand last in every title, so
they are probed only by titles that hold nothing rarer.  Lengths (total weights) and what
is left after the shared word bound a pair before its words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import bounded_broadcast, leading_rows, left_join_nonnull, unique_by

#: scores are in millionths
FULL = 1_000_000


def title_words(c) -> Column:
    """Sorted distinct lower-cased words (letters and digits of any script)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sort_array(F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), "")))


def title_key(c) -> Column:
    """The word set as one string; NULL for a title without words."""
    key = F.array_join(title_words(c), " ")
    return F.when(key != "", key)


def _weighed(keys: DataFrame, weights: DataFrame, top: int) -> DataFrame:
    """One row per title and word: ``key, word, w, left`` (weight from this word to the
    last in global order), ``total``, ``words`` (all, in this order)."""
    exploded = keys.select("key", F.explode(F.split("key", " ")).alias("word"))
    met = exploded.join(weights, "word", "left").withColumn("w", F.coalesce("w", F.lit(top)))
    of = Window.partitionBy("key")
    rarest = of.orderBy(F.desc("w"), "word")
    ordered = met.withColumn("total", F.sum("w").over(of)) \
        .withColumn("left", F.col("total") - F.sum("w").over(rarest) + F.col("w")) \
        .withColumn("words", F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), "word")).over(of)))
    return ordered


def _prefix(weighed: DataFrame, threshold: int, side: str) -> DataFrame:
    """The rows of prefix words: those from which on a title could still reach the
    threshold (in millionths) alone."""
    rows = weighed.where(F.col("left") * FULL >= F.col("total") * threshold)
    return rows.select("word", *[F.col(c).alias(f"{side}_{c}") for c in ("key", "left", "total", "words")])


def best_titles(queries: DataFrame, titles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The best hits of each query title: ``query, key, score``.

    ``queries`` and ``titles`` have a distinct ``key`` (:func:`title_key`).  ``score`` is
    in millionths; all keys of a query's highest score are returned, if that is
    ``threshold`` or more.  Words that no title has weigh as if one had them."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    least = round(threshold * FULL)
    table, seen = materialize(titles.select("key"), "titles", {"n": F.count(F.lit(1))})
    n = max(seen["n"], 1)
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(1.0) + F.lit(float(n)) / F.col("df"))).cast("long")
    weights, _ = bounded_broadcast(table.select(F.explode(F.split("key", " ")).alias("word")).groupBy("word")
                                   .agg(F.count(F.lit(1)).alias("df")).select("word", weight.alias("w")), name="word-weights")
    top = table.sparkSession.range(1).select(F.floor(F.lit(1000.0) * F.log(F.lit(1.0) + F.lit(float(n)))).cast("long")).head()[0]
    q = _prefix(_weighed(queries.select("key"), weights, top), least, "q")
    t = _prefix(_weighed(table, weights, top), least, "t")
    q_total, t_total = F.col("q_total"), F.col("t_total")
    # common >= threshold * (q + t - common), and common is at most what is left in either
    reach = F.least("q_left", "t_left") * (FULL + least) >= (q_total + t_total) * least
    met = q.join(t, "word").where((q_total * FULL >= t_total * least) & (t_total * FULL >= q_total * least) & reach)
    common = F.array_intersect("q_words", "t_words")
    # a pair may share several prefix words: it is scored at the first common word only
    scored = met.withColumn("common", common).where(F.col("common")[0]["word"] == F.col("word")) \
        .withColumn("both", -F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x["o"])) \
        .withColumn("score", F.floor(F.col("both") * FULL / (q_total + t_total - F.col("both"))).cast("long")) \
        .where(F.col("both") * FULL >= (q_total + t_total - F.col("both")) * least)
    pairs = scored.select(F.col("q_key").alias("query"), F.col("t_key").alias("key"), "score")
    best = pairs.groupBy("query").agg(F.max("score").alias("best"))
    return pairs.join(best, "query").where("score = best").select("query", "key", "score")


def resolve_ids_ranked(papers: DataFrame, index: DataFrame, hit_order: str = "hit_rank", threshold: float = 0.5,
                       score_col: str = "title_score") -> DataFrame:
    """Papers without DOI get identifiers from the best hit for their title in an index
    ``(title, semantic_scholar_id, doi, <hit_order>)``; ``score_col`` has the hit's score
    in millionths (NULL without one).

    Of hits with the highest score the one with the smallest ``hit_order`` wins, then by
    identifier and DOI.  Papers with a DOI, without words in the title, or without a hit
    of ``threshold`` keep their values, a missing identifier included."""
    keyed = papers.withColumn("_t", F.when(F.col("doi").isNull(), title_key("title")))
    order = F.struct(hit_order, F.coalesce("semantic_scholar_id", F.lit("")), F.coalesce("doi", F.lit("")))
    hits = leading_rows(index.select("title", "semantic_scholar_id", "doi", hit_order), "title", title_key("title"), "key", hit_order)
    values = [hit_order, "semantic_scholar_id", "doi"]
    firsts = materialize(unique_by(hits, ["key"], order, values), "title-hits")
    wanted = materialize(keyed.where("_t is not null").select(F.col("_t").alias("key")).distinct(), "title-queries")
    best = best_titles(wanted, firsts, threshold).join(firsts, "key")
    one = unique_by(best.withColumnRenamed("query", "_t"), ["_t"], order, ["semantic_scholar_id", "doi", "score"]) \
        .select("_t", F.col("semantic_scholar_id").alias("_ix_ss"), F.col("doi").alias("_ix_doi"), F.col("score").alias("_ix_score"))
    joined = left_join_nonnull(keyed, one, ["_t"])
    hit = F.col("_ix_score").isNotNull()
    own = {"semantic_scholar_id": "_ix_ss", "doi": "_ix_doi"}
    columns = [F.when(hit, F.col(own[c])).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in papers.columns if c != score_col]
    if "semantic_scholar_id" not in papers.columns:
        columns.append(F.col("_ix_ss").alias("semantic_scholar_id"))
    return joined.select(*columns, F.col("_ix_score").alias(score_col))

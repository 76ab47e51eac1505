"""Keyword screening for thousands of studies, and allow-lists as a table.

``multi.screen_many`` asks every study of a record's year for its query.  Here the
queries of all studies are one inverted index instead, which a title asks once:

1. The conjuncts of all queries (a group's pieces, of which one must occur, or a piece
   that must) are taken once each, however many studies have them.
2. Every piece is filed under one of its n-grams: the one that fewest pieces hold.  A
   title's n-grams are joined to them, and a piece counts if the title contains it.
3. A study is looked for under its rarest conjunct, by the number of titles that have
   it; its year range and venue types are checked there, and then that the record has
   the study's other conjuncts too.
4. Only such pairs meet the whole query.

Titles are not shuffled for 1 to 3 while the index is below the broadcast limit; what is
shuffled are record ids with conjunct ids.  Studies whose query accepts everything have
no conjunct and meet the records of their years, as those pairs are their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.venue import prefix_any_expr, rank_valid
from ..functions.cnf import match_compiled_expr
from ..session import materialize
from .joins import bounded_broadcast
from .multi import STUDY_COLUMNS, _split_keep, limit_per_study, study_queries, study_years
from .ranks import lookup_ranks
from .screening import PAPER_COLUMNS

#: characters of the n-grams that pieces are filed under (shorter pieces: themselves)
GRAM = 4
#: indexes of at most so many n-grams are asked for each of them in the row
FEW_GRAMS = 64


def _grams(text: Column, n: Column) -> Column:
    """Distinct substrings of ``n`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, n)))


def conjuncts(studies: DataFrame) -> DataFrame:
    """``study_id, conjunct, pieces``: what each study's query needs, conjuncts that hold
    the empty piece (always true) left out.  Equal conjuncts have equal numbers."""
    q = studies.select("study_id", F.concat(F.col("_q.any_of"), F.transform("_q.all_of", lambda p: F.array(p))).alias("all"))
    one = q.select("study_id", F.explode("all").alias("pieces")).where(~F.array_contains("pieces", ""))
    return one.select("study_id", F.array_sort(F.array_distinct("pieces")).alias("pieces")) \
        .select("study_id", F.xxhash64("pieces").alias("conjunct"), "pieces").distinct()


def piece_index(needed: DataFrame, gram: int = GRAM) -> DataFrame:
    """``gram, piece, conjuncts``: every piece under the n-gram that fewest pieces hold
    (ties: the least)."""
    pieces = needed.select("conjunct", F.explode("pieces").alias("piece")).groupBy("piece").agg(F.collect_set("conjunct").alias("conjuncts"))
    pieces = pieces.withColumn("gram", F.explode(_grams(F.col("piece"), F.least(F.char_length("piece"), F.lit(gram)))))
    held = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    chosen = pieces.join(held, "gram").groupBy("piece").agg(F.min(F.struct("n", "gram")).alias("c"), F.first("conjuncts").alias("conjuncts"))
    return chosen.select("c.gram", "piece", "conjuncts")


def conjunct_hits(records: DataFrame, index: DataFrame) -> DataFrame:
    """``rec_id, year, key, hits``: the conjuncts that each title satisfies (rows without
    any are left out)."""
    table, _ = bounded_broadcast(index, name="piece-index")
    low = records.select("rec_id", "year", "key", F.lower("title").alias("low"))
    none = F.array().cast("array<string>")
    few = [r[0] for r in table.select("gram").where("gram IS NOT NULL").distinct().limit(FEW_GRAMS + 1).collect()]
    if len(few) <= FEW_GRAMS:
        # a title's n-grams that the index lacks are neither made nor joined
        held = F.filter(F.array(*map(F.lit, sorted(few))).cast("array<string>"), lambda g: F.col("low").contains(g))
    else:
        lengths = sorted(r[0] for r in table.select(F.char_length("gram")).distinct().collect())  # GRAM at most
        held = F.concat(none, *[F.when(F.char_length("low") >= n, _grams(F.col("low"), F.lit(n))).otherwise(none) for n in lengths])
    asked = low.withColumn("gram", F.explode(held))
    met = asked.join(table, "gram").where(F.col("low").contains(F.col("piece")))
    return met.select("rec_id", "year", "key", F.explode("conjuncts").alias("conjunct")).groupBy("rec_id", "year", "key") \
        .agg(F.collect_set("conjunct").alias("hits"))


def matching_pairs(records: DataFrame, queries: DataFrame) -> DataFrame:
    """``rec_id, study_id`` of records of a study's years and venue types that have every
    conjunct of its query.  ``queries`` are rows of ``multi.study_queries`` that have
    conjuncts."""
    needed = materialize(conjuncts(queries), "conjuncts")
    hits = materialize(conjunct_hits(records, piece_index(needed)), "conjunct-hits")
    titles = hits.select(F.explode("hits").alias("conjunct")).groupBy("conjunct").agg(F.count(F.lit(1)).alias("titles"))
    # a conjunct without titles rules its studies out
    of = needed.join(titles, "conjunct", "left").groupBy("study_id").agg(
        F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "conjunct")).alias("rarest"), F.collect_set("conjunct").alias("needs"))
    seeds, _ = bounded_broadcast(queries.select("study_id", "_types", "_lo", "_hi").join(of.where("rarest.titles > 0"), "study_id")
                                 .select("study_id", "_types", "_lo", "_hi", F.col("rarest.conjunct").alias("conjunct"), "needs"), name="seeds")
    found = hits.withColumn("conjunct", F.explode("hits")).join(seeds, "conjunct")
    return found.where(F.col("year").between(F.col("_lo"), F.col("_hi")) & prefix_any_expr("key", "_types")
                       & (F.size(F.array_except("needs", "hits")) == 0)).select("rec_id", "study_id")


def indexed_candidates(records: DataFrame, studies: DataFrame, batch_size: int | None = None) -> DataFrame:
    """The rows of ``multi.multi_candidates`` by the index, where ``rec_id`` is unique."""
    missing = [c for c in STUDY_COLUMNS if c not in studies.columns]
    if missing:
        raise ValueError(f"studies table lacks columns {missing}")
    queries, seen = materialize(study_queries(studies.where(F.col("year_min") <= F.col("year_max"))), "study-queries",
                                {"lo": F.min("_lo"), "hi": F.max("_hi")})
    if seen.get("lo") is not None:
        records = records.where(F.col("year").between(int(seen["lo"]), int(seen["hi"])))
    free = F.forall(F.concat("_q.any_of", F.transform("_q.all_of", lambda p: F.array(p))), lambda c: F.array_contains(c, ""))
    pairs, _ = bounded_broadcast(matching_pairs(records, queries.where(~free)), name="matching-pairs")
    side, _ = bounded_broadcast(queries.where(~free).drop("_lo", "_hi"), name="queries")
    years, _ = bounded_broadcast(study_years(queries.where(free)), name="study-years")
    # only the pairs found meet a whole query
    found = records.join(pairs, "rec_id").join(side, "study_id").where(match_compiled_expr("title", "_q"))
    every = records.join(years, "year").where(prefix_any_expr("key", "_types") & match_compiled_expr("title", "_q"))
    return limit_per_study(found.unionByName(every), batch_size)


# --- allow-lists as a table ---------------------------------------------------------
def allow_rows(studies: DataFrame) -> DataFrame:
    """``study_id, prefix`` rows of the studies' own allow-lists."""
    return studies.select("study_id", F.explode("manually_accepted_venue_codes").alias("prefix")).where("prefix IS NOT NULL")


def _lengths(allow: DataFrame) -> list[int]:
    """Distinct lengths of the prefixes: as many as the longest has characters, at most."""
    return sorted(r[0] for r in allow.select(F.char_length("prefix")).distinct().collect())


def _prefixes(text: Column, lengths: list[int], longest: Column) -> Column:
    return F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= longest), lambda n: F.substring(text, F.lit(1), n))


def least_prefixes(allow: DataFrame) -> DataFrame:
    """The rows whose prefix doesn't start with another of the same study: a key starts with
    one of a study's rows at most, and with one exactly if it started with any before."""
    rows = materialize(allow.select("study_id", "prefix").where("study_id IS NOT NULL AND prefix IS NOT NULL").distinct(), "allow")
    shorter = rows.select("study_id", "prefix", F.explode(_prefixes(F.col("prefix"), _lengths(rows), F.char_length("prefix") - 1)).alias("head"))
    held = shorter.join(rows.select("study_id", F.col("prefix").alias("head")), ["study_id", "head"], "left_semi").select("study_id", "prefix")
    return rows.join(held, ["study_id", "prefix"], "left_anti")


def gate_by_table(ranked: DataFrame, allow: DataFrame, missing_passes: bool = True) -> DataFrame:
    """Rows of ``ranked`` (``study_id``, ``key``, ``venue_rank``, ``_th``) that pass the rank
    threshold or whose key starts with one of the study's prefixes in ``allow``
    (``study_id, prefix``).

    The prefixes of a key, of the lengths that occur, are joined to the table by equality, so
    a list of any length costs a key no more than a short one; no row is compared with a
    list.  Rows the rank accepts are not joined."""
    rows, _ = bounded_broadcast(least_prefixes(allow), name="allow-least")
    lengths = _lengths(rows)
    ok = F.coalesce(rank_valid("venue_rank", F.col("_th"), missing_passes), F.lit(False))
    heads = _prefixes(F.col("key"), lengths, F.char_length("key")) if lengths else F.array().cast("array<string>")
    listed = ranked.where(~ok).withColumn("prefix", F.explode(heads)).join(rows, ["study_id", "prefix"], "left_semi")
    return ranked.where(ok).unionByName(listed.select(*ranked.columns))


def screen_indexed(records: DataFrame, studies: DataFrame, rank_table: DataFrame, *, batch_size: int | None = None,
                   missing_passes: bool = True, allow: DataFrame | None = None) -> DataFrame:
    """The rows of ``multi.screen_many`` by the index; ``allow`` (``study_id, prefix``) takes
    the place of the allow-lists in ``studies``."""
    cands = materialize(indexed_candidates(records, studies, batch_size), "indexed-candidates")
    ranked = lookup_ranks(_split_keep(cands), rank_table)
    return gate_by_table(ranked, allow_rows(studies) if allow is None else allow, missing_passes).select(*PAPER_COLUMNS)

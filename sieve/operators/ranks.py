"""Venue rank tables: extraction from rank pages, and the rank lookup join.

Rank pages are HTML search-result pages with one table: a header row, then
rows whose cells are title (0), acronym (1), source (2) and rank (3).
Conference ranks are looked up by acronym, journal ranks by title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import table_cells
from ..functions.text import py_strip
from ..functions.venue import parse_rank, rank_kind
from .joins import bounded_broadcast, unique_by

# cell holding the lookup key, per kind of rank page
KEY_CELL = {"conference": 1, "journal": 0}
RANK_CELL = 3


def rank_rows(pages: DataFrame, kind, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Data rows of the first table of each page →
    ``(kind, lookup_key, page_id, pos, rank_text)``; cell texts are the
    stripped text content.  ``pos`` counts rows after the header (from 1).
    Rows with fewer than four cells are skipped.  Tables in cells count as part
    of the first table: their rows are rows, and their cells cells, too.

    ``kind`` is ``"conference"`` / ``"journal"`` for pages of one kind, or a
    Column naming each page's kind, so mixed pages are read in one pass."""
    if isinstance(kind, str):
        if kind not in KEY_CELL:
            raise ValueError(f"kind must be one of {sorted(KEY_CELL)}")
        kind_col = F.lit(kind)
    else:
        kind_col = kind
    exploded = pages.select(kind_col.alias("_kind"), F.col(page_id).cast("bigint").alias("page_id"),
                            F.posexplode(table_cells(html)).alias("pos", "cells")).where(F.col("pos") >= 1)
    with_cells = exploded \
        .where(F.size("cells") > RANK_CELL).where(F.col("_kind").isin(*KEY_CELL))

    def cell(i):
        return py_strip(F.col("cells")[i])

    key_idx = F.when(F.col("_kind") == "conference", F.lit(KEY_CELL["conference"])) \
        .otherwise(F.lit(KEY_CELL["journal"]))
    return with_cells.select(
        F.col("_kind").alias("kind"),
        py_strip(F.element_at("cells", key_idx + 1)).alias("lookup_key"),
        "page_id",
        F.col("pos").cast("int").alias("pos"),
        cell(RANK_CELL).alias("rank_text"),
    )


def rank_dimension(rank_table: DataFrame) -> DataFrame:
    """One row per ``(kind, lower(lookup_key))``: the first row's rank (page
    order, then row order), parsed to a rank name."""
    keyed = rank_table.select("kind", F.lower("lookup_key").alias("lkey"), "rank_text",
                              F.struct("page_id", "pos").alias("_order"))
    first = unique_by(keyed, ["kind", "lkey"], "_order", ["rank_text"])
    return first.select("kind", "lkey", parse_rank("rank_text").alias("venue_rank"))


def lookup_ranks(papers: DataFrame, rank_table: DataFrame, max_broadcast_rows: int | None = None) -> DataFrame:
    """Attach ``venue_rank`` to papers: case-insensitive match of the venue code
    in the table of its type (``conf`` → conference, ``journals`` → journal);
    other types and codes not found get ``MISSING``.

    The dimension is reduced to one row per key first; it is broadcast when its
    size check passes, else joined by shuffle (AQE splits skewed codes)."""
    dim = rank_dimension(rank_table)
    dim, _ = bounded_broadcast(dim, max_broadcast_rows)
    keyed = papers.withColumn("_kind", rank_kind("venue_type")).withColumn("_lkey", F.lower("venue_code"))
    joined = keyed.join(dim, (keyed["_kind"] == dim["kind"]) & (keyed["_lkey"] == dim["lkey"]), "left")
    out_cols = [c for c in papers.columns if c != "venue_rank"]
    return joined.select(*[keyed[c] for c in out_cols],
                         F.coalesce(dim["venue_rank"], F.lit("MISSING")).alias("venue_rank"))


def code_rank_table(ranks: DataFrame, kind: str = "conference", code: str = "venue_code",
                    rank_text: str = "rank_text") -> DataFrame:
    """A plain ``(code, rank text)`` table in rank-table form (one page)."""
    return ranks.select(F.lit(kind).alias("kind"), F.col(code).alias("lookup_key"),
                        F.lit(0).cast("bigint").alias("page_id"), F.lit(1).alias("pos"),
                        F.col(rank_text).alias("rank_text"))

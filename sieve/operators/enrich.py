"""Enrichment joins: identifiers, metadata, abstract fallback, known papers.

Each lookup side is reduced to one row per key before the join
(``unique_by``: a partial aggregate, so a hot key is pre-reduced in every map
task), papers with a NULL key never meet the shuffle on a single reducer
(``left_join_nonnull``), and small sides are broadcast only after a size
check.  All joins are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_WS
from .abstracts import extract_abstracts
from .joins import bounded_broadcast, leading_rows, left_join_nonnull, unique_by


def normalize_title(c) -> Column:
    """Lower case, blanks collapsed to one space, ends stripped (exact-title
    lookup key).  After collapsing, the only blank left at either end is a
    single space, so ``trim`` finishes the strip.  Titles whose only blanks are
    single spaces, most of them, have nothing to collapse."""
    col = F.col(c) if isinstance(c, str) else c
    odd = col.contains("  ") | col.rlike(PY_WS.replace(" ", ""))
    return F.lower(F.trim(F.when(odd, F.regexp_replace(col, f"{PY_WS}+", " ")).otherwise(col)))


def resolve_ids(papers: DataFrame, index: DataFrame, hit_order: str = "hit_rank", cut: bool = False) -> DataFrame:
    """Papers without DOI get an identifier from a title index
    ``(title, semantic_scholar_id, doi, <hit_order>)``: the first hit for the
    normalised title sets ``semantic_scholar_id`` and ``doi``.  Papers that
    have a DOI, or whose title has no hit, keep their values.

    ``cut=True`` first cuts the index to the titles that are looked up
    (semi-join on the key, so the per-title reduction only sees needed
    titles).  Use it when ``papers`` is materialised (the review run writes
    its papers first): the needed titles are then a cheap read, not a second
    evaluation of the papers' plan."""
    keyed = papers.withColumn("_t", F.when(F.col("doi").isNull(), normalize_title("title")))
    needed = None
    if cut:
        needed, _ = bounded_broadcast(keyed.where(F.col("_t").isNotNull()).select("_t").distinct(), name="needed-titles")
    hits = index.select("title", "semantic_scholar_id", "doi", hit_order)
    idx = leading_rows(hits, "title", normalize_title("title"), "_t", hit_order, needed)
    # equal hit orders are broken by the hit's own values, so the pick is
    # deterministic
    order = F.struct(hit_order, F.coalesce("semantic_scholar_id", F.lit("")), F.coalesce("doi", F.lit("")))
    first = unique_by(idx, ["_t"], order, ["semantic_scholar_id", "doi"]) \
        .withColumnRenamed("semantic_scholar_id", "_ix_ss").withColumnRenamed("doi", "_ix_doi")
    joined = left_join_nonnull(keyed, first, ["_t"], broadcast_right=True)
    cols = []
    for c in papers.columns:
        if c == "semantic_scholar_id":
            cols.append(F.when(F.col("doi").isNull(), F.col("_ix_ss")).otherwise(F.col(c)).alias(c))
        elif c == "doi":
            cols.append(F.when(F.col("doi").isNull(), F.col("_ix_doi")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols)


META_VALUES = ["abstract", "tldr", "is_open_access", "pdf_url", "citations", "influential_citations", "meta_id"]


def _meta_lookup(meta: DataFrame, needed: DataFrame | None = None) -> DataFrame:
    """Metadata keyed both ways in one table: ``s:<id>`` and ``d:<doi>``, one
    row per key (first by value order), so papers need a single join.  With
    ``needed`` (a ``_key`` column) the keyed rows are cut to those keys by a
    semi-join before the per-key reduction."""
    vals = [F.col(v) for v in META_VALUES if v != "meta_id"] + [F.col("semantic_scholar_id").alias("meta_id")]
    by_ss = meta.where(F.col("semantic_scholar_id").isNotNull()).select(
        F.concat(F.lit("s:"), F.col("semantic_scholar_id")).alias("_key"), *vals)
    by_doi = meta.where(F.col("doi").isNotNull()).select(F.concat(F.lit("d:"), F.col("doi")).alias("_key"), *vals)
    keyed = by_ss.unionByName(by_doi)
    if needed is not None:
        keyed = keyed.join(needed, "_key", "left_semi")
    return unique_by(keyed, ["_key"], F.struct(*[F.col(v) for v in META_VALUES]), META_VALUES)


def lookup_key(ss, doi) -> Column:
    """``s:<id>`` when the paper has an id, else ``d:<doi>`` (NULL without both)."""
    return F.when(ss.isNotNull(), F.concat(F.lit("s:"), ss)).otherwise(F.concat(F.lit("d:"), doi))


def attach_metadata(papers: DataFrame, meta: DataFrame, cut: bool = False) -> DataFrame:
    """Look each paper up by ``semantic_scholar_id`` when it has one, else by
    ``doi`` (an unknown id does not fall back to the DOI).  Adds ``meta_found``
    and the ``m_*`` metadata columns.  One shuffle join on a combined key.
    ``cut=True`` first cuts the metadata to the papers' keys (for
    materialised papers, see ``resolve_ids``)."""
    keyed = papers.withColumn("_mk", lookup_key(F.col("semantic_scholar_id"), F.col("doi")))
    needed = keyed.where(F.col("_mk").isNotNull()).select(F.col("_mk").alias("_key")).distinct() if cut else None
    lookup = _meta_lookup(meta, needed)
    for v in META_VALUES:
        lookup = lookup.withColumnRenamed(v, "m_" + v)
    j = left_join_nonnull(keyed, lookup, ["_mk"], ["_key"])
    return j.select(*papers.columns, *["m_" + v for v in META_VALUES]) \
        .withColumn("meta_found", F.col("m_meta_id").isNotNull())


def enrich(papers: DataFrame, meta: DataFrame, cut: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata enrichment of accepted papers.

    Returns ``(papers, contents, metrics)``: papers with ``pdf_source`` set when
    the metadata is open access with a non-empty pdf URL; one contents row
    (``tldr``, ``abstract``; empty texts → NULL) and one metrics row per paper
    whose metadata was found.  Papers without metadata get neither."""
    m = attach_metadata(papers, meta, cut)
    pdf = F.when(F.col("m_is_open_access") & (F.coalesce(F.col("m_pdf_url"), F.lit("")) != ""), F.col("m_pdf_url"))
    enriched = m.withColumn("pdf_source", F.coalesce(pdf, F.col("pdf_source")))
    keys = [c for c in ("study_id", "rec_id") if c in papers.columns]
    found = enriched.where("meta_found")
    contents = found.select(*keys, F.nullif(F.col("m_tldr"), F.lit("")).alias("tldr"),
                            F.nullif(F.col("m_abstract"), F.lit("")).alias("abstract"))
    metrics = found.select(*keys, F.col("m_citations").alias("citations"),
                           F.col("m_influential_citations").alias("influential_citations"),
                           F.lit(None).cast("int").alias("paper_length"))
    return enriched.select(*papers.columns), contents, metrics


def enrich_wide(papers: DataFrame, meta: DataFrame, cut: bool = False) -> DataFrame:
    """Single-pass form of ``enrich``: papers plus their contents and metrics
    columns (NULL when no metadata was found) and ``meta_found``."""
    m = attach_metadata(papers, meta, cut)
    pdf = F.when(F.col("m_is_open_access") & (F.coalesce(F.col("m_pdf_url"), F.lit("")) != ""), F.col("m_pdf_url"))
    return m.select(
        *[F.coalesce(pdf, F.col(c)).alias(c) if c == "pdf_source" else F.col(c) for c in papers.columns],
        "meta_found",
        F.nullif(F.col("m_tldr"), F.lit("")).alias("tldr"),
        F.nullif(F.col("m_abstract"), F.lit("")).alias("abstract"),
        F.col("m_citations").alias("citations"),
        F.col("m_influential_citations").alias("influential_citations"),
        F.col("m_meta_id").alias("meta_id"),
    )


def abstract_fallback(contents: DataFrame, pages: DataFrame, source: str = "publisher_source",
                      page_url: str = "url", final_url: str = "final_url", html: str = "html",
                      cut: bool = False) -> DataFrame:
    """Where ``abstract`` is NULL or empty, extract one from the page fetched at
    ``source``: the page row with ``url == source``, routed by its
    ``final_url``.  The pages are reduced to one per URL; only rows that need
    a fallback are joined and parsed.  ``cut=True`` first cuts the pages to
    the URLs that are needed (for materialised contents, see
    ``resolve_ids``)."""
    need = F.coalesce(F.col("abstract"), F.lit("")) == ""
    keyed = contents.withColumn("_k", F.when(need, F.col(source)))
    pg_in = pages.select(F.col(page_url).alias("_src"), F.col(final_url).alias("_final"), F.col(html).alias("_html"))
    if cut:
        pg_in = pg_in.join(keyed.where(F.col("_k").isNotNull()).select(F.col("_k").alias("_src")).distinct(),
                           "_src", "left_semi")
    pg = unique_by(pg_in, ["_src"], F.struct("_final", "_html"), ["_final", "_html"])
    joined = left_join_nonnull(keyed, pg, ["_k"], ["_src"])
    ex = extract_abstracts(joined, keys=[c for c in joined.columns if c not in ("_html", "_final")],
                           url="_final", html="_html", out="_extracted")
    out = ex.withColumn("abstract", F.when(need, F.col("_extracted")).otherwise(F.col("abstract")))
    return out.select(*contents.columns)


def match_known(papers: DataFrame, stored: DataFrame, stored_order: str = "rec_id", cut: bool = False) -> DataFrame:
    """Known-paper match: by DOI when the incoming paper has one, else by
    ``semantic_scholar_id``.  A match replaces the incoming row by the stored
    one (first stored row per key); ``known`` tells which rows matched.  The
    stored side is keyed both ways in one table, so this is one join;
    ``cut=True`` cuts it to the incoming keys first (materialised papers)."""
    cols = list(papers.columns)
    vals = list(stored.columns)
    by_doi = stored.where(F.col("doi").isNotNull()).withColumn("_key", F.concat(F.lit("d:"), F.col("doi")))
    by_ss = stored.where(F.col("semantic_scholar_id").isNotNull()).withColumn(
        "_key", F.concat(F.lit("s:"), F.col("semantic_scholar_id")))
    keyed = papers.withColumn("_pk", F.when(F.col("doi").isNotNull(), F.concat(F.lit("d:"), F.col("doi")))
                              .otherwise(F.concat(F.lit("s:"), F.col("semantic_scholar_id"))))
    both = by_doi.unionByName(by_ss)
    if cut:
        both = both.join(keyed.where(F.col("_pk").isNotNull()).select(F.col("_pk").alias("_key")).distinct(),
                         "_key", "left_semi")
    first = unique_by(both, ["_key"], stored_order, vals)
    for v in vals:
        first = first.withColumnRenamed(v, "st_" + v)
    j = left_join_nonnull(keyed, first, ["_pk"], ["_key"])
    hit = F.col("st_" + stored_order).isNotNull()
    out = [F.when(hit, F.col("st_" + c)).otherwise(F.col(c)).alias(c) if c in vals else F.col(c) for c in cols]
    return j.select(*out, hit.alias("known"))

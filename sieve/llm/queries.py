"""Registered queries of this package: one per operator, over whole tables,
with production parameters.  ``ORACLES`` has DuckDB SQL where SQL can say it."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, imatch, language, lines, maintext, minmax, mixing, quality, simhash, suffixes, trie, warc
from ..session import materialize
from .common import bounded_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_classifier(spark, sf_dir):
    """Posterior of every document from its evidence and its source's and
    language's rates, trained on at most 20,000 labelled documents."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op2_warc(spark, sf_dir):
    """Every page written to dictionary-compressed WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT digest, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM p LEFT JOIN r ON p.digest = r.digest"""


@query
def op3_benchmark_decontamination(spark, sf_dir):
    """Words of every document hit by 10-word windows of the benchmark, and the items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op3_benchmark_decontamination"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
cut AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM cut),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM d, sizes),
hits AS (SELECT p.doc_id, p.i, p.n, g.item FROM places p JOIN grams g ON g.n = p.n AND g.g = array_to_string(p.w[p.i + 1 : p.i + p.n], ' ')),
spots AS (SELECT doc_id, unnest(range(i, i + n)) AS i FROM (SELECT DISTINCT doc_id, i, n FROM hits)),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM spots GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op4_line_dedup(spark, sf_dir):
    """Whole documents without their repeated lines (20 code points, 3 documents)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_repeated_lines(docs, n_lines="n_lines", n_dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES["op4_line_dedup"] = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
hot AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND h.last_doc <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op5_language_id(spark, sf_dir):
    """Language of every whole text, from profiles of the documents not held out."""
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    profiles = language.learn(docs.where(~out))
    return language.predict(docs.select("doc_id", "text", out.alias("held_out")), profiles).drop("text")


@query
def op6_imatch_fingerprints(spark, sf_dir):
    """I-Match fingerprints of every whole text and of its edited text, and how
    alike they and the next document's are."""
    docs = table(spark, sf_dir, "documents")
    return imatch.edited_and_next(docs, imatch.build_lexicon(docs))


@query
def op7_main_text(spark, sf_dir):
    """Main text of every page, with weights from all pages that label theirs."""
    pages = table(spark, sf_dir, "pages")
    texts = maintext.main_text(pages, maintext.learn(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_simhash_near_dedup(spark, sf_dir):
    """SimHash components of all documents: 3-word shingles, at most 3 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op9_source_mixing(spark, sf_dir):
    """Weight, chance and decision of every document, raked to source, language
    and topic shares tempered by 0.7; half of all tokens are expected in the sample."""
    docs = table(spark, sf_dir, "documents")
    narrow = materialize(docs.select("doc_id", "source", "lang", mixing.topic_column(F.col("text")).alias("topic"),
                                     mixing.tokens_column(F.col("text")).alias("n_tokens")), "mixing")
    dims = {d: F.col(d) for d in ("source", "lang", "topic")}
    return mixing.mix(narrow, dims, tokens=F.col("n_tokens"), alpha=0.7, share=0.5, text_col="topic", gap_col="gap")


@query
def op10_suffix_array_dedup(spark, sf_dir):
    """Documents with passages of 50 words or more that repeat across documents."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op11_conversation_trie(spark, sf_dir):
    """Nodes of the prefix trie of all conversations, rebuilt on others' first turns."""
    return trie.prefix_nodes(*trie.rebuilt(trie.numbered(table(spark, sf_dir, "conversations"))))


ORACLES["op11_conversation_trie"] = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos, key, chars FROM (
    SELECT conv_id, turn, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
           length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM turns, tab),
placed AS (
  SELECT i.conv_id, 0 AS part, pos, key, chars FROM ids i JOIN turns t ON t.conv_id = i.base WHERE pos <= h
  UNION ALL SELECT i.conv_id, 1, pos, key, chars FROM ids i JOIN turns t ON t.conv_id = i.conv_id WHERE pos > h),
seqs AS (
  SELECT conv_id, coalesce(list(key ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS ks, coalesce(list(chars ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS cs
  FROM ids LEFT JOIN placed USING (conv_id) GROUP BY conv_id),
members AS (SELECT conv_id, ks, cs, unnest(range(0, len(ks) + 1)) AS depth FROM seqs),
named AS (
  SELECT conv_id, depth, array_to_string(ks[1:depth], '') AS path, CASE WHEN depth > 0 THEN array_to_string(ks[1:depth - 1], '') END AS parent,
         CASE WHEN depth > 0 THEN cs[depth] ELSE 0 END AS chars, len(ks) = depth AS ends FROM members),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM named GROUP BY path, depth),
kids AS (SELECT parent AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
full_ AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sub AS (
  SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.chars) AS BIGINT) AS saved_tokens
  FROM full_ a JOIN full_ b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN sub USING (path) LEFT JOIN full_ p ON p.path = f.parent"""


@query
def op12_minmax_near_dedup(spark, sf_dir):
    """Components of all documents whose 4-word shingle sets are alike to 80 %."""
    found = minmax.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"),
                        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


ORACLES["op12_minmax_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS items FROM w),
n AS (SELECT doc_id, CAST(len(items) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(items) AS item FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM e x JOIN e y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
k AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT k.b, r.root FROM r JOIN k ON k.a = r.doc_id)
SELECT n.doc_id, n AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n"""


@query
def op13_fill_in_middle(spark, sf_dir):
    """Every whole text cut after two units, put in its form and rebuilt from it."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""

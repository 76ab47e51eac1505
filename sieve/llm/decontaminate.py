"""Benchmark decontamination with built-in functions only.

Benchmark texts are cut into windows of ``WINDOW`` normalised words (an item with
fewer words is one window of its own length).  A bit table of the windows' hashes, of
bounded size, goes with the plan: every document's windows are hashed in the row, and
those whose bit is set are exploded with their words.  These are probed in the broadcast
hash set of the windows by all their words, so a hit is verified, not only likely.
Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import by_id, fresh, quoted, without, words_of

WINDOW = 10
#: distinct windows up to which they are broadcast; more are joined by shuffle
MAX_GRAMS = 1_000_000
#: 64-bit words of the bit table at most (512 KB); a fuller table only lets more pass
MAX_BIT_WORDS = 1 << 16
CUT = "array<struct<pos:int,n:int,gram:string>>"


def bit_table(grams: DataFrame, rows: int) -> list[int]:
    """Bits of the windows' hashes ``h``: about 64 a window, a power of two of them."""
    size = 16
    while size < rows and size < MAX_BIT_WORDS:
        size *= 2
    at = F.shiftright("h", 6).bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    table = [0] * size
    for r in grams.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")).collect():
        table[r["at"]] = r["bits"]
    return table


def likely_windows(words: Column, length: int, table: list[int]) -> Column:
    """``(pos, n, gram)`` of the windows of ``length`` words whose bit is set."""
    bits = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to a constant

    def hit(h: Column) -> Column:
        word = F.element_at(bits, (F.shiftright(h, 6).bitwiseAND(F.lit(len(table) - 1)) + 1).cast("int"))
        return F.call_function("shiftright", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    last = F.size(words) - length
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, length)))
    places = F.array_compact(F.transform(hashes, lambda h, i: F.when(hit(h), i)))
    cut = F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("n"), F.array_join(F.slice(words, i + 1, length), " ").alias("gram")))
    return F.when(last >= 0, cut).otherwise(F.array().cast(CUT))


def benchmark_grams(bench: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, list[int], int]:
    """``h, gram, items``: distinct windows, their words joined by spaces and the
    (sorted, distinct) item ids as strings; the lengths that occur; their number."""
    words = F.col("words")
    items = bench.select(quoted(id_col).cast("string").alias("item"), words_of(quoted(text_col)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size(words), F.lit(window))
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - length), lambda i: F.slice(words, i + 1, length))
    cut = items.select("item", F.explode(grams).alias("g"))
    found = cut.groupBy(F.xxhash64("g").alias("h"), F.array_join("g", " ").alias("gram"), F.size("g").alias("n")) \
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    table, seen = materialize(found, "grams", {"rows": F.count(F.lit(1)), "lengths": F.collect_set("n")})
    return table, sorted(seen["lengths"] or []), seen["rows"]


def find_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              bench_id: str = "item_id", bench_text: str = "text", window: int = WINDOW, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Per row of ``docs``: ``id, n_words, hits`` with its ``(pos, n, items)``.

    Every row sends one marker with its number of words beside its likely windows, so
    that all come from one pass.  Rows of equal id and words are counted and given back
    as often as they were."""
    grams, lengths, rows = benchmark_grams(bench, bench_id, bench_text, window)
    table = bit_table(grams, rows) if rows else [0]
    words = F.col("words")
    tokens = docs.select(quoted(id_col).alias("id"), words_of(quoted(text_col)).alias("words"))
    marker = F.array(F.struct(F.lit(-1).alias("pos"), F.size(words).alias("n"), F.concat(F.lit("\n"), F.xxhash64(words).cast("string")).alias("gram")))
    cut = F.concat(marker, *[likely_windows(words, n, table) for n in lengths])
    probes = tokens.select("id", F.xxhash64(words).alias("h"), F.explode(cut).alias("w")).select("id", "h", "w.pos", "w.n", "w.gram")
    items = grams.select(F.col("gram").alias("_gram"), "items")
    found = probes.join(F.broadcast(items) if rows <= max_grams else items, F.col("gram") == F.col("_gram"), "left")
    is_marker = F.col("pos") < 0
    by = found.where(is_marker | F.col("items").isNotNull()).groupBy("id", "h") \
        .agg(F.max(F.when(is_marker, F.col("n"))).alias("n_words"), F.count_if(is_marker).alias("copies"),
             F.collect_set(F.when(~is_marker, F.struct("pos", "n", "items"))).alias("hits"))
    return by.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("id", F.col("n_words").cast("long").alias("n_words"), "hits")


def spots(hits: Column) -> Column:
    """Distinct places of the words in the hits."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["n"] - 1))))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_words, n_hit, items`` (sorted as strings).

    Null and empty texts have no words; items without words have no windows; items
    with a null id make words hit but are not listed.  Rows with equal ids are judged
    each by its own words.  An empty benchmark hits nothing."""
    found = find_hits(docs, bench, id_col, text_col, **options)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    return found.select(F.col("id").alias(id_col), "n_words", F.size(spots(F.col("hits"))).cast("long").alias("n_hit"), items.alias("items"))


def remove_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns.

    Rows of one id, or without an id, are taken as one document: all go if one is hit."""
    found = contamination(docs, bench, id_col, text_col, **options).where("n_hit > 0")
    return without(docs, id_col, found.select(quoted(id_col).alias("gone")).distinct())


def remove_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "kept_words", **options) -> DataFrame:
    """``docs`` with ``out``: the normalised words that are in no hit, joined by spaces.
    Of rows with one id, the hits of all are taken from each."""
    hits = find_hits(docs, bench, id_col, text_col, **options).where(F.size("hits") > 0)
    hits = materialize(hits.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(spots(F.col("hits"))))).alias("spots")), "hits")
    met, names = by_id(docs, id_col, hits, "id")
    held, words = F.coalesce(names["spots"], F.array().cast("array<int>")), fresh(met, "words")
    met = met.withColumn(words, words_of(quoted(text_col)))
    stays = F.filter(F.col(words), lambda _, i: ~F.array_contains(held, i))
    return met.withColumn(out, F.array_join(stays, " ")).drop(words, *names.values())

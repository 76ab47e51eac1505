"""Bibliography dump (XML) → ``records`` table.

The dump is one huge XML file (or several) whose root holds one child element per
record (``<article key="journals/x/Y" ...>`` with children ``title``, ``year``,
``ee``...).  It is read as *text* split on the literal form of the key attribute that
the dump mostly uses (``' key="'``, see :func:`record_mark`), so files are split across
tasks like any text file and no task holds more than its split.  Records that write the
attribute otherwise (any white space, either quote, blanks around ``=``, after other
attributes) stay in the chunk of the record before them and are split off there, at
every start tag with a ``key``.  Fields are taken with built-in regular expressions:

* ``key``   – the attribute
* ``year``  – first ``<year>`` element, as an integer
* ``title`` – first ``<title>`` element, inner markup removed, character
  references decoded, CDATA kept (the text of all nested nodes, joined)
* ``ee``    – text of the first ``<ee>`` element before any child, decoded

What comments and CDATA sections hold is text: neither records nor fields start there.
A section that holds the marker itself is cut by the reader; such chunks are found in a
first pass and put together again before they are parsed.  Pieces that are not records
(the prolog) or cannot be parsed go to a rejects table, whole and with a reason, never
silently away.

``ord`` numbers the records from 0 in the order of the dump, files by name, whatever the
number of files and splits; ``rec_id`` equals it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decode_entities, markup_text, py_strip
from ..operators.joins import bounded_broadcast
from ..session import materialize

RECORD_MARK = ' key="'
#: start tags looked at for the form of the marker
MARK_SAMPLE = 20_000
#: chunks looked at for cut sections before the first pass
OPEN_SAMPLE = 2_000
KEY_RE = {'"': '^([^"<>]+)"', "'": "^([^'<>]+)'"}
ATTRIBUTES = "(?:\\s+[\\w:.-]+\\s*=\\s*(?:\"[^\"<]*\"|'[^'<]*'))*?"
TAG = "<[A-Za-z_][\\w:.-]*" + ATTRIBUTES + "\\s+key\\s*=\\s*"
START = TAG + "(?:\"[^\"<]*\"|'[^'<]*')"
START_KEY = "^" + TAG + "(?:\"([^\"<]*)\"|'([^'<]*)')"
SECTION = "(?s)<!\\[CDATA\\[.*?\\]\\]>|<!--.*?-->"
#: sections without ``<`` inside hide nothing
PLAIN_SECTION = "<!--[^<]*?-->|<!\\[CDATA\\[[^<]*?\\]\\]>"
OPENER = "<!\\[CDATA\\[|<!--"
FIRST = "(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>"
EE_TEXT = "(?s)<ee(?:\\s[^>]*)?>([^<]*)"
#: stands for ``<`` within sections; not a character of XML
HIDDEN = "\u0002"


def record_mark(spark: SparkSession, path: str) -> str:
    """The literal form of the key attribute that the dump's first start tags mostly use.
    It only decides where the files are cut; records of other forms are found too."""
    form = F.regexp_extract("value", "^[A-Za-z_][\\w:.-]*" + ATTRIBUTES + "(\\skey=[\"'])", 1)
    tags = spark.read.option("lineSep", "<").text(path).limit(MARK_SAMPLE).select(form.alias("form")).where("form <> ''")
    most = tags.groupBy("form").count().orderBy(F.desc("count"), "form").head(1)
    return most[0]["form"] if most else RECORD_MARK


def read_chunks(spark: SparkSession, path: str, mark: str = RECORD_MARK) -> DataFrame:
    """Chunks with their place: file, start of the split, and a number that grows within it."""
    raw = spark.read.option("lineSep", mark).text(path)
    return raw.select(F.col("value").alias("chunk"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def hide_sections(c: Column) -> Column:
    """``c`` with every ``<`` inside closed comments and CDATA sections hidden."""
    tokens = F.regexp_extract_all(c, F.lit(SECTION + "|[^<]+|<"), 0)
    hidden = F.transform(tokens, lambda t: F.when(t.startswith("<!") & (F.length(t) > 4),
                                                  F.concat(F.lit(HIDDEN), F.replace(t.substr(F.lit(2), F.length(t)), F.lit("<"), F.lit(HIDDEN)))).otherwise(t))
    return F.when(_has_more(c), F.array_join(hidden, "")).otherwise(c)


def _has_more(c: Column) -> Column:
    """Whether ``c`` has sections beyond plain ones, or an open one."""
    return c.contains("<!") & F.regexp_replace(c, PLAIN_SECTION, "").rlike(OPENER)


def shown(c: Column) -> Column:
    return F.replace(c, F.lit(HIDDEN), F.lit("<"))


def open_section(c: Column) -> Column:
    """Kind of a section that ``c`` opens and does not close (``-->`` or ``]]>``), or NULL."""
    opener = F.regexp_extract(F.regexp_replace(c, SECTION, ""), OPENER, 0)
    return F.when(_has_more(c), F.when(opener == "<!--", "-->").when(opener != "", "]]>"))


def parse_chunks(chunks: DataFrame, mark: str = RECORD_MARK) -> DataFrame:
    """Chunks → a row per record or reject: the chunks' columns, ``sub`` (the place within
    the chunk), parsed fields, ``reason`` (NULL for good records), ``chunk`` (its own text)."""
    pieces = F.split(hide_sections(F.col("chunk")), "(?=" + START + ")")
    rows = chunks.select(*[c for c in chunks.columns if c != "chunk"], F.posexplode(pieces).alias("sub", "_piece"))
    p = F.col("_piece")
    tag_key = F.concat(F.regexp_extract(p, START_KEY, 1), F.regexp_extract(p, START_KEY, 2))
    key = F.when(p.rlike("^" + START), tag_key).otherwise(F.regexp_extract(p, KEY_RE[mark[-1]], 1))
    year_txt = F.regexp_extract(p, FIRST.format(tag="year"), 1)
    year = py_strip(shown(year_txt)).try_cast("int")
    has_title = p.rlike(FIRST.format(tag="title"))
    title = markup_text(shown(F.regexp_extract(p, FIRST.format(tag="title"), 1)))
    has_ee = p.rlike("<ee(?:\\s[^>]*)?>")
    ee = F.when(has_ee, decode_entities(F.regexp_extract(p, EE_TEXT, 1)))
    reason = (F.when(key == "", F.lit("no_key"))
              .when(year_txt == "", F.lit("no_year"))
              .when(year.isNull(), F.lit("bad_year"))
              .when(~has_title, F.lit("no_title")))
    return rows.select(*[c for c in rows.columns if c != "_piece"], decode_entities(key).alias("key"), title.alias("title"),
                       year.alias("year"), ee.alias("ee"), reason.alias("reason"), shown(p).alias("chunk"))


def _numbered(rows: DataFrame, within: list[str], counted: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: how many ``counted`` rows come before in dump order.

    Splits are counted, their sums run over the small table of splits, and rows are
    numbered within their split, so no task sees more than a split."""
    splits = rows.groupBy("file", "block").agg(F.count_if(counted).alias("_n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets, _ = bounded_broadcast(splits.select(F.col("file").alias("_file"), F.col("block").alias("_block"),
                                                 F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), name="splits")
    own = Window.partitionBy("file", "block").orderBy(*within).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_own", F.coalesce(F.sum(counted.cast("long")).over(own), F.lit(0)))
    return placed.join(offsets, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))) \
        .withColumn(name, F.col("_offset") + F.col("_own")).drop("_own", "_offset", "_file", "_block")


def _ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of chunks of a file that sections cut: from the chunk that opens one to the
    next that closes its kind, which may open another.  Openers in between are text."""
    out, first, kind = [], None, ""
    for n, opens, closes in zip(*(pdf.sort_values("n")[c] for c in ("n", "opens", "closes"))):
        if kind and kind not in closes.split():
            continue
        if not kind:
            first = n
        if kind and not opens:
            out.append((first, n))
        kind = opens
    return pd.DataFrame(out, columns=["first", "last"], dtype="int64")


def join_cut_sections(chunks: DataFrame, mark: str) -> DataFrame:
    """Chunks with those that a section holding the marker was cut into put together.
    Only chunks that open a section or close one that they didn't open are compared."""
    table = materialize(chunks.withColumn("_opens", F.coalesce(open_section(F.col("chunk")), F.lit(""))), "chunks")
    placed = materialize(_numbered(table, ["at"], F.lit(True), "n"), "placed-chunks")
    rest = F.regexp_replace("chunk", SECTION, "")
    closes = F.concat_ws(" ", F.when(rest.contains("-->"), "-->"), F.when(rest.contains("]]>"), "]]>"))
    odd = placed.select("file", "n", F.col("_opens").alias("opens"), closes.alias("closes")).where("opens <> '' or closes <> ''")
    runs = odd.groupBy("file").applyInPandas(_ranges, "first long, last long")
    members, _ = bounded_broadcast(runs.select("first", F.explode(F.sequence("first", "last")).alias("_n")), name="cut-chunks")
    told = placed.join(members, F.col("n") == F.col("_n"), "left")
    alone = told.where("first is null").select("chunk", "file", "block", "at")
    joined = told.where("first is not null").groupBy("first").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "chunk"))), lambda x: x["chunk"]), mark).alias("chunk"),
        F.min_by(F.struct("file", "block", "at"), "n").alias("_at"))
    return alone.unionByName(joined.select("chunk", "_at.file", "_at.block", "_at.at"))


def _slim(parsed: DataFrame) -> DataFrame:
    """Good records without their text."""
    return parsed.withColumn("chunk", F.when(F.col("reason").isNotNull(), F.col("chunk")))


def read_bibliography(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` of an XML dump (file or directory), parsed and written to the
    shared folder in one pass; a second one only if a section was cut, the first being
    left out if that shows in a few chunks.  ``rejects`` has the ``ord`` of the next
    record, the reason and the whole text."""
    mark = record_mark(spark, path)
    chunks = read_chunks(spark, path, mark)
    is_open = open_section(F.col("chunk")).isNotNull()
    cut = bool(chunks.select(is_open.alias("_open")).limit(OPEN_SAMPLE).where("_open").head(1))
    if not cut:
        told = chunks.withColumn("_open", is_open)
        parsed, seen = materialize(_slim(parse_chunks(told, mark)), "parsed", {"open": F.count_if("_open")})
        cut = bool(seen["open"])
    if cut:
        parsed = materialize(_slim(parse_chunks(join_cut_sections(chunks, mark), mark)), "parsed")
    placed = _numbered(parsed, ["at", "sub"], F.col("reason").isNull(), "ord")
    records = placed.where(F.col("reason").isNull()).select(F.col("ord").alias("rec_id"), "ord", "key", "title", "year", "ee")
    rejects = placed.where(F.col("reason").isNotNull()).select("ord", "reason", "chunk")
    return records, rejects


def write_records(records: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store records as Parquet, partitioned by the key's first segment (so a
    venue-type prefix prunes whole directories) and sorted by year inside each
    file (so Parquet statistics prune row groups for a year range).

    Records are range-partitioned on (type, year, ord) first: a type holding
    a third of the dump is spread over many tasks instead of one, and each
    task writes into few directories."""
    n = partitions or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (records.withColumn("ktype", F.split("key", "/")[0])
     .repartitionByRange(n, "ktype", "year", "ord").sortWithinPartitions("ktype", "year", "ord")
     .write.mode("overwrite").partitionBy("ktype").parquet(path))


# --- writing a dump (used to turn the test tables into an XML file) ------------
def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def record_xml(tag: str = "article") -> F.Column:
    """XML text of one record from ``key``, ``title``, ``year``, ``ee``.  The
    title's first word is set in ``<i>`` and its blanks written as ``&#32;``,
    which readers must undo; ``ee`` is optional."""
    words = F.split(_xml_escape(F.col("title")), " ", 2)
    title = F.when(F.size(words) > 1,
                   F.concat(F.lit("<i>"), words[0], F.lit("</i>&#32;"),
                            F.replace(words[1], F.lit(" "), F.lit("&#32;"))))\
        .otherwise(_xml_escape(F.col("title")))
    ee = F.when(F.col("ee").isNotNull(), F.concat(F.lit("<ee>"), _xml_escape(F.col("ee")), F.lit("</ee>\n")))\
        .otherwise(F.lit(""))
    return F.concat(F.lit(f'<{tag} mdate="2024-01-01" key="'), F.col("key"), F.lit('">\n<author>A. Author</author>\n'),
                    F.lit("<title>"), title, F.lit("</title>\n<!-- r -->\n<year>"), F.col("year").cast("string"),
                    F.lit("</year>\n"), ee, F.lit(f"</{tag}>"))


def varied_xml() -> Column:
    """XML text of records whose start tags differ by ``ord``: white space, quotes and
    order of attributes, and comments and CDATA sections that hold other start tags."""
    kind = F.col("ord") % 6
    parts = F.split(record_xml(), ' key="', 2)  # <article mdate="2024-01-01" | KEY">...
    rest = F.substring(parts[1], F.length("key") + 2, F.length(parts[1]))
    fake = F.lit('<article mdate="x" key="conf/fake/1"><title>no record</title><year>1900</year></article>')
    return F.when(kind == 1, F.concat(F.lit("<article\tmdate='2024'\tkey='"), "key", F.lit("'"), rest)) \
        .when(kind == 2, F.concat(F.lit('<article\n  key = "'), "key", F.lit('"\n  note="a>b"'), rest)) \
        .when(kind == 3, F.concat(F.lit("<!-- "), fake, F.lit(" -->\n"), record_xml())) \
        .when(kind == 4, F.concat(parts[0], F.lit("\nkey='"), "key", F.lit("'"), F.regexp_replace(rest, "<author>", F.concat(F.lit("<note><![CDATA["), fake, F.lit("]]></note><author>")))))\
        .otherwise(record_xml())


def write_dump(records: DataFrame, path: str, xml: Column | None = None) -> None:
    """Write records as an XML dump (one text file per partition)."""
    records.select((record_xml() if xml is None else xml).alias("value")).write.mode("overwrite").text(path)

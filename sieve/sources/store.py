"""Stored review tables (Parquet) and CSV export / read-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.screening import PAPER_COLUMNS

# A value no CSV field holds: empty fields then read back as '' (not NULL),
# the way a plain CSV reader returns them.
_NO_NULL_TOKEN = "\u0000<null>\u0000"


def write_table(df: DataFrame, path: str, partition_by: str | None = "study_id", study_ids=None) -> None:
    """Write a review table; with dynamic partition overwrite a rerun of one
    study replaces only that study's partition.  With the ``study_ids`` of a run,
    the partitions of those without rows are removed.  Tables that must change
    together go through ``commit.StudyStore``."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    w.parquet(path)
    for i in study_ids or []:
        _remove_empty(df, path, f"{partition_by}={i}", F.col(partition_by) == i)


def _remove_empty(df: DataFrame, path: str, folder: str, rows) -> None:
    """Remove a partition folder of ``path`` that ``df`` has no rows for."""
    spark = df.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and df.where(rows).isEmpty():
        fs.delete(old, True)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Stored table scan (filters on ``study_id`` prune partitions).  With the
    table's schema the partition column keeps its declared type instead of
    the type guessed from directory names."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def export_csv(papers: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """All paper columns, header in table order, NULL written as an empty
    field; one file per partition."""
    cols = columns or [c for c in PAPER_COLUMNS if c in papers.columns]
    (papers.select(*[F.col(c).cast("string").alias(c) for c in cols])
     .write.mode("overwrite").option("header", True).csv(path))


def csv_record(columns) -> Column:
    """One CSV record of string columns: comma-separated, NULL empty, and fields quoted
    only if they hold a comma, quote or line break (quotes are doubled).  A record that is
    one empty field is quoted, as a reader would skip it."""
    fields = []
    for c in columns:
        value = F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        special = value.rlike('[",\\r\\n]')
        fields.append(F.when(special if len(columns) > 1 else special | (value == ""), quoted).otherwise(value))
    return F.concat_ws(",", *fields)


def export_studies(papers: DataFrame, path: str, columns: list[str] | None = None, order_by: str = "rec_id") -> None:
    """CSV export per study below ``path/study_id=<n>``: header first, CRLF line ends, rows
    by ``order_by``, minimal quoting, NULL as an empty field.  A study's part files
    joined in the order of their names are the whole file, however many tasks wrote it."""
    cols = columns or [c for c in PAPER_COLUMNS if c in papers.columns]
    rows = papers.select("study_id", F.lit(1).alias("_kind"), F.col(order_by).alias("_order"), csv_record(cols).alias("value"))
    names = csv_record([F.lit(c) for c in cols])
    heads = papers.select("study_id").distinct().select("study_id", F.lit(0).alias("_kind"), F.lit(None).cast(papers.schema[order_by].dataType).alias("_order"), names.alias("value"))
    order = ["study_id", "_kind", "_order", "value"]
    (heads.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("study_id", "value")
     .write.mode("overwrite").option("lineSep", "\r\n").partitionBy("study_id").text(path))


def csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of an exported CSV (header names the columns); empty fields
    come back as ``''``.  Files without that column contribute nothing."""
    df = (spark.read.option("header", True).option("nullValue", _NO_NULL_TOKEN)
          .option("emptyValue", "").csv(path))
    if column not in df.columns:
        return spark.createDataFrame([], f"`{column}` string")
    return df.select(F.coalesce(F.col(column), F.lit("")).alias(column))

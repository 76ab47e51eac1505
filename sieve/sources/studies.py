"""Study spec sources: JSON documents → studies table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import STUDY_SPEC


def studies_from_json(docs: DataFrame, key: str = "study_id", doc: str = "doc") -> DataFrame:
    """``(key, JSON doc)`` rows → one studies row each (``STUDIES`` columns).
    Unknown keys are ignored; validate first with ``assess.validate_specs``."""
    parsed = docs.select(F.col(key).cast("bigint").alias("study_id"), F.from_json(F.col(doc), STUDY_SPEC).alias("s"))
    return parsed.select("study_id", *[F.col("s")[f.name].alias(f.name) for f in STUDY_SPEC.fields])


def load_study(spark: SparkSession, path: str, study_id: int = 1) -> DataFrame:
    """One whole-file JSON study spec (multi-line object) → studies row."""
    raw = spark.read.schema(STUDY_SPEC).option("multiLine", True).json(path)
    return raw.select(F.lit(study_id).cast("bigint").alias("study_id"), *[f.name for f in STUDY_SPEC.fields])


def load_studies(spark: SparkSession, path: str) -> DataFrame:
    """A directory of JSON-lines specs (one object per line), ids in file order
    are not implied: each line must carry ``study_id``."""
    schema = T.StructType(list(STUDY_SPEC.fields) + [T.StructField("study_id", T.LongType())])
    raw = spark.read.schema(schema).json(path)
    return raw.select("study_id", *[f.name for f in STUDY_SPEC.fields])

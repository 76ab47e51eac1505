"""Session and shared-folder helpers.

Library functions never create a session; they take the caller's.  The
helpers here are for tests, ``bench.py`` and command-line use.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "sieve") -> SparkSession:
    """Local session with the settings the library is tuned for.

    On a cluster the same keys go into ``spark-defaults.conf``; the values
    that depend on data size are ``spark.sql.shuffle.partitions`` and
    ``spark.sql.files.maxPartitionBytes``.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # whole web pages go through the Python HTML parser in Arrow batches;
        # 1,000 rows per batch bounds a task's batch memory for large pages
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    A cluster names it; only when it is unset on a local master (tests, a
    laptop) is a fresh local folder made and registered.  On a cluster an
    unset folder is an error: a machine-local folder would not survive the
    loss of that machine.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        base = tempfile.mkdtemp(prefix="sieve-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared checkpoint folder, grouped by
    application: ``<checkpoint dir>/sieve-scratch/<application id>/...``, so
    the intermediates of a finished run can be dropped as one folder (for
    example by a retention policy on the shared store)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    app = spark.sparkContext.applicationId
    return f"{base}/sieve-scratch/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", metrics: dict | None = None):
    """Write ``df`` once as Parquet below the shared checkpoint folder and read
    it back: the plan is computed a single time, lineage is cut (a lost
    executor re-reads files instead of recomputing), and later plans see real
    file statistics.

    With ``metrics`` (name → aggregate Column) the aggregates are observed
    while writing, with no extra job, and ``(table, values)`` is returned."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    obs = None
    if metrics:
        obs = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        df = df.observe(obs, *[c.alias(k) for k, c in metrics.items()])
    df.write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    if obs is None:
        return table
    return table, obs.get

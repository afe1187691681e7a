"""Session helpers: a local session for tests and benchmarks, and lineage cuts.

Library code never creates a session; it uses ``df.sparkSession``. Only tests,
``bench.py`` and the driver entry build one with :func:`local_session`.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "sparkrisk") -> SparkSession:
    """Local session used by tests and the benchmark (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where unset.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared file
    system). Only a ``local[...]`` master may fall back to a fresh temp folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session: the server's spark.checkpoint.dir applies
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is unset on the Spark Connect server")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not re.fullmatch(r"local(\[.*\])?", sc.master):   # local-cluster[...] has several machines' worth of workers
        raise RuntimeError(
            "spark.checkpoint.dir is unset: point it at a shared folder (HDFS/S3/...) "
            "so iterative operators can cut lineage")
    folder = tempfile.mkdtemp(prefix="sparkrisk-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder (survives executor loss).

    Spark deletes a checkpoint once nothing refers to it if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as our sessions do.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, max_rows: int, max_bytes: int = 256 << 20) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes as text.

    One aggregate whose tasks send a row each; nothing meets in one task.
    """
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("bigint")).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a result that is small by construction, refusing if it is not."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; refusing to collect")
    return rows

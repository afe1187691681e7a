"""Sources and sinks (SRC1, SRC2).

CSV with a header row, column names normalised to Spark-friendly identifiers;
an explicit schema is the production path (inference costs an extra pass).
Parquet tables are read with column pruning and filter pushdown left to
Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def normalise_names(names: Sequence[str]) -> list[str]:
    """Header names -> identifiers: invalid characters become '_', a leading
    digit gets an 'X' prefix, names taken already (whatever their case) get the
    first free '_2', '_3' ... suffix."""
    out, taken = [], set()
    for n in names:
        s = re.sub(r"[^0-9A-Za-z_]", "_", n.strip()) or "X"
        if s[0].isdigit():
            s = "X" + s
        free, k = s, 1
        while free.lower() in taken:
            k += 1
            free = f"{s}_{k}"
        taken.add(free.lower())
        out.append(free)
    return out


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None,
             infer_schema: bool = False, normalise: bool = True, **options) -> DataFrame:
    """CSV scan with a header row (SRC1)."""
    reader = spark.read.option("header", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer_schema:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path if isinstance(path, str) else list(path))
    return df.toDF(*normalise_names(df.columns)) if normalise else df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV sink (SRC2): header, no row names; a folder of part files."""
    df.write.mode(mode).option("header", True).csv(path)


def read_table(spark: SparkSession, folder, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``."""
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")

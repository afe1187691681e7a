"""CSV scan with types found from the data and a quarantine for broken lines (SRC1).

Types come from one aggregate over all columns: each column keeps the narrowest of the types that every value of it can
be read as (boolean; bigint within double; date within timestamp; else string). Counts of values that do not fit are
summed up task by task, so the pass is one scan and one row. Lines with another number of fields than the header has are
told by Spark's permissive reader; they take no part in the types and come back as a frame of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ensure_checkpoint_dir
from .io import normalise_names

#: From narrow to wide; a column gets the first that all its values fit.
LATTICE = ("boolean", "bigint", "double", "date", "timestamp")
CORRUPT = "_corrupt_record"


def _reads_as(value: Column, kind: str) -> Column:
    """Is the text a value of the type, as it stands (nothing cut off, no type suffix)?"""
    text = F.trim(value)
    parsed = text.try_cast(kind).isNotNull()
    if kind == "boolean":
        return F.lower(text).isin("true", "false")
    if kind == "bigint":
        return text.rlike(r"^[+-]?[0-9]+$") & parsed
    if kind == "double":
        return ~text.rlike("(?i)[df]$") & parsed
    if kind == "date":
        return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & parsed
    return text.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}.*)?$") & parsed


def infer_types(text: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """{column: type} of text columns: the narrowest type of LATTICE that every value fits, else string.

    NULL and empty values fit everything; a column of nothing else is a string.
    """
    cols = list(text.columns if cols is None else cols)
    plain = text.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(cols)):
        v = F.col(f"c{i}")
        some = v.isNotNull() & (F.trim(v) != "")
        aggs.append(F.count_if(some).alias(f"n{i}"))
        aggs += [F.count_if(some & ~F.coalesce(_reads_as(v, kind), F.lit(False))).alias(f"m{i}_{j}") for j, kind in enumerate(LATTICE)]
    row = plain.agg(*aggs).first()
    return {c: next((kind for j, kind in enumerate(LATTICE) if row[f"n{i}"] and not row[f"m{i}_{j}"]), "string") for i, c in enumerate(cols)}


def read_typed(spark: SparkSession, path: str | Sequence[str], header: Sequence[str] | None = None, **options) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(rows with their types, broken lines as ``line``, {column: type}).

    ``header``: column names where the files have no header line. Names are normalised as by :func:`.io.read_csv`.
    """
    paths = path if isinstance(path, str) else list(path)
    reader = spark.read.options(**options).option("header", header is None)
    names = list(header) if header is not None else reader.csv(paths).columns
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))] + [StructField(CORRUPT, StringType())])
    # without pruning of columns: a line is told broken by all its fields, whatever is selected
    raw = (reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .option("columnPruning", False).csv(paths))
    text = [f"c{i}" for i in range(len(names))]
    # Spark refuses to read the broken lines alone, so the condition reads the first field too
    broken = F.coalesce(F.length(F.concat(F.col(CORRUPT), F.coalesce(F.col("c0"), F.lit("")))) >= 0, F.lit(False))
    whole = raw.where(~broken)
    kinds = infer_types(whole, text)
    out = normalise_names(names)
    good = whole.select(*[_typed(c, kinds[c]).alias(n) for c, n in zip(text, out)])
    bad = raw.where(broken).select(F.col(CORRUPT).alias("line"))
    return good, bad, {n: kinds[c] for c, n in zip(text, out)}


def _typed(c: str, kind: str) -> Column:
    if kind == "string":
        return F.col(c)
    return F.trim(F.col(c)).try_cast(kind)


# --- bucketed tables (JN3) ---------------------------------------------------------------------------------

def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written once as a table bucketed and sorted by ``key`` in the shared folder, and read back.

    Tables of the same key and number of buckets join without a shuffle or sort, again and again. Rows are gathered by
    bucket first, so each bucket is one sorted file; a key that holds a third of all rows makes its bucket as large.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bucketed/{table}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", folder).format("parquet").saveAsTable(table))
    return spark.table(table)

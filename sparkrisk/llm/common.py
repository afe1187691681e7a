"""Shared pieces of the operators: text batches, label folds, bounded broadcasts, written steps."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows up to which a table of a few numbers a row is broadcast (about 100 MB); beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that a Python task works on at a time (a longer single text is one chunk).
CHUNK_BYTES = 1 << 20
#: Labels are learnt from documents whose crc32(doc_id as text) mod FOLDS is not HELD_OUT.
FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str) -> Column:
    """True for documents whose labels are never learnt from; a NULL id counts as the text ''."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return (F.crc32(text) % FOLDS) == HELD_OUT


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string array; NULL is the empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not (pa.types.is_large_string(texts.type) or pa.types.is_string(texts.type)):
        texts = texts.cast(pa.string())
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(texts: pa.Array, budget: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of ``texts`` of about ``budget`` bytes, so that temporary arrays stay bounded."""
    _, off = utf8(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(off, off[start] + budget, side="right")) - 1
        end = max(start + 1, min(end, len(texts)))
        yield texts.slice(start, end - start)
        start = end


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows, by a plain count (partial counts per task)."""
    return df.count() <= max_rows


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast where a count proves it small; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, max_rows) else df


def let_workers_import(spark: SparkSession) -> None:
    """Put this package's folder on the path of Python workers started from now on.

    Needed where the driver imports it from a folder (tests); on a cluster the package is installed or sent
    with --py-files, and the entry does nothing.
    """
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if top not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([top, known] if known else [top])


class Steps:
    """Tables written to the shared checkpoint folder: they cut lineage and survive a lost executor.

    ``keep(df)`` writes and rereads a table; ``drop(path)`` deletes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        self.made = 0
        self.last = ""

    def keep(self, df: DataFrame) -> DataFrame:
        self.last = f"{self.root}/{self.made}"
        self.made += 1
        df.write.parquet(self.last)
        return self.spark.read.schema(df.schema).parquet(self.last)

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

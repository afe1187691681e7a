"""Seeded, keyed sampling and partitioning (SRT1, SMP1-SMP6).

Every operator is a function of (key, seed): the same rows come out on any
partitioning, and an SQL engine with ``md5`` reproduces them exactly. Sizes are
exact (not Bernoulli approximations like ``randomSplit``/``sample``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import by_rank, fold_of, seeded_md5, shuffle_rank, u32
from ..session import collect_bounded

MAX_CLASSES = 100_000


def class_counts(df: DataFrame, label: str) -> dict:
    """{class: rows} over non-NULL labels; one row per class reaches the driver (bounded)."""
    rows = collect_bounded(df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")),
                           MAX_CLASSES, "class_counts")
    return {r[label]: r["n"] for r in rows}


# SMP2 -------------------------------------------------------------------------
def assign_folds(df: DataFrame, key: str | Sequence[str], k: int = 5, seed: int = 42,
                 fold_col: str = "fold") -> DataFrame:
    """Shuffle by seeded hash, then cut positions 1..n into k equal-width intervals."""
    return by_rank(df, key, seed, lambda rn, n: fold_of(rn, n, k), fold_col)


# SMP3 -------------------------------------------------------------------------
def stratified_split(df: DataFrame, label: str, key: str | Sequence[str], p: float = 0.7,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """Within each class, the first ceil(p * n_class) rows in hash order are 'train'.

    Every row gets a part; rows with a NULL label are split like a class of their own.
    """
    def part(rn, n):
        return F.when(rn <= F.ceil(F.lit(float(p)) * n), F.lit("train")).otherwise(F.lit("test"))

    return by_rank(df, key, seed, part, out, within=label)


# SMP4 -------------------------------------------------------------------------
def random_split(df: DataFrame, key: str | Sequence[str], test_size: float = 0.3, seed: int = 42,
                 out: str = "split") -> DataFrame:
    """Plain split with exactly ceil(test_size * n) 'test' rows (first in hash order)."""
    def part(rn, n):
        return F.when(rn <= F.ceil(F.lit(float(test_size)) * n), F.lit("test")).otherwise(F.lit("train"))

    return by_rank(df, key, seed, part, out)


# SMP5 -------------------------------------------------------------------------
def down_sample(df: DataFrame, label: str, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest class, without replacement.

    As with a factor's level table, a NULL label belongs to no class: those rows
    are not part of the result.
    """
    counts = class_counts(df, label)
    if not counts:
        return df
    smallest = min(counts.values())
    df = df.where(F.col(label).isNotNull())
    told = by_rank(df, key, seed, lambda rn, n: rn <= smallest, "_d_in", within=label, n_hint=sum(counts.values()))
    return told.where("_d_in").drop("_d_in")


# SMP6 -------------------------------------------------------------------------
DRAW_CHUNK = 100_000_000   # draw ids per chunk: the class table holds #classes + draws / DRAW_CHUNK rows
COPY_CHUNK = 1_000_000     # copies of one row expanded by one task, at most


def _draws(spark, label: str, label_type: str, shortfall: dict, seed: int, n_by_class: dict) -> DataFrame | None:
    """(label, _u_rn): one row per draw with replacement, generated in parallel.

    All draws are one ``spark.range``; a draw id is mapped to its class by an
    equi-join on id chunks (each class spans a few chunks of DRAW_CHUNK ids),
    then filtered to the class's id interval: a bucketed range join, so neither
    the number of classes nor the number of draws meets one task.
    """
    spans, start = [], 0
    for cls, short in shortfall.items():
        spans.append((cls, start, start + short, n_by_class[cls]))
        start += short
    if start == 0:
        return None
    classes = spark.createDataFrame(spans, f"{label} {label_type}, _lo long, _hi long, _n long")
    classes = classes.withColumn("_chunk", F.explode(F.sequence(
        F.floor(F.col("_lo") / DRAW_CHUNK).cast("long"), F.floor((F.col("_hi") - 1) / DRAW_CHUNK).cast("long"))))
    ids = spark.range(0, start).withColumn("_chunk", F.floor(F.col("id") / DRAW_CHUNK).cast("long"))
    # the class table holds #classes + draws/DRAW_CHUNK rows: bounded, broadcast
    drawn = (ids.join(F.broadcast(classes), "_chunk")
                .where((F.col("id") >= F.col("_lo")) & (F.col("id") < F.col("_hi"))))
    j = F.col("id") - F.col("_lo") + 1
    pick = F.lit(1) + F.pmod(u32(seeded_md5(seed, F.col(label), j)), F.col("_n"))
    return drawn.select(label, pick.alias("_u_rn"))


def drawn_again(df: DataFrame, label: str, key: str | Sequence[str], seed: int = 42) -> DataFrame | None:
    """The rows that ``up_sample`` repeats, once each, with ``_u_extra``: how often each is drawn. None: no row is."""
    counts = class_counts(df, label)
    largest = max(counts.values(), default=0)
    shortfall = {c: largest - n for c, n in counts.items() if n < largest}
    draws = _draws(df.sparkSession, label, dict(df.dtypes)[label], shortfall, seed, counts)
    if draws is None:
        return None
    copies = draws.groupBy(label, "_u_rn").agg(F.count(F.lit(1)).alias("_u_extra"))
    ranked = shuffle_rank(df.where(F.col(label).isin(list(shortfall))), key, seed, within=label, out="_u_rn", total=None,
                          n_hint=sum(counts.values()))
    return ranked.join(copies, [label, "_u_rn"]).select(*df.columns, "_u_extra")


def up_sample(df: DataFrame, label: str, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Every class grown to the largest class size: all original rows plus
    (largest - n_class) rows drawn with replacement from the class.

    Draw j of class c picks the row of rank ``1 + u32(md5(seed-c-j)) % n_c``.
    Draws are generated in parallel, counted per picked rank with a partial
    aggregate (a row picked often is still one row in the shuffle), then joined
    1:1 to the ranked rows and expanded.
    """
    spark = df.sparkSession
    counts = class_counts(df, label)
    if not counts:
        return df
    df = df.where(F.col(label).isNotNull())          # a NULL label belongs to no class (as in down_sample)
    largest = max(counts.values())
    shortfall = {c: largest - n for c, n in counts.items() if n < largest}
    draws = _draws(spark, label, dict(df.dtypes)[label], shortfall, seed, counts)
    if draws is None:
        return df
    copies = draws.groupBy(label, "_u_rn").agg(F.count(F.lit(1)).alias("_u_extra"))
    # nothing is drawn from the largest classes: their rows need no rank and pass as they are
    full = [c for c, n in counts.items() if n == largest]
    as_is, df = df.where(F.col(label).isin(full)), df.where(~F.col(label).isin(full))
    ranked = shuffle_rank(df, key, seed, within=label, out="_u_rn", total=None, n_hint=sum(counts.values()))
    heavy = None
    if max(shortfall.values(), default=0) > COPY_CHUNK:       # otherwise no row can exceed COPY_CHUNK copies
        limit = sum(shortfall.values()) // COPY_CHUNK + 1
        rows = collect_bounded(copies.where(F.col("_u_extra") > COPY_CHUNK), limit, "heavily drawn rows")
        if rows:
            heavy = spark.createDataFrame(rows, copies.schema)
    joined = ranked.join(copies, [label, "_u_rn"], "left")
    if heavy is not None:
        joined = joined.where(F.col("_u_extra").isNull() | (F.col("_u_extra") <= COPY_CHUNK))
    times = F.coalesce(F.col("_u_extra") + 1, F.lit(1)).cast("int")
    out = joined.withColumn("_u_copy", F.explode(F.sequence(F.lit(1), times))).select(*df.columns)
    if heavy is not None:
        # rows drawn more than COPY_CHUNK times: their copies are cut into chunks spread over tasks
        hot = ranked.join(F.broadcast(heavy), [label, "_u_rn"])     # at most draws / COPY_CHUNK rows
        total = F.col("_u_extra") + 1
        chunks = (hot.withColumn("_u_c", F.explode(F.sequence(F.lit(0), F.ceil(total / COPY_CHUNK).cast("long") - 1)))
                     .withColumn("_u_n", F.least(F.lit(COPY_CHUNK), total - F.col("_u_c") * COPY_CHUNK).cast("int")))
        n_chunks = sum(-(-(r["_u_extra"] + 1) // COPY_CHUNK) for r in rows)
        spread = chunks.repartition(max(1, n_chunks))            # round robin: one chunk per task
        out = out.unionByName(spread.withColumn("_u_copy", F.explode(F.sequence(F.lit(1), F.col("_u_n"))))
                              .select(*df.columns))
    return out.unionByName(as_is.select(*df.columns))

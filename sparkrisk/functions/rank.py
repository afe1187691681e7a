"""Seeded, partition-independent row order.

Every random choice in the library (shuffles, folds, splits, re-sampling, donor
draws) is a function of ``md5(seed || '-' || key)``, never of ``rand()`` (which
depends on partitioning) or ``hash()`` (which differs between engines). The same
key and seed give the same rows on any cluster layout, and the same rows in an
SQL engine that has ``md5``.

Two-level rank
--------------
A global ``row_number() over (order by h, key)`` would run in one task. Instead:

1. bucket = first ``digits`` hex characters of ``h`` (order preserving, at most
   ``16**digits`` buckets; md5 spreads unique keys evenly, so no bucket is hot);
2. rows per bucket: a partial+final hash aggregate, at most ``16**digits`` rows;
3. running offsets over that small table: inside bucket groups of a shared
   prefix, then over the groups, so that no task windows over more than
   ``16**ONE_LEVEL`` rows;
4. ``row_number()`` inside each bucket (the rows' only shuffle), plus the
   bucket's offset, joined on the bucket the rows are already partitioned by.

The result equals the single global window exactly. NULL is a group value like
any other (grouping and join use a text key that is never NULL): no row is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import collect_bounded

MAX_BUCKET_ROWS = 1_000_000   # rows per hash bucket the in-bucket window may sort
MAX_DIGITS = 6
MAX_RANGES = 1_000_000        # groups x (answers + cuts) that by_rank may look up
ONE_LEVEL = 3                 # digits up to which one window over all offsets is small (4,096 rows)


def bucket_digits(df: DataFrame, n: int | None = None) -> int:
    """Hex digits of the bucket prefix for ``df``: enough buckets to keep each
    under MAX_BUCKET_ROWS rows and to give every shuffle partition about four
    buckets, so the in-bucket windows are balanced and small (one count job
    unless the row count ``n`` is already known)."""
    n = df.count() if n is None else n
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    need = max(n / MAX_BUCKET_ROWS, 4 * parts, 1)
    return max(1, min(MAX_DIGITS, math.ceil(math.log(need, 16))))


def _names(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def seeded_md5(seed: int | str, *cols: str | Column) -> Column:
    """``md5(seed-c1-c2...)`` as lowercase hex; columns are cast to string."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.md5(F.concat_ws("-", *parts))


def hash_name(seed: int | str, *cols: str) -> str:
    """Name of the column that :func:`with_hash` adds."""
    return "_md5_" + "_".join([str(seed), *cols])


def with_hash(df: DataFrame, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """``df`` with the seeded md5 of its key as a column: written with the rows, it is not worked out again by every pass,
    and the key columns need not be kept for it (ranks break ties of the hash by the key and do need them)."""
    keys = _names(key)
    return df.withColumn(hash_name(seed, *keys), seeded_md5(seed, *keys))


def hash_of(df: DataFrame, seed: int | str, *cols: str) -> Column:
    """The seeded md5 of the key: the column of :func:`with_hash` where ``df`` has it."""
    name = hash_name(seed, *cols)
    return F.col(f"`{name}`") if name in df.columns else seeded_md5(seed, *cols)


def u32(hex_col: Column) -> Column:
    """First 8 hex digits of an md5 as an unsigned 32-bit number (bigint)."""
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("bigint")


def shuffle_rank(df: DataFrame, key: str | Sequence[str], seed: int = 42,
                 within: str | Sequence[str] | None = None, out: str = "rn",
                 total: str | None = "n_group", digits: int | None = None,
                 n_hint: int | None = None) -> DataFrame:
    """Add ``out`` = 1..n in seeded random order (SRT1), per ``within`` group if given.

    ``key`` must be unique (within ``within``); ties on the hash are broken by it.
    ``total`` (if not None) receives the group size n. ``digits`` (bucket
    prefix length) defaults to :func:`bucket_digits` (``n_hint``: a known row
    count, saves its count job); the result does not depend on it.
    """
    if digits is None:
        digits = bucket_digits(df, n_hint)
    keys = _names(key)
    tmp_h, tmp_b, tmp_nb, tmp_off = "_sr_h", "_sr_b", "_sr_nb", "_sr_off"
    hashed, named = _hashed(df, keys, seed, _names(within), digits)
    part = named + [tmp_b]
    counts = hashed.groupBy(*part).agg(F.count(F.lit(1)).alias(tmp_nb))
    offsets = _offsets(counts, named, tmp_b, tmp_nb, tmp_off, digits).drop(tmp_nb)
    # number rows inside each bucket first (the one shuffle of the rows, by bucket), then add the
    # bucket's offset: the rows are already partitioned by the bucket, so the join moves only the
    # offsets table (#groups x 16**digits rows); AQE turns it into a broadcast when that is small
    w_in = Window.partitionBy(*part).orderBy(tmp_h, *keys)
    ranked = (hashed.withColumn("_sr_in", F.row_number().over(w_in))
                    .join(offsets, part)
                    .withColumn(out, (F.col("_sr_in") + F.col(tmp_off)).cast("bigint")))
    extra = [out]
    if total:
        ranked = ranked.withColumn(total, F.col("_sr_total").cast("bigint"))
        extra.append(total)
    return ranked.select(*[c for c in df.columns if c not in extra], *extra)


def _hashed(df: DataFrame, keys: list[str], seed: int, groups: list[str], digits: int) -> tuple[DataFrame, list[str]]:
    """``df`` with its order hash, bucket, and a text key per group column that is never NULL; those keys' names."""
    named = [f"_sr_g{i}" for i in range(len(groups))]
    hashed = (df.withColumn("_sr_h", hash_of(df, seed, *keys))
                .withColumn("_sr_b", F.substring("_sr_h", 1, digits)))
    return hashed.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(f"`{g}`").cast("string")), F.lit("NULL"))
                               for n, g in zip(named, groups)}), named


def by_rank(df: DataFrame, key: str | Sequence[str], seed: int, decide: Callable[[Column, Column], Column], out: str,
            within: str | Sequence[str] | None = None, n_hint: int | None = None) -> DataFrame:
    """Add ``out`` = decide(rank, size) of every row's place in the seeded order of its group, without ranking all.

    ``decide`` must never turn back as the rank grows (folds, "is among the first m"). The bucket counts say
    which buckets lie wholly on one side of every cut: their rows get the answer from a lookup of one range of
    buckets per group and answer, in place. Only the buckets that a cut falls in (at most one per cut and
    group) are shuffled and ranked. Same rows and answers as ranking everything.
    """
    digits = bucket_digits(df, n_hint)
    keys = _names(key)
    hashed, named = _hashed(df, keys, seed, _names(within), digits)
    counts = hashed.groupBy(*named, "_sr_b").agg(F.count(F.lit(1)).alias("_sr_nb"))
    table = _offsets(counts, named, "_sr_b", "_sr_nb", "_sr_off", digits)
    table = table.withColumns({"_sr_lo": decide(F.col("_sr_off") + 1, F.col("_sr_total")),
                               "_sr_hi": decide(F.col("_sr_off") + F.col("_sr_nb"), F.col("_sr_total"))})
    same = F.col("_sr_lo").eqNullSafe(F.col("_sr_hi"))
    whole = table.where(same).groupBy(*named, "_sr_lo").agg(F.min("_sr_b").alias("_sr_from"), F.max("_sr_b").alias("_sr_to"))
    none = F.lit(None)
    both = whole.select(*named, "_sr_lo", "_sr_from", "_sr_to", none.cast("bigint").alias("_sr_off"), none.cast("bigint").alias("_sr_total")) \
        .unionByName(table.where(~same).select(*named, none.cast(table.schema["_sr_lo"].dataType).alias("_sr_lo"),
                                               F.col("_sr_b").alias("_sr_from"), F.col("_sr_b").alias("_sr_to"),
                                               F.col("_sr_off").cast("bigint"), F.col("_sr_total").cast("bigint")))
    rows = collect_bounded(both, MAX_RANGES, "by_rank")  # a row per group and answer, and per group and cut
    spark, cols = df.sparkSession, [c for c in df.columns if c != out]
    ranges = [r for r in rows if r["_sr_off"] is None]
    cuts = [r for r in rows if r["_sr_off"] is not None]
    if not rows:
        return df.select(*cols, decide(F.lit(1), F.lit(1)).alias(out))
    at = spark.createDataFrame(cuts, both.schema).withColumnRenamed("_sr_from", "_sr_b").drop("_sr_lo", "_sr_to")
    if named:
        known = F.broadcast(spark.createDataFrame(ranges, both.schema).drop("_sr_off", "_sr_total"))
        clear = hashed.join(F.broadcast(at.select(*named, "_sr_b")), [*named, "_sr_b"], "left_anti") if cuts else hashed
        answered = (clear.join(known, named).where(F.col("_sr_b").between(F.col("_sr_from"), F.col("_sr_to")))
                    .select(*cols, F.col("_sr_lo").alias(out)))
    else:
        answer = F.lit(None).cast(both.schema["_sr_lo"].dataType)
        for r in ranges:
            answer = F.when(F.col("_sr_b").between(r["_sr_from"], r["_sr_to"]), F.lit(r["_sr_lo"])).otherwise(answer)
        inside = F.lit(False)
        for r in cuts:
            inside = inside | (F.col("_sr_b") == r["_sr_from"])
        answered = hashed.where(~inside).select(*cols, answer.alias(out))
    if not cuts:
        return answered
    w_in = Window.partitionBy(*named, "_sr_b").orderBy("_sr_h", *keys)
    ranked = (hashed.join(F.broadcast(at), [*named, "_sr_b"]).withColumn("_sr_in", F.row_number().over(w_in))
              .select(*cols, decide(F.col("_sr_in") + F.col("_sr_off"), F.col("_sr_total")).alias(out)))
    return answered.unionByName(ranked)


def _offsets(counts: DataFrame, groups: list[str], bucket: str, n: str, off: str, digits: int) -> DataFrame:
    """Rows in each bucket (``n``), before it in its group (``off``), and the group's size (``_sr_total``)."""
    def before(value: str, window) -> Column:
        return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if digits <= ONE_LEVEL:
        return counts.select(*groups, bucket, n, before(n, Window.partitionBy(*groups).orderBy(bucket)).alias(off),
                             F.sum(n).over(Window.partitionBy(*groups)).alias("_sr_total"))
    key = [*groups, "_sr_p"]
    inner = counts.withColumn("_sr_p", F.substring(bucket, 1, digits - ONE_LEVEL))
    tops = inner.groupBy(*key).agg(F.sum(n).alias("_sr_t"))
    tops = tops.select(*key, before("_sr_t", Window.partitionBy(*groups).orderBy("_sr_p")).alias("_sr_up"),
                       F.sum("_sr_t").over(Window.partitionBy(*groups)).alias("_sr_total"))
    inner = inner.select(*key, bucket, n, before(n, Window.partitionBy(*key).orderBy(bucket)).alias("_sr_low"))
    return inner.join(tops, key).select(*groups, bucket, n, (F.col("_sr_low") + F.col("_sr_up")).alias(off), "_sr_total")


def fold_of(rn: Column | str, n: Column | str, k: int) -> Column:
    """Fold of the rn-th of n rows when 1..n is cut into k equal-width intervals.

    Same as cutting ``seq(1, n)`` with ``breaks=k`` into right-closed intervals:
    ``max(1, ceil((rn-1)*k/(n-1)))``, in integer arithmetic; n = 1 gives fold 1.
    """
    rn = F.col(rn) if isinstance(rn, str) else rn
    n = F.col(n) if isinstance(n, str) else n
    numer = (rn - 1) * F.lit(k) + n - 2          # >= 0 whenever n >= 2
    denom = n - 1
    quotient = ((numer - F.pmod(numer, denom)) / denom).cast("bigint")  # exact integer div
    return (F.when(n <= 1, F.lit(1))
             .otherwise(F.greatest(F.lit(1), quotient.cast("int")))
             .cast("int"))

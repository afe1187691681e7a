"""Classification and regression metrics, cross-validation (EVL1-EVL8, MDL11).

Each metric set is one aggregate over the scored rows (partial aggregation, no
row reaches the driver). Tests that need special functions (confidence
interval, McNemar, binomial test) are computed from the few resulting counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import stats
from .shape import fold_split, stack_tagged


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# EVL1 -------------------------------------------------------------------------
def _grouped(df: DataFrame, by: str | Sequence[str] | None):
    if by is None:
        return df.groupBy()
    return df.groupBy(*([by] if isinstance(by, str) else list(by)))


def recall(df: DataFrame, pred: str, truth: str, relevant, by: str | Sequence[str] | None = None) -> DataFrame:
    """(tp, fn, recall) of one class: TP / (TP + FN); one row per ``by`` group."""
    is_rel = _c(truth) == F.lit(relevant)
    hit = _c(pred) == F.lit(relevant)
    out = _grouped(df, by).agg(F.count_if(is_rel & hit).alias("tp"), F.count_if(is_rel & ~hit).alias("fn"))
    return out.withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))


# EVL2 -------------------------------------------------------------------------
def confusion_matrix(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Long confusion matrix: (truth, prediction, n)."""
    return (df.groupBy(_c(truth).alias("truth"), _c(pred).alias("prediction"))
              .agg(F.count(F.lit(1)).alias("n")))


def confusion_stats(df: DataFrame, pred: str, truth: str, positive,
                    by: str | Sequence[str] | None = None) -> DataFrame:
    """One row (per ``by`` group) of two-class statistics with ``positive`` as the event class.

    accuracy, kappa, sensitivity, specificity, ppv, npv, prevalence,
    detection_rate, detection_prevalence, balanced_accuracy, no_information_rate
    plus the four counts. Rows whose truth or prediction is NULL are left out.
    """
    t, p = _c(truth), _c(pred)
    pos_t, pos_p = t == F.lit(positive), p == F.lit(positive)
    base = _grouped(df.where(t.isNotNull() & p.isNotNull()), by).agg(
        F.count_if(pos_t & pos_p).alias("tp"), F.count_if(~pos_t & pos_p).alias("fp"),
        F.count_if(pos_t & ~pos_p).alias("fn"), F.count_if(~pos_t & ~pos_p).alias("tn"))
    return _two_class(base, [] if by is None else ([by] if isinstance(by, str) else list(by)))


def counted_stats(counts: DataFrame, positive, by: Sequence[str] = ()) -> DataFrame:
    """:func:`confusion_stats` from counts (truth, prediction, n), as the forests and machines give them."""
    t, p = F.col("truth") == F.lit(positive), F.col("prediction") == F.lit(positive)

    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")

    base = counts.groupBy(*by).agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))
    return _two_class(base, list(by))


def counted_recall(counts: DataFrame, relevant, by: Sequence[str] = ()) -> DataFrame:
    """:func:`recall` from counts (truth, prediction, n)."""
    stats_ = counted_stats(counts, relevant, by)
    return stats_.select(*by, "tp", "fn", F.col("sensitivity").alias("recall"))


def _two_class(base: DataFrame, keys: list[str]) -> DataFrame:
    """The statistics of rows with the four counts tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    acc = F.try_divide(tp + tn, n)
    pe = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    sens = F.try_divide(tp, tp + fn)
    spec = F.try_divide(tn, tn + fp)
    return base.select(
        *keys, "tp", "fp", "fn", "tn",
        acc.alias("accuracy"),
        F.try_divide(acc - pe, 1 - pe).alias("kappa"),
        sens.alias("sensitivity"), spec.alias("specificity"),
        F.try_divide(tp, tp + fp).alias("ppv"), F.try_divide(tn, tn + fn).alias("npv"),
        F.try_divide(tp + fn, n).alias("prevalence"), F.try_divide(tp, n).alias("detection_rate"),
        F.try_divide(tp + fp, n).alias("detection_prevalence"),
        ((sens + spec) / 2).alias("balanced_accuracy"),
        F.try_divide(F.greatest(tp + fn, fp + tn), n).alias("no_information_rate"))


def confusion_tests(tp: int, fp: int, fn: int, tn: int, conf: float = 0.95) -> dict:
    """Accuracy CI (exact binomial), P[accuracy > NIR] and McNemar p from four counts."""
    n = tp + fp + fn + tn
    correct = tp + tn
    lo, hi = stats.clopper_pearson(correct, n, conf) if n else (float("nan"), float("nan"))
    nir = max(tp + fn, fp + tn) / n if n else float("nan")
    return {"accuracy_lower": lo, "accuracy_upper": hi,
            "accuracy_p_value": stats.binom_sf(correct, n, nir) if n else float("nan"),
            "mcnemar_p_value": stats.mcnemar_p(fp, fn)}


def confusion_report(df: DataFrame, pred: str, truth: str, positive, conf: float = 0.95) -> dict:
    """confusion_stats plus the tests, as one dict (a single row reaches the driver)."""
    row = confusion_stats(df, pred, truth, positive).first().asDict()
    row.update(confusion_tests(row["tp"], row["fp"], row["fn"], row["tn"], conf))
    return row


def per_class_stats(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """One-vs-rest recall / precision per class for any number of classes."""
    cm = confusion_matrix(df, pred, truth)
    by_truth = cm.groupBy("truth").agg(F.sum("n").alias("n_truth"),
                                       F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n"))).alias("tp"))
    by_pred = cm.groupBy("prediction").agg(F.sum("n").alias("n_pred"))
    out = by_truth.join(by_pred, by_truth.truth == by_pred.prediction, "full_outer")
    cls = F.coalesce("truth", "prediction")
    tp = F.coalesce("tp", F.lit(0)).cast("double")
    return out.select(cls.alias("class"), F.coalesce("n_truth", F.lit(0)).alias("n_truth"),
                      F.coalesce("n_pred", F.lit(0)).alias("n_pred"),
                      F.try_divide(tp, F.col("n_truth")).alias("recall"),
                      F.try_divide(tp, F.col("n_pred")).alias("precision"))


# EVL3-EVL7 / AGG13 / UDF3 / UDF4 ----------------------------------------------
def regression_metrics(df: DataFrame, pred: str, truth: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """One pass: n, r2, mae, mse, rmse, mape (one row per ``by`` group).

    r2 = 1 - SSE / (n * var_pop(y)); mape = mean(|pred - y| / y) as a fraction
    with the signed denominator; rows with y = 0 are left out of mape (where
    numpy would return inf).
    """
    p, y = _c(pred).cast("double"), _c(truth).cast("double")
    e = p - y
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    agg = _grouped(df.where(p.isNotNull() & y.isNotNull()), by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("_sse"), F.var_pop(y).alias("_vy"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.avg(F.try_divide(F.abs(e), y)).alias("mape"))
    return agg.select(
        *keys, "n",
        (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("n"))).alias("r2"),
        "mae", "mse", F.sqrt("mse").alias("rmse"), "mape")


# EVL8 -------------------------------------------------------------------------
def residuals(df: DataFrame, pred: str, truth: str, out: str = "residual") -> DataFrame:
    """Adds residual = truth - prediction (the data behind a residual plot)."""
    return df.withColumn(out, _c(truth).cast("double") - _c(pred).cast("double"))


def missing_residuals(df: DataFrame, pred: str, truth: str) -> int:
    """Rows whose residual is NULL or NaN (left out of the histogram)."""
    return residuals(df, pred, truth).where(F.col("residual").isNull() | F.isnan("residual")).count()


def residual_histogram(df: DataFrame, pred: str, truth: str, bins: int = 20) -> DataFrame:
    """(bin, lower, upper, n): equal-width histogram of residuals; one tiny agg + one grouped count.

    NULL and NaN residuals belong to no bin; :func:`missing_residuals` counts them.
    """
    r = residuals(df, pred, truth).select("residual").where(F.col("residual").isNotNull() & ~F.isnan("residual"))
    lo, hi = r.agg(F.min("residual"), F.max("residual")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("residual") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1)) + 1
    counts = r.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
                         (F.lit(lo) + F.col("bin") * F.lit(width)).alias("upper"), "n")


# MDL11 ------------------------------------------------------------------------
def cross_validate(df: DataFrame, k: int, fit: Callable[[DataFrame], object],
                   predict: Callable[[object, DataFrame], DataFrame],
                   metrics: Callable[..., DataFrame],
                   rebalance: Callable[[DataFrame], DataFrame] | None = None,
                   fold_col: str = "fold", folds: Sequence[int] | None = None, parallel: int = 3) -> DataFrame:
    """k-fold CV with rebalancing applied to the training part of each fold only.

    ``df`` carries a ``fold`` column (see ``assign_folds``) and should be
    checkpointed by the caller. Per fold: rebalance(train) -> fit -> one
    scoring pass over the (rebalanced) training part and the held-out part ->
    ``metrics(scored, by="part")``, one row per part. The rebalanced part is
    persisted for the fold (fit and scoring read it; it is deterministic, so a
    lost block recomputes to the same rows) and released once the fold's few
    metric rows are collected. Returns (fold, part, <metric columns>); fits are
    distributed, and ``parallel`` folds, which are independent, are submitted at
    a time: a tree fit is one small job per level, so one fold alone leaves
    executors idle. Results do not depend on it.
    """
    def one(i: int) -> tuple[list, StructType]:
        train, held = fold_split(df, i, fold_col)
        train, held = train.drop(fold_col), held.drop(fold_col)
        if rebalance is not None:
            train = rebalance(train)
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = fit(train)
            scored = predict(model, stack_tagged({"train": train, "held_out": held}, tag="part"))
            m = metrics(scored, by="part")
            return [(i, *r) for r in m.collect()], m.schema
        finally:
            train.unpersist()

    spark = df.sparkSession
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        done = list(pool.map(one, folds if folds is not None else range(1, k + 1)))
    if not done:
        return spark.createDataFrame([], "fold int")
    rows, schema = [r for part, _ in done for r in part], done[0][1]
    out = spark.createDataFrame(rows, StructType([StructField("fold", IntegerType())] + list(schema.fields)))
    ordered = ["fold", "part"] + [c for c in out.columns if c not in ("fold", "part")]
    return out.select(*ordered)

"""Feature ranking and selection (MDL12, MDL13, SRT4, DOR4).

``rank_features`` is one unpivot + one grouped count over all features, then
window sums over the small (feature, value, label) table: information gain,
chi-squared and Cramer's V for every feature in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..session import collect_bounded, cut_lineage
from .discretise import entropy_bins


# SRT4 / SRT3 ------------------------------------------------------------------
def top_k(df: DataFrame, by: str, k: int, descending: bool = True, tie: str | None = None) -> DataFrame:
    """The k rows with the largest (or smallest) ``by``; ``tie`` breaks ties."""
    order = [F.desc(by) if descending else F.asc(by)] + ([F.asc(tie)] if tie else [])
    return df.orderBy(*order).limit(k)


def equal_width_bins(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Replace numeric columns by their equal-width bin (1..bins) between min and max."""
    if not cols:
        return df
    row = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    exprs = {}
    for i, c in enumerate(cols):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:
            exprs[c] = F.lit(None).cast("int")
            continue
        width = (float(hi) - float(lo)) / bins if hi != lo else 1.0
        b = F.floor((F.col(c).cast("double") - F.lit(float(lo))) / F.lit(width)).cast("int")
        exprs[c] = F.least(b, F.lit(bins - 1)) + 1
    return df.withColumns(exprs)


def quantile_bins(df: DataFrame, cols: Sequence[str], bins: int = 10, accuracy: int = 10_000) -> DataFrame:
    """Replace numeric columns by their quantile bin (1..bins): cut points from
    one GK-sketch aggregate (``percentile_approx``), a value's bin is one plus
    the number of cut points below it."""
    if not cols:
        return df
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(c, probs, accuracy).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    exprs = {}
    for i, c in enumerate(cols):
        cuts = sorted(set(row[f"q{i}"] or []))
        b = F.lit(1)
        for cut in cuts:
            b = b + (F.col(c).cast("double") > F.lit(float(cut))).cast("int")
        exprs[c] = F.when(F.col(c).isNotNull(), b)
    return df.withColumns(exprs)


# MDL13 ------------------------------------------------------------------------
def rank_features(df: DataFrame, label: str, categorical: Sequence[str] = (), numeric: Sequence[str] = (),
                  bins: int = 10, p_values: bool = False, cuts: str = "width") -> DataFrame:
    """(feature, info_gain, chi2, dof, cramers_v, rank[, p_value]) ranked by information gain.

    Numeric features are cut into ``bins`` equal-width bins first
    (``cuts='quantile'``: equal-frequency bins from a GK sketch; ``cuts='entropy'``:
    cuts that pay for their description, see :mod:`.discretise`). Information
    gain is the mutual information of feature and label in nats; chi2 sums
    (O - E)^2 / E over every (value, label) pair of the feature, the
    unobserved pairs through their expected counts (no grid of pairs is built).
    """
    labelled = df.where(F.col(label).isNotNull())
    data = (entropy_bins(labelled, label, list(numeric)) if cuts == "entropy"
            else quantile_bins(labelled, list(numeric), bins) if cuts == "quantile"
            else equal_width_bins(labelled, list(numeric), bins))
    feats = list(categorical) + list(numeric)
    long = (data.select(F.col(label).cast("string").alias("_y"), *[F.col(c).cast("string").alias(c) for c in feats])
                .unpivot(["_y"], feats, "feature", "value")
                .where(F.col("value").isNotNull()))
    # the cell table feeds the margins and the sums: written once instead of scanning the input again
    cells = cut_lineage(long.groupBy("feature", "value", "_y").agg(F.count(F.lit(1)).alias("o")))
    values = cells.groupBy("feature", "value").agg(F.sum("o").alias("n_v"))
    labels = cells.groupBy("feature", "_y").agg(F.sum("o").alias("n_y"))
    totals = values.groupBy("feature").agg(F.sum("n_v").alias("n"), F.count(F.lit(1)).alias("_r"))
    # margins are joined to the observed cells only (one row per feature for the totals)
    # (feature, label) margins are features x classes rows: broadcast, else the cells would meet on that few keys
    obs = (cells.join(values, ["feature", "value"]).join(F.broadcast(labels), ["feature", "_y"])
                .join(F.broadcast(totals), "feature"))
    o = F.col("o").cast("double")
    nv, ny, n = (F.col(x).cast("double") for x in ("n_v", "n_y", "n"))
    e = nv * ny / n
    # chi2 over every (value, label) pair = sum over observed cells of (O - E)^2 / E
    # plus the expected counts of the unobserved cells, N - sum over observed cells of E
    per = obs.groupBy("feature").agg(
        (F.sum((o - e) * (o - e) / e) + (F.first(n) - F.sum(e))).alias("_chi2"),
        F.first(n).alias("_n"),
        F.sum(o / n * F.log(o * n / (nv * ny))).alias("info_gain"),
        F.first("_r").alias("_r"), F.count_distinct("_y").alias("_c"))
    chi2 = F.col("_chi2")
    dof = ((F.col("_r") - 1) * (F.col("_c") - 1)).cast("int")
    k = F.least(F.col("_r"), F.col("_c")) - 1
    out = per.select("feature", "info_gain", chi2.alias("chi2"), dof.alias("dof"),
                     F.when(k > 0, F.sqrt(chi2 / (F.col("_n") * k))).alias("cramers_v"))
    # one row per feature: the unpartitioned window sorts a bounded table
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("info_gain"), F.asc("feature"))))
    if not p_values:
        return out
    rows = collect_bounded(out, 100_000, "rank_features")  # one row per feature
    data_rows = [(*r, stats.chi2_sf(r["chi2"], r["dof"]) if r["chi2"] is not None else None) for r in rows]
    return df.sparkSession.createDataFrame(
        data_rows, "feature string, info_gain double, chi2 double, dof int, cramers_v double, rank int, "
                   "p_value double")


# MDL12 ------------------------------------------------------------------------
def leave_one_out_features(features: Sequence[str], fit_and_score: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Refit once per feature with that feature left out.

    ``fit_and_score(kept_features)`` returns a metrics frame; the union is tagged
    with the dropped feature. Each fit is distributed; the loop runs on the driver.
    """
    out = None
    for f in features:
        kept = [x for x in features if x != f]
        m = fit_and_score(kept).select(F.lit(f).alias("dropped"), "*")
        out = m if out is None else out.unionByName(m)
    return out


# DOR4 -------------------------------------------------------------------------
def tune_mtry(grid: Sequence[int], evaluate: Callable[[int], float]) -> list[tuple[int, float]]:
    """[(mtry, score)] for each candidate; ``evaluate`` typically runs cross-validation."""
    return [(m, evaluate(m)) for m in grid]

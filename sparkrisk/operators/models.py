"""Model fitting and scoring on MLlib (MDL1-MDL10, MDL14, DOR3, DOR5).

Every fit takes a DataFrame with named feature columns; a pipeline (indexer +
assembler + estimator) is returned, so scoring new rows is one ``transform``
(a projection: the fitted model is broadcast to the executors).

Tree fits first put rows in a canonical layout (hash-partition on the row key,
sort within partitions): MLlib's split candidates come from a sample of the
input, so the same rows in another partitioning could grow other trees.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import forest as H
from .features import assembler_pipeline, encoder_levels, feature_names, fit_levels, gappy_columns
from .kernel_svm import PolyMap

MAX_DEPTH = 30  # MLlib's hard limit


def _depth(max_depth: int) -> int:
    if not 0 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth {max_depth}: MLlib grows trees to depth {MAX_DEPTH} at most")
    return max_depth


def _encoder(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], one_hot_encode: bool,
             max_bins: int = 0) -> tuple[PipelineModel, int]:
    """(fitted feature pipeline, bins): enough bins for every level of the widest category, and ``max_bins`` at least."""
    enc = assembler_pipeline(numeric, categorical, one_hot_encode=one_hot_encode,
                             gappy=gappy_columns(df, numeric)).fit(df)
    return enc, max([max_bins, *(n + 1 for n in encoder_levels(enc))])


def canonical_layout(df: DataFrame, key: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """Fixed partitioning and order so tree fits do not depend on the input layout.

    ``partitions`` defaults to the session's ``spark.sql.shuffle.partitions``
    (the cluster's sizing); the layout is fixed for a given setting.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def _label_indexer(label: str, out: str = "_label") -> StringIndexer:
    # alphabetical level order, as factor levels are
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc")


def class_weight_col(df: DataFrame, label: str, weights: Mapping, out: str = "_weight") -> DataFrame:
    """Per-row weight from a {class: weight} map (classes not listed get 1)."""
    expr = None
    for cls, w in weights.items():
        cond = F.col(label) == F.lit(cls)
        expr = F.when(cond, F.lit(float(w))) if expr is None else expr.when(cond, F.lit(float(w)))
    return df.withColumn(out, (expr.otherwise(F.lit(1.0)) if expr is not None else F.lit(1.0)))


def labels_of(model: PipelineModel) -> list[str]:
    """Class names in index order of a fitted classification pipeline."""
    return list(model.stages[0].labels)


def _fit_classifier(df: DataFrame, label: str, numeric, categorical, estimator, key,
                    class_weights, layout_partitions, one_hot_encode: bool, max_bins: int = 0) -> PipelineModel:
    data = df
    if class_weights:
        data = class_weight_col(data, label, class_weights)
        estimator.setWeightCol("_weight")
    held = None
    if key is not None:
        # shuffled and sorted once: encoders, split candidates and the fit read it again and again
        used = dict.fromkeys([label, *numeric, *categorical, *(["_weight"] if class_weights else [])])
        data = held = canonical_layout(data, key, layout_partitions).select(*used).persist(StorageLevel.DISK_ONLY)
    try:
        enc, bins = _encoder(data, numeric, categorical, one_hot_encode, max_bins)
        if max_bins:
            estimator.setMaxBins(bins)
        indexer = _label_indexer(label).fit(data)
        return PipelineModel([indexer, enc, estimator.fit(enc.transform(indexer.transform(data)))])
    finally:
        if held is not None:
            held.unpersist()


# MDL1 -------------------------------------------------------------------------
def random_forest(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                  trees: int = 50, mtry: int | str = 17, class_weights: Mapping | None = None,
                  max_depth: int = 10, max_bins: int = 64, seed: int = 42, key: str | None = None,
                  layout_partitions: int | None = None) -> PipelineModel:
    """Random forest classifier; ``mtry`` candidate features per split."""
    rf = RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=trees,
                                featureSubsetStrategy=str(mtry), maxDepth=_depth(max_depth), seed=seed)
    return _fit_classifier(df, label, numeric, categorical, rf, key, class_weights, layout_partitions, False, max_bins)


# MDL4 -------------------------------------------------------------------------
def decision_tree(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                  max_depth: int = 10, min_instances: int = 2, min_info_gain: float = 0.0,
                  max_bins: int = 64, seed: int = 42, key: str | None = None,
                  class_weights: Mapping | None = None, layout_partitions: int | None = None) -> PipelineModel:
    """Single entropy decision tree."""
    dt = DecisionTreeClassifier(featuresCol="features", labelCol="_label", impurity="entropy",
                                maxDepth=_depth(max_depth), minInstancesPerNode=min_instances,
                                minInfoGain=min_info_gain, seed=seed)
    return _fit_classifier(df, label, numeric, categorical, dt, key, class_weights, layout_partitions, False, max_bins)


# MDL8 -------------------------------------------------------------------------
def logistic_multinomial(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                         max_iter: int = 100, reg: float = 0.0) -> PipelineModel:
    """Multinomial logistic regression on one-hot encoded categories."""
    lr = LogisticRegression(featuresCol="features", labelCol="_label", family="multinomial",
                            maxIter=max_iter, regParam=reg)
    return _fit_classifier(df, label, numeric, categorical, lr, None, None, 0, True)


# MDL2 -------------------------------------------------------------------------
def score(model: PipelineModel, df: DataFrame, out: str = "predicted") -> DataFrame:
    """Apply a classification pipeline; ``out`` holds the predicted class name.

    A label column is not needed on the scored rows.
    """
    labels = labels_of(model)
    inner = PipelineModel(model.stages[1:])
    scored = inner.transform(df)
    lab = F.array(*[F.lit(v) for v in labels])
    return scored.withColumn(out, F.element_at(lab, F.col("prediction").cast("int") + 1))


# MDL5 -------------------------------------------------------------------------
def cost_sensitive(scored: DataFrame, labels: Sequence[str], costs: Mapping[str, Mapping[str, float]],
                   probability: str = "probability", out: str = "predicted") -> DataFrame:
    """Minimum expected cost decision: predict i minimising sum_j p_j * cost[i][j].

    ``costs[predicted][true]``; a two-class matrix with c(miss) / c(false alarm)
    predicts the positive class iff p_pos * c_miss > p_neg * c_false_alarm.
    Ties go to the earlier class.
    """
    p = vector_to_array(F.col(probability)) if dict(scored.dtypes).get(probability) == "vector" \
        else F.col(probability)
    exp_cost = []
    for pred_cls in labels:
        total = None
        for j, true_cls in enumerate(labels):
            c = float(costs.get(pred_cls, {}).get(true_cls, 0.0))
            term = p[j] * F.lit(c)
            total = term if total is None else total + term
        exp_cost.append(total)
    best = F.least(*exp_cost) if len(exp_cost) > 1 else exp_cost[0]
    choice = None
    for cls, e in zip(labels, exp_cost):
        choice = F.when(e == best, F.lit(cls)) if choice is None else choice.when(e == best, F.lit(cls))
    return scored.withColumn(out, choice)


def cost_matrix(classes: Sequence[str], miss_cost: float, false_alarm_cost: float) -> dict:
    """Two-class cost matrix {predicted: {true: cost}}; classes = (negative, positive)."""
    neg, pos = classes
    return {neg: {neg: 0.0, pos: float(miss_cost)}, pos: {neg: float(false_alarm_cost), pos: 0.0}}


# MDL6 -------------------------------------------------------------------------
class BoostedTrees:
    """SAMME boosted decision trees: a list of (tree pipeline, vote weight)."""

    def __init__(self, labels, rounds):
        self.labels = list(labels)
        self.rounds = rounds  # [(PipelineModel without label indexer, alpha)]

    def transform(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Weighted class shares in ``probability`` (array) and the class with the largest in ``out``."""
        return boosted_score(self, df, out)


def boosted_tree(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                 rounds: int = 3, max_depth: int = 5, key: str | None = None, seed: int = 42,
                 max_bins: int = 64, layout_partitions: int | None = None,
                 checkpoint_every: int = 5) -> BoostedTrees:
    """SAMME (multi-class AdaBoost): each round fits a weighted entropy tree, the
    weight of misclassified rows grows by exp(alpha).

    The weight update is one projection and one aggregate. Each round's frame
    is persisted (the fitted trees are fixed, so a lost block recomputes to the
    same rows) and lineage is cut into the reliable checkpoint folder every
    ``checkpoint_every`` rounds, so long runs never replay a long chain.
    """
    indexer = _label_indexer(label).fit(df)
    labels = list(indexer.labels)
    k = len(labels)
    feats, bins = _encoder(df, numeric, categorical, False, max_bins)
    data = feats.transform(indexer.transform(df))
    if key is not None:
        data = canonical_layout(data, key, layout_partitions)
    data = cut_lineage(data.withColumn("_w", F.lit(1.0)))
    held = []
    out_rounds = []
    for r in range(rounds):
        tree = DecisionTreeClassifier(featuresCol="features", labelCol="_label", weightCol="_w",
                                      impurity="entropy", maxDepth=_depth(max_depth),
                                      maxBins=bins, seed=seed + r,
                                      predictionCol="_bp", rawPredictionCol="_br", probabilityCol="_bq")
        model = tree.fit(data)
        pred = model.transform(data)
        miss = (F.col("_bp") != F.col("_label")).cast("double")
        agg = pred.agg(F.sum(F.col("_w") * miss).alias("e"), F.sum("_w").alias("t")).first()
        err = agg["e"] / agg["t"] if agg["t"] else 0.0
        if err >= 1.0 - 1.0 / k:  # no better than chance: stop
            if not out_rounds:
                out_rounds.append((PipelineModel([feats, model]), 1.0))
            break
        err = max(err, 1e-10)
        alpha = math.log((1.0 - err) / err) + math.log(k - 1)
        out_rounds.append((PipelineModel([feats, model]), alpha))
        if err <= 1e-10 or r == rounds - 1:
            break
        new_w = F.col("_w") * F.exp(F.lit(alpha) * miss) / F.lit(agg["t"])
        nxt = pred.withColumn("_w", new_w).drop("_bp", "_br", "_bq")
        if (r + 1) % checkpoint_every == 0:
            data = cut_lineage(nxt)
            for h in held:
                h.unpersist()
            held = []
        else:
            data = nxt.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(data)
    for h in held:
        h.unpersist()
    return BoostedTrees(labels, out_rounds)


def boosted_score(model: BoostedTrees, df: DataFrame, out: str = "predicted") -> DataFrame:
    """Score with a boosted model: features are assembled once, each tree votes with its leaf's class shares.

    The shares, averaged by the trees' weights, are the ``probability`` that a cost rule needs (whole votes of
    a few trees are no probabilities: nearly any single vote would decide).
    The columns of ``df`` all stay; what scoring adds besides ``probability`` and ``out`` goes.
    """
    feats = model.rounds[0][0].stages[0]
    scored = feats.transform(df)
    k = len(model.labels)
    votes = [F.lit(0.0) for _ in range(k)]
    for r, (m, alpha) in enumerate(model.rounds):
        tree = m.stages[-1].copy()
        tree.setPredictionCol(f"_b{r}_pred").setRawPredictionCol(f"_b{r}_raw").setProbabilityCol(f"_b{r}_prob")
        scored = tree.transform(scored)
        share = vector_to_array(F.col(f"_b{r}_prob"))
        votes = [v + F.lit(alpha) * share[i] for i, v in enumerate(votes)]
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    scored = scored.withColumn("probability", F.array(*[F.try_divide(v, total) for v in votes]))
    best = F.greatest(*[F.col("probability")[i] for i in range(k)])
    choice = None
    for i, cls in enumerate(model.labels):
        cond = F.col("probability")[i] == best
        choice = F.when(cond, F.lit(cls)) if choice is None else choice.when(cond, F.lit(cls))
    drop = [c for c in scored.columns if c not in df.columns and c not in ("probability", out)]
    return scored.withColumn(out, choice).drop(*drop)


# MDL7 / DOR5 ------------------------------------------------------------------
def maclaurin_weights(d: int, dims: int, degree: int = 3, seed: int = 42) -> np.ndarray:
    """Rademacher projections (degree x d x dims) for the random Maclaurin map."""
    rng = np.random.default_rng(seed)
    return rng.choice(np.array([-1.0, 1.0]), size=(degree, d, dims))


def maclaurin_features(df: DataFrame, features: str, d: int, dims: int = 512, degree: int = 3,
                       gamma: float | None = None, seed: int = 42, out: str = "rm_features") -> DataFrame:
    """Explicit random feature map of the homogeneous kernel (gamma * x.y)^degree.

    z(x) = gamma^(degree/2) * prod_i (w_i . x) / sqrt(dims) with Rademacher w_i,
    so E[z(x).z(y)] = (gamma x.y)^degree (Kar & Karnick 2012). Runs as an
    Arrow-batched pandas UDF (one matrix product per batch); the projections
    (degree * d * dims numbers) are a broadcast variable, shipped once per executor.
    """
    gamma = 1.0 / d if gamma is None else gamma
    weights = maclaurin_weights(d, dims, degree, seed)
    try:
        payload = (True, df.sparkSession.sparkContext.broadcast(weights))
    except Exception:  # Spark Connect: the projections travel with the function instead
        payload = (False, weights)
    del weights            # the function below must capture only the payload
    scale = gamma ** (degree / 2.0) / math.sqrt(dims)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rm_map(xs: pd.Series) -> pd.Series:
        w = payload[1].value if payload[0] else payload[1]
        x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, d))
        z = np.full((x.shape[0], dims), scale)
        for i in range(degree):
            z *= x @ w[i]
        return pd.Series(list(z))

    return df.withColumn(out, array_to_vector(rm_map(vector_to_array(F.col(features)))))


class PolySVM:
    """Standardised features -> map of the kernel (gamma x.y)^degree (``dims`` 0: exact, else random Maclaurin) -> linear SVM."""

    def __init__(self, labels, prep, svm, d, dims, degree, seed):
        self.labels, self.prep, self.svm = list(labels), prep, svm
        self.d, self.dims, self.degree, self.seed = d, dims, degree, seed

    def transform(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        x = self.prep.transform(df)
        z = _polynomial(x, self.d, self.dims, self.degree, self.seed)
        s = self.svm.transform(z)
        lab = F.array(*[F.lit(v) for v in self.labels])
        keep = [c for c in df.columns]
        return s.select(*keep, "rawPrediction",
                        F.element_at(lab, F.col("prediction").cast("int") + 1).alias(out))


def _polynomial(x: DataFrame, d: int, dims: int, degree: int, seed: int) -> DataFrame:
    """``_svm_x`` -> ``rm_features``: the exact map of weighted monomials, or the random map of the same kernel."""
    if dims:
        return maclaurin_features(x, "_svm_x", d, dims, degree, seed=seed)
    exact = PolyMap(d, degree)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def mapped(xs: pd.Series) -> pd.Series:
        return pd.Series(list(exact(np.stack(xs.to_numpy())))) if len(xs) else pd.Series([], dtype=object)

    return x.withColumn("rm_features", array_to_vector(mapped(vector_to_array("_svm_x"))))


def poly_svm(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (),
             degree: int = 3, dims: int = 0, class_weights: Mapping | None = None, reg: float = 0.0,
             max_iter: int = 100, seed: int = 42) -> PolySVM:
    """Polynomial-kernel SVM (two classes) on MLlib's linear one: over the exact map (``dims`` 0; an error where it has too
    many dimensions) or a random map of ``dims``. :mod:`.kernel_svm` fits many at once."""
    data = class_weight_col(df, label, class_weights) if class_weights else df
    prep = Pipeline(stages=[
        _label_indexer(label),
        assembler_pipeline(numeric, categorical, out="_svm_raw", one_hot_encode=True, gappy=gappy_columns(df, numeric)),
        StandardScaler(inputCol="_svm_raw", outputCol="_svm_x", withMean=True, withStd=True),
    ]).fit(data)
    x = prep.transform(data)
    d = len(x.select("_svm_x").first()[0])
    z = _polynomial(x, d, dims, degree, seed)
    svm = LinearSVC(featuresCol="rm_features", labelCol="_label", regParam=reg, maxIter=max_iter)
    if class_weights:
        svm.setWeightCol("_weight")
    fitted = svm.fit(z)
    return PolySVM(prep.stages[0].labels, PipelineModel(prep.stages[1:]), fitted, d, dims, degree, seed)


# MDL9 -------------------------------------------------------------------------
def linear_regression(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = ()
                      ) -> PipelineModel:
    """Ordinary least squares (normal equations, no regularisation)."""
    lr = LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0,
                          standardization=False)
    enc, _ = _encoder(df, numeric, categorical, True)
    return PipelineModel([enc, lr.fit(enc.transform(df))])


def linear_coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(term, estimate) with the intercept first, plus the training r2 as a term."""
    lr = model.stages[-1]
    names = feature_names(model.stages[0].transform(df.limit(1)))
    rows = [("(intercept)", float(lr.intercept))] + [(n, float(v)) for n, v in zip(names, lr.coefficients)]
    rows.append(("r2", float(lr.summary.r2)))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double")


# MDL10 ------------------------------------------------------------------------
def random_forest_regressor(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                            trees: int = 100, max_depth: int = 10, max_bins: int = 64, seed: int = 42,
                            key: str | None = None, layout_partitions: int | None = None,
                            exclusive: Sequence[Sequence[str]] = ()) -> H.RegressionForest | PipelineModel:
    """Random forest regressor, every feature a candidate at each split: ``transform`` adds ``prediction``.

    All trees grow together over one binned table (:mod:`.forest`). Bags are drawn by ``key``; without one by all columns, so
    equal rows are drawn alike. ``exclusive``: groups of dummies among ``numeric``, counted together (the trees are the same).
    A category of more levels than a bin number tells apart goes to MLlib's forest.
    """
    _depth(max_depth)
    wide = [c for c, v in fit_levels(df, list(categorical)).items() if len(v) > H.MAX_BINS - 1] if categorical else []
    if not wide:
        return H.regression_forest(df, label, df.columns if key is None else key, numeric, categorical, trees, max_depth,
                                   min(max_bins, H.MAX_BINS - 2), seed, exclusive)
    data = canonical_layout(df, key, layout_partitions) if key is not None else df
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees,
                               featureSubsetStrategy="all", maxDepth=max_depth, seed=seed)
    enc, bins = _encoder(data, numeric, categorical, False, max_bins)
    return PipelineModel([enc, rf.setMaxBins(bins).fit(enc.transform(data))])


# MDL3 / SRT3 ------------------------------------------------------------------
def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance, rank): impurity importances, summing to 1, ranked."""
    est = model.stages[-1]
    assembler = next(s for s in model.stages if isinstance(s, PipelineModel))
    names = feature_names(assembler.transform(df.limit(1)))
    imp = est.featureImportances.toArray()
    rows = sorted(((n, float(v)) for n, v in zip(names, imp)), key=lambda t: (-t[1], t[0]))
    data = [(n, v, i + 1) for i, (n, v) in enumerate(rows)]
    return df.sparkSession.createDataFrame(data, "feature string, importance double, rank int")


# DOR3 -------------------------------------------------------------------------
def save_model(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    """Persist a fitted pipeline (Spark's own format; a folder)."""
    w = model.write()
    (w.overwrite() if overwrite else w).save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

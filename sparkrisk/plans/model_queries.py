"""Model-bound queries: fits on whole tables, metrics out.

The learnable binding: lineitem rows labelled 'high' when the unit price
l_extendedprice / l_quantity exceeds 2000, else 'low' (52 % high at sf0.01),
from quantity, price, discount, tax, return flag and line status. The driver's
other numeric columns are nearly uncorrelated, so real targets score at chance.

Only linear regression has an oracle (``regr_*``); the others are checked by
rows and by the invariants in the tests.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.rank import with_hash
from ..operators import boosting as BO
from ..operators import ensembles as EN
from ..operators import evaluate as E
from ..operators import forest as H
from ..operators import impute as IM
from ..operators import models as M
from ..operators import sample as SM
from ..operators import select as SEL
from ..operators import shape as SH
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import io
from .registry import PRIORITY_SENTINEL, SEED, _md5_sql, _rule_scored, register
from .tables import LINEITEM_KEY, sig_all, sig_sql, table

LABEL = "price_band"
FLOW_SENTINEL = "fr"    # plays the role of '?' in documents.lang for the flows
POSITIVE = "high"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]

# Fixed values taken over from the reference's settings
TREES = 50              # forest size of the classifier
REGRESSOR_TREES = 100   # forest size of the regressor
SEARCH_TREES = 60       # forest size of the mtry search
FOLDS = 5
BOOST_ROUNDS = 3
CLASS_WEIGHTS = {"high": 2.0, "low": 1.0}      # weights (2, 1) in level order
COSTS_CV = {"miss": 1.2, "false_alarm": 0.2}   # cost matrix of the cross-validated boosting
COSTS_TREE = {"miss": 30.0, "false_alarm": 7.0}   # cost matrix of the single tree
TRAIN_SHARE = 0.7
TEST_SHARE = 0.3

MTRY = 2
DEPTH = 10              # tree depth of every classifier and regressor here (the library's default)


def lineitem_labelled(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    band = F.when(F.col("l_extendedprice") > F.lit(2000.0) * F.col("l_quantity"), "high").otherwise("low")
    return li.select(*LINEITEM_KEY, *[c for c in NUMERIC if c not in LINEITEM_KEY], *CATEGORICAL,
                     band.alias(LABEL))


def _stats(scored: DataFrame, pred: str = "predicted", by: str | None = None) -> DataFrame:
    out = sig_all(E.confusion_stats(scored, pred, LABEL, POSITIVE, by=by))
    return out.withColumnRenamed("split", "part") if by == "split" else out


def _cv_stats(scored: DataFrame, by: str | None = None) -> DataFrame:
    return _stats(scored, by=by)


def _split_data(spark, d) -> DataFrame:
    """lineitem with the 70/30 stratified 'split' column, materialised once."""
    return cut_lineage(SM.stratified_split(lineitem_labelled(spark, d), LABEL, LINEITEM_KEY, TRAIN_SHARE, SEED))


def _hashed(spark, d) -> DataFrame:
    """lineitem_labelled with the seeded hash of its key, which folds, down-samples and bags are drawn by."""
    return with_hash(lineitem_labelled(spark, d), LINEITEM_KEY, SEED)


def _fold_data(spark, d) -> DataFrame:
    """lineitem with its hash and the 'fold' column, materialised once; the key itself has done its work."""
    return cut_lineage(SM.assign_folds(_hashed(spark, d), LINEITEM_KEY, FOLDS, SEED).drop(*LINEITEM_KEY))


def _bins(spark, d) -> H.Bins:
    """Bins of all rows, from the table's own columns: the passes read no others."""
    return H.fit_bins(lineitem_labelled(spark, d), LABEL, NUMERIC, CATEGORICAL)


# MDL1 + MDL11 + SMP2 + SMP5 + FLT3 + EVL1 --------------------------------------
@register("mdl1_random_forest_cv")
def mdl1_random_forest_cv(spark, d):
    """Recall of a forest per fold, down-sampled inside each; the five forests grow together."""
    counts = EN.cross_validate_forests(_fold_data(spark, d), LABEL, LINEITEM_KEY, NUMERIC, CATEGORICAL, FOLDS, [MTRY], TREES, DEPTH,
                                       class_weights=CLASS_WEIGHTS, seed=SEED, bins=_bins(spark, d))
    return sig_all(E.counted_recall(counts, POSITIVE, ["fold", "part"]))


# MDL3 / SRT3 ---------------------------------------------------------------------
@register("mdl3_feature_importance")
def mdl3_feature_importance(spark, d):
    """(feature, importance, rank) of the final forest on the down-sampled rows."""
    data = SM.down_sample(lineitem_labelled(spark, d), LABEL, LINEITEM_KEY, SEED)
    _, grown = EN.final_forest(data, LABEL, LINEITEM_KEY, NUMERIC, CATEGORICAL, MTRY, TREES, DEPTH, class_weights=CLASS_WEIGHTS, seed=SEED)
    rows = [(f, v, i + 1) for i, (f, v) in enumerate(H.importances(grown))]
    return sig_all(spark.createDataFrame(rows, "feature string, importance double, rank int"))


# MDL4 + EVL2 ---------------------------------------------------------------------
@register("mdl4_decision_tree")
def mdl4_decision_tree(spark, d):
    """The gain-ratio tree, pruned; statistics of both parts of the split."""
    data = _split_data(spark, d)
    bins = H.fit_bins(data, LABEL, NUMERIC, CATEGORICAL)
    binned = H.bin_table(data, bins, LINEITEM_KEY, SEED, [F.col("split").alias("_split")], (F.col("split") == "train").cast("bigint"))
    tree = EN.gain_ratio_tree(binned, bins, max_depth=DEPTH)
    return sig_all(E.counted_stats(H.confusion(binned, tree, {"tree": "_split"}), POSITIVE, ["part"]))


# MDL5 ------------------------------------------------------------------------------
@register("mdl5_cost_sensitive")
def mdl5_cost_sensitive(spark, d):
    data = _split_data(spark, d)
    train = data.where(F.col("split") == "train").drop("split")
    model = M.decision_tree(train, LABEL, NUMERIC, CATEGORICAL, max_depth=DEPTH, seed=SEED, key=LINEITEM_KEY)
    costs = M.cost_matrix(["low", "high"], COSTS_CV["miss"], COSTS_CV["false_alarm"])
    # rows are counted by what a leaf says of them first, so that each is scored once and the cost rule reads few rows
    scored = M.score(model, data).select(F.col("split").alias("part"), F.col(LABEL).alias("truth"), vector_to_array("probability").alias("probability"))
    counts = scored.groupBy("part", "truth", "probability").agg(F.count(F.lit(1)).alias("n"))
    return sig_all(E.counted_stats(M.cost_sensitive(counts, M.labels_of(model), costs, out="prediction"), POSITIVE, ["part"]))


# MDL6 (+ MDL5 on the vote shares) + MDL11 + SMP5 / SMP6 ---------------------------
@register("mdl6_boosted_tree_cv")
def mdl6_boosted_tree_cv(spark, d):
    """Statistics of cost-sensitive boosted trees per fold, down- and up-sampled inside each; the ten models grow together."""
    data = cut_lineage(SM.assign_folds(_hashed(spark, d), LINEITEM_KEY, FOLDS, SEED))
    costs = M.cost_matrix(["low", "high"], COSTS_CV["miss"], COSTS_CV["false_alarm"])
    votes, classes = BO.cross_validate_boosted(data, LABEL, LINEITEM_KEY, NUMERIC, CATEGORICAL, FOLDS, BOOST_ROUNDS, DEPTH, seed=SEED,
                                              bins=_bins(spark, d))
    counts = M.cost_sensitive(votes, classes, costs, out="prediction")
    out = sig_all(E.counted_stats(counts, POSITIVE, ["fold", "part", "rebalance"]))
    return out.select(*[c for c in out.columns if c != "rebalance"], "rebalance")


# MDL7 + DOR5 -----------------------------------------------------------------------
@register("mdl7_poly_svm")
def mdl7_poly_svm(spark, d):
    """Cubic machines of five folds, down-sampled inside each, and of all down-sampled rows, fitted together: statistics of
    the training rows of each and of the held-out folds."""
    counts = EN.cross_validate_machines(_fold_data(spark, d), LABEL, LINEITEM_KEY, NUMERIC, CATEGORICAL, FOLDS, class_weights=CLASS_WEIGHTS, seed=SEED)
    return sig_all(E.counted_stats(counts, POSITIVE, ["model", "part"]))


# MDL9 ------------------------------------------------------------------------------
@register("mdl9_linear_regression", f"""
SELECT '(intercept)' AS term, {sig_sql('regr_intercept(l_extendedprice, l_quantity)')} AS estimate FROM lineitem
UNION ALL SELECT 'l_quantity', {sig_sql('regr_slope(l_extendedprice, l_quantity)')} FROM lineitem
UNION ALL SELECT 'r2', {sig_sql('regr_r2(l_extendedprice, l_quantity)')} FROM lineitem
""")
def mdl9_linear_regression(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    model = M.linear_regression(li, "l_extendedprice", ["l_quantity"])
    return sig_all(M.linear_coefficients(model, li))


# MDL10 + SMP4 + EVL3-EVL6 ------------------------------------------------------------
@register("mdl10_rf_regressor")
def mdl10_rf_regressor(spark, d):
    li = table(spark, d, "lineitem").select(*LINEITEM_KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag",
                                            "l_extendedprice")
    data = cut_lineage(SM.random_split(li, LINEITEM_KEY, TEST_SHARE, SEED))
    train = data.where(F.col("split") == "train")
    model = M.random_forest_regressor(train, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"],
                                      ["l_returnflag"], trees=REGRESSOR_TREES, max_depth=DEPTH, seed=SEED,
                                      key=LINEITEM_KEY)
    metrics = E.regression_metrics(model.transform(data), "prediction", "l_extendedprice", by="split")
    return sig_all(metrics).withColumnRenamed("split", "part")


# MDL12 -----------------------------------------------------------------------------
@register("mdl12_leave_one_out")
def mdl12_leave_one_out(spark, d):
    """Recall of a forest without each feature in turn, on both parts of the split; all forests grow together."""
    data = cut_lineage(SM.stratified_split(_hashed(spark, d), LABEL, LINEITEM_KEY, TRAIN_SHARE, SEED).drop(*LINEITEM_KEY))
    counts = EN.leave_one_out_forests(data, LABEL, LINEITEM_KEY, NUMERIC, CATEGORICAL, "split", MTRY, TREES, DEPTH, seed=SEED,
                                      bins=_bins(spark, d))
    return sig_all(E.counted_recall(counts, POSITIVE, ["dropped", "part"]))


# MDL14 + PRJ9 + SRC2 + SRC1 ------------------------------------------------------------
@register("mdl14_train_and_score")
def mdl14_train_and_score(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good")
                                              .otherwise("poor").alias("quality"))
    train = SM.down_sample(SH.bind_columns(docs, labels, "doc_id"), "quality", "doc_id", SEED)
    unlabelled = docs.join(labels, "doc_id", "left_anti")
    model = M.random_forest(train, "quality", ["n_chars"], ["lang", "source"], trees=TREES, mtry="sqrt",
                            max_depth=DEPTH, seed=SEED, key="doc_id")
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/submissions/{uuid.uuid4().hex}"
    M.save_model(model, f"{run}/model")
    model = M.load_model(f"{run}/model")
    sub = SH.submission(M.score(model, unlabelled), "doc_id", "predicted", "quality")
    folder = f"{run}/pred"
    io.write_csv(sub, folder)
    return io.read_csv(spark, folder, schema="doc_id bigint, quality string")


# IMP2 + MDL8 + IMP4 --------------------------------------------------------------------
def _orders_with_gaps(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                         "o_orderpriority")
    o = o.withColumn("month", S.month_of("o_orderdate")).drop("o_orderdate")
    return S.null_sentinel(o, ["o_orderpriority"], PRIORITY_SENTINEL)


@register("imp2_impute_multinomial")
def imp2_impute_multinomial(spark, d):
    o = _orders_with_gaps(spark, d)
    _, (filled,) = IM.impute_multinomial(o, "o_orderpriority", ["o_totalprice"], ["o_orderstatus", "month"])
    return filled.select("o_orderkey", "o_orderpriority")


@register("imp4_impute_audit")
def imp4_impute_audit(spark, d):
    o = _orders_with_gaps(spark, d)
    model, _ = IM.impute_multinomial(o, "o_orderpriority", ["o_totalprice"], ["o_orderstatus", "month"])
    labels = model.stages[0].labels
    scored = model.stages[2].transform(model.stages[1].transform(o.where(F.col("o_orderpriority").isNotNull())))
    scored = scored.withColumn("imputed", F.element_at(F.array(*[F.lit(v) for v in labels]),
                                                       F.col("_imp_pred").cast("int") + 1))
    cm, _ = IM.impute_audit(scored, "o_orderpriority", "imputed")
    return cm


# IMP3 ----------------------------------------------------------------------------------
@register("imp3_impute_cart")
def imp3_impute_cart(spark, d):
    o = _orders_with_gaps(spark, d)
    filled = IM.impute_cart(o, ["o_orderpriority"], "o_orderkey", ["o_totalprice"], ["o_orderstatus", "month"],
                            sweeps=2, seed=SEED, max_depth=DEPTH)
    return filled.select("o_orderkey", "o_orderpriority")


# End-to-end flows (SURVEY entries B, C, D) ---------------------------------------------
def _doc_tables(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good")
                                              .otherwise("poor").alias("quality"))
    return SH.bind_columns(docs, labels, "doc_id"), docs.join(labels, "doc_id", "left_anti")


@register("flow_classification_cv")
def flow_classification_cv(spark, d):
    from . import flows
    train, _ = _doc_tables(spark, d)
    return sig_all(flows.classification_cv(train, "doc_id", "quality", ["lang", "source"], ["n_chars"], "poor",
                                           k=FOLDS, trees=TREES, mtry="sqrt", max_depth=DEPTH,
                                           class_weights={"good": 2.0, "poor": 1.0}, sentinel=FLOW_SENTINEL,
                                           seed=SEED))


@register("flow_classification_submission")
def flow_classification_submission(spark, d):
    from . import flows
    train, test = _doc_tables(spark, d)
    return flows.classify_and_submit(train, test, "doc_id", "quality", ["lang", "source"], ["n_chars"],
                                     trees=TREES, mtry="sqrt", max_depth=DEPTH, sentinel=FLOW_SENTINEL,
                                     seed=SEED)


@register("flow_holdout_boosted")
def flow_holdout_boosted(spark, d):
    from . import flows
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                         "o_orderpriority")
    o = o.withColumn("month", S.month_of("o_orderdate")).drop("o_orderdate")
    o = o.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "F").otherwise("other"))
    return sig_all(flows.holdout_boosted(o, "o_orderkey", "o_orderstatus", ["o_orderpriority", "month"],
                                         ["o_totalprice"], "F", "other", COSTS_CV["miss"],
                                         COSTS_CV["false_alarm"], p=TRAIN_SHARE, rounds=BOOST_ROUNDS, max_depth=DEPTH,
                                         sentinel=PRIORITY_SENTINEL, seed=SEED))


@register("flow_regression")
def flow_regression(spark, d):
    from . import flows
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_type", "p_brand", "p_retailprice")
    return sig_all(flows.regression_flow(p, "p_partkey", "p_retailprice", ["p_size"], ["p_type", "p_brand"],
                                         test_size=TEST_SHARE, trees=REGRESSOR_TREES, max_depth=DEPTH, seed=SEED))


# DOR4 ------------------------------------------------------------------------------------
@register("dor4_tune_mtry")
def dor4_tune_mtry(spark, d):
    """Mean held-out recall by candidates a split: the forests of all folds and settings grow together."""
    counts = EN.cross_validate_forests(_fold_data(spark, d), LABEL, LINEITEM_KEY, NUMERIC, CATEGORICAL, FOLDS, [1, 2, 4], SEARCH_TREES, DEPTH,
                                       down_sampled=False, seed=SEED, bins=_bins(spark, d))
    held = E.counted_recall(counts.where(F.col("part") == "held_out"), POSITIVE, ["mtry", "fold"])
    return sig_all(held.groupBy("mtry").agg(F.avg("recall").alias("held_out_recall")))


# What SQL can say of the model queries -----------------------------------------------------
_GAP = f"o_orderpriority = '{PRIORITY_SENTINEL}'"
_FILL_SQL = f"""
SELECT o_orderkey, {_GAP} AS was_gap, CASE WHEN {_GAP} THEN NULL ELSE o_orderpriority END AS known_value,
       TRUE AS filled_with_observed FROM orders
"""


def _fill_check(spark, d, filled: DataFrame) -> DataFrame:
    """Per order: was it a gap, the known value as it came back, and is the value now one that was observed."""
    before = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderpriority") == PRIORITY_SENTINEL).alias("was_gap"))
    seen = (table(spark, d, "orders").where(F.col("o_orderpriority") != PRIORITY_SENTINEL)
            .select(F.col("o_orderpriority").alias("seen")).distinct())
    return (filled.join(before, "o_orderkey").join(seen, F.col("o_orderpriority") == F.col("seen"), "left")
            .select("o_orderkey", "was_gap", F.when(~F.col("was_gap"), F.col("o_orderpriority")).alias("known_value"),
                    F.col("seen").isNotNull().alias("filled_with_observed")))


@register("imp2_fill_check", _FILL_SQL)
def imp2_fill_check(spark, d):
    return _fill_check(spark, d, imp2_impute_multinomial(spark, d))


@register("imp3_fill_check", _FILL_SQL)
def imp3_fill_check(spark, d):
    return _fill_check(spark, d, imp3_impute_cart(spark, d))


@register("imp4_distribution_after", """
SELECT count(*) AS n FROM orders
""")
def imp4_distribution_after(spark, d):
    """Rows of the distribution after filling add up to all rows (its levels depend on the fit)."""
    o = _orders_with_gaps(spark, d)
    _, (filled,) = IM.impute_multinomial(o, "o_orderpriority", ["o_totalprice"], ["o_orderstatus", "month"])
    _, after = IM.impute_audit(o.select("o_orderkey", F.col("o_orderpriority").alias("truth"))
                               .join(filled.select("o_orderkey", F.col("o_orderpriority").alias("imputed")), "o_orderkey"),
                               "truth", "imputed")
    return after.where(F.col("imputed").isNotNull()).agg(F.sum("n").cast("bigint").alias("n"))


@register("mdl14_keys_check", """
SELECT doc_id, TRUE AS known_class FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def mdl14_keys_check(spark, d):
    return mdl14_train_and_score(spark, d).select("doc_id", F.col("quality").isin("good", "poor").alias("known_class"))


@register("flow_submission_keys_check", """
SELECT doc_id, TRUE AS known_class FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def flow_submission_keys_check(spark, d):
    out = flow_classification_submission(spark, d)
    return out.select("doc_id", F.col("quality").isin("good", "poor").alias("known_class"))


@register("mdl5_rule_check", """
SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM lineitem
""")
def mdl5_rule_check(spark, d):
    """The decision of the single tree under its cost matrix against the rule worked out from its probabilities."""
    data = lineitem_labelled(spark, d)
    model = M.decision_tree(data, LABEL, NUMERIC, CATEGORICAL, max_depth=DEPTH, seed=SEED, key=LINEITEM_KEY)
    labels = M.labels_of(model)
    costs = M.cost_matrix(["low", "high"], COSTS_TREE["miss"], COSTS_TREE["false_alarm"])
    p = vector_to_array("probability")
    scored = M.cost_sensitive(M.score(model, data, out="plain"), labels, costs)
    high, low = p[labels.index("high")], p[labels.index("low")]
    rule = F.when(high * COSTS_TREE["miss"] > low * COSTS_TREE["false_alarm"], "high").otherwise("low")
    tie = high * COSTS_TREE["miss"] == low * COSTS_TREE["false_alarm"]
    return scored.agg(F.count("*").alias("n"), F.count_if(~tie & (rule != F.col("predicted"))).alias("differing"))


_FOLD_SQL = f"""
WITH l AS (SELECT *, CASE WHEN l_extendedprice > 2000.0 * l_quantity THEN 'high' ELSE 'low' END AS band FROM lineitem),
r AS (SELECT band, row_number() OVER (ORDER BY {_md5_sql(*LINEITEM_KEY)}, {', '.join(LINEITEM_KEY)}) AS rn,
             count(*) OVER () AS n FROM l),
f AS (SELECT band, CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((rn - 1) * {FOLDS} + n - 2) // (n - 1)) END AS fold FROM r),
c AS (SELECT k.fold, f.fold = k.fold AS held, f.band, count(*) AS n
      FROM f, (SELECT DISTINCT fold FROM f) k GROUP BY 1, 2, 3)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN held THEN 'held_out' ELSE 'train' END AS part,
       CAST(CASE WHEN held THEN max(n) FILTER (WHERE band = 'high') ELSE min(n) END AS BIGINT) AS n_relevant,
       TRUE AS learnt
FROM c GROUP BY fold, held
"""


@register("mdl1_cv_counts", _FOLD_SQL)
def mdl1_cv_counts(spark, d):
    """Per fold and part: relevant rows (exact in SQL through the md5 folds), and is recall over 0.9."""
    out = mdl1_random_forest_cv(spark, d)
    return out.select("fold", "part", (F.col("tp") + F.col("fn")).cast("bigint").alias("n_relevant"),
                      (F.col("recall") > 0.9).alias("learnt"))


@register("evl2_confusion_tests")
def evl2_confusion_tests(spark, d):
    """Interval, P[accuracy > no-information rate] and McNemar p of the rule-made predictions."""
    row = E.confusion_report(_rule_scored(spark, d), "pred", "truth", "yes")
    names = ["tp", "fp", "fn", "tn", "accuracy", "accuracy_lower", "accuracy_upper", "accuracy_p_value", "mcnemar_p_value"]
    kinds = ["long"] * 4 + ["double"] * 5
    return sig_all(spark.createDataFrame([[row[k] for k in names]], ", ".join(f"{n} {k}" for n, k in zip(names, kinds))))


@register("mdl13_p_value", f"""
WITH c AS (SELECT l_returnflag AS v, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY 1, 2),
v AS (SELECT v, sum(o) AS nv FROM c GROUP BY v), y AS (SELECT y, sum(o) AS ny FROM c GROUP BY y),
n AS (SELECT sum(o) AS n, count(DISTINCT v) AS r, count(DISTINCT y) AS k FROM c),
x AS (SELECT sum((coalesce(o, 0) - nv * ny / n) * (coalesce(o, 0) - nv * ny / n) / (nv * ny / n)) AS chi2,
             max((r - 1) * (k - 1)) AS dof
      FROM v CROSS JOIN y CROSS JOIN n LEFT JOIN c ON c.v = v.v AND c.y = y.y)
SELECT 'l_returnflag' AS feature, {sig_sql('chi2')} AS chi2, CAST(dof AS INTEGER) AS dof,
       {sig_sql('exp(-chi2 / 2)')} AS p_value FROM x
""")
def mdl13_p_value(spark, d):
    """Chi-squared test of return flag against line status: two degrees of freedom, so p = exp(-chi2 / 2)."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    return sig_all(SEL.rank_features(li, "l_linestatus", ["l_returnflag"], p_values=True)
                   .select("feature", "chi2", "dof", "p_value"))


# Flagship (entry) ------------------------------------------------------------------------
_FLAGSHIP_LONG = " UNION ALL ".join(
    f"SELECT '{a}' AS attr, {a} AS value, o_orderstatus FROM p" for a in ("c_mktsegment", "c_nation",
                                                                          "o_orderpriority", "month"))


@register("flagship_class_profile", f"""
WITH p AS (SELECT o.o_orderstatus, c.c_mktsegment, n.n_name AS c_nation,
                  CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
                       THEN o.o_orderpriority END AS o_orderpriority,
                  strftime(o.o_orderdate, '%m') AS month
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
long AS ({_FLAGSHIP_LONG}),
c AS (SELECT attr, value, o_orderstatus, count(*) AS n FROM long GROUP BY attr, value, o_orderstatus)
SELECT attr, value, o_orderstatus, n, n / sum(n) OVER (PARTITION BY attr, value) AS share FROM c
""")
def flagship_class_profile(spark, d):
    from . import flagship
    return flagship.class_profile(spark, d)


from . import learning_queries, source_queries  # noqa: E402,F401  (register the companions and the sources)

"""Checkable companions of the forests, trees, machines and fits: what SQL can say of them, exactly.

Bags, folds and down-samples are md5 arithmetic, a tree's first split is counting, least squares on dummies is group means,
and frequent values are a HAVING clause; the fits themselves are checked by the invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discretise as DI
from ..operators import ensembles as EN
from ..operators import evaluate as E
from ..operators import forest as H
from ..operators import frequent as FQ
from ..operators import least_squares as LS
from ..session import cut_lineage
from . import model_queries as Q
from .registry import SEED, _md5_sql, register
from .tables import LINEITEM_KEY, sig_all, sig_sql, table

BAGS = 8               # bags that the companion query counts
FREQUENT_SHARE = 0.05  # least share of a frequent value
_BAND = "CASE WHEN l_extendedprice > 2000.0 * l_quantity THEN 'high' ELSE 'low' END"


# DOR4 ------------------------------------------------------------------------------------
@register("dor4_oob")
def dor4_oob(spark, d):
    """Out-of-bag error by candidates a split on the down-sampled rows, searched by halving and doubling from 7."""
    from ..operators import sample as SM
    data = cut_lineage(SM.down_sample(Q._hashed(spark, d), Q.LABEL, LINEITEM_KEY, SEED).drop(*LINEITEM_KEY))
    return sig_all(EN.tune_mtry_oob(data, Q.LABEL, LINEITEM_KEY, Q.NUMERIC, Q.CATEGORICAL, trees=Q.SEARCH_TREES, max_depth=Q.DEPTH, seed=SEED))


_FACTORS = ", ".join("({}, CAST('{}' AS HUGEINT), CAST('{}' AS HUGEINT), CAST('{}' AS HUGEINT))".format(t, *H.bag_factors(SEED, t))
                     for t in range(BAGS))
_DRAWN = " + ".join(f"CAST(u >= {int(p)} AS INTEGER)" for p in H.POISSON)


@register("dor4_bag_counts", f"""
WITH m AS (SELECT {_md5_sql(*LINEITEM_KEY)} AS h FROM lineitem),
h AS (SELECT CAST('0x' || substr(h, 1, 8) AS HUGEINT) AS h1, CAST('0x' || substr(h, 9, 8) AS HUGEINT) AS h2 FROM m),
f(tree, a, b, c) AS (VALUES {_FACTORS}),
u AS (SELECT tree, (a * h1 + b * h2 + c) % CAST('18446744073709551616' AS HUGEINT) // 4294967296 AS u FROM h CROSS JOIN f),
n AS (SELECT tree, {_DRAWN} AS n FROM u)
SELECT CAST(tree AS INTEGER) AS tree, CAST(sum(n) AS BIGINT) AS drawn, count(*) FILTER (n > 0) AS rows,
       count(*) FILTER (n = 0) AS out_of_bag FROM n GROUP BY tree
""")
def dor4_bag_counts(spark, d):
    """Draws, drawn rows and out-of-bag rows of the first trees' bags over lineitem."""
    li = Q.lineitem_labelled(spark, d)
    bins = H.fit_bins(li, Q.LABEL, [], Q.CATEGORICAL)
    return EN.bag_counts(H.bin_table(li, bins, LINEITEM_KEY, SEED), SEED, BAGS)


# MDL4 ------------------------------------------------------------------------------------
def _numeric_test(c: str) -> str:
    """SQL of the best cut of a numeric column: feature, gain, gain ratio, cut."""
    return f"""
SELECT '{c}' AS feature, max(gain) AS gain, arg_max(gain / info, (gain, -cut)) AS ratio, arg_max(cut, (gain, -cut)) AS split_at FROM (
  SELECT cut, h - (nl * hl + (n - nl) * hr) / n AS gain, -(nl / n * ln(nl / n) + (n - nl) / n * ln((n - nl) / n)) AS info FROM (
    SELECT cut, n, nl, {_entropy('hl_', 'nl')} AS hl, {_entropy('(hn - hl_)', '(n - nl)')} AS hr, {_entropy('hn', 'n')} AS h FROM (
      SELECT cut, CAST(n AS DOUBLE) AS n, CAST(hn AS DOUBLE) AS hn, CAST(count(*) AS DOUBLE) AS nl, CAST(count(*) FILTER (y = 'high') AS DOUBLE) AS hl_
      FROM l JOIN (SELECT DISTINCT x AS cut, n, hn FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS r, n, hn FROM l, total)
                   WHERE r IN (SELECT unnest(range(1, 64)) * n // 64 FROM total) AND x < (SELECT max({c}) FROM l)) ON {c} <= cut
      GROUP BY cut, n, hn)))"""


def _entropy(hits: str, n: str) -> str:
    return (f"-(CASE WHEN {hits} > 0 THEN {hits} / {n} * ln({hits} / {n}) ELSE 0 END"
            f" + CASE WHEN {n} - {hits} > 0 THEN ({n} - {hits}) / {n} * ln(({n} - {hits}) / {n}) ELSE 0 END)")


def _level_test(c: str) -> str:
    """SQL of the split by a child a level."""
    return f"""
SELECT '{c}' AS feature, gain, gain / info AS ratio, NULL AS split_at FROM (
  SELECT any_value(h) - sum(nv / n * hv) AS gain, -sum(nv / n * ln(nv / n)) AS info FROM (
    SELECT nv, n, {_entropy('hits', 'nv')} AS hv, {_entropy('hn', 'n')} AS h FROM (
      SELECT CAST(count(*) AS DOUBLE) AS nv, CAST(count(*) FILTER (y = 'high') AS DOUBLE) AS hits, CAST(n AS DOUBLE) AS n, CAST(hn AS DOUBLE) AS hn
      FROM l, total GROUP BY {c}, n, hn)))"""


@register("mdl4_root_split", f"""
WITH l AS (SELECT *, {_BAND} AS y FROM lineitem),
total AS (SELECT count(*) AS n, count(*) FILTER (y = 'high') AS hn FROM l),
tests AS ({' UNION ALL '.join([_numeric_test(c) for c in Q.NUMERIC] + [_level_test(c) for c in Q.CATEGORICAL])}),
fair AS (SELECT * FROM tests WHERE gain > 1e-9 AND gain >= (SELECT avg(gain) FROM tests WHERE gain > 1e-9) - 1e-12)
SELECT feature, {sig_sql('gain')} AS gain, split_at FROM fair ORDER BY ratio DESC, feature LIMIT 1
""")
def mdl4_root_split(spark, d):
    """Feature, gain and cut of the gain-ratio tree's first split over all of lineitem."""
    li = Q.lineitem_labelled(spark, d)
    bins = H.fit_bins(li, Q.LABEL, Q.NUMERIC, Q.CATEGORICAL)
    tree = EN.gain_ratio_tree(H.bin_table(li, bins, LINEITEM_KEY, SEED), bins, max_depth=1, min_rows=1, cf=None)
    return sig_all(EN.tree_rows(tree, spark).where("node = 0").select("feature", "gain", "split_at"))


@register("mdl4_pruning", """
SELECT 'lineitem' AS source, count(*) AS n_rows, TRUE AS never_larger, TRUE AS leaves_add_up FROM lineitem
""")
def mdl4_pruning(spark, d):
    """The pruned tree against the unpruned one: never more nodes, and its leaves hold every row."""
    li = Q.lineitem_labelled(spark, d)
    bins = H.fit_bins(li, Q.LABEL, Q.NUMERIC, Q.CATEGORICAL)
    binned = H.bin_table(li, bins, LINEITEM_KEY, SEED)
    full = EN.gain_ratio_tree(binned, bins, max_depth=Q.DEPTH, cf=None)
    short = EN.prune(full.trees[0])
    leaves = int(short.counts[short.feature < 0].sum())
    row = ("lineitem", leaves, len(short.feature) <= len(full.trees[0].feature), leaves == int(short.counts[0].sum()))
    return spark.createDataFrame([row], "source string, n_rows bigint, never_larger boolean, leaves_add_up boolean")


# MDL9 ------------------------------------------------------------------------------------
@register("mdl9_min_norm", f"""
SELECT p_brand, {sig_sql('avg(p_retailprice)')} AS fitted, count(*) AS n FROM part GROUP BY p_brand
""")
def mdl9_min_norm(spark, d):
    """Least squares of the price on an intercept and a dummy for every brand (rank deficient): the fitted values."""
    part = table(spark, d, "part").select("p_brand", "p_retailprice")
    model = LS.least_squares(part, "p_retailprice", [], ["p_brand"])
    fitted = model.transform(part, "fitted").groupBy("p_brand").agg(F.max("fitted").alias("fitted"), F.count("*").alias("n"))
    return sig_all(fitted)


@register("mdl9_normal_equations", f"""
SELECT '(intercept)' AS term, {sig_sql('regr_intercept(l_extendedprice, l_quantity)')} AS estimate FROM lineitem
UNION ALL SELECT 'l_quantity', {sig_sql('regr_slope(l_extendedprice, l_quantity)')} FROM lineitem
""")
def mdl9_normal_equations(spark, d):
    """The same solver where the solution is unique: intercept and slope."""
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    return sig_all(LS.coefficients(LS.least_squares(li, "l_extendedprice", ["l_quantity"]), spark))


# MDL7 / MDL11 ----------------------------------------------------------------------------
@register("mdl7_cv_counts", Q._FOLD_SQL.replace("SELECT CAST(fold AS INTEGER) AS fold,", "SELECT 'fold ' || fold AS model,") + f"""
UNION ALL SELECT 'final', 'train', min(n), TRUE FROM (SELECT count(*) AS n FROM lineitem GROUP BY {_BAND})
""")
def mdl7_cv_counts(spark, d):
    """Relevant rows of every fold's and the final machine's parts (exact in SQL), and is recall over 0.8."""
    out = Q.mdl7_poly_svm(spark, d)
    return out.select("model", "part", (F.col("tp") + F.col("fn")).cast("bigint").alias("n_relevant"), (F.col("sensitivity") > 0.8).alias("learnt"))


# AGG14 -----------------------------------------------------------------------------------
_FREQUENT = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_partkey"]


@register("agg14_frequent_values", f"""
WITH v AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM lineitem" for c in _FREQUENT)}),
n AS (SELECT count(*) AS n FROM lineitem)
SELECT col AS "column", value, count(*) AS n, n.n AS n_rows, {sig_sql('count(*) / n.n')} AS share
FROM v, n GROUP BY col, value, n.n HAVING count(*) > {FREQUENT_SHARE} * n.n
""")
def agg14_frequent_values(spark, d):
    """Values that more than a twentieth of lineitem hold, by counters and an exact count."""
    return sig_all(FQ.frequent_values(table(spark, d, "lineitem").select(*_FREQUENT), min_share=FREQUENT_SHARE))


# EVL2 ------------------------------------------------------------------------------------
def _tail(p: str, a: str, b: str) -> str:
    """SQL of the probability that a binomial number of n and p is in [a, b)."""
    return (f"(SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p})))"
            f" FROM (SELECT unnest(range({a}, {b})) AS k))")


def _bisected(name: str, goes_up: str) -> str:
    """SQL of a recursive table that halves [0, 1] 45 times, upwards where the condition on (lo + hi) / 2 holds."""
    return f"""{name}(i, x, n, lo, hi) AS (
  SELECT 0, x, n, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM s
  UNION ALL SELECT i + 1, x, n, CASE WHEN {goes_up} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {goes_up} THEN hi ELSE (lo + hi) / 2 END FROM {name} WHERE i < 45)"""


@register("evl2_tests_check", f"""
WITH RECURSIVE l AS (SELECT l_linestatus = 'O' AS t, l_quantity > 25 AS p FROM lineitem),
s AS (SELECT CAST(count(*) FILTER (t = p) AS BIGINT) AS x, CAST(count(*) AS BIGINT) AS n,
             greatest(count(*) FILTER (t), count(*) FILTER (NOT t)) / count(*) AS nir FROM l),
{_bisected('below', _tail('((lo + hi) / 2)', 'x', 'n + 1') + ' < 0.025')},
{_bisected('above', _tail('((lo + hi) / 2)', '0', 'x + 1') + ' > 0.025')},
m AS (SELECT (abs(b - c) - 1) * (abs(b - c) - 1) / (2.0 * (b + c)) AS z FROM (SELECT count(*) FILTER (t AND NOT p) AS b, count(*) FILTER (NOT t AND p) AS c FROM l))
SELECT 'accuracy_p_value' AS test, round({_tail('nir', 'x', 'n + 1')}, 8) AS value FROM s
UNION ALL SELECT 'accuracy_lower', round(max(lo) FILTER (i = 45), 8) FROM below
UNION ALL SELECT 'accuracy_upper', round(max(lo) FILTER (i = 45), 8) FROM above
UNION ALL SELECT 'mcnemar_p_value', round(1 - 2 / sqrt(pi()) * (
  SELECT sum(exp(-z + 2 * k * ln(2) + (k + 0.5) * ln(z) + lgamma(k + 1) - lgamma(2 * k + 2))) FROM (SELECT unnest(range(0, 400)) AS k)), 8) FROM m
""")
def evl2_tests_check(spark, d):
    """The tests of a confusion matrix: binomial tail, interval (the oracle halves its way to the bounds) and McNemar's p."""
    li = table(spark, d, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("truth"), F.when(F.col("l_quantity") > 25, "yes").otherwise("no").alias("pred"))
    report = E.confusion_report(li, "pred", "truth", "yes")
    names = ["accuracy_p_value", "accuracy_lower", "accuracy_upper", "mcnemar_p_value"]
    return spark.createDataFrame([(n, round(report[n], 8)) for n in names], "test string, value double")


# Entry B: derivations, boosted submission ----------------------------------------------------
STAY_LEVELS = list(range(1, 6))   # level list of the line number
CHANGES = (["l_returnflag", "l_linestatus"], ["R", "O"], "n_changes")


@register("flow_derivations", """
SELECT l_orderkey, l_linenumber AS line, l_partkey, coalesce(CASE WHEN l_linenumber BETWEEN 1 AND 5 THEN CAST(l_linenumber AS VARCHAR) END, 'NA') AS l_linenumber,
       l_returnflag, l_linestatus, strftime(o_orderdate, '%m') AS month,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS n_days,
       CAST((l_returnflag IN ('R', 'O')) AS INTEGER) + CAST((l_linestatus IN ('R', 'O')) AS INTEGER) AS n_changes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def flow_derivations(spark, d):
    """The flow's derivations over lineitem and orders: level list, days and month of a stay, near-constant drop, change count."""
    from . import flows
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus",
                                            "l_shipdate", F.when(F.col("l_quantity") < 0, "odd").otherwise("plain").alias("flat"))
    both = li.join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    plan = flows.Derivations({"l_linenumber": STAY_LEVELS}, ("o_orderdate", "l_shipdate"), 0.99, CHANGES)
    frames, cat, num = flows.derive([both], plan, ["l_returnflag", "l_linestatus", "flat"], [])
    (out,), _ = flows.count_changes(frames, plan, num)
    assert "flat" not in out.columns and cat == ["l_returnflag", "l_linestatus", "month"]
    return out.withColumns({"n_changes": F.col("n_changes").cast("int"), "l_linenumber": F.coalesce(F.col("l_linenumber").cast("string"), F.lit("NA"))})


@register("mdl6_submission", """
SELECT doc_id, TRUE AS known_class FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def mdl6_submission(spark, d):
    """Boosted trees on all down-sampled labelled documents: a class for every unlabelled one."""
    from . import flows
    train, test = Q._doc_tables(spark, d)
    out = flows.boosted_submission(train, test, "doc_id", "quality", ["lang", "source"], ["n_chars"], "poor", "good", Q.COSTS_CV["miss"],
                                   Q.COSTS_CV["false_alarm"], Q.BOOST_ROUNDS, Q.DEPTH, sentinel=Q.FLOW_SENTINEL, seed=SEED)
    return out.select("doc_id", F.col("quality").isin("good", "poor").alias("known_class"))


# MDL13 -----------------------------------------------------------------------------------
def _cut_sql(c: str) -> str:
    """SQL of the best first entropy cut of a column, over all cut points."""
    h = lambda hits, n: _entropy(hits, n) + " "
    return f"""
SELECT '{c}' AS feature, arg_max(cut, (gain, -cut)) AS cut, max(gain) / ln(2) AS gain FROM (
  SELECT cut, {h('hn', 'n')} - (nl * ({h('hl', 'nl')}) + (n - nl) * ({h('(hn - hl)', '(n - nl)')})) / n AS gain FROM (
    SELECT {c} AS cut, CAST(sum(count(*)) OVER w AS DOUBLE) AS nl, CAST(sum(count(*) FILTER (y = 'high')) OVER w AS DOUBLE) AS hl,
           CAST(n AS DOUBLE) AS n, CAST(hn AS DOUBLE) AS hn
    FROM l, total GROUP BY {c}, n, hn WINDOW w AS (ORDER BY {c})) WHERE nl < n)"""


@register("mdl13_entropy_cut", f"""
WITH l AS (SELECT *, {_BAND} AS y FROM lineitem),
total AS (SELECT count(*) AS n, count(*) FILTER (y = 'high') AS hn FROM l),
cuts AS ({' UNION ALL '.join(_cut_sql(c) for c in Q.NUMERIC)})
SELECT feature, cut, round(gain, 9) AS gain FROM cuts
""")
def mdl13_entropy_cut(spark, d):
    """First entropy cut of each numeric column of lineitem and its gain in bits; no cap on cut points."""
    li = Q.lineitem_labelled(spark, d)
    classes = DI.classes_of(li, Q.LABEL)
    prefix, k = DI.prefix_counts(li, Q.LABEL, Q.NUMERIC, classes), len(classes)
    ends = prefix.groupBy("feature").agg(*[F.max(f"c{j}").alias(f"c{j}") for j in range(k)]).collect()
    whole = [(r["feature"], None, None, [0] * k, [r[f"c{j}"] for j in range(k)]) for r in ends]
    found = DI.best_cuts(prefix, whole, k)
    rows = [(Q.NUMERIC[int(f[1:])], found[i][0], round(found[i][1], 9)) for i, (f, *_) in enumerate(whole) if i in found]
    return spark.createDataFrame(rows, "feature string, cut double, gain double")


@register("mdl13_entropy_rank")
def mdl13_entropy_rank(spark, d):
    """Features ranked by information gain after entropy cuts."""
    from ..operators import select as SEL
    ranked = SEL.rank_features(Q.lineitem_labelled(spark, d), Q.LABEL, Q.CATEGORICAL, Q.NUMERIC, cuts="entropy")
    return sig_all(ranked.select("feature", "info_gain", "dof", "rank"))  # a feature without cuts has no chi-squared

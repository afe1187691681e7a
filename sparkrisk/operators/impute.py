"""Imputation (IMP1-IMP4).

IMP1  median fill: exact distributed median (or GK sketch), then ``coalesce``.
IMP2  model fill of a category: multinomial logistic regression fitted on the
      rows where the column is known; one transform fills only the gaps.
IMP3  chained-equation CART fill: per sweep and column, a decision tree is fit
      on the known rows and every gap draws a *donor value* from the known rows
      of its leaf. Donors are numbered per leaf with the two-level rank and
      picked by seeded hash, so a big leaf never lands in one task and the
      result does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import seeded_md5, shuffle_rank, u32
from ..functions.scalar import fill_value
from ..session import cut_lineage
from .evaluate import confusion_matrix
from .features import assembler_pipeline, encoder_levels, gappy_columns
from .models import canonical_layout
from .profile import frequency, median_of

INTEGERS = ("int", "bigint", "smallint", "tinyint")
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


# IMP1 / AGG9 / SCL7 -----------------------------------------------------------
def fit_median(df: DataFrame, cols: Sequence[str], exact: bool = True) -> dict[str, float]:
    """Medians of the known values (NULL and NaN ignored)."""
    return median_of(df, cols, exact) if cols else {}


def apply_fill(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """Replace NULL / NaN by the fitted value; an integer column becomes double where the value is no integer."""
    types = dict(df.dtypes)
    wide = [c for c, v in values.items() if types[c] in INTEGERS and v is not None and float(v) != int(v)]
    return fill_value(df.withColumns({c: F.col(c).cast("double") for c in wide}), values)


def impute_median(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                  exact: bool = True) -> DataFrame:
    """Median fill; the medians come from ``fit_on`` (e.g. the training part) or ``df``."""
    return apply_fill(df, fit_median(fit_on if fit_on is not None else df, cols, exact))


# IMP2 / MDL8 / DOR6 -----------------------------------------------------------
def impute_multinomial(train: DataFrame, col: str, numeric: Sequence[str], categorical: Sequence[str],
                       others: Sequence[DataFrame] = (), max_iter: int = 100):
    """Fill NULLs of category ``col`` with a multinomial logistic model.

    The model is fitted on the rows of ``train`` where ``col`` is known (the
    label and ``col`` itself must not be among the features) and applied to
    ``train`` and every frame in ``others``. Returns (model, [filled frames]).
    """
    known = train.where(F.col(col).isNotNull())
    label_idx = StringIndexer(inputCol=col, outputCol="_imp_label", stringOrderType="alphabetAsc")
    feats = assembler_pipeline(numeric, categorical, out="_imp_features", gappy=gappy_columns(known, numeric))
    lr = LogisticRegression(featuresCol="_imp_features", labelCol="_imp_label", family="multinomial",
                            maxIter=max_iter, predictionCol="_imp_pred",
                            probabilityCol="_imp_prob", rawPredictionCol="_imp_raw")
    model = Pipeline(stages=[label_idx, feats, lr]).fit(known)
    labels = model.stages[0].labels
    lab = F.array(*[F.lit(v) for v in labels])

    def fill(d: DataFrame) -> DataFrame:
        scored = model.stages[2].transform(model.stages[1].transform(d))
        pred = F.element_at(lab, F.col("_imp_pred").cast("int") + 1)
        return scored.withColumn(col, F.coalesce(F.col(col), pred)).select(*d.columns)

    return model, [fill(train)] + [fill(o) for o in others]


# IMP4 -------------------------------------------------------------------------
def impute_audit(df: DataFrame, truth: str, imputed: str) -> tuple[DataFrame, DataFrame]:
    """(confusion matrix of imputed vs known values, distribution after filling)."""
    known = df.where(F.col(truth).isNotNull())
    return confusion_matrix(known, imputed, truth), frequency(df, imputed)


# IMP3 -------------------------------------------------------------------------
JOIN_KEY_ROWS = 100_000   # gaps per (group, donor, salt) key in a donor lookup
MAX_DEPTH = 20            # leaf tables (<= 2**depth rows) are broadcast: about 1M rows at most


def _donor_lookup(gaps: DataFrame, donors: DataFrame, group: list[str], value: str, key: str,
                  seed: int, salt: str, sizes: DataFrame) -> DataFrame:
    """Give every gap the value of a donor drawn by seeded hash from its group.

    ``donors``: (group..., _d_rn, value) numbered 1..n per group; ``sizes``:
    (group..., _d_n, _g_n) donors and gaps per group, one row per group
    (bounded: a tree's leaves or a single group), broadcast. A group whose
    gaps outnumber its donors by more than JOIN_KEY_ROWS is salted: the gap
    side takes a hashed salt in [0, S) and each donor row is repeated S times,
    so no join key carries more than about JOIN_KEY_ROWS gaps. The drawn
    donor, and so the result, does not depend on S.
    """
    s_col = F.greatest(F.lit(1), F.ceil(F.col("_g_n") / (F.col("_d_n") * F.lit(JOIN_KEY_ROWS)))).cast("int")
    sizes = F.broadcast(sizes.withColumn("_salts", s_col))
    picked = gaps.join(sizes, group)
    picked = (picked.withColumn("_d_rn", F.lit(1) + F.pmod(u32(seeded_md5(seed, F.lit(salt), F.col(key))),
                                                           F.col("_d_n")))
                    .withColumn("_salt", F.pmod(u32(seeded_md5(seed, F.lit(f"salt-{salt}"), F.col(key))),
                                                F.col("_salts"))))
    spread = (donors.join(sizes.select(*group, "_salts"), group)
                    .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))))
    return picked.drop(value).join(spread.select(*group, "_d_rn", "_salt", value), [*group, "_d_rn", "_salt"])


def _initial_draw(df: DataFrame, col: str, key: str, seed: int) -> tuple[DataFrame, int]:
    """Fill gaps of ``col`` with an observed value drawn by seeded hash (mice's start).

    Returns (filled frame, number of known values)."""
    known = df.where(F.col(col).isNotNull()).select(key, col)
    row = df.agg(F.count(col).alias("n"), F.count_if(F.col(col).isNull()).alias("g")).first()   # one pass
    n, n_gaps = row["n"], row["g"]
    if not n:
        return df, 0
    if not n_gaps:
        return df, n
    gaps = df.where(F.col(col).isNull()).withColumn("_one", F.lit(1))
    donors = (shuffle_rank(known, key, seed, out="_d_rn", total=None, n_hint=n)
              .withColumn("_one", F.lit(1)))
    sizes = df.sparkSession.createDataFrame([(1, n, n_gaps)], "_one int, _d_n long, _g_n long")
    filled = _donor_lookup(gaps, donors, ["_one"], col, key, seed, f"init-{col}", sizes)
    return df.where(F.col(col).isNotNull()).unionByName(filled.select(*df.columns)), n


def _drawn(scored: DataFrame, donors: DataFrame, sizes: DataFrame, col: str, key: str, flag: str, seed: int, sweep: int) -> DataFrame:
    """``scored`` without its ``_cart_leaf``, the gaps of ``col`` filled with donors of their leaves drawn for this sweep."""
    columns = [x for x in scored.columns if x != "_cart_leaf"]
    picked = _donor_lookup(scored.where(F.col(flag)), donors, ["_cart_leaf"], col, key, seed, f"s{sweep}-{col}", sizes).select(*columns)
    return scored.where(~F.col(flag)).select(*columns).unionByName(picked)


def impute_cart(df: DataFrame, cols: Sequence[str], key: str, numeric: Sequence[str],
                categorical: Sequence[str], sweeps: int = 2, seed: int = 42, max_depth: int = 10,
                min_instances: int = 5, layout_partitions: int | None = None) -> DataFrame:
    """Chained-equation CART imputation of ``cols`` (m = 1).

    ``numeric``/``categorical`` list every predictor column (imputed columns may
    be among them; the label must not). Each gap (NULL or NaN) ends with a value
    observed in its column; a wholly empty column stays as it is and predicts
    nothing. Gaps of predictors that are not imputed enter the trees as a
    missing indicator. Lineage is cut after every column update. A column none of whose predictors is imputed trains on
    the same rows in every sweep: its tree, leaves and donors are those of the first, and each sweep draws from them anew.
    """
    floats = [c for c, t in df.dtypes if t in ("double", "float") and c in cols]
    df = df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(dict(df.dtypes)[c])) for c in floats})
    known = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first() if cols else []
    empty = {c for i, c in enumerate(cols) if not known[f"n{i}"]}
    cols = [c for c in cols if c not in empty]
    numeric, categorical = [c for c in numeric if c not in empty], [c for c in categorical if c not in empty]
    if not cols:
        return df
    if max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth {max_depth} > {MAX_DEPTH}: the per-leaf tables would not stay small")
    miss_flags = {c: f"_miss_{i}" for i, c in enumerate(cols)}
    cur = df.withColumns({flag: F.col(c).isNull() for c, flag in miss_flags.items()})
    n_known = {}
    for c in cols:
        cur, n_known[c] = _initial_draw(cur, c, key, seed)
    cur = cut_lineage(cur)
    types = dict(df.dtypes)
    # encoders are fitted once per column: gaps are filled with observed values,
    # so the level sets do not change between sweeps
    prepared = {}
    for c in cols:
        num = [x for x in numeric if x != c]
        cat = [x for x in categorical if x != c]
        stages = [StringIndexer(inputCol=c, outputCol="_cart_y", stringOrderType="alphabetAsc",
                                handleInvalid="keep")] if types[c] not in NUMERIC else []
        gappy = gappy_columns(cur, [x for x in num if x not in miss_flags])
        stages.append(assembler_pipeline(num, cat, out="_cart_f", one_hot_encode=False, gappy=gappy))
        enc = Pipeline(stages=stages).fit(cur)
        prepared[c] = (enc, max([32] + [n + 1 for n in encoder_levels(enc)]))
    fixed = {c for c in cols if not any(x in miss_flags for x in [*numeric, *categorical] if x != c)}
    leaves, held = {c: f"_leaf_{i}" for i, c in enumerate(cols) if c in fixed}, {}
    for sweep in range(1, sweeps + 1):
        for c in cols:
            flag = miss_flags[c]
            if c in held:
                donors, sizes = held[c]
                cur = cut_lineage(_drawn(cur.withColumn("_cart_leaf", F.col(leaves[c])), donors, sizes, c, key, flag, seed, sweep))
                continue
            enc, bins = prepared[c]
            if types[c] not in NUMERIC:
                tree = DecisionTreeClassifier(featuresCol="_cart_f", labelCol="_cart_y", leafCol="_cart_leaf",
                                              maxDepth=max_depth, minInstancesPerNode=min_instances,
                                              maxBins=bins, seed=seed, predictionCol="_cart_p",
                                              rawPredictionCol="_cart_raw", probabilityCol="_cart_prob")
            else:
                tree = DecisionTreeRegressor(featuresCol="_cart_f", labelCol=c, leafCol="_cart_leaf",
                                             maxDepth=max_depth, minInstancesPerNode=min_instances,
                                             maxBins=bins, seed=seed, predictionCol="_cart_p")
            encoded = enc.transform(cur)
            model = tree.fit(canonical_layout(encoded.where(~F.col(flag)), key, layout_partitions))
            scored = model.transform(encoded).withColumn("_cart_leaf", F.col("_cart_leaf").cast("double"))
            # read by the donor ranking, the leaf sizes and the lookup: computed once (deterministic,
            # so a lost block recomputes to the same rows); the sweep ends in a reliable checkpoint
            scored = scored.select(*cur.columns, "_cart_leaf").persist(StorageLevel.MEMORY_AND_DISK)
            donors = shuffle_rank(scored.where(~F.col(flag)).select(key, "_cart_leaf", c), key, seed,
                                  within="_cart_leaf", out="_d_rn", total=None, n_hint=n_known[c])
            # donors and gaps per leaf in one aggregate: one row per leaf (at most 2**depth)
            sizes = (scored.groupBy("_cart_leaf")
                     .agg(F.count_if(~F.col(flag)).alias("_d_n"), F.count_if(F.col(flag)).alias("_g_n"))
                     .where((F.col("_d_n") > 0) & (F.col("_g_n") > 0)))
            told = scored
            if c in fixed and sweep < sweeps:  # written once for the sweeps to come; the leaf stays with the row
                donors, sizes = held[c] = cut_lineage(donors.drop(key)), cut_lineage(sizes)
                told = scored.withColumn(leaves[c], F.col("_cart_leaf"))
            cur = cut_lineage(_drawn(told, donors, sizes, c, key, flag, seed, sweep))
            scored.unpersist()
    return cur.drop(*miss_flags.values(), *leaves.values())

"""End-to-end flows built from the operators.

classification_cv / classify_and_submit
    audit keys -> drop sparse columns -> sentinel to NULL -> impute gaps ->
    k folds -> per fold: down-sample the training part, fit, recall on both
    parts -> final fit on the down-sampled whole -> score the unlabelled rows
    -> (key, predicted class).
holdout_boosted
    the variant with model imputation, a stratified hold-out split and a
    cost-sensitive boosted tree.
regression_flow
    split -> fit encoders, medians and scaler on the training part only ->
    linear regression and a random forest regressor -> error metrics on both
    parts (``fit_scope='all'`` fits the preparation on all rows instead).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import forest as H
from ..operators import frequent as FQ
from ..operators import impute as IM
from ..operators import least_squares as LS
from ..operators import models as M
from ..operators import profile as P
from ..operators import sample as SM
from ..operators import shape as SH
from ..session import cut_lineage


@dataclass(frozen=True)
class Derivations:
    """What a flow makes of its columns before imputation.

    ``levels``: closed level lists (other values become gaps). ``stay``: (start, end) dates, replaced by the days between
    (``n_days``) and the month of the start (``month``). ``near_constant``: share of its most frequent value in the training
    rows from which a category is dropped. ``changes``: (columns, values, name), the number of the columns that hold one
    of the values, counted after imputation as the reference does.
    """

    levels: Mapping[str, Sequence] = field(default_factory=dict)
    stay: tuple[str, str] | None = None
    near_constant: float | None = None
    changes: tuple[Sequence[str], Sequence, str] | None = None


def derive(frames: Sequence[DataFrame], d: Derivations, categorical: Sequence[str], numeric: Sequence[str]
           ) -> tuple[list[DataFrame], list[str], list[str]]:
    """(frames, categorical, numeric) after level lists, stay and the near-constant drop; the first frame decides the drop."""
    frames, cat, num = list(frames), list(categorical), list(numeric)
    for c, levels in d.levels.items():
        frames = [S.restrict_levels(f, c, levels) for f in frames]
    if d.stay:
        frames = [S.stay_features(f, *d.stay, drop_dates=True) for f in frames]
        cat, num = [*cat, "month"], [*num, "n_days"]
    if d.near_constant is not None and cat:
        flat = {r["column"] for r in FQ.top_values(frames[0], cat, d.near_constant).where("near_constant").collect()}
        frames = [f.drop(*flat) for f in frames]
        cat = [c for c in cat if c not in flat]
    return frames, cat, num


def count_changes(frames: Sequence[DataFrame], d: Derivations, numeric: Sequence[str]) -> tuple[list[DataFrame], list[str]]:
    """(frames, numeric) with the change count, of the columns that are still there."""
    if not d.changes:
        return list(frames), list(numeric)
    cols, values, name = d.changes
    cols = [c for c in cols if c in frames[0].columns]
    return [S.count_values_in(f, cols, values, name) for f in frames], [*numeric, name]


def prepare(train: DataFrame, others: Sequence[DataFrame], key: str, label: str, categorical: Sequence[str],
            numeric: Sequence[str], sentinel: str | None = "?", threshold: float = 0.5,
            impute: str = "cart", seed: int = 42, derivations: Derivations | None = None
            ) -> tuple[list[DataFrame], list[str], list[str]]:
    """Shared preparation; returns ([train, *others], kept categorical, kept numeric).

    Columns with too many missing values go first, then ``derivations`` apply (see :class:`Derivations`).

    Every kept column with a gap (NULL or NaN) in a frame is filled in that frame: by chained trees of the
    frame's own rows, or by models fitted on ``train`` (multinomial for categories, medians for numbers).
    """
    dup = P.duplicate_keys(train, key).limit(1).count()
    if dup:
        raise ValueError(f"duplicate {key} values in the training table")
    sparse = set(P.sparse_columns(train, threshold, sentinel, list(categorical) + list(numeric)))
    cat = [c for c in categorical if c not in sparse]
    num = [c for c in numeric if c not in sparse]
    frames = [train] + list(others)
    if sentinel is not None:
        frames = [S.null_sentinel(f.drop(*sparse), cat, sentinel) for f in frames]
    else:
        frames = [f.drop(*sparse) for f in frames]
    d = derivations or Derivations()
    frames, cat, num = derive(frames, d, cat, num)
    gaps = [[c for c in cat + num if c in found] for f in frames for found in [_gaps(f, cat, num)]]
    if impute == "cart":
        frames = [IM.impute_cart(f, g, key, num, cat, seed=seed) if g else f for f, g in zip(frames, gaps)]
        return _with_changes(frames, d, cat, num)
    some = {c for g in gaps for c in g}
    medians = IM.fit_median(frames[0], [c for c in num if c in some])
    frames = [IM.apply_fill(f, {c: v for c, v in medians.items() if v is not None}) for f in frames]
    for g in [c for c in cat if c in some]:
        _, frames = IM.impute_multinomial(frames[0], g, num, [c for c in cat if c != g], frames[1:])
    return _with_changes(frames, d, cat, num)


def _with_changes(frames: Sequence[DataFrame], d: Derivations, cat: list[str], num: list[str]) -> tuple[list[DataFrame], list[str], list[str]]:
    frames, num = count_changes(frames, d, num)
    return frames, cat, num


def _gaps(df: DataFrame, cat: Sequence[str], num: Sequence[str]) -> set[str]:
    """Columns with a NULL (or, for numbers, NaN); one aggregate."""
    numbers = set(FE.gappy_columns(df, list(num)))
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(cat)]).first() if cat else None
    return numbers | {c for i, c in enumerate(cat) if row[f"g{i}"]}


def classification_cv(train: DataFrame, key: str, label: str, categorical: Sequence[str],
                      numeric: Sequence[str], positive, k: int = 5, trees: int = 50, mtry: int | str = 17,
                      class_weights: Mapping | None = None, sentinel: str | None = "?",
                      max_depth: int = 10, seed: int = 42, derivations: Derivations | None = None) -> DataFrame:
    """(fold, part, tp, fn, recall) of a down-sampled random forest, k folds."""
    (data,), cat, num = prepare(train, [], key, label, categorical, numeric, sentinel, seed=seed, derivations=derivations)
    data = cut_lineage(SM.assign_folds(data, key, k, seed))

    def fit(part):
        return M.random_forest(part, label, num, cat, trees=trees, mtry=mtry, class_weights=class_weights,
                               max_depth=max_depth, seed=seed, key=key)

    return E.cross_validate(data, k, fit, lambda m, d: M.score(m, d),
                            lambda d, by=None: E.recall(d, "predicted", label, positive, by=by),
                            rebalance=lambda d: SM.down_sample(d, label, key, seed))


def classify_and_submit(train: DataFrame, test: DataFrame, key: str, label: str, categorical: Sequence[str],
                        numeric: Sequence[str], trees: int = 50, mtry: int | str = 17,
                        class_weights: Mapping | None = None, sentinel: str | None = "?",
                        max_depth: int = 10, seed: int = 42) -> DataFrame:
    """(key, predicted label) for the unlabelled rows, from a forest on the down-sampled training rows."""
    (tr, te), cat, num = prepare(train, [test], key, label, categorical, numeric, sentinel, seed=seed)
    model = M.random_forest(SM.down_sample(tr, label, key, seed), label, num, cat, trees=trees, mtry=mtry,
                            class_weights=class_weights, max_depth=max_depth, seed=seed, key=key)
    return SH.submission(M.score(model, te), key, "predicted", label)


def holdout_boosted(train: DataFrame, key: str, label: str, categorical: Sequence[str], numeric: Sequence[str],
                    positive, negative, miss_cost: float, false_alarm_cost: float, p: float = 0.7,
                    rounds: int = 3, max_depth: int = 5, sentinel: str | None = "?", seed: int = 42) -> DataFrame:
    """Confusion statistics (train / validation) of a cost-sensitive boosted tree on a stratified split."""
    (data,), cat, num = prepare(train, [], key, label, categorical, numeric, sentinel, impute="multinomial",
                                seed=seed)
    split = cut_lineage(SM.stratified_split(data, label, key, p, seed))
    tr = split.where(F.col("split") == "train").drop("split")
    model = M.boosted_tree(tr, label, num, cat, rounds=rounds, max_depth=max_depth, key=key, seed=seed)
    costs = M.cost_matrix([negative, positive], miss_cost, false_alarm_cost)

    # both parts scored in one pass, statistics grouped by part
    scored = M.cost_sensitive(M.boosted_score(model, split, out="vote"), model.labels, costs)
    scored = scored.withColumn("part", F.when(F.col("split") == "train", "train").otherwise("validation"))
    stats = E.confusion_stats(scored, "predicted", label, positive, by="part")
    return stats.select(*[c for c in stats.columns if c != "part"], "part")


def boosted_submission(train: DataFrame, test: DataFrame, key: str, label: str, categorical: Sequence[str], numeric: Sequence[str],
                       positive, negative, miss_cost: float, false_alarm_cost: float, rounds: int = 3, max_depth: int = 5,
                       sentinel: str | None = "?", seed: int = 42, derivations: Derivations | None = None) -> DataFrame:
    """(key, predicted label) for the unlabelled rows, from boosted trees on all down-sampled training rows and the cost rule."""
    (tr, te), cat, num = prepare(train, [test], key, label, categorical, numeric, sentinel, seed=seed, derivations=derivations)
    model = M.boosted_tree(cut_lineage(SM.down_sample(tr, label, key, seed)), label, num, cat, rounds=rounds, max_depth=max_depth, key=key, seed=seed)
    costs = M.cost_matrix([negative, positive], miss_cost, false_alarm_cost)
    return SH.submission(M.cost_sensitive(M.boosted_score(model, te, out="vote"), model.labels, costs), key, "predicted", label)


def regression_flow(df: DataFrame, key: str, label: str, numeric: Sequence[str], categorical: Sequence[str],
                    test_size: float = 0.3, trees: int = 100, max_depth: int = 8, seed: int = 42,
                    fit_scope: str = "train") -> DataFrame:
    """(model, part, n, r2, mae, mse, rmse, mape) for linear regression and a forest regressor."""
    split = cut_lineage(SM.random_split(df, key, test_size, seed))
    train = split.where(F.col("split") == "train")
    fit_on = train if fit_scope == "train" else split
    levels = FE.fit_levels(fit_on, list(categorical))
    medians = IM.fit_median(fit_on, list(numeric))
    encoded = FE.one_hot(IM.apply_fill(split, {c: v for c, v in medians.items() if v is not None}),
                         list(categorical), levels)
    dummies = [c for c in encoded.columns if c not in split.columns]
    features = list(numeric) + dummies
    scale = FE.fit_standardize(encoded.where(F.col("split") == "train") if fit_scope == "train" else encoded,
                               features)
    # scored by every tree: dealt to all cores, however few partitions a small file was read in
    ready = cut_lineage(FE.apply_standardize(H.deal(encoded, split.count()), scale))
    tr = ready.where(F.col("split") == "train")
    linear = LS.least_squares(tr, label, features)  # all-level dummies: the design is rank deficient
    sizes = [len(levels[c]) for c in categorical]
    each = [dummies[sum(sizes[:i]):sum(sizes[:i + 1])] for i in range(len(sizes))]
    forest = M.random_forest_regressor(tr, label, features, trees=trees, max_depth=max_depth, seed=seed, key=key, exclusive=each)
    parts = {}
    for mname, model in (("linear", linear), ("forest", forest)):
        # one scoring pass over both parts per model, metrics grouped by part
        parts[mname] = E.regression_metrics(model.transform(ready), "prediction", label, by="split")
    out = SH.stack_tagged(parts, tag="model").withColumnRenamed("split", "part")
    return out.select("model", "part", *[c for c in out.columns if c not in ("model", "part")])

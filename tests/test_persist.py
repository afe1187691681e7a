import random

import pytest

from helpers import rows
from sparkrisk.operators import forest as H
from sparkrisk.operators import kernel_svm as K
from sparkrisk.operators import least_squares as LS
from sparkrisk.operators import models as M
from sparkrisk.operators import persist as P


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(1)
    return spark.createDataFrame([(i, rnd.random(), rnd.choice("abc"), rnd.choice(["p", "q"])) for i in range(400)], "id int, x double, c string, y string")


def test_own_models_score_equally_after_a_round_trip(spark, data, tmp_path):
    bins = H.fit_bins(data, "y", ["x"], ["c"])
    table = H.bin_table(data, bins, "id", keep=["id"])
    grown = H.grow(table, bins, [H.Spec("m", trees=3), H.Spec("n", features=("x",), trees=1)], 4)
    P.save_fitted(grown, spark, f"{tmp_path}/forest")
    again = P.load_fitted(spark, f"{tmp_path}/forest")
    assert again.specs == grown.specs and again.bins == grown.bins
    for i in (0, 1):
        assert rows(H.probabilities(table, grown, i), "id", "probability", "predicted") == rows(H.probabilities(table, again, i), "id", "probability", "predicted")

    scaled = K.fit_scaled(data, "y", ["x"], ["c"])
    table = K.scale_table(data, scaled, ["id"])
    for dims in (0, 32):
        fitted = K.fit_machines(table, scaled, [K.Machine("m")], dims=dims)
        P.save_fitted(fitted, spark, f"{tmp_path}/machine{dims}")
        assert rows(K.decisions(table, fitted), "id", "decision") == rows(K.decisions(table, P.load_fitted(spark, f"{tmp_path}/machine{dims}")), "id", "decision")

    line = LS.least_squares(data, "x", [], ["c"])
    P.save_fitted(line, spark, f"{tmp_path}/line")
    assert rows(line.transform(data), "id", "prediction") == rows(P.load_fitted(spark, f"{tmp_path}/line").transform(data), "id", "prediction")

    boosted = M.boosted_tree(data, "y", ["x"], ["c"], rounds=2, max_depth=3, key="id")
    P.save_fitted(boosted, spark, f"{tmp_path}/boosted")
    again = P.load_fitted(spark, f"{tmp_path}/boosted")
    assert rows(boosted.transform(data), "id", "probability", "predicted") == rows(again.transform(data), "id", "probability", "predicted")


def test_what_cannot_be_saved(spark, tmp_path):
    with pytest.raises(TypeError):
        P.save_fitted(LS.LeastSquares([], {}, object(), 0, 0, 0.0, 0.0), spark, f"{tmp_path}/odd")

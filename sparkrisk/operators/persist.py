"""Saving and loading of the library's own fitted models (DOR3): forests, trees, machines, least squares, boosted trees.

A model is one row of a Parquet table (its kind and its fields as JSON, arrays by type, shape and bytes), so it goes
wherever Spark writes and needs no code to be run on loading. Boosted trees hold pipelines of Spark's own kind, which are
saved beside the row.
"""

from __future__ import annotations

import base64
import json
from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from .forest import Bins, Forest, RegressionForest, Spec, Tree, Weigh
from .kernel_svm import Machine, Machines, PolyMap, Scaled
from .least_squares import LeastSquares
from .models import BoostedTrees

KINDS = {c.__name__: c for c in (Bins, Forest, RegressionForest, Spec, Tree, Weigh, Machine, Machines, PolyMap, Scaled, LeastSquares)}


def _plain(value):
    """Numbers, text, lists and tagged dicts that JSON can hold."""
    if isinstance(value, np.ndarray):
        return {"array": base64.b64encode(np.ascontiguousarray(value).tobytes()).decode(), "dtype": str(value.dtype), "shape": list(value.shape)}
    if isinstance(value, np.generic):
        return value.item()
    if type(value).__name__ in KINDS:
        names = [f.name for f in fields(value)] if is_dataclass(value) else list(vars(value))
        return {"kind": type(value).__name__, "fields": {n: _plain(getattr(value, n)) for n in names}}
    if isinstance(value, tuple):
        return {"tuple": [_plain(v) for v in value]}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {"dict": [[_plain(k), _plain(v)] for k, v in value.items()]}
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise TypeError(f"{type(value).__name__} cannot be saved (class labels may be text, numbers or booleans)")


def _built(value):
    if isinstance(value, list):
        return [_built(v) for v in value]
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.frombuffer(base64.b64decode(value["array"]), value["dtype"]).reshape(value["shape"]).copy()
    if "tuple" in value:
        return tuple(_built(v) for v in value["tuple"])
    if "dict" in value:
        return {_built(k): _built(v) for k, v in value["dict"]}
    cls, parts = KINDS[value["kind"]], {n: _built(v) for n, v in value["fields"].items()}
    if is_dataclass(cls):
        return cls(**parts)
    made = cls.__new__(cls)
    vars(made).update(parts)
    return made


def save_fitted(model, spark: SparkSession, path: str) -> None:
    """Saves a model at ``path`` (a folder that must not exist)."""
    path = path.rstrip("/")
    if isinstance(model, BoostedTrees):
        for i, (trees, _) in enumerate(model.rounds):
            trees.write().save(f"{path}/round_{i}")
        kind, body = "BoostedTrees", {"labels": _plain(model.labels), "votes": _plain([float(a) for _, a in model.rounds])}
    else:
        kind, body = type(model).__name__, _plain(model)
    spark.createDataFrame([(kind, json.dumps(body))], "kind string, body string").coalesce(1).write.parquet(f"{path}/model")


def load_fitted(spark: SparkSession, path: str):
    """The model saved at ``path``; it scores as the one that was saved."""
    path = path.rstrip("/")
    row = spark.read.parquet(f"{path}/model").first()
    body = json.loads(row["body"])
    if row["kind"] != "BoostedTrees":
        return _built(body)
    votes = _built(body["votes"])
    return BoostedTrees(_built(body["labels"]), [(PipelineModel.load(f"{path}/round_{i}"), a) for i, a in enumerate(votes)])

import numpy as np
import pyarrow as pa
import pytest

from sparkrisk.llm import quality_classifier as C
from sparkrisk.llm.queries import QUERIES


def test_features_approximate_a_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(C, "FEATURES", 20_000)
    n = len(C.STATS)
    model = C.Model(np.zeros(n), np.ones(n))
    x = np.random.default_rng(0).normal(size=(6, n))
    z = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * C.WIDTH ** 2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_statistics_by_definition():
    texts = ["The cat. THE cat!\nthe cat\nthe cat", "", None, "a a a a", "über 12 %%%\n\n|"]
    rows = C.statistics(pa.array(texts))
    at = {k: i for i, k in enumerate(C.STATS)}
    for text, row in zip(texts, rows):
        data = (text or "").encode()
        words, lines = data.split(), [x for x in data.split(b"\n") if x]
        if not data:
            assert not row.any()
            continue
        assert row[at["share_upper"]] == pytest.approx(sum(65 <= b <= 90 for b in data) / len(data))
        assert row[at["share_digit"]] == pytest.approx(sum(48 <= b <= 57 for b in data) / len(data))
        assert row[at["log_words"]] == pytest.approx(np.log1p(len(words)))
        assert row[at["word_bytes"]] == pytest.approx(np.mean([len(w) for w in words]))
        assert row[at["new_words"]] == pytest.approx(len(set(words)) / len(words))
        assert row[at["same_as_last"]] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / len(words))
        pairs = list(zip(words, words[1:]))
        assert row[at["repeated_pairs"]] == pytest.approx(1 - len(set(pairs)) / max(1, len(pairs)) if pairs else 1)
        assert row[at["repeated_lines"]] == pytest.approx(1 - len(set(lines)) / len(lines))


def test_chunks_change_nothing(monkeypatch):
    texts = pa.array([f"word{i} " * (i % 50) + "end" for i in range(300)])
    whole = C.statistics(texts)
    monkeypatch.setattr(C, "chunks", lambda t: (t.slice(i, 7) for i in range(0, len(t), 7)))
    assert np.allclose(whole, C.statistics(texts))


def test_normal_equations_equal_one_pass(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, len(C.STATS))), rng.integers(0, 2, 200).astype(float)
    model = C.Model(np.zeros(len(C.STATS)), np.ones(len(C.STATS)))
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "s array<double>, y double").repartition(5)
    a, b, n = C.normal_equations(rows, model)
    z = model.features(x)
    assert n == 200 and np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)


def test_isotonic():
    score = np.array([0.1, 0.2, 0.2, 0.4, 0.5, 0.9])
    label = np.array([0, 1, 0, 0, 1, 1.0])
    x, y = C.isotonic(score, label)
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] < y[-1] < 1


def test_odd_rows(odd_docs, no_docs, no_labels, spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")
    model = C.fit(odd_docs, labels)
    rows = C.scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert C.scores(no_docs, model).count() == 0
    assert C.fit(odd_docs, no_labels) is None
    assert {r.score for r in C.scores(odd_docs, None).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op1_quality_classifier"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.93

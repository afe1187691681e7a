import os
import sys

import pytest

import corpus_pipeline as P
from sparkrisk.llm import decontam, quality_rules, toxicity

import test_decontam
import test_quality_rules
import test_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(input, output)] of every stage, each written and reread as the driver does."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages_equal_brute_force(spark, stages):
    (a, b), (_, c), (_, d), (_, e), (_, f) = stages
    rows = [(r.doc_id, r.text) for r in a.collect()]
    trusted = {r.id for r in quality_rules.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    ratios = test_quality_rules.brute_ratios(rows, trusted)
    good = []
    for key, text in rows:
        n = max(1, 2 * test_quality_rules.base(text)[0] - 1)
        total = sum(ratios[x] for x in test_quality_rules.buckets(text))
        if not test_quality_rules.base(text)[5] and total >= quality_rules.THRESHOLD * n:
            good.append(key)
    assert ids(b) == sorted(good) and len(good) < len(rows)
    model = toxicity.fit(b, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.scores(b, model).collect()
    assert ids(c) == sorted(r.doc_id for r in scored if r.score < 0.3)
    texts = {r.doc_id: r.text for r in c.collect()}
    order = sorted(texts)
    roots = test_simhash.brute_components([test_simhash.by_definition(texts[i]) for i in order])
    assert ids(d) == sorted({order[r] for r in roots})
    left = [(r.doc_id, r.text) for r in d.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    shared = {s for _, t in items for s in decontam.shingles(decontam.words_of(t), decontam.WORDS_EACH)}
    touched = [x for x in left if shared & set(decontam.shingles(decontam.words_of(x[1]), decontam.WORDS_EACH))]
    dirty = {key for key, _ in test_decontam.brute(touched, items)}
    assert ids(e) == sorted(key for key, _ in left if key not in dirty)
    assert ids(f) == ids(e)


def test_columns_stay_until_the_last(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes
    assert stages[-1][1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_odd_and_empty_rows_pass_every_stage(spark, odd_docs, no_docs):
    for name, stage in P.STAGES:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, SF)
            rows = out.collect()
            if name != "bpe":
                assert out.dtypes == docs.dtypes
            assert len(rows) <= docs.count()
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES][2] == "simhash_neardup"

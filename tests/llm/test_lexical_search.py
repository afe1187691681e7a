import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkrisk.llm import lexical_search as L
from sparkrisk.llm.common import Steps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """Every score of every document, by the definition; rows (item, rank, id, score)."""
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in tfs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), s in zip(tfs, sizes):
            m = 10 + (90 * s * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_terms():
    text = "Ab-C9_é漢 \u0085x\x7f`Z{} ÀÉ"
    assert [t.decode() for t in L.terms_of(text.encode())] == terms(text) == ["ab", "c9", "é漢", "\u0085x", "z", "ÀÉ"]


@pytest.mark.parametrize("seed", range(30))
def test_range_max(seed):
    rnd = np.random.default_rng(seed)
    v = rnd.integers(0, 5, rnd.integers(1, 70))
    table = L.RangeMax(v, len(v))
    a, b = np.array([(i, j) for i in range(len(v)) for j in range(i + 1, len(v) + 1)]).T
    assert table.of(a, b).tolist() == [i + int(v[i:j].argmax()) for i, j in zip(a, b)]


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = []
    for i in range(n):
        if docs and rnd.random() < .4:
            docs.append((i, docs[rnd.randrange(len(docs))][1]))  # copies: equal scores
        else:
            docs.append((i, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))))
    rnd.shuffle(docs)
    items = [(j, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for j in range(15)]
    return docs, items


@pytest.mark.parametrize("seed", range(12))
def test_search_equals_brute_force(seed, monkeypatch):
    """Several shards one after another, small batches, many ties."""
    monkeypatch.setattr(L, "BATCH", 1 + seed % 3)
    docs, items = corpus(seed, 300)
    tfs = [Counter(terms(t)) for _, t in docs]
    n, total = sum(bool(c) for c in tfs), sum(sum(c.values()) for c in tfs)
    df = Counter(t for c in tfs for t in c)
    places = L.Places({t.encode(): i for i, t in enumerate(sorted({t for _, x in items for t in terms(x)}))})
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t.decode()] + 1))) if df[t.decode()] else 0 for t in places], np.int64)
    lists = [np.array([places[t.encode()] for t in sorted(set(terms(x)))], np.int64) for _, x in items]
    tops, scored = [[] for _ in items], 0
    for at in range(0, len(docs), 70):
        part = docs[at:at + 70]
        row, order = L.shard_of([t.encode() for _, t in part])
        shard = L.Shard(row, pa.array([part[i][0] for i in order], pa.int64()), places, weights, n, total)
        scored += L.search(shard, lists, tops, 10)
    got = sorted(((j, r + 1, v, s) for j, top in enumerate(tops) for r, (s, v) in enumerate(top)), key=str)
    assert got == brute(docs, items)
    assert scored < .8 * len(docs) * len(items)  # the bounds leave some documents out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_spark_equals_brute_force(spark, monkeypatch):
    docs, items = corpus(99, 400)
    items += [(7, items[3][1]), (None, items[4][1]), (100, None), (101, "--")]
    table = spark.createDataFrame(docs, "doc_id int, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id string, text string")
    want = brute(docs, [(None if i is None else str(i), t) for i, t in items])
    monkeypatch.setattr(L, "QUERIES", 4)  # several blocks
    assert rows(L.ranked(table, asked)) == want
    steps = Steps(spark, "lexical-test")
    index = L.build_index(table, steps)
    assert rows(L.search_index(index, asked, steps, k=3).select("item", "rank", "doc", "score")) == [w for w in want if w[1] <= 3]


def test_small_shards():
    texts = ["a b", "", "c " * 500, "b"]
    row, order = L.shard_of([t.encode() for t in texts])
    assert sorted(order.tolist()) == [0, 1, 2, 3] and (row["n_docs"], row["n_terms"]) == (3, 503)
    empty, order = L.shard_of([])
    assert (empty["n_docs"], empty["n_terms"], len(order)) == (0, 0, 0)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one alpha no", 5, "x"), (2, None, 6, "y"), (3, "", 7, "z")],
                                  "item_id bigint, text string, score int, rank string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows(L.ranked(odd_docs, items)) == brute(docs, [(1, "one alpha no")])
    assert rows(L.ranked(no_docs, items)) == [] and rows(L.ranked(odd_docs, items.limit(0))) == []


def test_null_id_comes_last_and_text_ids(spark):
    docs = spark.createDataFrame([(None, "same words"), ("b", "same words"), ("a", "same words"), ("c", "other")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "same")], "item_id int, text string")
    assert [r.doc_id for r in L.ranked(docs.coalesce(1), asked).orderBy("rank").collect()] == ["a", "b", None]

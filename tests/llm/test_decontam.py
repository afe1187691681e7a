import pickle
import random

import numpy as np

from sparkrisk.llm import decontam as D
from sparkrisk.llm.queries import QUERIES


def brute(docs, items, n=D.WORDS_EACH, least=D.SIMILARITY):
    """Pairs with an item-sized window of at least ``least`` weighted similarity."""
    out = set()
    for item, text in items:
        words = D.words_of(text or "")
        if item is None or not words:
            continue
        want = D.shingles(words, n)
        for key, doc in docs:
            have = D.words_of(doc or "")
            for at in range(max(1, len(have) - len(words) + 1)):
                if D.weighted_jaccard(D.shingles(have[at:at + len(words)], n), want) >= least:
                    out.add((key, item))
                    break
    return out


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(6, 40)))) for i in range(80)]
    index = D.Index(items, D.WORDS_EACH, D.SIMILARITY, D.RADIUS)
    for _ in range(300):
        p = int(index.prints[rng.randrange(len(items))])
        for _ in range(rng.randint(0, 30)):
            p ^= 1 << rng.randrange(64)
        want = {i: int(b) for i, b in enumerate(np.bitwise_count(index.prints ^ np.uint64(p))) if b <= D.RADIUS}
        assert index.within(p) == want


def test_edited_passages(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 60)))) for i in range(12)]
    items += [(50, "Short one"), (51, ""), (52, None), (None, "never counts at all here"), (53, "same same same same same same same same")]
    docs = []
    for k in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        passage = (items[k % 12][1]).split()
        for _ in range(k % 4):
            passage[rng.randrange(len(passage))] = "changed"
        if k % 3 == 0 and len(passage) > 3:
            del passage[1]
        body[len(body) // 2:len(body) // 2] = [w.upper() + "," for w in passage]
        docs.append((k, " ".join(body)))
    docs += [(90, "a short one\nindeed"), (91, "same " * 30), (92, None), (93, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    found = D.contaminated(d, b).collect()
    got, want = {(r.doc_id, r.item_id) for r in found}, brute(docs, items)
    assert got == want and len(got) == len(found) > 20
    assert all(r.similarity >= D.SIMILARITY and r.hamming <= D.RADIUS for r in found)


def test_blocks_of_items(spark, monkeypatch):
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i}") for i in range(9)]
    docs = [(k, "start " + items[k][1] + " stop") for k in range(9)]
    monkeypatch.setattr(D, "INDEX_CHARS", 100)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()} == {(k, k) for k in range(9)}
    assert D.keep_clean(d, b).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two three four five six", "clash"), (1, "one two three four five six", "clash")],
                                  "item_id bigint, text string, doc_id string")
    none = bench.where("item_id > 9")
    assert [r.doc_id for r in D.contaminated(odd_docs, bench).collect()] == [1] * 4
    kept = D.keep_clean(odd_docs, bench)
    assert kept.dtypes == odd_docs.dtypes and kept.count() == odd_docs.count() - 2
    assert D.contaminated(no_docs, bench).count() == 0 == D.contaminated(odd_docs, none).count()
    assert D.keep_clean(odd_docs, none).count() == odd_docs.count()


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    shared = {s for _, t in items for s in D.shingles(D.words_of(t), D.WORDS_EACH)}
    touched = [d for d in docs if shared & set(D.shingles(D.words_of(d[1] or ""), D.WORDS_EACH))]  # others have similarity 0
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, sf).collect()}
    assert got == brute(touched, items) and got


def test_index_survives_pickling():
    block = pickle.dumps(([(1, "a b c d e f g")], D.WORDS_EACH, D.SIMILARITY, D.RADIUS))
    index = D.Index(*pickle.loads(block))
    assert [m[0] for m in index.matches("x a b c d e f g y")] == [1]


def test_moved_parts_are_found(spark):
    """Windows that hold an item's sentences in another order are as similar as their shingles say."""
    rng = random.Random(8)
    items = [(i, [f"w{rng.randrange(5000)}" for _ in range(size)]) for i, size in enumerate((60, 60, 61, 90, 48))]
    docs = []
    for key, (_, words) in enumerate(items):
        half = len(words) // 2
        filler = [f"f{rng.randrange(5000)}" for _ in range(200)]
        docs.append((key, " ".join(filler[:90] + words[half:] + words[:half] + filler[90:])))
        third = len(words) // 3
        docs.append((key + 10, " ".join(words[third:] + words[:third])))
        docs.append((key + 20, " ".join(words[half:] + words[:half - 3])))  # shorter than the item
    items = [(i, " ".join(words)) for i, words in items]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    found = D.contaminated(d, b).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got == brute(docs, items) and {(0, 0), (10, 0), (3, 3)} <= got
    assert next(r for r in found if r.doc_id == 0).first_word == 90
    assert {r.doc_id for r in D.keep_clean(d, b).collect()} == {k for k, _ in docs} - {k for k, _ in got}


def test_items_without_an_id_count(spark):
    text = "alpha beta gamma delta eps zeta eta theta"
    d = spark.createDataFrame([(1, "so " + text + " it goes"), (2, "nothing of the kind in here at all")], "doc_id bigint, text string")
    b = spark.createDataFrame([(None, text), (None, text), (7, text)], "item_id bigint, text string")
    assert [r.doc_id for r in D.keep_clean(d, b).collect()] == [2]
    assert [(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()] == [(1, 7), (1, None), (1, None)]

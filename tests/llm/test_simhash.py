import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkrisk.llm import simhash as S
from sparkrisk.llm.common import Steps
from sparkrisk.llm.queries import QUERIES


def by_definition(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    runs = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, max_bits=4):
    """{index: smallest index reachable}"""
    out = list(range(len(prints)))

    def top(i):
        while out[i] != i:
            i = out[i]
        return i

    v = np.array(prints, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[:i] ^ v[i]) <= max_bits).tolist():
            a, b = sorted((top(i), top(j)))
            out[b] = a
    return [top(i) for i in range(len(v))]


def check(rows, texts):
    """rows: of the query; texts: {id: text}, ids unique and not null"""
    ids = sorted(texts)
    prints = [by_definition(texts[i]) for i in ids]
    roots = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert got == {i: (format(p, "016x"), ids[r]) for i, p, r in zip(ids, prints, roots)}


def test_fingerprint_is_sparks_hash(spark):
    native = spark.sql("SELECT xxhash64('a b c d')").first()[0] & (2**64 - 1)
    assert S.shingle_hashes(b"A b  C\td", 4, 42).tolist() == [native]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op7_simhash_neardup"](spark, sf).collect()
    check(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_every_linked_pair_meets_in_a_leaf():
    rng = np.random.default_rng(1)
    far = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    near = far[:800].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    values = np.concatenate([far, near])
    trees = [S.VantageTree((values >> np.uint64(s)) & np.uint64(m), len(values), 4 // S.PARTS, leaf=60) for s, m in S.bit_ranges()]
    leaves = [[set() for _ in values] for _ in trees]
    for k, (tree, (s, m)) in enumerate(zip(trees, S.bit_ranges())):
        assert tree.leaves > 20
        index, leaf = tree.leaves_of((values >> np.uint64(s)) & np.uint64(m))
        for i, x in zip(index.tolist(), leaf.tolist()):
            leaves[k][i].add(x)
        assert all(leaves[k])
    for i in range(800):
        assert np.bitwise_count(values[i] ^ values[3000 + i]) <= 4
        assert any(leaves[k][i] & leaves[k][3000 + i] for k in range(S.PARTS))


def test_reach_equals_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 5, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for b in base]))
    got, want = S.reach(values, 4), brute_components(values.tolist())
    pairs = lambda x: {(i, j) for i in range(len(x)) for j in range(len(x)) if x[i] == x[j]}
    assert pairs(got.tolist()) == pairs(want)


def test_dense_group_in_chunk_pairs(spark, monkeypatch):
    """A chain of close fingerprints with a cloud around it, in leaves that are cut into chunks."""
    monkeypatch.setattr(S, "CHUNK", 50)
    values = [((1 << k) - 1) ^ (k % 7) for k in range(60)]
    values = sorted(set(values) | {v ^ 1 << b for v in values for b in range(0, 64, 9)})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    steps = Steps(spark, "test")
    roots = {r.node: r.root for r in S.components(S.links(prints, 4, steps), steps).collect()}
    want = brute_components(values)
    got = [roots.get(s, s) for s in signed]
    groups = lambda x: sorted(tuple(i for i in range(len(x)) if x[i] == k) for k in set(x))
    assert groups(got) == groups(want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    out = S.components(spark.createDataFrame(edges, "a bigint, b bigint"), Steps(spark, "test")).collect()
    assert {r.node: r.root for r in out} == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 30)}}


def test_odd_rows(odd_docs, no_docs):
    rows = S.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].fingerprint == by_id[3].fingerprint == by_id[4].fingerprint == "0" * 16
    assert {by_id[i].component_id for i in (2, 3, 4)} == {2} and by_id[1].component_id == 1
    assert S.near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(odd_docs, no_docs):
    kept = S.keep_one(odd_docs)
    assert kept.dtypes == odd_docs.dtypes
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [1, 2, 5, 6, None]
    assert S.keep_one(no_docs).count() == 0


def test_copies_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f")] * 3 + [(9, "a b c d e f")], "doc_id bigint, text string")
    assert {r.component_id for r in S.near_duplicates(docs).collect()} == {9}
    assert [r.doc_id for r in S.keep_one(docs).collect()] == [9]
    assert S.near_duplicates(docs.where(F.col("doc_id").isNull())).first().component_id is None


def test_hubs_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "HUB", 5)
    edges = [(5, k) for k in range(10, 40)] + [(39, 60), (60, 3)] + [(100, 100 + k) for k in range(1, 9)] + [(200, 201)]
    out = S.components(spark.createDataFrame(edges, "a bigint, b bigint"), Steps(spark, "test")).collect()
    want = {**{k: 3 for k in (5, 60, *range(10, 40))}, **{100 + k: 100 for k in range(1, 9)}, 201: 200}
    assert {r.node: r.root for r in out} == want

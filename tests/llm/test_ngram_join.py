import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkrisk.llm import ngram_join as J
from sparkrisk.llm.common import utf8
from sparkrisk.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def shingles(text, each=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) <= each:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[k:] for k in range(each))))


def brute(docs, percent=80, each=5):
    """(id, set size, smallest id reachable), from the exact overlap of every two sets that share a shingle."""
    sets = [(i, shingles(t, each)) for i, t in docs]
    root, holders = list(range(len(sets))), {}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, (_, s) in enumerate(sets):
        for b, both in Counter(b for x in s for b in holders.get(x, ())).items():
            if 100 * both >= percent * (len(s) + len(sets[b][1]) - both):
                root[find(a)] = find(b)
        for x in s:
            holders.setdefault(x, []).append(a)
    least = {}
    for a, (i, _) in enumerate(sets):
        least.setdefault(find(a), []).append(i)
    name = {a: min((i for i in ids if i is not None), default=None) for a, ids in least.items()}
    return sorted(((i, len(s), name[find(a)]) for a, (i, s) in enumerate(sets)), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def family(rnd, words, base, n, edits):
    """Near copies of one text by a few changed words each, some of them exact copies."""
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append(" ".join(t))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choices(words, k=60))  # shared by many documents that are not alike
    texts = []
    for size, n, edits in ((120, 40, 3), (300, 25, 12), (30, 12, 1), (200, 8, 9)):
        texts += family(rnd, words, rnd.choices(words, k=size), n, edits)
    texts += [" ".join(rnd.choices(words, k=rnd.randint(20, 90))) + " " + passage for _ in range(30)]
    texts += ["a b c", "A b  C", "a b", "", None, "x", "a b c d e", "A B C D E"] + [" ".join(rnd.choices(words, k=70)) for _ in range(20)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,percent,rounds,worth", [(1, 80, 4, 4), (2, 80, 1, 0), (3, 60, 3, 0), (4, 95, 4, 4)])
def test_equals_brute_force(spark, monkeypatch, seed, percent, rounds, worth):
    """Whatever the rounds of hubs find, the rest is found by pairs of groups."""
    monkeypatch.setattr(J, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(J, "WORTH", worth)
    docs = corpus(seed)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    want = brute(docs, percent)
    assert rows(J.similar_documents(table, percent=percent)) == want
    assert sum(i != c for i, _, c in want) > 10


@pytest.mark.parametrize("percent", [50, 80, 93, 100])
def test_prefixes_of_similar_sets_meet(percent):
    rnd = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rnd.integers(1, 60))
        a = rnd.choice(200, n, replace=False)
        b = np.union1d(a[:max(1, n - int(rnd.integers(0, 12)))], rnd.choice(np.arange(200, 400), int(rnd.integers(0, 12))))
        both = len(np.intersect1d(a, b))
        order = rnd.permutation(400)  # any order will do
        if 100 * both >= percent * (len(a) + len(b) - both):
            one, two = (s[np.argsort(order[s])][:J.prefix_length(len(s), percent)] for s in (a, b))
            assert len(np.intersect1d(one, two))


def test_shingles():
    texts = ["", " \n", "a", "a b c d e", "a b c d e f", "a " * 50, "", "a b", None, "x" * 3000, "\u00a0 \u0085z"]
    sets = J.shingle_sets(pa.array(texts), 5)
    assert list(map(len, sets)) == [0, 0, 1, 1, 2, 1, 0, 1, 0, 1, 1]
    _, sizes = J.word_hashes(*utf8(pa.array(texts)))
    assert sizes.tolist() == [0, 0, 1, 5, 6, 50, 0, 2, 0, 1, 2]  # only ASCII white space separates
    same = lambda a, b: np.array_equal(*J.shingle_sets(pa.array([a, b]), 5))
    assert same("A  b\tc", "a b c") and same(" x", "x\r\n") and same("AZ@[`{az", "az@[`{az")
    assert not same("a b c", "a c b") and not same("Ä b", "ä b") and not same("a b", "a b b") and not same("ab c", "a bc")
    many = [f"word{i}" for i in range(100_000)] + ["a" * i for i in range(1, 2000)]
    assert len(np.unique(J.word_hashes(*utf8(pa.array([" ".join(many)])))[0])) == len(many)


def test_identical_prefixes_are_one_group(spark, monkeypatch):
    """Sets of one size and prefix that differ later: one group, whose members are verified one by one."""
    monkeypatch.setattr(J, "bucket_counts", lambda *a: np.zeros(J.BUCKETS, np.int64))  # in the order of the hashes
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    base = rnd.sample(words, 100)
    docs = list(enumerate(family(rnd, words, base, 60, 1) + family(rnd, words, base[:50] + rnd.sample(words, 50), 20, 2)))
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    heads = J.prefixes(table, "doc_id", "text", 5, 80, J.bucket_counts()).collect()
    assert len({(r.n, bytes(r.prefix_digest)) for r in heads}) < len({bytes(r.digest) for r in heads})
    assert rows(J.similar_documents(table)) == brute(docs)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op13_ngram_join"](spark, SF).select("doc_id", "n_shingles", "component_id")) == brute(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = rows(J.similar_documents(odd_docs))
    want = [(i, n, i if not n else c) for i, n, c in brute(docs)]  # without shingles: its own
    assert got == want
    assert rows(J.similar_documents(no_docs)) == []
    none = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), ("k", "z")], "doc_id string, text string")
    assert rows(J.similar_documents(none)) == rows(spark.createDataFrame([(None, 2, None), (None, 2, None), ("k", 1, "k")], "a string, b bigint, c string"))


def test_a_crowd_meets_once_a_pair(spark):
    """Groups that share many shingles: one row a pair, not one a shared shingle."""
    rnd = np.random.default_rng(3)
    shared, state = rnd.integers(0, 1 << 62, 20), []
    for gid in range(30):
        prefix = np.concatenate([shared, rnd.integers(0, 1 << 62, 10)])
        bits, fine = (J.prefix_bits(prefix.astype(np.uint64), n).view(np.int64).tolist() for n in (len(J.BITS), J.FINE))
        slots = [min((int(t) for t in shared if t % J.SLOTS == i), default=None) for i in range(J.SLOTS)]
        state += [(int(t), gid, 146, gid, gid, *bits, fine, slots) for t in shared]
    table = spark.createDataFrame(state, "token bigint, gid bigint, n bigint, lo bigint, hi bigint, "
                                  + "".join(f"{b} bigint, " for b in J.BITS) + "fine array<bigint>, slots array<bigint>")
    every = J._met(table, table, 80).where("a < b")
    once = J._met(table, table, 80, True).where("a < b")
    assert every.count() == 435 * 20
    assert rows(once) == rows(every.distinct())


def test_finer_bits_bound_what_prefixes_share():
    rnd = np.random.default_rng(1)
    for _ in range(100):
        a = rnd.integers(0, 1 << 63, int(rnd.integers(1, 90))).astype(np.uint64)
        b = np.concatenate([a[:int(rnd.integers(0, len(a) + 1))], rnd.integers(0, 1 << 63, 30).astype(np.uint64)])
        one, two = J.prefix_bits(a, J.FINE), J.prefix_bits(b, J.FINE)
        assert len(np.intersect1d(a, b)) <= len(np.unique(a)) - sum(int(x).bit_count() for x in one & ~two)

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrisk.llm import periodic_runs as R
from sparkrisk.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words):
    """Every maximal stretch of every period, each stretch with its smallest one."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def sequence(rnd):
    n, few, out = rnd.randint(0, 700), rnd.choice([1, 2, 3, 5, 50, 1000]), []
    while len(out) < n:
        if rnd.random() < .35:
            out += [rnd.randrange(few) for _ in range(rnd.randint(1, 60))]
            continue
        block = [rnd.randrange(rnd.choice([1, 2, 3, 1000])) for _ in range(rnd.choice([1, 2, 5, 20, 47, 48, 49, 60, 83, 84, 100, 150]))]
        if rnd.random() < .3 and len(block) > 4:  # a short period inside a long one
            block = (block[:2] * len(block))[:len(block) - 1] + [7777]
        out += (block * 6)[:rnd.randint(len(block), 5 * len(block))]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    many = [sequence(rnd) for _ in range(3)]
    assert R.runs_of([np.array(s, np.int32) for s in many]) == [brute(s) for s in many]


@pytest.mark.parametrize("period,repeats", [(1, 24), (7, 4), (47, 3), (48, 3), (83, 3), (84, 4), (1000, 3), (5000, 5)])
def test_one_run_at_any_scale(period, repeats):
    rnd = random.Random(period)
    head, block = [-1 - i for i in range(17)], [rnd.randrange(1 << 30) for _ in range(period)]
    words = np.array([abs(x) + (1 << 30) - 1 if x < 0 else x for x in head + block * repeats + [-99]], np.int64)
    assert R.runs_of([words.astype(np.int32)]) == [[(17, period * repeats, period)]]


def test_square_is_no_run_and_run_ends_where_words_differ():
    block = list(range(60))
    assert R.runs_of([np.array(block * 2 + block[:59], np.int32)]) == [[]]
    assert R.runs_of([np.array(block * 3, np.int32)]) == [[(0, 180, 60)]]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark):
    """The whole query against the definition, on every document of the smallest table."""
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        if len((r.text or "").split()) <= 3000:  # the definition takes the square of a text's words
            assert got[r.doc_id] == expected(r.doc_id, r.text), r.doc_id
    assert sum(v[0] > 0 for v in got.values()) > 5


def test_odd_rows(spark, odd_docs, no_docs):
    out = R.run_digests(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by_id = {r.doc_id: r for r in out}
    empty = hashlib.sha256(b"").hexdigest()
    for i in (2, 3, 4):
        assert (by_id[i].n_runs, by_id[i].start, by_id[i].collapsed_sha256) == (0, None, empty)
    assert (by_id[5].n_runs, by_id[5].start, by_id[5].length, by_id[5].period) == (1, 0, 20000, 5)
    assert by_id[5].collapsed_sha256 == hashlib.sha256(b"alpha beta gamma delta epsilon").hexdigest()
    assert by_id[6].n_runs == 0 and [r.doc_id for r in out].count(1) == 2
    assert R.run_digests(no_docs).collect() == []


def test_columns(spark):
    """Runs and collapsed texts as columns, with other columns of the same names beside them."""
    df = spark.createDataFrame([("a b " * 20 + "end", 1, "x"), (None, 2, "y")], "text string, runs int, collapsed string")
    out = df.select(R.find_runs(F.col("text")).alias("found"), R.collapse(F.col("text")).alias("short"), "*").collect()
    assert [tuple(r) for r in out[0].found] == [(0, 40, 2)] and out[0].short == "a b end"
    assert out[1].found == [] and out[1].short == ""

import collections
import math
import re
import struct

import xxhash

from sparkrisk.llm import quality_rules as Q
from sparkrisk.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(text):
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in WORD.findall(text or "")]
    pairs = [xxhash.xxh64(struct.pack("<Q", b), seed=xxhash.xxh64(struct.pack("<Q", a), seed=42).intdigest()).intdigest()
             for a, b in zip(h, h[1:])]
    return [signed(x) % Q.BUCKETS for x in h + pairs]


def brute_ratios(texts, trusted):
    target, raw = collections.Counter(), collections.Counter()
    for key, text in texts:
        raw.update(b := buckets(text))
        if key in trusted:
            target.update(b)
    n_raw, n_target = sum(raw.values()) + Q.BUCKETS, sum(target.values())
    out = []
    for b in range(Q.BUCKETS):
        share = (raw[b] + 1) / n_raw
        p = (target[b] + Q.PRIOR * Q.BUCKETS * share) / (n_target + Q.PRIOR * Q.BUCKETS)
        out.append(round(1e6 * math.log(p / share)))
    return out


def test_query_equals_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r.id for r in Q.trusted_ids(labels).collect()}
    assert trusted == {r.doc_id for r in labels.collect() if r.quality == 1
                       and __import__("zlib").crc32(str(r.doc_id).encode()) % 4 != 2}
    ratios = brute_ratios(texts, trusted)
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    assert len(got) == len(texts)
    near = 0
    for key, text in texts:
        r, want = got[key], base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        b = buckets(text)
        total, n = sum(ratios[x] for x in b), max(1, 2 * want[0] - 1)
        if abs(total - Q.THRESHOLD * n) <= len(b):
            near += 1  # one micro-nat of rounding a gram could tip it
            continue
        assert r.kept == (not want[5] and total >= Q.THRESHOLD * n)
    assert near <= 1


def test_ratios_equal_brute_force(spark, odd_docs):
    trusted = spark.createDataFrame([(1,), (6,)], "id bigint")
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = Q.fit_ratios(odd_docs, trusted)
    assert max(abs(a - b) for a, b in zip(got, brute_ratios(texts, {1, 6}))) <= 1


def test_windows_and_lines(spark):
    texts = ["a b c a b c", "a b c d", "x x x x", "a a", "", None, "l 1\nl 1\n \n \nl 2", " a b c", "a\x1cb c d a\x1cb c d",
             " ".join(f"w{i % 90}" for i in range(300)), " ".join(f"w{i}" for i in range(60)) + " %%% <b>|"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in Q.verdicts(docs, None).collect():
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[5])


def test_odd_rows(spark, odd_docs, no_docs, no_labels):
    out = Q.verdicts(odd_docs, None)
    assert out.count() == odd_docs.count() and "lang" not in out.columns
    assert Q.verdicts(no_docs, [0] * Q.BUCKETS).count() == 0
    assert Q.fit_ratios(odd_docs, Q.trusted_ids(no_labels)) is None
    kept = Q.keep_good(odd_docs.withColumnRenamed("t", "_rules_t"), None)
    assert kept.columns == [c if c != "t" else "_rules_t" for c in odd_docs.columns]
    assert kept.count() == 0  # too short, or one run repeated
    assert Q.keep_good(no_docs, None).count() == 0


def test_unlikely_documents_are_rejected(spark):
    good = [" ".join(f"common{(i * k) % 40} rare{i}{k}" for i in range(600)) for k in range(1, 120)]
    bad = [" ".join(f"spam{(i * k) % 40}! junk{i}{k}" for i in range(600)) for k in range(1, 20)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    ratios = Q.fit_ratios(docs, spark.createDataFrame([(i,) for i in range(80)], "id bigint"))
    kept = {r.doc_id for r in Q.keep_good(docs, ratios).collect()}
    assert kept == set(range(len(good)))


def test_plan_has_no_python(odd_docs):
    plan = Q.verdicts(odd_docs, [1] * Q.BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("split(") <= 3


def test_buckets_are_remainders_and_bigrams_one_pass(spark):
    """Buckets equal the remainders of the hashes; a bigram is hashed and dealt to its bucket in one step over the words."""
    from pyspark.sql import functions as F
    from sparkrisk.llm import quality_rules as Q
    df = spark.createDataFrame([(["a", "b", "a", "c"],), (["x"],), ([],)], "w array<string>").select(Q.word_hashes(F.col("w")).alias("h"))
    for r in df.select("h", Q.ngrams(F.col("h")).alias("g")).collect():
        pairs = spark.createDataFrame(list(zip(r.h, r.h[1:])), "a bigint, b bigint").select(F.xxhash64("a", "b")).collect() if len(r.h) > 1 else []
        assert r.g == [h % Q.BUCKETS for h in r.h] + [p[0] % Q.BUCKETS for p in pairs]
    plan = df.select(Q.ngrams(F.col("h")).alias("g"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("transform(") == 3, plan  # one for the words' hashes, one each for uni- and bigrams

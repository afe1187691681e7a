import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkrisk.llm import toxicity as T
from sparkrisk.llm.queries import QUERIES

INSULTS = ["grumblefool", "snotwhistle", "dirtmuffin", "clodhopperish"]


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "an", "er", "on", "ti", "es", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(INSULTS))
        text = "".join(w + (". " if k % 9 == 8 else " ") for k, w in enumerate(body))
        docs.append((i, text))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return docs, labels, T.fit(docs, labels)


def test_weights_equal_the_kernel():
    """The collapsed table gives the same sum as the kernel against every landmark."""
    rng = np.random.default_rng(0)
    landmarks = [T.features(w.encode()) for w in ("idea", "window", "another")]
    alpha = rng.normal(size=3)
    table = np.zeros(1 << (5 * T.ORDER))
    for (k, v), a in zip(landmarks, alpha):
        table[k] += v * a
    text = b"win-dow and an1other i d e a"
    data = np.frombuffer(text, np.uint8)
    codes, _ = T.spread(data, np.array([0, len(data)]))
    sums = T.window_sums(codes, T.decayed(table))
    for at in range(0, len(text) - T.WINDOW - T.SPAN):
        want = T.kernel([T.features(text[at:at + T.WINDOW + T.SPAN])], landmarks)[0] @ alpha
        assert sums[at] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_kernel_by_definition():
    """Common subsequences of ORDER letters with decayed gaps, counted one by one."""
    from itertools import combinations
    def phi(s):
        out = {}
        for at in combinations(range(len(s)), T.ORDER):
            if at[-1] - at[0] <= T.SPAN and at[0] < T.WINDOW and all(s[i].isalpha() for i in at):
                key = "".join(s[i] for i in at)
                out[key] = out.get(key, 0) + T.DECAY ** (at[-1] - at[0] - T.ORDER + 1)
        return out
    a, b = "gapped", "g-ap ped"
    x, y = phi(a), phi(b)
    want = sum(v * y.get(k, 0) for k, v in x.items())
    assert T.kernel([T.features(a.encode())], [T.features(b.encode())])[0, 0] == pytest.approx(want, rel=1e-5)


def test_held_out_accuracy_and_spoiled_insults(spark, fitted):
    docs, labels, model = fitted
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = T.scores(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.97
    clean = "therti onanes and the ertist was here. "
    hard = [clean + s + " tieson" for w in INSULTS for s in (w, "-".join(w), w[:4] + "*" + w[4:], w.upper())]
    scored = T.scores(spark.createDataFrame(list(enumerate(hard)), "doc_id bigint, text string"), model).collect()
    assert sum(r.predicted for r in scored) >= len(hard) - 1
    calm = T.scores(spark.createDataFrame([(1, clean * 200)], "doc_id bigint, text string"), model).first()
    assert calm.predicted == 0


def test_longer_than_a_chunk_and_last_words():
    table = np.zeros(1 << (5 * T.ORDER))
    k, v = T.features(b"scoundrel")
    table[k] += v
    weight = T.decayed(table)
    plain = "quiet " * 600_000
    out = T.worst_windows(pa.array([plain, None, "", "scoundrel", plain + "scoundrel"]), weight)
    assert out[1] == out[2] == 0 and out[4] == pytest.approx(out[3]) and out[0] < out[3] / 2


def test_odd_rows(odd_docs, no_docs, no_labels, fitted):
    model = fitted[2]
    rows = T.scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    empty = {r.score for r in rows if r.doc_id in (2, 3, 4)}
    assert len(empty) == 1
    assert T.scores(no_docs, model).count() == 0
    assert T.fit(odd_docs, no_labels) is None and T.fit(no_docs, fitted[1]) is None
    assert {r.score for r in T.scores(odd_docs, None).collect()} == {0.0}
    kept = T.keep_civil(odd_docs, model)
    assert kept.dtypes == odd_docs.dtypes and kept.count() == sum(r.score < 0.3 for r in rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op2_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    english = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in toxic and r.doc_id in english]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.9


SEPARATORS = ["\u00b7", "\u00ad", "\u200b", "\u0336", "--", " - ", "\u200b\u200d", "\U0001f600", " \u2022\u2022 "]


@pytest.mark.parametrize("sign", SEPARATORS)
def test_separators_of_any_width_stay_in_the_span(sign):
    """A run of non-letters is one skipped character, however many bytes or signs it has."""
    table = np.zeros(1 << (5 * T.ORDER))
    k, v = T.features(b"scoundrel")
    table[k] += v
    weight = T.decayed(table)
    got, one = T.worst_windows(pa.array(["you " + sign.join("scoundrel") + " there", "you " + ".".join("scoundrel") + " there"]), weight)
    assert got == pytest.approx(one) and got > 0
    assert T.features(sign.join("idiot").encode())[0].tolist() == T.features(b"i.d.i.o.t")[0].tolist() != []


def test_characters_not_bytes_are_counted():
    """Letters of several bytes are one character, alone and as inserted letters, and texts stay apart."""
    for word in ("\u0434\u0443\u0440\u0430\u043a", "\u0e01\u0e02\u0e04\u0e07", "\u00e9\u00e8\u00ea\u00eb"):
        plain, gapped = T.features(word.encode()), T.features("\u00b7".join(word).encode())
        assert len(plain[0]) and set(plain[0].tolist()) >= set(gapped[0].tolist()) != set()
    keys = T.features(b"idio")[0].tolist()
    assert set(keys) <= set(T.features("\u4f60".join("idio").encode())[0].tolist())
    texts = ["a\u00b7", "\u00b7b", "", None, "--x--\u00e9", "\U0001f600"]
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    codes, starts = T.spread(data, offsets)
    assert (np.diff(starts) - T.PAD).tolist() == [2, 2, 0, 0, 4, 1]
    assert [codes[s:e - T.PAD].tolist() for s, e in zip(starts, starts[1:])] == [[1, 0], [0, 2], [], [], [0, 24, 0, 27 + 0xe9 % 64 % 5], [0]]


def test_separated_insults_score_as_toxic(spark, fitted):
    """Insults with separators of several bytes or signs are found in whole texts."""
    clean = "therti onanes and the ertist was here. "
    hard = [clean + s.join(w) + " tieson" for w in INSULTS for s in SEPARATORS]
    rows = T.scores(spark.createDataFrame(list(enumerate(hard)), "doc_id bigint, text string"), fitted[2]).collect()
    assert sum(r.predicted for r in rows) >= len(hard) - len(SEPARATORS)
    calm = T.scores(spark.createDataFrame([(1, clean * 200)], "doc_id bigint, text string"), fitted[2]).first()
    assert calm.predicted == 0


def small_corpus(toxic_texts, n=60):
    docs, _ = corpus(n * 5, seed=9)
    clean = [t for k, (_, t) in enumerate(docs) if k % 5]
    texts = [(t, 1) for t in toxic_texts] + [(t, 0) for t in clean]
    return [(i, t) for i, (t, _) in enumerate(texts)], [(i, 1, y) for i, (_, y) in enumerate(texts)]


@pytest.mark.parametrize("toxic", [
    ["theres an grumblefool here. "] * 20,  # copies of one sentence
    ["the onest thanes are grumblefool erti" + " onti erres stesan" * 80 + f" there{i}" for i in range(20)],  # only long sentences
])
def test_few_or_long_toxic_sentences_still_give_a_model(spark, toxic):
    docs, labels = small_corpus(toxic)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = T.fit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert model is not None
    kept = {r.doc_id for r in T.keep_civil(d, model).collect()}
    assert not kept & {i for i, _, y in labels if y}
    assert len(kept) > 0.9 * sum(1 - y for _, _, y in labels)


def test_long_sentences_are_cut_whole(spark):
    words = [f"w{i}" for i in range(900)]
    rows = spark.createDataFrame([(1, " ".join(words) + ". short one"), (0, "x" * 2500)], "y int, text string")
    out = T._sentences(rows).collect()
    assert all(len(r.s) <= T.TRAIN_CHARS for r in out) and sum(len(r.s) for r in out if not r.y) == 1500
    assert {w for r in out if r.y for w in r.s.split()} == {*words, "short", "one"}

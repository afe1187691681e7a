"""Quality rules with a hashed n-gram likelihood ratio, in DataFrame functions only (operator 8).

Base rules count words, symbols, repeated lines and repeated three-word windows of each text. The method's
verdict compares two multinomials over hashed word unigrams and bigrams: one counted over trusted documents
(the target), one over all documents (the raw corpus). A document's score is the mean log ratio of its
n-grams; the ratios are whole micro-nats, so sums don't depend on their order, and a fixed threshold decides
about every document. Everything stays in the JVM: the text is split once per pass, words are hashed once,
and windows and bigrams are hashes of those hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_side

#: Buckets of the hashed n-grams (the ratio table is bounded by them), and how many counts a bucket of the
#: target is drawn towards the raw corpus by, on average.
BUCKETS, PRIOR = 16_384, 8
#: A document is rejected below this mean log ratio (micro-nats an n-gram).
THRESHOLD = -150_000
#: Fixed values of the base rules: least words, and per cent of words that may lie in repeated windows.
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"


def word_hashes(words: Column) -> Column:
    """64-bit hash of each word, in order."""
    return F.transform(words, lambda w: F.xxhash64(w))


def bucket(h: Column) -> Column:
    """The lower bits of a hash: its remainder by BUCKETS, a power of two."""
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("bigint")).cast("int")


def bigrams(hashes: Column) -> Column:
    """Bucket of each pair of neighbours, from the words' hashes."""
    pairs = F.transform(hashes, lambda h, i: bucket(F.xxhash64(h, F.get(hashes, i + 1))))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0)))


def ngrams(hashes: Column) -> Column:
    """Buckets of all unigrams and bigrams."""
    return F.concat(F.transform(hashes, bucket), bigrams(hashes))


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeat_words(ordered: Column) -> Column:
    """Words that lie in a window found twice or more. ``ordered``: (hash, place) of each window, sorted."""
    found = F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]))
    covered = F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.size(F.array_distinct(covered)).cast("bigint")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")


def _prefix(cols: list[str]) -> str:
    """A prefix that no column name begins with."""
    prefix = "_rules_"
    while any(c.lower().startswith(prefix) for c in cols):
        prefix = "_" + prefix
    return prefix


def _measured(docs: DataFrame, text_col: str, ratios: list[int] | None) -> tuple[DataFrame, str]:
    """``docs`` with a column for each of MEASURES, and the prefix of these columns' names.

    What several expressions use is a column of its own (never a struct, which the optimiser takes apart and
    unfolds into every use), so it is computed once.
    """
    at = _prefix(docs.columns)

    def col(name: str) -> Column:
        return F.col(at + name)

    rows = docs.withColumn(at + "t", F.coalesce(F.col(text_col), F.lit(""))).withColumn(at + "words", split_words(F.col(text_col)))
    rows = rows.withColumn(at + "lines", F.filter(F.split(col("t"), "\n", -1), lambda x: x.rlike(A_WORD)))
    rows = rows.withColumns({
        at + "n_words": F.size(col("words")).cast("bigint"),
        at + "word_chars": F.char_length(F.array_join(col("words"), "")).cast("bigint"),
        at + "n_symbols": (F.char_length(col("t")) - F.char_length(F.regexp_replace(col("t"), SYMBOLS, ""))).cast("bigint"),
        at + "n_dup_lines": (F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("bigint"),
        at + "hashes": word_hashes(col("words"))}).drop(at + "t", at + "words", at + "lines")
    hashes = col("hashes")
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3),
                          lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))
    total = F.lit(0).cast("bigint")
    if ratios:
        table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")  # a constant, folded once
        total = F.aggregate(ngrams(hashes), total, lambda s, b: s + F.get(table, b))
    rows = rows.withColumns({
        at + "total": total,
        at + "windows": F.when(F.size(hashes) >= 3, windows).otherwise(F.array().cast("array<bigint>"))}).drop(at + "hashes")
    windows = col("windows")
    twice = F.size(F.array_distinct(windows)) < F.size(windows)  # most texts repeat no window: nothing to sort
    ordered = F.when(twice, F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn(at + "ordered", ordered).drop(at + "windows")
    rows = rows.withColumn(at + "n_repeat_words", F.when(col("ordered").isNull(), F.lit(0).cast("bigint"))
                           .otherwise(repeat_words(col("ordered")))).drop(at + "ordered")
    grams = F.greatest(2 * col("n_words") - 1, F.lit(1))
    rows = rows.withColumns({
        at + "base_failed": (col("n_words") < MIN_WORDS) | (100 * col("n_repeat_words") > MAX_REPEAT * col("n_words")),
        at + "log_ratio": col("total") / grams / 1e6})
    rows = rows.withColumn(at + "kept", ~col("base_failed") & (col("total") >= F.lit(THRESHOLD) * grams))
    return rows.drop(at + "total"), at


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Ids of the trusted target: labelled 1 in every label row, outside the held-out fold; NULL ids don't count."""
    return (labels.where(F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id"))
            .agg(F.min(F.coalesce(F.col(quality_col), F.lit(0))).alias("q")).where("q = 1").select("id"))


def fit_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int] | None:
    """Micro-nats of log(target / raw) per bucket, counted over all documents; None if no n-gram is trusted.

    Counts are summed in each task before the shuffle, so at most two rows per bucket and task move. The
    trusted ids are broadcast if a count proves them few; beyond that the join shuffles.
    """
    known = small_side(trusted.select(F.col("id").alias("_id"), F.lit(True).alias("_trusted")))
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    rows = rows.join(known, rows["_key"] == known["_id"], "left")
    rows = rows.select(F.coalesce("_trusted", F.lit(False)).alias("trusted"), word_hashes(split_words(F.col("_text"))).alias("h"))
    rows = rows.select("trusted", F.explode(ngrams(F.col("h"))).alias("bucket"))
    counts = np.zeros((2, BUCKETS))
    for trust, bucket, n in rows.groupBy("trusted", "bucket").count().collect():  # at most 2 * BUCKETS rows
        counts[int(trust), bucket] = n
    target, raw = counts[1], counts.sum(axis=0) + 1
    if not target.sum():
        return None
    share = raw / raw.sum()
    fitted = (target + PRIOR * BUCKETS * share) / (target.sum() + PRIOR * BUCKETS)
    return np.rint(1e6 * np.log(fitted / share)).astype(int).tolist()


def verdicts(docs: DataFrame, ratios: list[int] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, the four counts, base_failed, kept, log_ratio (nats an n-gram).

    A NULL text has no words, so all counts are 0 and the base rules reject it, like the empty text. Repeated
    rows are judged each; only the id and text columns are read, so other columns cannot clash; an empty
    table gives an empty result. Without ``ratios`` the method rejects nothing. Windows are compared by
    64-bit hashes.
    """
    rows, at = _measured(docs.select(F.col(id_col), F.col(text_col)), text_col, ratios)
    return rows.select(F.col(id_col), *[F.col(at + c).alias(c) for c in MEASURES])


def keep_good(docs: DataFrame, ratios: list[int] | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and no others."""
    rows, at = _measured(docs, text_col, ratios)
    # A filter over these columns would be pushed below the projections, with all that it uses unfolded into
    # it; it stays above a projection that is not deterministic.
    fenced = F.when(F.monotonically_increasing_id() >= 0, F.col(at + "kept"))
    return rows.withColumn(at + "kept", fenced).where(F.col(at + "kept")).drop(*[at + c for c in MEASURES])

"""Jaccard join of word-shingle sets by grouped prefixes (operator 13).

Two documents link if their sets of distinct shingles have a Jaccard similarity of ``percent`` / 100 or more; linked
documents, directly or through others, form a component.

* Shingles are ordered from rare to frequent by a count over all documents (in ``BUCKETS`` hashed buckets), ties
  by hash. Sets of n shingles that reach the similarity share one among their first n - ceil(s * n) + 1.
* Documents with equal sets are one node. Nodes with an identical prefix and size are one group; only groups go
  through the filters: one row a group and prefix shingle, kept where two groups meet.
* Pairs of groups pass by size, by the bits of their prefixes and by the number of shingles these share: what they share beyond lies behind
  the prefix that ends first, so that rest bounds it. They are then expanded to pairs of nodes and verified on the
  whole sets, which are read once more from the texts, for these nodes only.
* At each shingle the groups are first paired with one hub, the group that meets most others (for most shingles of
  a cluster the text that its members were made from), and what links becomes one component; nodes of one component are
  never paired again. Further rounds take other hubs while many pairs are left. Then every remaining pair of groups that
  spans two components goes through the filters. So a cluster of near copies costs about a pair a node, and no link
  between components is lost.
* What is left of a cluster then are near copies that mostly just miss the similarity, and they meet at most of their
  shingles. At shingles of CROWD open groups or more, pairs therefore pass finer bits first, and where two groups
  prove to meet at an earlier such shingle (they have the same least one of a slot) they are not made again; what
  they share there is counted afterwards, once a pair.

Shingles are compared by 64-bit hash, sets of equal documents by a 128-bit hash of theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Steps, chunks, utf8
from .simhash import components

#: Production parameters: words a shingle, least similarity in percent.
WORDS_EACH, PERCENT = 5, 80
#: Buckets in which shingles are counted to order them (a fixed size: 2 MB to each task).
BUCKETS = 1 << 18
#: Bits of the filter that tells which sets a pair needs (2 ** FILTER bits: 4 MB to each task).
FILTER = 25
#: Rounds of hubs (one at least), and open pairs a row from which another is worth it (if the last one closed a fifth).
HUB_ROUNDS, WORTH = 4, 2

#: Open groups at a shingle from which their pairs are made by finer bits and once, not once a shingle.
CROWD = 8

#: Columns of a prefix's bits: every shingle sets one of 64 in one of them.
BITS = ["s0", "s1", "s2", "s3"]
#: Numbers of 64 bits each that a crowded group's prefix is spread over besides, and slots that have the least hash each of
#: its crowded shingles.
FINE, SLOTS = 16, 16

_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- shingles ----------------------------------------------------------------------------------------------

#: Fixed byte tables: A-Z to lower case; the six white-space bytes.
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 0x20 or 0x09 <= c <= 0x0D for c in range(256)])
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd factor and of its inverse, modulo 2 ** 64; kept up to a chunk's length."""
    if len(_POWERS[0]) >= n:
        return _POWERS
    made = []
    for factor in (int(_MIX), pow(int(_MIX), -1, 1 << 64)):
        steps = np.full(n, factor, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= 2 * CHUNK_BYTES:
        _POWERS[:] = made
    return made


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every lower-cased word of some texts (bytes end to end), and the number of words of each text.

    Words are runs of other bytes than white space; a hash is the sum of the word's bytes times powers of a factor, as
    one running sum over all bytes gives it, then scattered.
    """
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    start = np.flatnonzero(word & (edge[:-1] | ~before)) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (edge[1:] | ~after)) + 1 if len(data) else start
    up, down = _powers(max(1, len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, np.diff(np.searchsorted(start, offsets))


def shingle_sets(texts: pa.Array, words_each: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of the runs of ``words_each`` lower-cased words (fewer words: of
    all; NULL or none: empty)."""
    codes, sizes = word_hashes(*utf8(texts))
    runs = _hashed_runs(codes, words_each)
    out, at = [], 0
    for n in sizes.tolist():
        here = runs[at:at + n - words_each + 1] if n >= words_each else _hashed_runs(codes[at:at + n], n)[:min(n, 1)]
        here = np.sort(here)
        out.append(here[np.concatenate([[True], here[1:] != here[:-1]])] if n else here)
        at += n
    return out


def _hashed_runs(codes: np.ndarray, each: int) -> np.ndarray:
    """Hash of every run of ``each`` codes: each enters a running hash, so their order and number count."""
    out = np.full(max(0, len(codes) - each + 1), each, np.uint64)
    for k in range(each):
        out ^= codes[k:k + len(out)]
        out *= _MIX
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n that it shares one of with every set as similar as ``percent``."""
    return n - -(-percent * n // 100) + 1


def prefix_bits(head: np.ndarray, words: int = len(BITS)) -> np.ndarray:
    """The bits that a prefix's shingles set, 64 in each of the BITS columns (or of so many)."""
    at = head * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 6 - words.bit_length() + 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _fine_bits(prefix: str) -> Column:
    """The bits of the FINE columns of each prefix, an array."""

    @F.arrow_udf("array<bigint>")
    def of(heads: pa.Array) -> pa.Array:
        return _lists([prefix_bits(h.values.to_numpy().view(np.uint64), FINE).view(np.int64) for h in heads])

    return of(F.col(prefix))


def _sets(texts: pa.Array, words_each: int) -> Iterator[list[np.ndarray]]:
    """The sets of a batch of texts, a chunk of texts at a time."""
    for part in chunks(texts):
        yield shingle_sets(part, words_each)


def bucket_counts(docs: DataFrame, text_col: str, words_each: int) -> np.ndarray:
    """Documents' distinct shingles in each bucket, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for sets in _sets(batch.column(0), words_each):
                np.add.at(total, bucket_of(np.concatenate(sets)), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select(F.col(text_col)).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[r[0]] = r[1]  # at most BUCKETS rows
    return out


def prefixes(docs: DataFrame, id_col: str, text_col: str, words_each: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(id, n, digest, prefix_digest, prefix) of every row, the prefix in the order of the shingles; ``weight`` and
    ``last`` place its end in that order, BITS are the bits its shingles set. Without words: NULL digests and an empty prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    kind = ("struct<n:bigint,digest:binary,prefix_digest:binary,weight:bigint,last:bigint,"
            + "".join(f"{b}:bigint," for b in BITS) + "prefix:array<bigint>>")

    @F.arrow_udf(kind)
    def of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = shared.value
        for texts in it:
            n, digest, short, weight, last, bits, first = [], [], [], [], [], [], []
            for sets in _sets(texts, words_each):
                for s in sets:
                    n.append(len(s))
                    if not len(s):
                        for column in (digest, short, weight, last):
                            column.append(None)
                        first.append(s.view(np.int64))
                        bits.append(prefix_bits(s))
                        continue
                    own = counts[bucket_of(s)]
                    head = s[np.argsort(own, kind="stable")[:prefix_length(len(s), percent)]]
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    short.append(xxhash.xxh3_128_digest(head.tobytes()))
                    weight.append(int(counts[bucket_of(head[-1:])][0]))
                    last.append(int((head[-1:] ^ np.uint64(1 << 63)).view(np.int64)[0]))  # signed numbers in the order of the hashes
                    bits.append(prefix_bits(head))
                    first.append(head.view(np.int64))
            numbers = [pa.array(c, pa.int64()) for c in (n, weight, last)]
            set_bits = np.array(bits, np.uint64).reshape(-1, len(BITS)).view(np.int64)
            yield pa.StructArray.from_arrays([numbers[0], pa.array(digest, pa.binary()), pa.array(short, pa.binary()), *numbers[1:],
                                              *[pa.array(set_bits[:, i]) for i in range(len(BITS))], _lists(first)],
                                             ["n", "digest", "prefix_digest", "weight", "last", *BITS, "prefix"])

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("h")).select("id", "h.*")


# --- candidates --------------------------------------------------------------------------------------------

def _filter_bits(digests: DataFrame) -> np.ndarray:
    """A bit for every digest, by its first bits: at most 2 ** FILTER / 32 rows to the driver."""
    h = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"), 32 - FILTER)
    words = (digests.select(F.shiftright(h, 5).cast("int").alias("w"), F.pow(F.lit(2.0), h % 32).cast("bigint").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    out = np.zeros(1 << (FILTER - 5), np.int64)
    for r in words.collect():
        out[r["w"]] = r["b"]
    return out


def _sets_of(docs: DataFrame, digests: DataFrame, text_col: str, words_each: int) -> DataFrame:
    """(digest, shingles) of the ``digests`` (and of few others): texts are read once more, and the sets that are not
    asked for drop out by the bits in the task that reads them."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(digests))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = shared.value, set()
        for batch in batches:
            for sets in _sets(batch.column(0), words_each):
                found, kept = [], []
                for s in sets:
                    if not len(s):
                        continue
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    at = int.from_bytes(digest[:4]) >> (32 - FILTER)
                    if bits[at >> 5] >> (at & 31) & 1 and digest not in sent:  # copies are sent once a task
                        sent.add(digest)
                        found.append(digest)
                        kept.append(s.view(np.int64))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), _lists(kept)], ["digest", "shingles"])

    sets = docs.select(F.col(text_col)).mapInArrow(told, "digest binary, shingles array<bigint>")
    return sets.groupBy("digest").agg(F.first("shingles").alias("shingles"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays + [np.zeros(0, np.int64)])))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, words_each: int, percent: int, steps: Steps) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets are similar enough."""
    named = nodes.select("node", "digest")
    pairs = steps.keep(pairs.join(named.select(F.col("node").alias("a"), F.col("digest").alias("da")), "a")
                       .join(named.select(F.col("node").alias("b"), F.col("digest").alias("db")), "b"))
    digests = pairs.select(F.col("da").alias("digest")).unionByName(pairs.select(F.col("db").alias("digest"))).distinct()
    sets = steps.keep(_sets_of(docs, digests, text_col, words_each))
    one = sets.select(F.col("digest").alias("da"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("digest").alias("db"), F.col("shingles").alias("sb"))
    both = pairs.join(two, "db").join(one, "da")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * percent).select("a", "b")


def _group_pairs(met: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of ``met`` (a row for each shingle that the prefixes of two groups of sizes n_a, n_b share) that may
    be similar enough.

    The shingles the sets share beyond their prefixes come after the prefix that ends first in the common order, so they
    are at most what its set has left.
    """
    return _likely(met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared")), groups, percent)


def _likely(counted: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that may be similar enough by the number of shingles that their prefixes have ``shared``."""
    def enough(n: Column) -> Column:
        return _enough(F.col("shared"), n, percent)

    likely = counted.where(enough(F.greatest("n_a", "n_b")))  # whichever prefix ends first
    sides = [groups.select(F.col("gid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("weight", "last")]) for side in "ab"]
    both = likely.join(sides[0], "a").join(sides[1], "b")
    ends = F.struct("weight_a", "last_a") <= F.struct("weight_b", "last_b")
    return both.where(enough(F.when(ends, F.col("n_a")).otherwise(F.col("n_b")))).select("a", "b")


def _enough(shared: Column, n: Column, percent: int) -> Column:
    """Can sets of n_a and n_b shingles whose prefixes share that many be similar enough, if the prefix of the set of n
    shingles ends first?"""
    rest = F.ceil(n * percent / 100 - F.lit(1e-6)) - 1  # a set's shingles behind its prefix
    return shared + rest >= F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent) - F.lit(1e-6))


def _may_share(x: str, y: str, percent: int, fine: bool = False) -> Column:
    """Shingles that x's prefix shares with y's at most: a bit that only x's has set stands for one that y's has not."""
    def alone(one: Column, two: Column) -> Column:
        return F.bit_count(one.bitwiseAND(F.bitwise_not(two)))

    n = F.col(f"n_{x}")
    if fine:
        missing = F.aggregate(F.zip_with(f"fine_{x}", f"fine_{y}", alone), F.lit(0), lambda total, bits: total + bits)
    else:
        missing = sum((alone(F.col(f"{b}_{x}"), F.col(f"{b}_{y}")) for b in BITS), F.lit(0))
    return n - F.ceil(n * percent / 100 - F.lit(1e-6)) + 1 - missing


def _sizes_fit(n1: Column, n2: Column, percent: int) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def _met(left: DataFrame, right: DataFrame, percent: int, crowded: bool = False) -> DataFrame:
    """(a, b, n_a, n_b) for every shingle at which two groups of fitting sizes meet, both of (token, gid, n, lo, hi, BITS).

    Pairs whose bits tell that their prefixes share too little are left out by the join itself. ``crowded``: with ``fine`` and
    ``slots`` too, and a pair is left out wherever it is sure to be met at another shingle: the first that both have as the
    least of a slot.
    """
    more = ["fine", "slots"] if crowded else []
    one, two = (side.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("gid", "n", "lo", "hi", *BITS, *more)]) for side, x in ((left, "a"), (right, "b")))
    fits = _sizes_fit(F.col("n_a"), F.col("n_b"), percent)
    for fine in [False, True][:1 + crowded]:
        shared = F.least(_may_share("a", "b", percent, fine), _may_share("b", "a", percent, fine))
        fits = fits & _enough(shared, F.greatest("n_a", "n_b"), percent)
    if crowded:
        same = F.filter(F.zip_with("slots_a", "slots_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
        fits = fits & (F.coalesce(F.get(same, F.lit(0)), "token") == F.col("token"))
    met = one.join(two, "token").where(fits)
    # groups whose nodes all are of one component need no further link
    return met.where("NOT (lo_a = hi_a AND lo_b = hi_b AND lo_a = lo_b)").select(F.col("gid_a").alias("a"), F.col("gid_b").alias("b"), "n_a", "n_b")


def _across(state: DataFrame, groups: DataFrame, ends: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """Distinct pairs (a, b) of groups of ``state`` that may be similar enough and are not of one component.

    Shingles of few groups are counted as their pairs meet. At crowded ones a pair is made about once, and the crowded
    shingles that both have are counted from their lists.
    """
    few = _met(*[state.where(F.col("open") < CROWD)] * 2, percent).where("a < b")
    crowd = state.where(F.col("open") >= CROWD).select("token", "gid", "n", "lo", "hi", *BITS)
    least = F.array(*[F.min(F.when(F.pmod("token", F.lit(SLOTS)) == i, F.col("token"))) for i in range(SLOTS)])
    own = steps.keep(crowd.groupBy("gid").agg(least.alias("slots"), F.collect_list("token").alias("tokens")))
    signs = groups.select("gid", "prefix").join(own, "gid").select("gid", _fine_bits("prefix").alias("fine"), "slots")
    crowd = crowd.join(signs, "gid")
    pairs = steps.keep(_met(crowd, crowd, percent, True).where("a < b").distinct())
    one, two = (own.select(F.col("gid").alias(side), F.col("tokens").alias(f"tokens_{side}")) for side in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("bigint").alias("met"))
    counted = few.select("a", "b", "n_a", "n_b", F.lit(1).cast("bigint").alias("met")).unionByName(both)
    return _likely(counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("met").alias("shared")), ends, percent)


def _hub(state: DataFrame, turn: int) -> DataFrame:
    """One group of each shingle: first the one that meets most others, then by a number of its own, so that a cluster's
    shingles agree on it."""
    by = [F.col("degree"), F.xxhash64("gid")] if not turn else [F.xxhash64("gid", F.lit(turn))]
    cols = ["gid", "n", "lo", "hi", *BITS]
    first = F.max(F.struct(*[c.alias(f"by{i}") for i, c in enumerate(by)], *cols)).alias("h")
    return state.groupBy("token").agg(first).select("token", *[f"h.{c}" for c in cols])


def _links(rows: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, words_each: int, percent: int, steps: Steps) -> DataFrame:
    """(node, root) of every linked node. ``rows`` have the prefixes, ``nodes`` (node, digest, n, prefix_digest)."""
    firsts = [F.first(c).alias(c) for c in ("weight", "last", *BITS, "prefix")]
    groups = steps.keep(rows.where("digest IS NOT NULL").groupBy("prefix_digest", "n").agg(*firsts).withColumn("gid", F.monotonically_increasing_id()))
    tokens = groups.select("gid", F.explode("prefix").alias("token")).repartition("token")
    often = tokens.groupBy("token").agg(F.count("*").alias("met")).where("met > 1")
    meeting = steps.keep(tokens.join(often, "token").select("token", "gid", "met"))
    degrees = meeting.groupBy("gid").agg(F.sum("met").alias("degree"))
    ends = steps.keep(groups.select("gid", "n", "weight", "last", *BITS).join(degrees, "gid", "left"))
    members = steps.keep(nodes.join(groups.select("prefix_digest", "n", "gid"), ["prefix_digest", "n"]).select("node", "gid"))
    heads = members.groupBy("gid").agg(F.min("node").alias("head"))
    check = lambda pairs: steps.keep(verified(pairs, nodes, docs, text_col, words_each, percent, steps))

    edges = roots = None
    state = steps.keep(_open(meeting, ends, members, None))
    enough, last = WORTH * meeting.count(), math.inf
    for turn in range(HUB_ROUNDS):
        if turn:
            pairs_left = _left(state)
            if pairs_left <= enough or pairs_left > 0.8 * last:
                break
            last = pairs_left
        met = _met(_hub(state, turn), state, percent).where("a <> b")
        pairs = _expanded(_group_pairs(met, ends, percent), heads, "head")
        if turn == 0:
            pairs = pairs.unionByName(members.join(heads, "gid").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")))
        found = check(pairs)
        edges = found if edges is None else edges.unionByName(found)
        roots = components(edges, steps)
        state = steps.keep(_open(meeting, ends, members, roots))
    told = members.join(roots, "node", "left").select("gid", "node", F.coalesce("root", "node").alias("root"))
    across = _expanded(_across(state, groups, ends, percent, steps), told, "node", "root")
    mixed = told.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gid")
    inside = _expanded(mixed.select(F.col("gid").alias("a"), F.col("gid").alias("b")), told, "node", "root").where("a < b")
    pairs = across.unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = check(pairs)
    return components(edges.unionByName(more), steps) if more.limit(1).count() else roots


def _expanded(pairs: DataFrame, members: DataFrame, what: str, root: str | None = None) -> DataFrame:
    """Pairs (a, b) of groups as pairs of their members; with ``root``, only of members of different components."""
    extra = [root] if root else []
    one, two = (members.select(F.col("gid").alias(side), F.col(what).alias(f"{what}_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in extra if c != what])
                for side in "ab")
    both = pairs.join(one, "a").join(two, "b")
    if root:
        both = both.where(F.col(f"{root}_a") != F.col(f"{root}_b"))
    return both.select(F.col(f"{what}_a").alias("a"), F.col(f"{what}_b").alias("b"))


def _open(meeting: DataFrame, ends: DataFrame, members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(token, gid, n, degree, lo, hi, BITS): the rows of shingles at which nodes of several components meet, with the size of
    the group's sets, the rows it meets and the range of its components; with ``roots`` also ``open``, the rows of the shingle."""
    if roots is None:
        told = members.select("gid", F.col("node").alias("root"))
    else:
        told = members.join(roots, "node", "left").select("gid", F.coalesce("root", "node").alias("root"))
    spans = told.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    now = meeting.join(ends.select("gid", "n", "degree", *BITS).join(spans, "gid"), "gid").select("token", "gid", "n", "degree", "lo", "hi", *BITS)
    if roots is None:
        return now
    wide = now.groupBy("token").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.count("*").alias("open")).where("first <> last")
    return now.join(wide.select("token", "open"), "token")


def _left(state: DataFrame) -> int:
    """Pairs of rows at a shingle that are not of one component."""
    each = state.groupBy("token", "lo", "hi").agg(F.count("*").alias("c"))
    same = F.sum(F.when(F.col("lo") == F.col("hi"), F.col("c") * F.col("c")).otherwise(F.lit(0)))
    per = each.groupBy("token").agg(F.sum("c").alias("c"), same.alias("same"))
    return int(per.agg(F.sum((F.col("c") * F.col("c") - F.col("same")) / 2)).first()[0] or 0)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = WORDS_EACH,
                      percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links, its own included).

    NULL, empty and blank texts have no shingles and link with nothing; fewer than ``words_each`` words are one
    shingle. A NULL id stays NULL in its row and names a component only if all its members are NULL. Repeated rows
    come back each. Only the two columns are read, so others cannot clash. An empty table gives no rows.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"percent {percent}: must be over 0 and at most 100")
    steps = Steps(docs.sparkSession, "ngram-join")
    heads = steps.keep(prefixes(docs, id_col, text_col, words_each, percent, bucket_counts(docs, text_col, words_each)))
    rows = heads.select("id", "n", "digest")
    least = heads.where("digest IS NOT NULL").groupBy("digest", "n", "prefix_digest").agg(F.min("id").alias("least"))
    # Nodes are numbered in the order of their smallest ids, NULL last, so that a component's root bears its name.
    nodes = steps.keep(least.orderBy(F.asc_nulls_last("least"), "digest").withColumn("node", F.monotonically_increasing_id()))
    roots = _links(heads, nodes, docs, text_col, words_each, percent, steps)
    names = nodes.select(F.col("node").alias("root"), F.col("least").alias("name"), F.lit(True).alias("linked"))
    told = nodes.join(roots, "node", "left").join(names, "root", "left")
    named = steps.keep(told.select("digest", F.when(F.col("linked"), F.col("name")).otherwise(F.col("least")).alias("component_id")))
    some = rows.where("digest IS NOT NULL").join(named, "digest")
    out = some.select("id", "n", "component_id").unionByName(rows.where("digest IS NULL").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")

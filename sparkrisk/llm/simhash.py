"""SimHash near duplicates through vantage-point trees (operator 7).

Fingerprints link at a few differing bits; documents linked directly or through others form a component.

A vantage-point tree over whole 64-bit fingerprints hardly prunes: distances between unrelated fingerprints
crowd around 32, so a triangle bound of 4 cuts almost nothing. Distances are therefore taken on ``PARTS``
bit ranges of the fingerprint. Two fingerprints within ``max_bits`` differ by at most max_bits // PARTS bits
in some range, so one tree per range, with that radius, meets every pair. At a node (vantage value v, bound
mu) a fingerprint with distance d to v goes inside if d <= mu + radius and outside if d > mu: both of a
linked pair reach a common leaf, and only the shell (mu, mu + radius] is held twice. In the leaves the exact
64-bit distance decides.

Copies with equal fingerprints are one node. A leaf is searched from point to point over what is not yet
reached, which emits a link per member at most and never all pairs; an oversized leaf is cut into chunks, and
each pair of chunks is its own task. Components of the links are joined by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, chunks

#: Bit ranges of a fingerprint that have a tree each.
PARTS = 3
#: Fingerprints (a bounded sample, by hash order) from which the driver builds the trees; the trees only deal
#: the work out, every fingerprint passes through them.
TREE_SAMPLE = 32_768
#: Members that a leaf is meant to have, and members from which a leaf is searched in chunk pairs.
LEAF, CHUNK = 3_000, 12_000
#: Nodes a tree may have (its size is broadcast), and rounds in which the stars must settle.
MAX_NODES, MAX_ROUNDS = 200_000, 60
#: Links of a node beyond which it is a hub: hubs (at most links / HUB of them) are joined by broadcast.
HUB = 20_000


# --- fingerprints ------------------------------------------------------------------------------------------

def simhash(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of ``hashes`` (uint64, repeats count)."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def shingle_hashes(text: bytes, words_each: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words_each`` lower-cased words, space-joined; a shorter text is one shingle."""
    words = text.lower().split()  # on bytes: A-Z only, and words are split at \x20 and \x09-\x0d
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return np.array([digest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - words_each + 1].tolist()
    stops = ends[words_each - 1:].tolist()
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64, len(starts))


def fingerprint(text: Column, words_each: int = 4, seed: int = 42) -> Column:
    """The fingerprint of a text as a bigint (the 64 bits as a signed number); no words: zero."""

    @F.arrow_udf("bigint")
    def of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            out = [simhash(shingle_hashes(t or b"", words_each, seed))
                   for part in chunks(texts) for t in part.cast(pa.binary()).to_pylist()]
            yield pa.array(np.array(out, np.uint64).view(np.int64))

    return of(text)


def fingerprint_hex(bits: Column) -> Column:
    """16 lower-case hex digits of a bigint fingerprint."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


# --- vantage-point trees -----------------------------------------------------------------------------------

def bit_ranges(parts: int = PARTS) -> list[tuple[int, int]]:
    """(shift, mask) of each range: 64 bits dealt out as evenly as possible."""
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


class VantageTree:
    """Binary vantage-point tree over the values of one bit range, as flat arrays.

    ``inner[i]``/``outer[i]`` are a node's children; a negative entry -k-1 is leaf k. Built from a sample that
    stands for ``total`` values; a node is split until about ``leaf`` values are left or no split pays.
    """

    def __init__(self, sample: np.ndarray, total: int, radius: int, leaf: int = LEAF, seed: int = 7):
        self.radius = radius
        self.vantage: list[int] = []
        self.bound: list[int] = []
        self.inner: list[int] = []
        self.outer: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        scale = total / max(1, len(sample))
        stack = [(sample, None)]
        while stack:
            values, parent = stack.pop()
            split = None
            if len(values) * scale > leaf and len(values) > 4 and len(self.vantage) < MAX_NODES:
                split = self._split(values, rng)
            if split is None:
                code = -self.leaves - 1
                self.leaves += 1
            else:
                v, mu, d = split
                code = len(self.vantage)
                self.vantage.append(int(v))
                self.bound.append(int(mu))
                self.inner.append(0)
                self.outer.append(0)
                stack.append((values[d <= mu + radius], (code, self.inner)))
                stack.append((values[d > mu], (code, self.outer)))
            if parent is None:
                self.root = code
            else:
                parent[1][parent[0]] = code

    def _split(self, values: np.ndarray, rng) -> tuple[int, int, np.ndarray] | None:
        """The vantage value and bound with the least expected pairs among some candidates; None if none helps."""
        best = None
        for v in rng.choice(values, min(6, len(values)), replace=False):
            d = np.bitwise_count(values ^ v)
            for mu in {int(q) for q in np.quantile(d, (0.35, 0.5, 0.65))}:
                a = np.count_nonzero(d <= mu + self.radius) / len(values)
                b = np.count_nonzero(d > mu) / len(values)
                cost = a * a + b * b
                if cost < 0.9 and (best is None or cost < best[0]):
                    best = cost, v, mu, d
        return best and best[1:]

    def leaves_of(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``values``, leaf) of every leaf that each value reaches."""
        index: list[np.ndarray] = []
        leaf: list[np.ndarray] = []
        stack = [(self.root, np.arange(len(values)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                index.append(at)
                leaf.append(np.full(len(at), -node - 1))
                continue
            d = np.bitwise_count(values[at] ^ np.uint64(self.vantage[node]))
            stack.append((self.inner[node], at[d <= self.bound[node] + self.radius]))
            stack.append((self.outer[node], at[d > self.bound[node]]))
        if not index:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(index), np.concatenate(leaf)


def reach(values: np.ndarray, max_bits: int) -> np.ndarray:
    """For each value the smallest-index value of its component under links of at most ``max_bits`` bits.

    Goes from point to point and compares each only with those not reached yet, so a dense group shrinks
    at once and memory stays linear in the leaf.
    """
    first = np.arange(len(values))
    left = np.arange(len(values))
    while len(left):
        start, left = left[0], left[1:]
        front = [start]
        while front and len(left):
            near = np.bitwise_count(values[left] ^ values[front.pop()]) <= max_bits
            if near.any():
                found = left[near]
                first[found] = start
                front.extend(found.tolist())
                left = left[~near]
    return first


def links(prints: DataFrame, max_bits: int, steps: Steps) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) whose closure is all pairs within ``max_bits``."""
    spark = prints.sparkSession
    total = prints.count()
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()], np.int64)
    radius = max_bits // PARTS
    ranges = bit_ranges()
    trees = spark.sparkContext.broadcast([
        VantageTree((sample.view(np.uint64) >> np.uint64(s)) & np.uint64(m), total, radius) for s, m in ranges])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for part, (shift, mask) in enumerate(ranges):
                index, leaf = trees.value[part].leaves_of((fp.view(np.uint64) >> np.uint64(shift)) & np.uint64(mask))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(leaf), part, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(fp[index])],
                    ["part", "leaf", "fp"])

    dealt = prints.select("fp").mapInArrow(deal, "part int, leaf int, fp bigint")
    sizes = dealt.groupBy("part", "leaf").count()  # one row a leaf, and leaves are bounded by the tree
    large = {(r[0], r[1]): -(-r[2] // CHUNK) for r in sizes.where(F.col("count") > CHUNK).collect()}
    cut = F.lit(1)
    for (part, leaf), n in large.items():
        cut = F.when((F.col("part") == part) & (F.col("leaf") == leaf), n).otherwise(cut)
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = (dealt.withColumn("n", cut).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .select("part", "leaf", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp"))

    def search(table: pa.Table) -> pa.Table:
        fp = np.unique(table.column("fp").to_numpy())
        first = reach(fp.view(np.uint64), max_bits)
        linked = first != np.arange(len(fp))
        return pa.table({"a": fp[linked], "b": fp[first[linked]]})

    found = dealt.groupBy("part", "leaf", "lo", "hi").applyInArrow(search, "a bigint, b bigint")
    return steps.keep(found.distinct())


# --- components --------------------------------------------------------------------------------------------

def _with_lowest(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` (a, b) with the lowest neighbour m of their a. ``low``: (a, m, n links).

    A hub may hold a third of all links: hubs are few, so their minima are broadcast to the links instead of
    all of a hub's links going to one task; only the links of other nodes are shuffled.
    """
    if not (low.agg(F.max("n")).first()[0] or 0) > HUB:
        return edges.join(low.select("a", "m"), "a")
    hubs = F.broadcast(low.where(F.col("n") > HUB).select(F.col("a").alias("hub"), F.col("m").alias("hub_m")))
    told = edges.join(hubs, edges["a"] == hubs["hub"], "left")
    rest = told.where("hub IS NULL").select("a", "b").join(low.where(F.col("n") <= HUB).select("a", "m"), "a")
    return told.where("hub IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")).unionByName(rest.select("a", "b", "m"))


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node of its component.

    Alternating stars: each node hands its larger neighbours to its smallest one (large star), then its
    smaller neighbours too (small star), until nothing changes; the number of links never grows. Minima are
    summed up in each task before they move, and the links of a hub stay where they are (see _with_lowest).
    Nodes may be of any type that has an order.
    """
    now = steps.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, old = None, steps.last
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = (_with_lowest(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = steps.keep(large)
        large_path = steps.last
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        star = (_with_lowest(large, low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = steps.keep(star)
        steps.drop(large_path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        steps.drop(old)
        old = f"{steps.root}/{steps.made - 1}"
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4,
                    max_bits: int = 4, seed: int = 42) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    NULL and empty texts have fingerprint zero and link like any other. A NULL id stays NULL in its row and
    never names a component unless all its members are NULL. Repeated rows come back as often as they went in.
    Other columns are not read, so they cannot clash. An empty table gives an empty result.
    """
    steps = Steps(docs.sparkSession, "simhash")
    rows = steps.keep(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words_each, seed).alias("fp")))
    prints = steps.keep(rows.groupBy("fp").agg(F.min("id").alias("least")))
    # A node is ordered by its smallest id, NULL last, so that a component's root bears its name.
    node = F.struct(F.col("least").isNull().alias("unnamed"), F.col("least").alias("least"), F.col("fp").alias("fp"))
    nodes = prints.select("fp", node.alias("node"))
    found = links(prints, max_bits, steps)
    edges = (found.join(nodes.withColumnRenamed("node", "x"), F.col("a") == F.col("fp")).drop("fp")
             .join(nodes.withColumnRenamed("node", "y"), F.col("b") == F.col("fp"))
             .select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = components(edges, steps).select(F.col("node.fp").alias("fp"), F.col("root.least").alias("name"), F.lit(True).alias("linked"))
    # Written, so that both sides of the last join are plain shuffles: Spark then splits the partition of a
    # fingerprint that many copies share.
    named = steps.keep(prints.join(roots, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("name")).otherwise(F.col("least")).alias("component_id")))
    return (rows.join(named, "fp")
            .select(F.col("id").alias(id_col), fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4,
             max_bits: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with one row per component: the one with the smallest id (of rows equal in id, one stays).

    All columns are kept. The rows to keep are told by a key made before the search (id and a row number made
    once and written), so repeated rows cannot both stay.
    """
    steps = Steps(docs.sparkSession, "dedup")
    cols = docs.columns
    tag = "_row"
    while tag in {c.lower() for c in cols}:
        tag += "_"
    rows = steps.keep(docs.withColumn(tag, F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col(tag).alias("r")).alias("k"), text_col),
                            "k", text_col, words_each, max_bits, seed)
    keep = found.where("k = component_id").select(F.col("k.r").alias(tag))
    return rows.join(keep, tag, "left_semi").select(*[F.col(f"`{c}`") for c in cols])

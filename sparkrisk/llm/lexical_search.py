"""Ranked lexical search over interval bounds (operator 11).

Documents are cut into shards of bounded text, each with an inverted index of its own: for every term the
documents that hold it and how often. Nothing is shuffled to build it. For a block of queries, a task searches its
shards one after another:

* An impact is what a term adds to a document's score. Each posting list gets a range-maximum sparse table over its
  impacts (the tables of a shard lie end to end: list bounds are never crossed).
* An interval of documents is bounded by the sum of its lists' range maxima. Intervals are taken best first, a batch
  at a time for all queries together; each is split at the document of the largest single impact in it, whose
  exact score enters the query's top list, and the two rests come back with bounds of their own.
* An interval whose bound cannot beat the query's last place (score, then smallest id) is dropped. The top lists
  carry over from shard to shard of a task, so later shards start with a high bar.

Documents of a shard lie in an order that puts like beside like (see ``arrange``), which makes range maxima tight;
it decides nothing but the work. Each task sends at most ``k`` rows a query; a window ranks those.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, utf8

#: Documents ranked a query.
TOP = 10
#: Bytes of text in a shard (a longer single text is a shard of its own).
SHARD_BYTES = 8 << 20
#: Characters and number of queries that are sent to the tasks at once.
QUERY_CHARS, QUERIES = 1_000_000, 2_000
#: Queries searched together in a shard, and intervals of each that are split at a time.
TOGETHER, BATCH = 64, 16

#: Fixed values of the contract: bytes that separate terms become a space, A-Z lower case.
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
               for c in range(256))

_ARRAYS = "n_docs bigint, n_terms bigint, sizes binary, terms binary, starts binary, docs binary, counts binary"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of digits, letters and characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_LOWER).split()


class Numbers(dict):
    """Numbers terms by first occurrence."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Places(dict):
    """Numbers of known terms; -1 for others."""

    def __missing__(self, term: bytes) -> int:
        return -1


# --- index -------------------------------------------------------------------------------------------------

def arrange(codes: list[np.ndarray]) -> np.ndarray:
    """An order of documents that puts like beside like: by their most frequent term, then by size."""
    most = [int(np.bincount(c).argmax()) if len(c) else -1 for c in codes]
    return np.lexsort(([len(c) for c in codes], most)) if codes else np.zeros(0, np.int64)


def shard_of(texts: list[bytes]) -> tuple[dict, np.ndarray]:
    """The index of some texts (arrays as bytes), and the order in which it numbers them."""
    known = Numbers()
    codes = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in map(terms_of, texts)]
    order = arrange(codes)
    codes = [codes[i] for i in order]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    d = max(1, len(codes))
    keys = np.concatenate(codes + [np.zeros(0, np.int64)]) * d + np.repeat(np.arange(len(codes)), sizes)
    keys, counts = np.unique(keys, return_counts=True)
    term = keys // d
    row = {"n_docs": int((sizes > 0).sum()), "n_terms": int(sizes.sum()), "sizes": sizes.astype(np.int64).tobytes(),
           "terms": b" ".join(known), "starts": np.searchsorted(term, np.arange(len(known) + 1)).astype(np.int64).tobytes(),
           "docs": (keys % d).astype(np.int32).tobytes(), "counts": counts.astype(np.int32).tobytes()}
    return row, order


# --- search ------------------------------------------------------------------------------------------------

class RangeMax:
    """Sparse table: place of the (first) largest value of any range."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.rows = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= longest:
            last = self.rows[-1]
            a, b = last[:len(last) - width], last[width:]
            self.rows.append(np.where(values[b] > values[a], b, a))
            width *= 2
        size = max(len(r) for r in self.rows)
        self.table = np.zeros((len(self.rows), size), np.int32)
        for i, r in enumerate(self.rows):
            self.table[i, :len(r)] = r
        del self.rows

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the largest value in [start, end), which must not be empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        a = self.table[level, start]
        b = self.table[level, end - (1 << level)]
        return np.where(self.values[b] > self.values[a], b, a)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each (start, size), one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Shard:
    """A shard's lists of the terms of a query block, with impacts and range maxima."""

    def __init__(self, row: dict, ids: pa.Array, places: Places, weights: np.ndarray, n_docs: int, n_terms: int):
        sizes = np.frombuffer(row["sizes"], np.int64)
        starts = np.frombuffer(row["starts"], np.int64)
        docs, counts = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["counts"], np.int32)
        self.d = len(sizes)
        block = np.fromiter(map(places.__getitem__, row["terms"].split()), np.int64, len(starts) - 1)
        mine = np.flatnonzero(block >= 0)
        mine = mine[weights[block[mine]] > 0]
        lens = (starts[1:] - starts[:-1])[mine]
        at = _ragged(starts[mine], lens)
        doc, tf = docs[at].astype(np.int64), counts[at].astype(np.int64)
        m = 10 + norm(sizes, n_docs, n_terms)
        self.impact = np.repeat(weights[block[mine]], lens) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        self.doc = doc
        self.keys = np.repeat(np.arange(len(mine)), lens) * self.d + doc
        self.list_of = np.full(len(weights), -1)
        self.list_of[block[mine]] = np.arange(len(mine))
        self.bounds = np.concatenate([[0], np.cumsum(lens)])
        self.best = RangeMax(self.impact, int(lens.max())) if len(lens) else None
        order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end").to_numpy()
        self.ids, self.sorted = ids, [v for v in ids.take(pa.array(order)).to_pylist() if v is not None]
        self.rank = np.empty(self.d, np.int64)
        self.rank[order] = np.arange(self.d)
        self.first = RangeMax(-self.rank, self.d) if self.d else None


def norm(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(90 * n * N) div L, exactly."""
    if not n_terms:
        return np.zeros(len(sizes), np.int64)
    if not len(sizes) or 90 * int(sizes.max()) * n_docs < 1 << 62:
        return (90 * n_docs * sizes) // n_terms
    return np.array([90 * int(n) * n_docs // n_terms for n in sizes], np.int64)


class Pool:
    """Open intervals: query, first and end document, bound, place of the largest impact, and segments of lists."""

    NAMES = ("query", "lo", "hi", "bound", "top", "at", "size")

    def __init__(self):
        self.cols = {n: np.zeros(0, np.int64) for n in self.NAMES}
        self.segments = np.zeros((3, 0), np.int64)

    def take(self, some: np.ndarray) -> tuple[dict, np.ndarray]:
        """The chosen intervals and their segments, which leave the pool."""
        out = {n: c[some] for n, c in self.cols.items()}
        return out, self.segments[:, _ragged(out["at"], out["size"])]

    def keep(self, some: np.ndarray) -> None:
        self.cols = {n: c[some] for n, c in self.cols.items()}
        used = int(self.cols["size"].sum())
        if 2 * used < self.segments.shape[1]:
            self.segments = self.segments[:, _ragged(self.cols["at"], self.cols["size"])]
            self.cols["at"] = np.cumsum(self.cols["size"]) - self.cols["size"]

    def add(self, shard: Shard, query, lo, hi, size, segments) -> None:
        """Adds intervals with their segments (list, start, end), none empty."""
        if not len(query):
            return
        best = shard.best.of(segments[1], segments[2])
        value = shard.impact[best]
        at = np.cumsum(size) - size
        bound = np.add.reduceat(value, at)
        most = np.repeat(np.maximum.reduceat(value, at), size)
        where = np.flatnonzero(value == most)
        first = where[np.searchsorted(where, at)]
        new = {"query": query, "lo": lo, "hi": hi, "bound": bound, "top": best[first].astype(np.int64),
               "at": at + self.segments.shape[1], "size": size}
        self.cols = {n: np.concatenate([self.cols[n], new[n]]) for n in self.NAMES}
        self.segments = np.concatenate([self.segments, segments], axis=1)


def search(shard: Shard, lists: list[np.ndarray], tops: list[list[tuple[int, object]]], k: int) -> int:
    """Brings the top lists (score, id) of some queries up to date with a shard; ``lists`` are the block terms of each.

    Returns the number of documents whose score was worked out, over all queries.
    """
    q, scored = len(lists), 0
    if not shard.d or shard.best is None:
        return scored
    # Places in the order (score, id): twice the rank among this shard's ids, plus one for its own documents.
    score = np.full((q, k), 0, np.int64)
    place = np.full((q, k), -1, np.int64)
    who = np.full((q, k), -1, np.int64)  # own document, or -1 - place in the list as it was
    for i, top in enumerate(tops):
        for j, (s, v) in enumerate(top):
            score[i, j], who[i, j] = s, -1 - j
            place[i, j] = 2 * (len(shard.sorted) if v is None else bisect_left(shard.sorted, v))
    pool = Pool()
    mine = [shard.list_of[t] for t in lists]
    mine = [m[m >= 0] for m in mine]
    size = np.array([len(m) for m in mine])
    some = np.flatnonzero(size)
    if not len(some):
        return scored
    segs = np.concatenate(mine)
    pool.add(shard, some, np.zeros(len(some), np.int64), np.full(len(some), shard.d), size[some],
             np.array([segs, shard.bounds[segs], shard.bounds[segs + 1]]))
    while len(pool.cols["query"]):
        c = pool.cols
        bar, last = score[c["query"], k - 1], place[c["query"], k - 1]
        first = 2 * shard.rank[shard.first.of(c["lo"], c["hi"])] + 1
        open_ = (c["bound"] > bar) | ((c["bound"] == bar) & (bar > 0) & (first < last))
        pool.keep(open_)
        c = pool.cols
        n = len(c["query"])
        if not n:
            break
        order = np.lexsort((-c["bound"], c["query"]))
        query = c["query"][order]
        new = np.concatenate([[True], query[1:] != query[:-1]])
        nth = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        chosen = np.zeros(n, bool)
        chosen[order[nth < BATCH]] = True
        now, segments = pool.take(chosen)
        pool.keep(~chosen)
        scored += len(now["query"])
        # split at the document of the largest impact
        at_doc = shard.doc[now["top"]]
        per = np.repeat(np.arange(len(at_doc)), now["size"])
        key = segments[0] * shard.d + at_doc[per]
        cut = segments[1] + _cut(shard.keys, key, segments)
        hit = (cut < segments[2]) & (shard.keys[np.minimum(cut, len(shard.keys) - 1)] == key)
        points = np.zeros(len(at_doc), np.int64)
        np.add.at(points, per[hit], shard.impact[cut[hit]])
        # top lists
        rows = now["query"]
        touched = np.unique(rows)
        local = np.searchsorted(touched, rows)
        all_q = np.concatenate([np.repeat(np.arange(len(touched)), k), local])
        all_s = np.concatenate([score[touched].ravel(), points])
        all_p = np.concatenate([place[touched].ravel(), 2 * shard.rank[at_doc] + 1])
        all_w = np.concatenate([who[touched].ravel(), at_doc])
        order = np.lexsort((all_p, -all_s, all_q))
        starts = np.searchsorted(all_q[order], np.arange(len(touched)))
        pick = order[(starts[:, None] + np.arange(k)).ravel()]
        score[touched], place[touched], who[touched] = (x[pick].reshape(-1, k) for x in (all_s, all_p, all_w))
        # rests
        for lo, hi, a, b in ((now["lo"], at_doc, segments[1], cut), (at_doc + 1, now["hi"], cut + hit, segments[2])):
            alive = a < b
            size = np.bincount(per[alive], minlength=len(at_doc))
            some = size > 0
            pool.add(shard, rows[some], lo[some], hi[some], size[some],
                     np.array([segments[0][alive], a[alive], b[alive]]))
    for i, top in enumerate(tops):
        top[:] = [top[-1 - w] if w < 0 else (int(s), shard.ids[int(w)].as_py()) for s, w in zip(score[i], who[i].tolist()) if s > 0]
    return scored


def _cut(keys: np.ndarray, key: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Offset in each segment of the first key not below ``key``."""
    return np.clip(np.searchsorted(keys, key), segments[1], segments[2]) - segments[1]


# --- Spark -------------------------------------------------------------------------------------------------

def build_index(docs: DataFrame, steps: Steps, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``, written: one row a shard, self-contained, of a size bounded by SHARD_BYTES of text."""
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, id_type = [], [], 0, None

        def shard() -> pa.RecordBatch:
            row, order = shard_of(texts)
            own = pa.concat_arrays(ids).take(pa.array(order))
            cols = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
            names = [c.split()[0] for c in _ARRAYS.split(", ")]
            cols += [pa.array([row[n]], pa.int64() if isinstance(row[n], int) else pa.binary()) for n in names]
            return pa.RecordBatch.from_arrays(cols, ["ids", *names])

        for batch in batches:
            _, off = utf8(batch.column(1))
            data = batch.column(1).cast(pa.binary())
            at = 0
            while at < len(data):
                end = int(np.searchsorted(off, off[at] + SHARD_BYTES - size, side="right")) - 1
                end = min(max(end, at + (not texts)), len(data))
                ids.append(batch.column(0).slice(at, end - at))
                texts += [t or b"" for t in data.slice(at, end - at).to_pylist()]
                size += int(off[end] - off[at])
                if end < len(data):
                    yield shard()
                    ids, texts, size = [], [], 0
                at = end
        if texts:
            yield shard()

    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(index, f"ids array<{kind}>, {_ARRAYS}")
    return steps.keep(rows)


def _blocks(queries: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Queries (id, terms) in blocks of bounded size; the driver holds one at a time."""
    block, size = [], 0
    for item, text in queries.select(F.col(item_col), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and (size + len(text) > QUERY_CHARS or len(block) >= QUERIES):
            yield block
            block, size = [], 0
        block.append((item, sorted(set(terms_of(text.encode())))))
        size += len(text)
    if block:
        yield block


def _found_in(index: DataFrame, places: Places) -> np.ndarray:
    """Documents that hold each term of a block, over all shards."""
    shared = index.sparkSession.sparkContext.broadcast(pickle.dumps(dict(places)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(pickle.loads(shared.value))
        total = np.zeros(len(places), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.fromiter(map(places.__getitem__, terms.split()), np.int64)
                total[at[at >= 0]] += np.diff(np.frombuffer(starts, np.int64))[at >= 0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    df = np.zeros(len(places), np.int64)
    rows = index.select("terms", "starts").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # a row a term of the block at most
        df[r["term"]] = r["n"]
    shared.unpersist()
    return df


def _search_block(index: DataFrame, block: list[tuple], first: int, n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    """(query, doc_id, score): the top lists of every task for a block of queries, numbered from ``first``."""
    places = Places()
    for _, terms in block:
        for t in terms:
            if t not in places:
                places[t] = len(places)
    df = _found_in(index, places)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)
    lists = [np.array([places[t] for t in terms], np.int64) for _, terms in block]
    shared = index.sparkSession.sparkContext.broadcast(pickle.dumps((dict(places), weights, lists)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, lists = pickle.loads(shared.value)
        places, tops, id_type = Places(known), [[] for _ in lists], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("sizes", "terms", "starts", "docs", "counts")}
                ids = batch.column("ids")[i].values
                id_type = ids.type
                shard = Shard(row, ids, places, weights, n_docs, n_terms)
                for g in range(0, len(lists), TOGETHER):
                    search(shard, lists[g:g + TOGETHER], tops[g:g + TOGETHER], k)
        flat = [(first + q, v, s) for q, top in enumerate(tops) for s, v in top]
        if flat:
            query, doc, score = zip(*flat)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, id_type), pa.array(score, pa.int64())],
                                             ["query", "doc", "score"])

    rows = index.select("ids", "sizes", "terms", "starts", "docs", "counts")
    return rows.mapInArrow(find, f"query bigint, doc {kind}, score bigint")


def search_index(index: DataFrame, queries: DataFrame, steps: Steps, item_col: str = "item_id", item_text: str = "text",
                 k: int = TOP) -> DataFrame:
    """(query, item, rank, doc, score) for every query row: see :func:`ranked`."""
    spark = index.sparkSession
    totals = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    kind = dict(index.dtypes)["ids"][len("array<"):-1]
    item_kind = dict(queries.select(F.col(item_col)).dtypes)[item_col]
    parts, first = [], 0
    for block in _blocks(queries, item_col, item_text) if totals["n"] else ():
        found = _search_block(index, block, first, int(totals["n"]), int(totals["l"]), k, kind)
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(first + i, item) for i, (item, _) in enumerate(block)], f"query bigint, item {item_kind}")
        parts.append(steps.keep(found.join(F.broadcast(names), "query").select("query", "item", "rank", "doc", "score")))
        first += len(block)
    empty = spark.createDataFrame([], f"query bigint, item {item_kind}, rank int, doc {kind}, score bigint")
    return reduce(DataFrame.unionByName, parts) if parts else empty


def ranked(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", k: int = TOP) -> DataFrame:
    """(item id, rank, doc id, score): the ``k`` best documents of every query row, equal scores by ascending id.

    Only scores above 0 are listed. NULL, empty and separator-only texts hold no term: as documents they count
    nowhere, as queries they get no rows. Every query row has a list of its own, also where its id is NULL or
    repeated; repeated documents are ranked each, NULL ids after all others of equal score. Only the named columns are
    read, so others cannot clash. Either table empty: no rows.
    """
    steps = Steps(docs.sparkSession, "lexical")
    out = search_index(build_index(docs, steps, id_col, text_col), queries, steps, item_col, item_text, k)
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")

"""Benchmark decontamination by SimHash of item-sized windows (operator 9).

Texts and items are sequences of lower-cased words (runs of letters, digits and underscores). For an item of
L words, windows of L words of a document are fingerprinted over their five-word shingles. The items'
fingerprints sit in a multi-index: ``BLOCKS`` bit blocks, each within RADIUS // BLOCKS bits of the window's
block for at least one block if the whole is within RADIUS, so no fingerprint in the radius is missed.
Candidates are verified by exact weighted similarity: the multiset Jaccard of the shingles themselves, each
counted as often as it occurs.

A similarity of SIMILARITY needs a least number of shared shingles, in whatever order, and a window shares at
most as many as it has places whose shingle the item has. Windows with fewer such places than that are left
out before the fingerprint, and no others. This changes no result and makes the work follow the text's length,
not the number of item sizes.

The benchmark is the stated query set. Its index goes to the tasks in blocks of items of bounded bytes, so a
large benchmark costs more passes, not more memory.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .simhash import simhash

#: Production parameters: words a shingle, least similarity, and fingerprint bits that may differ. Windows at
#: similarity 0.8 differ by 10 of 64 bits on average with a deviation of 3, so 24 bits lie over four
#: deviations out, while unrelated windows differ by 32.
WORDS_EACH, SIMILARITY, RADIUS = 5, 0.8, 24
#: Bit blocks of the multi-index.
BLOCKS = 8
#: Characters of items whose index is sent to the tasks at once, and items read back by the driver a time.
INDEX_CHARS = 8_000_000

_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xFF51AFD7ED558CCD], np.uint64)

MATCH = "array<struct<item_id:bigint,similarity:double,hamming:int,first_word:int,n_words:int>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_codes(words: list[str]) -> np.ndarray:
    """64-bit code of each word, by this process's string hash: codes never leave the process."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def shingle_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Code of each run of ``n`` words (wrap-around sums of odd multiples, then mixed)."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        out += codes[k:k + len(out)] * _MIX[k % len(_MIX)] * np.uint64(2 * (k // len(_MIX)) + 1)
    out ^= out >> np.uint64(29)
    out *= _MIX[1]
    out ^= out >> np.uint64(32)
    return out


def shingles(words: list[str], n: int) -> Counter:
    """The shingles themselves with their counts (fewer than ``n`` words: the whole sequence)."""
    if len(words) <= n:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(n))))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def near_values(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` ones."""
    return [m for m in range(1 << bits) if m.bit_count() <= radius]


class Index:
    """Items (id, text), their fingerprints in a multi-index, and where their shingles lead."""

    def __init__(self, items: list[tuple[int | None, str]], words_each: int, similarity: float, radius: int):
        self.n, self.similarity, self.radius = words_each, similarity, radius
        self.items = []
        prints, by_code = [], {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            n = min(self.n, len(words))
            codes = shingle_codes(word_codes(words), n)
            at = len(self.items)
            self.items.append((item_id, len(words), shingles(words, self.n)))
            prints.append(simhash(codes))
            for code in set(codes.tolist()):
                by_code.setdefault((n, code), []).append(at)
        self.prints = np.array(prints, np.uint64)
        self.by_code = by_code
        self.sizes = sorted({n for n, _ in by_code})
        self.gate = {}
        for n in self.sizes:  # one bit per hashed code: most shingles are told from the benchmark's at once
            gate = np.zeros(1 << 20, bool)
            gate[np.array([c for m, c in by_code if m == n], np.uint64) >> np.uint64(44)] = True
            self.gate[n] = gate
        self.blocks = []
        width = 64 // BLOCKS
        masks = near_values(width, radius // BLOCKS)
        for b in range(BLOCKS):
            table: dict[int, list[int]] = {}
            for i, p in enumerate(prints):
                value = (p >> (b * width)) & ((1 << width) - 1)
                for m in masks:
                    table.setdefault(value ^ m, []).append(i)
            self.blocks.append({k: np.array(v) for k, v in table.items()})

    def within(self, fingerprint: int) -> dict[int, int]:
        """Items whose fingerprint is within the radius, with the differing bits: block lookups, then all bits."""
        width = 64 // BLOCKS
        found = [t for b, table in enumerate(self.blocks)
                 if (t := table.get((fingerprint >> (b * width)) & ((1 << width) - 1))) is not None]
        if not found:
            return {}
        some = np.unique(np.concatenate(found))
        bits = np.bitwise_count(self.prints[some] ^ np.uint64(fingerprint))
        near = bits <= self.radius
        return dict(zip(some[near].tolist(), bits[near].tolist()))

    def starts(self, n_words: int, codes: np.ndarray, at: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """For each number of words, the window starts at which a similar item could stand.

        Multiset Jaccard s of sets of a and b shingles needs s * (a + b) / (1 + s) shared ones, wherever they
        stand. The places in a window whose shingle an item has are at least the shared ones, so every window
        with that many places is a start. ``at`` gets the shingle codes.
        """
        spans: dict[int, list[np.ndarray]] = {}
        for n in self.sizes:
            if n_words < n:
                continue
            at[n] = shingle_codes(codes, n)
            touched: dict[int, list[int]] = {}
            for place in np.flatnonzero(self.gate[n][at[n] >> np.uint64(44)]).tolist():
                for item in self.by_code.get((n, int(at[n][place])), ()):
                    touched.setdefault(item, []).append(place)
            for item, places in touched.items():
                size = self.items[item][1]
                width = min(size, n_words) - n + 1  # shingles of a window; the item has size - n + 1
                need = self.similarity * (width + size - n + 1) / (1 + self.similarity)
                least = max(1, math.ceil(need - 1e-9 * need))
                if len(places) < least:
                    continue
                where = np.array(places)
                low = np.maximum(where[least - 1:] - width + 1, 0)
                high = np.minimum(where[:len(where) - least + 1], max(0, n_words - size))
                some = low <= high
                if some.any():
                    spans.setdefault(size, []).append(np.array([low[some], high[some]]))
        out = {}
        for size, ranges in spans.items():
            edge = np.zeros(n_words + 2, np.int64)
            low, high = np.hstack(ranges)
            np.add.at(edge, low, 1)
            np.add.at(edge, high + 1, -1)
            out[size] = np.flatnonzero(np.cumsum(edge) > 0)
        return out

    def matches(self, text: str) -> list[tuple[int | None, float, int, int, int]]:
        """(item id, similarity, differing bits, first word, words) of each item found: its best window."""
        words = words_of(text)
        if not words:
            return []
        codes = word_codes(words)
        at: dict[int, np.ndarray] = {}
        best: dict[int, tuple] = {}
        for size, starts in self.starts(len(words), codes, at).items():
            n = min(self.n, size)
            for start in starts.tolist():
                window = at[n][start:start + size - n + 1]
                near = self.within(simhash(window))
                near = {i: bits for i, bits in near.items() if self.items[i][1] == size}
                if not near:
                    continue
                own = shingles(words[start:start + size], self.n)
                for i, bits in near.items():
                    s = weighted_jaccard(own, self.items[i][2])
                    if s >= self.similarity and (i not in best or s > best[i][0]):
                        best[i] = s, bits, start, min(size, len(words) - start)
        return sorted(((self.items[i][0], *b) for i, b in best.items()),
                      key=lambda m: (m[0] is None, m[0] or 0, *m[1:]))


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """Blocks of items of bounded characters; the driver holds one at a time."""
    block, size = [], 0
    for item_id, text in (benchmark.select(F.col(item_col).cast("bigint"), F.col(text_col))
                          .where(F.col(text_col).isNotNull()).toLocalIterator()):
        if block and size + len(text) > INDEX_CHARS:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


_INDEXES: dict[int, Index] = {}


def _index(shared) -> Index:
    """This Python worker's index of a broadcast block of items; the last one is kept."""
    key = hash(shared.value)
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(*pickle.loads(shared.value))
    return _INDEXES[key]


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str,
           words_each: int, similarity: float, radius: int) -> list:
    """A column of matches per block of items."""
    columns = []
    sc = docs.sparkSession.sparkContext
    for block in _item_blocks(benchmark, item_col, item_text):
        shared = sc.broadcast(pickle.dumps((block, words_each, similarity, radius)))

        columns.append(_matcher(shared)(F.col(text_col)))
    return columns


def _matcher(shared):
    """Arrow function from texts to their matches in a broadcast block of items."""

    @F.arrow_udf(MATCH)
    def match(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("item_id", "similarity", "hamming", "first_word", "n_words")
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()),
                                   ("hamming", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
        index = _index(shared)
        for texts in it:
            yield pa.array([[dict(zip(names, m)) for m in index.matches(t or "")]
                            for part in chunks(texts) for t in part.to_pylist()], kind)

    return match


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", words_each: int = WORDS_EACH,
                 similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per input row and benchmark item found in it: id, item_id, similarity, hamming, first_word, n_words.

    The best window of each item counts; of equals the first. NULL and empty texts and items match nothing;
    an item under five words is one shingle; items with a NULL id are reported with it; repeated rows and items
    are reported each. Only the named columns are read, so others cannot clash. Either table empty: no rows.
    """
    found = _found(docs, benchmark, text_col, item_col, item_text, words_each, similarity, radius)
    if not found:
        found = [F.array().cast(MATCH)]
    parts = [docs.select(F.col(id_col), F.explode(c).alias("m")) for c in found]
    return reduce(DataFrame.unionByName, parts).select(F.col(id_col), "m.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns."""
    given = {"item_col": "item_id", "item_text": "text", "words_each": WORDS_EACH, "similarity": SIMILARITY,
             "radius": RADIUS} | params
    for column in _found(docs, benchmark, text_col, **given):
        docs = docs.where(F.size(column) == 0)
    return docs

"""Byte-level BPE encoding and decoding by backtracking over an Aho-Corasick automaton (operator 3).

Bytes are mapped to Latin-1 characters so that pyahocorasick, which works on str, sees one character a
byte. For every start the automaton gives the longest vocabulary token; the encoder takes it, steps back to
the next shorter prefix token where two neighbours could not stand side by side in a merge result, and marks
dead positions, so each position is left at most once and the work is linear in the piece. Whether two
tokens are compatible is decided by unmerging them along the merge table, and memoised.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks

#: Entries of a generation of the memos of encoded words and of pieces (two generations are held while a task
#: runs, so that common entries outlive a change), and entries after which the memo of token pairs starts anew.
MEMO_WORDS, MEMO_PIECES, MEMO_PAIRS = 150_000, 75_000, 300_000
#: Longer words and pieces are encoded each time, so that the memo's bytes stay bounded.
MEMO_CHARS = 40
#: A blank beside other white space: there a piece can cross the border between two words.
_WIDE_BLANK = re.compile(r" \s|\s ")

OUTPUT = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def load_ranks(data: bytes) -> list[bytes]:
    """Tokens by id from a rank file (base64 token, blank, rank per line). Ranks must be 0..n-1."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError("the ranks leave gaps")
    return tokens


@lru_cache(1)
def newer_characters() -> str:
    """Letters and digits to ``regex`` that the tokenizer library's older Unicode tables don't know yet.

    Found by asking both about every code point, so it holds for whichever versions are installed.
    """
    kinds = r"\p{L}|\p{N}"
    probe = tiktoken.Encoding("probe", pat_str=kinds, special_tokens={},
                              mergeable_ranks={bytes([b]): b for b in range(256)})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    known = set(bytes(probe.encode_ordinary(every)).decode("utf-8"))
    return "".join(c for c in regex.findall(kinds, every) if c not in known)


class Codec:
    """Encoder and decoder of one vocabulary; its memos are per process and bounded.

    Parameters: ``tokens`` (token bytes by id, id = merge rank), ``pattern`` (pieces are encoded apart) and
    ``newer`` (characters that count as neither letter nor digit in the pattern, see newer_characters).
    The empty text encodes to no ids. Every single byte must be in the vocabulary.
    """

    def __init__(self, tokens: list[bytes], pattern: str, newer: str = ""):
        self.tokens = tokens
        self.sizes = [len(t) for t in tokens]
        self.pattern = regex.compile(pattern)
        self.newer = re.compile(f"[{re.escape(newer)}]") if newer else None
        self.above = re.compile(f"[{min(newer)}-{chr(0x10FFFF)}]") if newer else None
        self.ids = {t: i for i, t in enumerate(tokens)}
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.text = [str(i) for i in range(len(tokens))]
        self._split: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            if len(t) == 1 or self.halves(i):
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._shorter: dict[int, int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: tuple[dict, dict] = {}, {}
        self._words: tuple[dict, dict] = {}, {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for single bytes and tokens that no merge reaches."""
        if token not in self._split:
            self._split[token] = self._merge_to_two(self.tokens[token], token)
        return self._split[token]

    def _merge_to_two(self, data: bytes, below: int) -> tuple[int, int] | None:
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.ids.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None

    def shorter(self, token: int) -> int:
        """The longest reachable token that is a proper prefix of ``token``, or -1."""
        if token not in self._shorter:
            data, found = self.tokens[token], -1
            for n in range(len(data) - 1, 0, -1):
                i = self.ids.get(data[:n], -1)
                if i >= 0 and (n == 1 or self.halves(i)):
                    found = i
                    break
            self._shorter[token] = found
        return self._shorter[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of ``left + right`` (as bytes) end in exactly these two tokens."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo merges on both sides, latest first, and see if one across the border would come before.

        ``before`` is the rank of the merge undone last (of the piece that then stood at the border): a merge
        over the border of lower rank would have been made earlier. Equal ranks are made left to right, so on
        the right side a merge over the border wins a tie.
        """
        tokens, ids = self.tokens, self.ids
        before = len(tokens)
        while True:
            across = ids.get(tokens[left] + tokens[right], len(tokens))
            if across < before:
                return False
            a, b = self._split.get(left), self._split.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, by backtracking from the longest match at each position."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        sizes, pairs = self.sizes, self._pairs
        n = len(piece)
        chars = piece.decode("latin-1")
        greedy = [token for _, token in self.automaton.iter_long(chars)]  # longest match after longest match
        good = 1
        for key in zip(greedy, greedy[1:]):
            fits = pairs.get(key)
            if not (self.compatible(*key) if fits is None else fits):
                break
            good += 1
        else:
            return greedy
        longest = [-1] * n
        for end, token in self.automaton.iter(chars):
            longest[end + 1 - sizes[token]] = token  # ends ascend, so the last one seen is the longest
        out = greedy[:good]
        alive = bytearray(b"\x01") * (n + 1)
        pos = sum([sizes[t] for t in out])
        token = longest[pos]
        while pos < n:
            end = pos + sizes[token]
            if alive[end]:
                if out:
                    key = (out[-1], token)
                    fits = pairs.get(key)
                    if fits is None:
                        fits = self.compatible(*key)
                else:
                    fits = True
                if fits:
                    out.append(token)
                    pos = end
                    if pos < n:
                        token = longest[pos]
                    continue
            token = self.shorter(token)
            while token < 0:
                alive[pos] = 0
                back = out.pop()
                pos -= sizes[back]
                token = self.shorter(back)
        return out

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches in ``text``."""
        if self.newer is None or not self.above.search(text) or not self.newer.search(text):
            return self.pattern.findall(text)
        masked = self.newer.sub("\ue000", text)  # a private-use character: no letter, digit or white space
        return [text[m.start():m.end()] for m in self.pattern.finditer(masked)]

    def forget(self) -> None:
        """Drop the memos' older generations: what a worker holds between tasks."""
        self._words = self._words[0], {}
        self._pieces = self._pieces[0], {}

    def _encode_pieces(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        if len(pieces) == 1:  # a whole word: memoised as such
            return self.encode_piece(pieces[0].encode("utf-8"))
        (memo, old), out = self._pieces, []
        for piece in pieces:
            ids = memo.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    ids = tuple(self.encode_piece(piece.encode("utf-8")))
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO_PIECES:
                        self._pieces = memo, old = {}, memo
                    memo[piece] = ids
            out += ids
        return out

    def encode(self, text: str, word_split: bool = True) -> list[int]:
        """Ids of a whole text.

        ``word_split``: the pattern lets one blank belong to what follows it and no other piece cross it, as
        this family's patterns do. Texts are then cut before every single blank, and whole words memoised; a
        text that has a blank beside other white space is given to the pattern as it is.
        """
        if not word_split or _WIDE_BLANK.search(text):
            return self._encode_pieces(text)
        first, *rest = text.split(" ")
        (memo, old), out = self._words, self._encode_pieces(first)
        for word in rest:
            ids = memo.get(word)
            if ids is None:
                ids = old.get(word)
                if ids is None:
                    ids = tuple(self._encode_pieces(" " + word))
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO_WORDS:
                        self._words = memo, old = {}, memo
                    memo[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ``ids`` stand for."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def ids_text(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        text = self.text
        return " ".join([text[i] for i in ids])


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """This Python worker's codec for a broadcast vocabulary; the last one is kept."""
    key = hash(shared.value)
    if key not in _CODECS:
        _CODECS.clear()
        ranks, pattern, newer = pickle.loads(shared.value)
        _CODECS[key] = Codec(load_ranks(ranks), pattern, newer)
    return _CODECS[key]


def _share(spark: SparkSession, ranks_path: str, pattern: str):
    """Broadcast of the rank file's bytes (a parameter, a few MB), pattern and newer characters."""
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(pickle.dumps((f.read(), pattern, newer_characters())))


def encode_ids(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """array<int> of the ids of ``text``; NULL and '' give an empty array."""
    shared = _share(spark, ranks_path, pattern)

    @F.arrow_udf("array<int>")
    def ids(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        for texts in it:
            yield pa.array([codec.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def decode_ids(spark: SparkSession, ids: Column, ranks_path: str, pattern: str) -> Column:
    """binary of an array of ids; NULL gives b''. Unknown ids raise."""
    shared = _share(spark, ranks_path, pattern)

    @F.arrow_udf("binary")
    def data(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        for rows in it:
            yield pa.array([codec.decode(r or []) for r in rows.to_pylist()], pa.binary())

    return data(ids)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256; encoded, then decoded from the ids.

    NULL and empty texts have no tokens; repeated rows are encoded each; other columns are not read, so
    names such as ``n_tokens`` in the input do not clash; an empty table gives an empty result. Row-wise:
    no shuffle, and the ids of a text are held only while it is worked on.
    """
    shared = _share(docs.sparkSession, ranks_path, pattern)

    @F.arrow_udf(OUTPUT)
    def digests(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        for texts in it:
            n, a, b = [], [], []
            for part in chunks(texts):
                gc.disable()  # the memos hold no cycles, and walking them costs a tenth of the time
                for t in part.to_pylist():
                    ids = codec.encode(t or "")
                    n.append(len(ids))
                    a.append(hashlib.sha256(codec.ids_text(ids).encode("ascii")).hexdigest())
                    b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                gc.enable()
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()

    return (docs.select(F.col(id_col), digests(F.col(text_col)).alias("_d"))
            .select(F.col(id_col), "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256"))

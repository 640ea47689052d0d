"""Byte-pair encoding and decoding with a public vocabulary.

Each pre-token is a doubly linked list of symbols; a priority queue holds (rank, left symbol) of the pairs that the
vocabulary can merge. Entries whose pair has changed since are stale and skipped when popped. Of short pre-tokens, many
are merged side by side: their lists are rows of arrays, and the least rank of a row takes the place of the queue.
Decoding concatenates the vocabulary's byte strings. No tokenizer is trained here, and the vocabulary file is only read.

Defined results: a null text gives null ids, count and decoded text; an empty text gives no ids and "". Texts of any
length are encoded whole. Repeated rows each give their own row; an empty table gives an empty one. Of a table's other
columns only ``doc_id`` is carried, so clashing names can't occur.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factlake.llm._common import lean, lists, no_clash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before merging: contractions, letters, digits, other signs, white space.
SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Bytes of pre-tokens that are merged side by side, by the width of their rows, and how many at once.
WIDTHS, SIDE_BY_SIDE = (4, 8, 12, 16, 24, 32), 8192
#: Texts without a character from here on are split by a pattern that names all letters, digits and white space below.
SIMPLE = 0x250
_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Byte string to rank (which is also the id) of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token."""
    n = len(piece)
    symbol: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = bytearray(n)
    queue = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        rank, left = heapq.heappop(queue)
        right = after[left]
        if gone[left] or right >= n or ranks.get(symbol[left] + symbol[right]) != rank:
            continue  # stale
        symbol[left] += symbol[right]
        gone[right] = 1
        after[left] = nxt = after[right]
        if nxt < n:
            before[nxt] = left
            if (r := ranks.get(symbol[left] + symbol[nxt])) is not None:
                heapq.heappush(queue, (r, left))
        if (prev := before[left]) >= 0 and (r := ranks.get(symbol[prev] + symbol[left])) is not None:
            heapq.heappush(queue, (r, prev))
    return tuple(ranks[symbol[i]] for i in range(n) if not gone[i])


class _Pairs:
    """The rank of each pair of ids that the vocabulary merges, in a table by hash."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for s, r in ranks.items():
            for k in range(1, len(s)):
                if (a := ranks.get(s[:k])) is not None and (b := ranks.get(s[k:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = max(4, int(len(key)).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        at = self._place(key)
        while len(key):  # one key a slot, the others go on to the next
            free = np.flatnonzero(self.keys[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            self.keys[slot], self.values[slot] = key[free[first]], value[free[first]]
            left = self.keys[at] != key
            key, value, at = key[left], value[left], (at[left] + 1) & (len(self.keys) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << np.int64(32) | b
        at = self._place(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], _NONE)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            found = self.keys[at[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


def merge_many(pieces: list[bytes], width: int, ranks: dict[bytes, int], pairs: _Pairs) -> list[bytes]:
    """Packed ids of each pre-token of up to ``width`` bytes: as ``merge`` gives them."""
    n = len(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    one = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    symbol, there = one[raw], np.arange(width) < size[:, None]
    rank = np.full((n, width), _NONE, np.int32)
    row, col = np.nonzero(there[:, 1:])
    rank[row, col] = pairs.rank(symbol[row, col], symbol[row, col + 1])
    after, before = np.tile(np.arange(1, width + 1), (n, 1)), np.tile(np.arange(-1, width - 1), (n, 1))
    row = np.arange(n)
    while len(row):
        left = rank[row].argmin(axis=1)
        least = rank[row, left]
        some = least < _NONE
        row, left, least = row[some], left[some], least[some]
        right = after[row, left]
        nxt = after[row, right]
        symbol[row, left], after[row, left] = least, nxt
        there[row, right], rank[row, right], rank[row, left] = False, _NONE, _NONE
        in_ = np.flatnonzero(nxt < size[row])
        r, x, y = row[in_], left[in_], nxt[in_]
        before[r, y] = x
        rank[r, x] = pairs.rank(symbol[r, x], symbol[r, y])
        prev = before[row, left]
        in_ = np.flatnonzero(prev >= 0)
        r, x, y = row[in_], prev[in_], left[in_]
        rank[r, x] = pairs.rank(symbol[r, x], symbol[r, y])
    flat, edge = symbol[there].tobytes(), np.concatenate([[0], 4 * np.cumsum(there.sum(axis=1))]).tolist()
    return [flat[i:j] for i, j in zip(edge, edge[1:])]


def _simple() -> re.Pattern:
    """SPLIT for texts of characters below SIMPLE."""
    import regex

    def those(pattern: str) -> str:
        return "".join(f"\\u{c:04x}" for c in range(SIMPLE) if regex.match(pattern, chr(c)))

    letter, digit, space = those(r"\p{L}"), those(r"\p{N}"), those(r"\s")
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


class Encoder(dict):
    """Pre-token to its ids as packed 32-bit numbers, filled as pre-tokens are met."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        super().__init__()
        self.ranks, self.pairs = ranks, _Pairs(ranks)
        self._any, self._few, self._beyond = regex.compile(SPLIT).findall, _simple().findall, re.compile(f"[^\\u0000-\\u{SIMPLE - 1:04x}]").search
        self.strings = [b""] * (max(ranks.values()) + 1)
        for s, r in ranks.items():
            self.strings[r] = s

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return self._any(text) if self._beyond(text) else self._few(text)

    def __missing__(self, piece: str) -> bytes:
        return array("i", merge(piece.encode(), self.ranks)).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Remembers those pre-tokens, all but long ones."""
        if len(self) + len(pieces) > REMEMBERED:
            self.clear()
        names = list(pieces.difference(self))
        raws = [p.encode() for p in names]
        width = np.searchsorted(WIDTHS, np.fromiter(map(len, raws), np.int64, len(raws)))
        for k, most in enumerate(WIDTHS):
            own = np.flatnonzero(width == k)
            for lo in range(0, len(own), SIDE_BY_SIDE):
                at = own[lo : lo + SIDE_BY_SIDE].tolist()
                self.update(zip([names[i] for i in at], merge_many([raws[i] for i in at], most, self.ranks, self.pairs)))
        for i in np.flatnonzero(width == len(WIDTHS)).tolist():
            if len(names[i]) <= 64:
                self[names[i]] = self[names[i]]  # merged by itself

    def packed_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed ids of each text; of texts of a few MB at a time."""
        found = [None if t is None else self.find(t) for t in texts]
        self.learn(set().union(*(f for f in found if f)))
        return [None if f is None else b"".join(map(self.__getitem__, f)) for f in found]

    def packed(self, text: str) -> bytes:
        return self.packed_all([text])[0]

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[tuple, Encoder] = {}


def encoder(ranks: dict[bytes, int]) -> Encoder:
    """This worker's encoder of that vocabulary."""
    key = (len(ranks), hash(frozenset(ranks.items())))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def encode_decode(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded) of each row of (doc_id, text).

    ``decoded`` is made from the ids alone and equals the text. The vocabulary is sent to the executors once; its size
    (under 1 MB) doesn't depend on the data.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for batch in batches:
            enc = enc or encoder(sent.value)
            keys, texts = batch.column(0), batch.column(1)
            i, n = 0, len(texts)
            while i < n:  # a few MB at a time
                rows, size, j = [], 0, i
                while j < n and (size < 2_000_000 or j == i):
                    t = texts[j].as_py()
                    rows.append(t)
                    size += len(t or "")
                    j += 1
                ids = enc.packed_all(rows)
                flat = np.frombuffer(b"".join(x for x in ids if x), np.int32)
                counts = np.array([len(x or b"") // 4 for x in ids], np.int64)
                null = np.array([x is None for x in ids])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                column = lists(pa.array(flat), counts) if not null.any() else pa.ListArray.from_arrays(
                    pa.array(offsets, mask=np.concatenate([null, [False]])), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), pa.array(counts, mask=null), column, pa.array([None if x is None else enc.decode(array("i", x)) for x in ids], pa.string())],
                    ["doc_id", "n_tokens", "token_ids", "decoded"])
                i = j

    return no_clash(df, "doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, token_ids array<int>, decoded string")

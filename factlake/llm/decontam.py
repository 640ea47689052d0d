"""Benchmark decontamination: documents that hold a passage within an edit distance of a benchmark item.

Texts are brought to lower-case words with single spaces. Candidates come from a complete filter: an item of m characters
that may have k edits is cut into disjoint pieces of ``q`` characters, ``PIECE`` or as many as leave more than k pieces.
An edit destroys one piece at most, so a passage within the bound still holds ``m // q - k`` of them or more, unchanged,
and shifts them by k at most. Of these, ``LEFT_OUT`` needn't be found as well: the commonest pieces of an item, as many as
that, aren't looked up at all. All places of a document are looked up among the others; pieces found are counted for each
item over bands of k + 1 shifts, and two bands side by side that together reach that number are a candidate if
all but 5 k of the item's 5-grams are there within these shifts as well: an edit destroys five at most. Its text is
verified once for each document and item by the exact edit distance between the whole item and the best-fitting passage
there (bit-parallel).

A document is contaminated by an item if a passage of it is within ``floor(SHARE * length)`` edits of the item, length
and edits in bytes of the normal form, so an edit of a non-ASCII character may count as two or more. No passage within
the bound is missed, wherever its edits lie and however short the item is. Edits are the least over the document, and
the end is that of the first such passage.

Items are sent to every task in slices of at most ``SLICE`` bytes of text, one pass over the documents for each slice, and
looked up in groups of ``GROUP``. Items of fewer than seven characters allow no edit.

Defined results: null or wordless documents and items match nothing. Items of any length are compared, and items
with equal text each give their row. Repeated rows of documents give repeated rows; null doc_ids are kept as null. Texts
are searched whole. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm._common import IS_WORD, buffers, chunks, lean, no_clash

SHARE = 0.15
#: Longest piece; bits of its hash; least width of a band of shifts; items looked up at once.
PIECE, SLOTS, BAND, GROUP = 5, 20, 8, 500
#: Share of the pieces that must be found that is left out of the search.
LEFT_OUT = 0.3
#: Above so many counters for a chunk, pieces found are sorted instead.
DENSE = 10_000_000
SLICE = 16_000_000


def normal(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of lower-cased bytes with one space before each but a text's first."""
    if not len(data):
        return data, offs
    inside = IS_WORD[data]
    follows = np.concatenate([inside[1:], [False]])
    keep = inside | follows
    last = offs[1:][np.diff(offs) > 0] - 1
    keep[last] = inside[last]  # the next byte is another text's
    total = np.concatenate([[0], np.cumsum(keep)])
    out = np.where(inside, data, 32).astype(np.uint8)[keep]
    return out, total[offs]


def slots(text: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes at each place that has as many."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = text[:n].astype(np.uint64)
    for k in range(1, q):
        code <<= np.uint64(8)
        code |= text[k : k + n]
    code *= np.uint64(0x9E3779B97F4A7C15)
    code >>= np.uint64(64 - SLOTS)
    return code.view(np.int64)


class Pieces:
    """The disjoint pieces of a group of items that are cut to the same length, by hash."""

    def __init__(self, items: list[tuple[int, bytes]], q: int):
        self.q, self.numbers = q, [x for x, _ in items]
        size = np.array([len(t) for _, t in items])
        most = (SHARE * size).astype(np.int64)
        self.least = size // q - most
        self.width = np.maximum(BAND, most + 1)
        self.grams = [slots(np.frombuffer(t, np.uint8), q).astype(np.int16) for _, t in items]
        self.kept = size - q + 1 - q * most  # of these, as many at least are unchanged
        self.ahead = int(size.max())  # a shift may be so far below zero
        every = [slots(np.frombuffer(t, np.uint8), q) for _, t in items]
        often = np.bincount(np.concatenate(every), minlength=1 << SLOTS)
        # a part of the pieces that must be found needn't be looked for: the commonest of each item
        less = (self.least * LEFT_OUT).astype(np.int64)
        self.least = self.least - less
        where = [np.arange(0, m - q + 1, q) for m in size.tolist()]
        where = [np.sort(w[np.argsort(often[own[w]], kind="stable")[: len(w) - d]]) for own, w, d in zip(every, where, less.tolist())]
        slot = np.concatenate([own[w] for own, w in zip(every, where)])
        order = np.argsort(slot, kind="stable")
        self.item = np.repeat(np.arange(len(items)), [len(w) for w in where])[order]
        self.back = self.ahead - np.concatenate(where)[order]
        self.count = np.bincount(slot, minlength=1 << SLOTS).astype(np.int32)
        self.first = (np.cumsum(self.count) - self.count).astype(np.int32)

    def candidates(self, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, least and greatest place where a passage may start), each item's in order and apart."""
        slot = slots(text, self.q)
        n = self.count[slot]
        place = np.flatnonzero(n)
        if not len(place):
            return
        n, low = n[place], self.first[slot[place]]
        entry = np.repeat(low - np.cumsum(n, dtype=np.int64) + n, n)
        entry += np.arange(len(entry))
        item = self.item[entry]
        bands = (len(text) + self.ahead) // self.width + 2  # the last stays empty
        base = np.cumsum(bands) - bands
        shift = np.repeat(place, n) + self.back[entry]
        key = base[item] + ((shift + 0.5) * (1 / self.width)[item]).astype(np.int64)
        if int(bands.sum()) <= DENSE:
            found = np.bincount(key, minlength=int(bands.sum()))
            own = found[:-1] + found[1:]
            own[base[1:] - 1] = 0
            band = np.flatnonzero(own >= self.least.min())
            own = own[band]
        else:
            some, count = np.unique(key, return_counts=True)
            band = np.union1d(some, some - 1)  # each with the next
            sums = np.concatenate([[0], np.cumsum(count)])
            own = sums[np.searchsorted(some, band + 2)] - sums[np.searchsorted(some, band)]
        x = np.maximum(0, np.searchsorted(base, band, side="right") - 1)
        hit = np.flatnonzero(own >= self.least[x])
        around = np.full(len(slot) + 4 * self.ahead + 4 * BAND, -1, np.int16)
        around[self.ahead : self.ahead + len(slot)] = slot.astype(np.int16)
        last = (-1, 0, 0)
        for i, b in zip(x[hit].tolist(), (band - base[x])[hit].tolist()):
            width, grams = int(self.width[i]), self.grams[i]
            lo = max(b, 0) * width
            if self.kept[i] > 1:
                there = np.ndarray((2 * width, len(grams)), np.int16, around, 2 * lo, (2, 2))
                if np.count_nonzero((there == grams).any(axis=0)) < self.kept[i]:
                    continue
            lo -= self.ahead
            if last[0] == i and lo <= last[2]:
                last = (i, last[1], lo + 2 * width)
                continue
            if last[0] >= 0:
                yield self.numbers[last[0]], last[1], last[2]
            last = (i, lo, lo + 2 * width)
        if last[0] >= 0:
            yield self.numbers[last[0]], last[1], last[2]


def distance(item: bytes, passage: bytes) -> tuple[int, int]:
    """Least edit distance between item and any part of passage, and where that part ends: Myers' bit vectors."""
    m = len(item)
    if not m:
        return 0, 0
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, where = full, 0, m, m, 0
    for j, c in enumerate(passage):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a passage may start anywhere
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, where = score, j + 1
    return best, where


def pieces(text: bytes) -> frozenset[bytes]:
    """A text's 5-grams; an edit destroys five at most."""
    return frozenset({text[k : k + 5] for k in range(len(text) - 4)})


class Index:
    """The items' normal forms and their pieces."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        data, offs = buffers(pc.utf8_lower(pa.array(texts, pa.string())))
        text, offs = normal(data, offs)
        self.items = [text[offs[i] : offs[i + 1]].tobytes().strip() for i in range(len(ids))]
        self.pieces: dict[int, frozenset[bytes]] = {}  # made where they are needed: items are sent, not these
        by: dict[int, list[tuple[int, bytes]]] = {}
        for x, t in enumerate(self.items):
            if t:
                by.setdefault(min(PIECE, len(t) // (int(SHARE * len(t)) + 1)), []).append((x, t))
        self.groups = [Pieces(own[k : k + GROUP], q) for q, own in sorted(by.items()) for k in range(0, len(own), GROUP)]

    def find(self, col: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, edits, end in the normal form) of each contaminated row and item of a batch."""
        data, offs = buffers(pc.utf8_lower(col))
        out: list[tuple[int, int, int, int]] = []
        for i, j in chunks(offs, 1_000_000):
            text, own = normal(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            seen: dict[tuple[int, int], tuple[int, int]] = {}
            for x, low, high in (c for g in self.groups for c in g.candidates(text)):
                item = self.items[x]
                most = int(SHARE * len(item))
                low, high = max(0, low - most), min(len(text), high + len(item) + most)
                d = max(0, int(np.searchsorted(own, low, side="right")) - 1)
                while d < len(own) - 1 and own[d] < high:
                    lo, hi = max(int(own[d]), low), min(int(own[d + 1]), high)
                    if hi - lo >= len(item) - most and seen.get((d, x), (1, 0))[0] > 0:
                        passage = text[lo:hi].tobytes()
                        if x not in self.pieces:
                            self.pieces[x] = pieces(item)
                        if len(self.pieces[x] - pieces(passage)) <= 5 * most:
                            edits, end = distance(item, passage)
                            if edits <= most and ((d, x) not in seen or edits < seen[d, x][0]):
                                seen[d, x] = (edits, lo + end - int(own[d]))
                    d += 1
            out += [(i + d, x, e, p) for (d, x), (e, p) in sorted(seen.items())]
        return out


def _slices(items: DataFrame) -> list[DataFrame]:
    """The benchmark in parts that are small enough to be sent."""
    own = no_clash(items, "item_id", "text").where("text IS NOT NULL")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // SLICE) + 1
    return [own.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else own for k in range(n)]


def _index(part: DataFrame) -> Index:
    rows = part.orderBy("item_id", "text").toArrow()
    return Index(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, end) of each contaminated document and item; end is in bytes of the normal form."""
    out = None
    for part in _slices(items):
        sent = docs.sparkSession.sparkContext.broadcast(_index(part))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                rows = index.find(b.column(1))
                keys = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([index.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                                                 ["doc_id", "item_id", "edits", "end"])

        one = no_clash(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, item_id long, edits long, end long")
        out = one if out is None else out.unionByName(one)
    return out


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without contaminated rows. Narrow: no shuffle, one pass for each slice of the benchmark."""
    at = docs.columns.index("text")
    for part in _slices(items):
        sent = docs.sparkSession.sparkContext.broadcast(_index(part))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(len(b), np.bool_)
                keep[[r[0] for r in sent.value.find(b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs

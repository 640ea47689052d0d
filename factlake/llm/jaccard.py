"""N-gram Jaccard self-join: all pairs of documents whose sets of word n-grams have a Jaccard of at least a threshold.

Rare-first prefix filtering with length, positional and suffix filters, joined on prefix n-grams and verified once a
pair. The result is exact: every filter only drops pairs that can't reach the threshold, and there is no cap on partners.

1. One pass counts all words and n-grams of the corpus in fixed numbers of buckets and gives each document's set key (a
   hash of its n-gram set), so exact copies become one record. An n-gram's order is its rarity class (no n-gram is more
   frequent than its bucket or its rarest word), then its hash: rare-first, the same in every task.
2. Each record's prefix n-grams go to the task of their hash, without the record's key: sorted hashes as differences, the
   record's number within its pack, and its size and the n-gram's place in a byte each, rounded so that no filter drops
   more. An n-gram in which a record can't pair with another of near size drops.
3. The rest go back to their pack, whose records so learn which of their prefix n-grams are shared, and pick a few of
   these by hashing as meeting points. They then meet by hash. Records with the same meeting point give their pair there
   and nowhere else; other pairs come from each n-gram they share and are made distinct after. Length and positional
   filters hold throughout: the smaller record's n-gram must lie in its index prefix, and of the n-grams that they
   share one must have enough behind it. A pair of records that meets nowhere must share several prefix n-grams.
4. Pairs are verified in groups: a pair's group is the least key that either record is paired with, so a record's set
   is sent to few tasks, however many partners it has; large groups are split. The suffix filter comes first: the sets'
   counts over hash ranges, two bits each, bound how far they are apart. The sets themselves are sent for what is left.

``linked`` and ``keep_one`` list no pairs, so they needn't verify those that a hub tells of. Records of an n-gram that
many have are compared with a few of these, the hubs. 1 - J is a metric: two records whose distances from the same hub
add up to 1 - t at most reach the threshold, whatever they are. Each record is in one ball at most, that of its hub with
most close records; such pairs of a ball are neither formed nor sent, and their links are counted from the ball's
distances in order. All other pairs go the way above, so the result is the same.

Records between tasks are blocks of packed arrays, one row for each target task, so that the engine moves few large rows.
The number of tasks follows the number of words. Packs are told by their records' keys, so a task that is run again must
see its rows in the same order, as it does from files; a table that comes out of a shuffle is written first.

Sets are known by a key of 63 bits and n-grams by 48 bits when they are verified: of m sets ``m^2 / 2^64`` pairs are
expected to share a key by chance, and a pair of sets of 1000 n-grams has a false match four times in 10^9 pairs.

Defined results: documents with null doc_id, or with null text or text without a word, are in no pair. A text of fewer
than n words has one n-gram: all its words. ``linked`` gives one row per document, with its class and the number of its
links; they are counted where pairs are verified, so rows and what is moved after don't grow with pairs. ``all_pairs`` gives every pair of documents, copies with each other and with
all near duplicates; ``join`` links exact copies (equal sets) to the least doc_id of theirs, which alone is compared.
A doc_id is never paired with itself, and repeated rows change nothing. Ties: doc_id is less than other_id in each row.
Texts are compared whole, at any length. Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm._common import buffers, chunks, distinct_per_doc, done, lean, mix, ngrams, no_clash, words, written

THRESHOLD, N = 0.6, 2
#: Counters for words and for n-grams. Their numbers are fixed, and with them the size of what every task gets (8 MB).
#: They are gathered in blocks of one byte each, with what a task counts above 255 beside them.
BUCKETS, GRAM_BUCKETS, BLOCK = 1 << 20, 1 << 22, 1 << 16
#: Bits of an n-gram's hash that find candidates; n-grams of a pack; words for each task at least.
BITS, PACK, TASK_WORDS = 41, 1_500_000, 4_000_000
#: Prefix n-grams that a pair must share to be verified (all that it needs, if that is fewer): at least this many, and
#: this share of the smaller record. Prefixes are longer by as much, so that each pair that reaches the threshold does.
COMMON, COMMON_SHARE = 8, 16
#: Meeting points of a record that shares at least MANY n-grams; others meet at each n-gram they share.
POINTS, MANY = 4, 16
#: Keys that are sent to every task (8 bytes each); beyond, Spark joins by shuffling.
SENT_KEYS = 2_000_000
#: N-grams of a set whose hashes are packed in less.
LARGE = 16_000
#: Pairs of a group that one task verifies.
GROUP_PAIRS = 1_000_000
#: Records with the same n-gram from which on balls are looked for, and hubs that each of these records is compared with.
CROWD, HUBS = 64, 4
#: Distances from hubs are rounded up to these parts, so that all who add them get the same.
PARTS = 1_000_000
_MASK = np.uint64((1 << 56) - 1)
_SIGN = np.uint64(2**63 - 1)


def _sets(h: np.ndarray, doc: np.ndarray, docs: int, n: int, rarity: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of each document, ascending, and their documents."""
    grams, owner = ngrams(h, doc, docs, n)
    code = grams & _MASK
    if rarity is not None and len(h):
        # the least bound decides; the most frequent word counts a little
        own = np.concatenate([rarity[0][h % np.uint64(BUCKETS)], np.zeros(n, np.float32)])
        count = np.bincount(doc, minlength=docs)
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        size = np.bincount(owner, minlength=docs)
        start = first[owner] + np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
        width = np.minimum(n, count[owner])
        low, high = own[start], own[start]
        for k in range(1, n):
            more = own[np.where(k < width, start + k, start)]
            low, high = np.minimum(low, more), np.maximum(high, more)
        low = np.minimum(low, rarity[1][(code % np.uint64(GRAM_BUCKETS)).astype(np.int64)].astype(np.float32) / 6)
        code = code | np.clip(np.rint(low * 2.7 + high * 0.3), 0, 127).astype(np.uint64) << np.uint64(56)
    return distinct_per_doc(code.astype(np.int64), owner)


def _keys(codes: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """A key of each document's set, whatever the order, and its size. Keys aren't negative."""
    size = np.bincount(owner, minlength=docs)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) & _MASK), out=total[1:])
    edge = np.concatenate([[0], np.cumsum(size)])
    return (mix((total[edge[1:]] - total[edge[:-1]]) ^ size.astype(np.uint64)) & _SIGN).astype(np.int64), size


def _batch(col: pa.Array, n: int, rarity: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple]:
    """(first row, end row, word hashes, codes, owners) of each chunk of a batch."""
    data, offs = buffers(pc.utf8_lower(col))
    for i, j in chunks(offs):
        h, doc, _, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield i, j, h, *_sets(h, doc, j - i, n, rarity)


_SCAN = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary()), ("part", pa.int32()), ("block", pa.binary()), ("over", pa.binary())])
_OVER = np.dtype([("at", np.uint32), ("n", np.int64)])


def _rows(**columns) -> pa.RecordBatch:
    """A batch of the scan's columns, null where none is given."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in _SCAN], schema=_SCAN)


def _ranges(size: np.ndarray) -> np.ndarray:
    """Logarithm of the number of hash ranges of a sketch: half to all of a set's size."""
    return np.maximum(4, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) - 1)


def _sketches(codes: np.ndarray, owner: np.ndarray, size: np.ndarray) -> pa.Array:
    """How many n-grams of each document lie in each hash range, three at most, four ranges a byte."""
    log = _ranges(size)
    edge = np.concatenate([[0], np.cumsum(np.int64(1) << log)])
    at = edge[owner] + ((codes & np.int64(_MASK)) >> (56 - log)[owner])
    four = np.minimum(np.bincount(at, minlength=int(edge[-1])), 3).astype(np.uint8).reshape(-1, 4)
    flat = four[:, 0] | four[:, 1] << np.uint8(2) | four[:, 2] << np.uint8(4) | four[:, 3] << np.uint8(6)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((edge // 4).astype(np.int32)), pa.py_buffer(flat)])


def _from_sketch(raw: pa.Buffer) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8)
    return np.stack([flat >> np.uint8(2 * k) & np.uint8(3) for k in range(4)], axis=1).ravel()


def _scan(df: DataFrame, n: int) -> DataFrame:
    """Set keys and sketches of all documents and, once a task, its counts by bucket: words, then documents of each n-gram; one table of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS + GRAM_BUCKETS, np.uint32)
        for b in batches:
            for i, j, h, codes, owner in _batch(b.column(1), n, None):
                counts[:BUCKETS] += np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
                at, n_at = np.unique((codes % GRAM_BUCKETS).astype(np.uint32), return_counts=True)
                counts[at + np.uint32(BUCKETS)] += n_at.astype(np.uint32)
                key, size = _keys(codes, owner, j - i)
                keep = np.flatnonzero(size)
                yield _rows(doc_id=b.column(0).slice(i, j - i).take(pa.array(keep)), key=pa.array(key[keep]), size=pa.array(size[keep].astype(np.int32)), sketch=_sketches(codes, owner, size).take(pa.array(keep)))
        if counts.any():
            parts, blocks, overs = [], [], []
            for lo in range(0, len(counts), BLOCK):
                own = counts[lo : lo + BLOCK]
                more = np.flatnonzero(own > 255)
                over = np.zeros(len(more), _OVER)
                over["at"], over["n"] = more, own[more] - 255
                parts.append(lo // BLOCK)
                blocks.append(np.minimum(own, 255).astype(np.uint8).tobytes())
                overs.append(over.tobytes())
            yield _rows(part=pa.array(parts, pa.int32()), block=pa.array(blocks, pa.binary()), over=pa.array(overs, pa.binary()))

    return df.mapInArrow(lean(run), "doc_id long, key long, size int, sketch binary, part int, block binary, over binary")


def _rarity(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Logarithms of the words' counts and sixths of those of the n-grams' counts, by bucket, and the number of words."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, np.ndarray] = {}
        for b in batches:
            for p, x, more in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                own = by.setdefault(p, np.zeros(BLOCK, np.int64))
                own += np.frombuffer(x.as_buffer(), np.uint8)
                over = np.frombuffer(more.as_buffer(), _OVER)
                own[over["at"]] += over["n"]
        values = []
        for p, own in by.items():
            log = np.log2(np.maximum(own, 1))
            values.append(log.astype(np.float32).tobytes() if p < BUCKETS // BLOCK else np.clip(np.rint(log * 6), 0, 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array(values, pa.binary()), pa.array([int(v.sum()) for v in by.values()], pa.int64())], ["part", "value", "n"])

    words_, grams, total = np.zeros(BUCKETS, np.float32), np.zeros(GRAM_BUCKETS, np.uint8), 0
    blocks = scanned.where("part IS NOT NULL").select("part", "block", "over").repartition("part").mapInArrow(lean(add), "part int, value binary, n long")
    for b in blocks.toArrow().to_batches():
        for p, x, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            if p < BUCKETS // BLOCK:
                words_[p * BLOCK : (p + 1) * BLOCK] = np.frombuffer(x.as_buffer(), np.float32)
                total += n
            else:
                lo = p * BLOCK - BUCKETS
                grams[lo : lo + BLOCK] = np.frombuffer(x.as_buffer(), np.uint8)
    return words_, grams, total


def _class(size: np.ndarray) -> np.ndarray:
    """A size in seven bits: sevenths of its logarithm, all from 2^18 on alike."""
    return np.minimum(127, np.floor(np.log2(np.maximum(size, 1)) * 7 + 1e-9)).astype(np.uint8)


#: Least size of each class, and what all of a class lie below.
_FLOOR = 2.0 ** (np.arange(128) / 7) * (1 - 1e-9)
_ROOF = np.append(2.0 ** (np.arange(1, 128) / 7) * (1 + 1e-9), np.inf)


def _rounded(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A place in a byte: 512ths of the size, rounded down."""
    return np.minimum(255, place.astype(np.int64) * 512 // np.maximum(size, 1)).astype(np.uint8)


def _unrounded(q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A place that is that of the byte or lies before it; the same for sizes up to 512 and places in the first half."""
    return -(-q.astype(np.int64) * size // 512)


def _differences(codes: np.ndarray, width: int) -> bytes:
    """Ascending codes: the first, the number of wide steps, the steps in ``width`` bytes (0 for wide ones), the wide steps with their places."""
    step = np.diff(codes, prepend=codes[:1])
    wide = np.flatnonzero(step >> np.int64(8 * width))
    low = step.copy()
    low[wide] = 0
    narrow = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return b"".join([np.int64(codes[0]).tobytes(), np.int64(len(wide)).tobytes(), np.ascontiguousarray(narrow.T).tobytes(), wide.astype(np.int32).tobytes(), step[wide].tobytes()])


def _summed(raw: pa.Buffer, n: int, width: int, at: int) -> tuple[np.ndarray, int]:
    """The codes of ``_differences`` at a place in a buffer, and the place after them."""
    first, wide = np.frombuffer(raw, np.int64, 2, at)
    step = np.zeros((n, 8), np.uint8)
    step[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T
    step = step.view("<i8").ravel()
    at += 16 + n * width
    step[np.frombuffer(raw, np.int32, wide, at)] = np.frombuffer(raw, np.int64, wide, at + 4 * int(wide))
    return first + np.cumsum(step), at + 12 * int(wide)


def _block(pack: int, codes: np.ndarray, width: int, *columns: np.ndarray) -> bytes:
    return b"".join([np.int64(pack).tobytes(), np.int64(len(codes)).tobytes(), _differences(codes, width), *[c.tobytes() for c in columns]])


def _from_block(raw: pa.Buffer, width: int, *types: type) -> tuple[int, list[np.ndarray]]:
    pack, n = map(int, np.frombuffer(raw, np.int64, 2))
    codes, at = _summed(raw, n, width, 16)
    out = [codes]
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return pack, out


def _pack(part: np.ndarray, parts: int, codes: np.ndarray, place: np.ndarray, key: np.ndarray, size: np.ndarray, *points: np.ndarray) -> pa.RecordBatch:
    """Rows (part, block). A block has its records' keys, sizes, points and numbers of n-grams, then the n-grams' codes (6 bytes) and places."""
    order = np.lexsort((key, part)) if len(part) else np.zeros(0, np.int64)
    part, codes, place, key, size = part[order], codes[order], place[order], key[order], size[order]
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([head, [len(key)]])).astype(np.int32)
    edge, heads = np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(part[head], np.arange(parts + 1))
    points = [p[order][head] for p in points]
    low, high = codes.astype(np.uint32), (codes >> np.int64(32)).astype(np.uint16)
    near, far = place.astype(np.uint16), (place >> 16).astype(np.uint8)
    used = np.flatnonzero(np.diff(edge))
    blocks = []
    for p in used:
        r, x = slice(heads[p], heads[p + 1]), slice(edge[p], edge[p + 1])
        blocks.append(b"".join([np.int64(heads[p + 1] - heads[p]).tobytes(), key[head[r]].tobytes(), size[head[r]].astype(np.int32).tobytes(), *[q[r].tobytes() for q in points],
                                count[r].tobytes(), low[x].tobytes(), high[x].tobytes(), near[x].tobytes(), far[x].tobytes()]))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blocks, pa.binary())], ["part", "block"])


def _unpack(batches: Iterator[pa.RecordBatch], points: int = 0) -> list[np.ndarray]:
    """Codes, places, keys, sizes and points of all n-grams of a task's blocks."""
    out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int64, np.int32, *[np.uint32] * points)]
    for b in batches:
        for block in b.column(1):
            raw = block.as_buffer()
            n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8

            def take(t: type, m: int) -> np.ndarray:
                nonlocal at
                x = np.frombuffer(raw, t, m, at)
                at += m * np.dtype(t).itemsize
                return x

            key, size, own = take(np.int64, n), take(np.int32, n), [take(np.uint32, n) for _ in range(points)]
            count = take(np.int32, n)
            m = int(count.sum())
            low, high, near, far = take(np.uint32, m), take(np.uint16, m), take(np.uint16, m), take(np.uint8, m)
            for o, x in zip(out, (low.astype(np.int64) | high.astype(np.int64) << np.int64(32), near.astype(np.int32) | far.astype(np.int32) << np.int32(16),
                                  np.repeat(key, count), np.repeat(size, count), *[np.repeat(q, count) for q in own])):
                o.append(x)
    return [np.concatenate(o) for o in out]


def moved(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.col("part"))


def _common(size: np.ndarray) -> np.ndarray:
    """How many prefix n-grams a record of that size must share with a larger one."""
    return np.maximum(COMMON, size // COMMON_SHARE)


def _last(t: float, size: np.ndarray) -> np.ndarray:
    """The last place of a record's prefix for a partner that it must share t of its size with."""
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + _common(size) - 1


def _prefixes(df: DataFrame, sent, n: int, t: float, parts: int) -> DataFrame:
    """Packs: blocks of (hash, record, class, place) of all prefix n-grams by hash, and each pack's table of keys and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, copied, rep = sent.value
        held: list[list[np.ndarray]] = [[] for _ in range(6)]
        rows, grams = 0, 0

        def pack() -> pa.RecordBatch:
            hashes, record, own_class, place, key, size = (np.concatenate(h) for h in held)
            table = key.tobytes() + size.astype(np.int32).tobytes()
            number = int.from_bytes(hashlib.blake2b(table, digest_size=7).digest(), "big")
            order = np.argsort(hashes)
            hashes, record, own_class, place = hashes[order], record[order], own_class[order], place[order]
            edge = np.searchsorted(hashes * parts >> np.int64(BITS), np.arange(parts + 1))
            used, blocks = np.flatnonzero(np.diff(edge)), []
            for p in used:
                x = slice(edge[p], edge[p + 1])
                blocks.append(_block(number, hashes[x], 3, record[x], own_class[x], place[x]))
            to = [*used.tolist(), number % parts]
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([*blocks, table], pa.binary()), pa.array([-1] * len(blocks) + [number], pa.int64())], ["part", "block", "table"])

        for b in batches:
            for i, j, _, codes, owner in _batch(b.column(1), n, rarity):
                key, size = _keys(codes, owner, j - i)
                once = np.zeros(j - i, np.bool_)
                once[np.unique(key, return_index=True)[1]] = True  # exact copies in this chunk
                if len(copied):
                    ids = b.column(0).slice(i, j - i).to_numpy()
                    at = np.minimum(np.searchsorted(copied, key), len(copied) - 1)
                    once &= (copied[at] != key) | (rep[at] == ids)
                once &= size > 0
                number = np.cumsum(once) - 1 + rows
                place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
                use = (place <= _last(t, size)[owner]) & once[owner]
                own, codes, place = owner[use], codes[use], place[use]
                indexed = (place <= _last(2 * t / (1 + t), size)[own]).astype(np.uint8)
                cols = ((codes & np.int64(_MASK)) >> np.int64(56 - BITS), number[own].astype(np.uint16), _class(size)[own] | indexed << np.uint8(7), _rounded(place, size[own]), key[once], size[once])
                for h, c in zip(held, cols):
                    h.append(c)
                rows, grams = rows + int(once.sum()), grams + len(own)
                if grams > PACK or rows > 60_000:
                    yield pack()
                    held, rows, grams = [[] for _ in range(6)], 0, 0
        if grams:
            yield pack()

    return df.mapInArrow(lean(run), "part int, block binary, table long")


def _grouped(codes: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by code, size and key without repeats, and the edges of the codes' groups of two or more in it."""
    order = np.lexsort((key, size, codes))
    c, k = codes[order], key[order]
    new = np.ones(len(c), np.bool_)
    new[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1])
    order = order[new]
    c = codes[order]
    first = np.ones(len(c), np.bool_)
    first[1:] = c[1:] != c[:-1]
    start = np.flatnonzero(first)
    length = np.diff(np.concatenate([start, [len(c)]]))
    keep = np.repeat(length > 1, length)
    length = length[length > 1]
    return order[keep], np.concatenate([[0], np.cumsum(length)])


def _partnered(codes: np.ndarray, own_class: np.ndarray, indexed: np.ndarray, t: float) -> np.ndarray:
    """Which n-grams, ordered by hash and class with indexed ones first, can pair with another of the same hash.

    The smaller record's n-gram must lie in its index prefix and its size reach t of the larger's. Of smaller records
    the best partner is the last indexed one before, of larger ones the next.
    """
    at = np.arange(len(codes))
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    length = np.diff(np.append(first, len(codes)))
    start, end = np.repeat(first, length), np.repeat(first + length, length)
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(indexed, at, -1))[:-1]])
    below = (last >= start) & (_ROOF[own_class[np.maximum(last, 0)]] >= t * _FLOOR[own_class])
    after = np.minimum(at + 1, len(at) - 1)
    above = indexed & (at + 1 < end) & (_ROOF[own_class] >= t * _FLOOR[own_class[after]])
    return below | above


def _shared(df: DataFrame, t: float, parts: int) -> DataFrame:
    """Of the blocks by hash, the n-grams in which records can pair; blocks by pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[int] = []
        held: list[list[np.ndarray]] = [[] for _ in range(5)]
        for b in batches:
            tables = b.filter(pc.greater_equal(b.column(2), 0))
            if len(tables):
                yield tables
            for block in b.filter(pc.less(b.column(2), 0)).column(1):
                pack, own = _from_block(block.as_buffer(), 3, np.uint16, np.uint8, np.uint8)
                for h, c in zip(held, (*own, np.full(len(own[0]), len(packs), np.int32))):
                    h.append(c)
                packs.append(pack)
        if not packs:
            return
        codes, record, mark, place, pack = (np.concatenate(h) for h in held)
        order = np.argsort(codes << np.int64(8) | (mark & np.int64(127)) << np.int64(1) | (mark < 128))
        keep = np.sort(order[_partnered(codes[order], mark[order] & np.uint8(127), mark[order] > 127, t)])  # by block again
        codes, record, place, pack = codes[keep], record[keep], place[keep], pack[keep]
        edge = np.searchsorted(pack, np.arange(len(packs) + 1))
        for k in np.flatnonzero(np.diff(edge)):
            x = slice(edge[k], edge[k + 1])
            yield pa.RecordBatch.from_arrays([pa.array([packs[k] % parts], pa.int32()), pa.array([_block(packs[k], codes[x], 4, record[x], place[x])], pa.binary()), pa.array([-1], pa.int64())], ["part", "block", "table"])

    return df.mapInArrow(lean(run), "part int, block binary, table long")


def _pointed(df: DataFrame, t: float, parts: int) -> DataFrame:
    """Of the blocks by pack, the same with each record's key, size and meeting points; blocks by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[list[np.ndarray]]] = {}
        for b in batches:
            for block, number in zip(b.column(1), b.column(2).to_pylist()):
                raw = block.as_buffer()
                if number >= 0:
                    n = raw.size // 12
                    tables[number] = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int32, n, 8 * n)
                else:
                    pack, own = _from_block(raw, 4, np.uint16, np.uint8)
                    by.setdefault(pack, []).append(own)
        for pack, blocks in by.items():
            codes, record, place = (np.concatenate(c) for c in zip(*blocks))
            key, size = tables[pack][0][record], tables[pack][1][record]
            yield from chosen(codes, _unrounded(place, size.astype(np.int64)).astype(np.int32), key, size)

    def chosen(codes: np.ndarray, place: np.ndarray, key: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((codes, key))
        codes, place, key, size = codes[order], place[order], key[order], size[order]
        new = np.ones(len(codes), np.bool_)
        new[1:] = (codes[1:] != codes[:-1]) | (key[1:] != key[:-1])  # a pack whose records all occur again has the same number
        codes, place, key, size = codes[new], place[new], key[new], size[new]
        for _ in range(2):  # first drop records that share too few n-grams for any partner
            if not len(key):
                return
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length = np.diff(np.concatenate([start, [len(key)]]))
            least = np.ceil(t * size - 1e-9).astype(np.int64)  # of any partner's size, and of what they share
            enough = np.repeat(length, length) >= np.minimum(_common(least), least)
            codes, place, key, size = codes[enough], place[enough], key[enough], size[enough]
        index = place <= _last(2 * t / (1 + t), size)  # only there a pair can meet from either side
        points = []
        for r in range(POINTS):
            h = mix(codes.astype(np.uint64) + np.uint64(0x1234567 * (r + 1)))
            h[~index] = np.uint64(2**64 - 1)
            least = np.minimum.reduceat(h, start)
            least[np.add.reduceat(index.astype(np.int64), start) < MANY] = np.uint64(2**64 - 1)
            points.append(np.repeat((least & np.uint64(0xFFFFFFFF)).astype(np.uint32), length))
        yield _pack((mix(codes.astype(np.uint64)) % np.uint64(parts)).astype(np.int64), parts, codes, place, key, size, *points)

    return df.mapInArrow(lean(run), "part int, block binary")


def _hubs(df: DataFrame) -> DataFrame:
    """(key, salt, hub, n): for each record of crowds, a hub of each crowd, and in how many of its crowds that is one.

    A record in which few n-grams come before that of the crowd has little that is its own and lies in the middle of its
    copies: half of the hubs are these, the others are chosen by hashing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, place, key, size, *_ = _unpack(batches, POINTS)
        order, edge = _grouped(codes, size, key)
        length = np.diff(edge)
        crowds = np.flatnonzero(length > CROWD)
        if not len(crowds):
            return
        at = order[np.concatenate([np.arange(edge[g], edge[g + 1]) for g in crowds])]
        key, place, length = key[at], place[at], length[crowds]
        own, start = np.repeat(np.arange(len(length)), length), np.concatenate([[0], np.cumsum(length)[:-1]])
        for salt in range(HUBS):
            h = mix(key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64))
            hub = np.repeat(key[np.lexsort((h, place, own) if salt < HUBS // 2 else (h, own))[start]], length)
            order = np.lexsort((hub, key))
            k, h = key[order], hub[order]
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]))
            n = np.diff(np.append(first, len(k)))
            for lo in range(0, len(first), 200_000):
                x = first[lo : lo + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(k[x]), pa.array(np.full(len(x), salt, np.int32)), pa.array(h[x]), pa.array(n[lo : lo + 200_000])], ["key", "salt", "hub", "n"])

    return df.mapInArrow(lean(run), "key long, salt int, hub long, n long")


def _limit(t: float) -> int:
    """What the distances of two records from a hub may add up to."""
    return int((1 - t) * PARTS + 1e-6)


def _balls(docs: DataFrame, scanned: DataFrame, met: DataFrame, reps: DataFrame, several: DataFrame, t: float, n: int, parts: int) -> DataFrame:
    """(key, ball, d, n): each record's hub, its distance and its number of documents. Of very many, those of the largest balls, as many as can be sent."""
    asked = _hubs(moved(met, parts)).groupBy("key", "salt", "hub").agg(F.sum("n").alias("n"))
    asked = asked.groupBy("key", "salt").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")).where("key <> hub")
    asked = written(asked.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct(), "jaccard-asked")
    close = written(_verify(docs, scanned, asked, reps.select("key", "rep"), t, n, parts), "jaccard-close")
    done(asked)
    d = F.ceil((1 - F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))) * PARTS + 1e-6)
    close = close.select("a", "b", d.alias("d"))
    ends = close.union(close.select("b", "a", "d"))
    ends = ends.union(ends.select("a", "a", F.lit(1).cast("long")).distinct()).toDF("key", "hub", "d")
    ends = ends.join(several.select("key").distinct(), "key", "left_anti")  # documents with several texts aren't linked with themselves
    sized = ends.join(ends.groupBy("hub").agg(F.count_if(F.col("d") * 2 <= _limit(t)).alias("inner")), "hub")
    own = sized.groupBy("key").agg(F.max_by(F.struct("hub", "d"), F.struct("inner", "hub")).alias("x")).select("key", F.col("x.hub").alias("ball"), "x.d")
    size = own.groupBy("ball").agg(F.count("*").alias("size")).where("size > 1")
    own = own.join(size, "ball").orderBy(F.desc("size"), "ball", "key").limit(SENT_KEYS)
    return written(own.join(reps, "key").select("key", "ball", "d", "n"), "jaccard-balls")


def _within(balls: DataFrame, t: float) -> DataFrame:
    """(key, links): of each record of a ball, the documents that its hub tells of."""

    def count(x):
        x = x.sort_values(["d", "key"])
        d, n = x["d"].to_numpy(), x["n"].to_numpy()
        upto = np.concatenate([[0], np.cumsum(n)])
        links = upto[np.searchsorted(d, _limit(t) - d, side="right")] - np.where(2 * d <= _limit(t), n, 0)
        return x[["key"]].assign(links=links)

    return balls.groupBy("ball").applyInPandas(count, "key long, links long")


def _candidates(df: DataFrame, t: float, balls: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b): keys of records that may reach the threshold, but those that a hub tells of. balls: keys, ascending, their balls' numbers and distances."""
    sent = df.sparkSession.sparkContext.broadcast(balls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, place, key, size, *points = _unpack(batches, POINTS)
        order, edge = _grouped(codes, size, key)
        codes, key, size, place = codes[order], key[order], size[order], place[order]
        known, number, distance = sent.value
        ball, d, limit = np.full(len(key), -1, np.int32), np.zeros(len(key), np.int32), _limit(t)
        if len(known):
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            ball, d = np.where(known[at] == key, number[at], -1), distance[at]
        points = [p[order] for p in points]
        indexed = place <= _last(2 * t / (1 + t), size)
        least, rest = np.ceil(t * size - 1e-9).astype(np.int64), size - place - 1
        whole = np.ceil(2 * t / (1 + t) * size - 1e-9).astype(np.int64)
        mine = [np.where(indexed, (mix(codes.astype(np.uint64) + np.uint64(0x1234567 * (r + 1))) & np.uint64(0xFFFFFFFF)).astype(np.uint32), 0) == p for r, p in enumerate(points)]
        out: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            x, y, room, need = (np.concatenate(c) for c in zip(*out))
            low, high = np.minimum(x, y), np.maximum(x, y)
            _, at, back, n = np.unique(mix(low.astype(np.uint64)) ^ (high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True, return_counts=True)
            most = np.full(len(at), -1, np.int32)
            np.maximum.at(most, back, room)
            for lo in range(0, len(at), 200_000):
                own = at[lo : lo + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (low[own], high[own], n[lo : lo + 200_000].astype(np.int32), most[lo : lo + 200_000], need[own])], ["a", "b", "n", "room", "need"])

        length = np.diff(edge)
        # groups of two to 64 records side by side, larger ones record by record
        small = [(k, np.flatnonzero(length == k)) for k in np.unique(length[length <= 64])]
        work: list[tuple[np.ndarray, np.ndarray]] = []
        for k, groups in small:
            p, q = np.triu_indices(k, 1)
            step = max(1, 400_000 // len(p))
            for lo in range(0, len(groups), step):
                base = edge[groups[lo : lo + step]][:, None]
                work.append(((base + p).ravel(), (base + q).ravel()))

        def meshed(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pairs of one of x with one of y; sizes ascend in both."""
            step = max(1, 400_000 // max(1, len(y)))
            for s in range(0, len(x), step):
                some = x[s : s + step]
                near, far = np.searchsorted(size[y], t * size[some[0]] - 1e-6), np.searchsorted(size[y], size[some[-1]] / t, side="right")
                i, j = (v.ravel() for v in np.meshgrid(some, y[near:far], indexing="ij"))
                yield np.minimum(i, j), np.maximum(i, j)

        def untold(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pairs of a ball that its hub may not tell of, each once: one of them at least is far from the hub."""
            x = x[np.argsort(-d[x], kind="stable")]
            outer = int((2 * d[x] > limit).sum())
            step = max(1, 400_000 // len(x))
            for s in range(0, outer, step):
                far = int(np.searchsorted(-d[x], d[x[s]] - limit, side="left"))  # d above limit - d of the farthest
                i, j = np.meshgrid(np.arange(s, min(s + step, outer)), np.arange(s + 1, far), indexing="ij")
                use = j > i
                i, j = x[i[use]], x[j[use]]
                yield np.minimum(i, j), np.maximum(i, j)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from work
            for g in np.flatnonzero(length > 64):
                rest = np.arange(edge[g], edge[g + 1])
                names, n = np.unique(ball[rest], return_counts=True)
                for name in names[(n > 64) & (names >= 0)]:
                    own = ball[rest] == name
                    inside, rest = rest[own], rest[~own]
                    yield from meshed(rest, inside)
                    yield from untold(inside)
                step = max(1, 400_000 // max(1, len(rest)))
                for s in range(0, len(rest), step):
                    # sizes ascend in a group: none beyond size / t can be a partner
                    some = rest[s : s + step]
                    far = int(np.searchsorted(size[rest], size[some[-1]] / t, side="right"))
                    i, j = np.meshgrid(some, rest[s + 1 : far], indexing="ij")
                    use = j > i
                    yield i[use], j[use]

        for i, j in pairs():
            use = indexed[i] & (size[i] >= least[j]) & ((ball[i] < 0) | (ball[i] != ball[j]) | (d[i] + d[j] > limit))
            i, j = i[use], j[use]
            met = np.zeros(len(i), np.bool_)
            here = np.zeros(len(i), np.bool_)
            for r, p in enumerate(points):
                same = (p[i] == p[j]) & (p[i] != np.uint32(0xFFFFFFFF)) & ~met
                here |= same & mine[r][i]
                met |= same
            # the first n-gram in common has enough behind it; of those that meet that is left to the verification
            alpha = np.ceil(t / (1 + t) * (size[i] + size[j]) - 1e-9).astype(np.int64)
            room = np.where(here, 0, np.clip(1 + np.minimum(rest[i], rest[j]) - alpha, -1, 0)).astype(np.int32)
            # of what they share, so much lies in the prefixes of either side
            mine_, other = alpha - whole[i] + _common(size[i]), alpha - least[j] + _common(size[j])
            need = np.where(here, 1, np.minimum(np.minimum(mine_, other), alpha)).astype(np.int32)
            use = here | ~met
            if use.any():
                out.append((key[i[use]], key[j[use]], room[use], need[use]))
                held += int(use.sum())
                if held > 3_000_000:
                    yield from flush()
                    out, held = [], 0
        if out:
            yield from flush()

    rows = df.mapInArrow(lean(run), "a long, b long, n int, room int, need int")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("room").alias("room"), F.min("need").alias("need")).where("n >= need AND room >= 0").select("a", "b")


def _packed(codes: np.ndarray) -> bytes:
    """A set's hashes, 48 bits of each: the low 40 (of large sets 32) bits as bytes, the rest in unary, a one for each hash and a zero after each range."""
    short = (codes & np.int64(_MASK)) >> np.int64(8)
    width = 4 if len(short) >= LARGE else 5
    low = np.ascontiguousarray(short.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    high = np.zeros(len(short) + (1 << 48 - 8 * width), np.uint8)
    high[(short >> np.int64(8 * width)) + np.arange(len(short))] = 1
    return np.int32(len(short)).tobytes() + low.tobytes() + np.packbits(high).tobytes()


def _unpacked(raw: pa.Buffer) -> np.ndarray:
    all_ = np.frombuffer(raw, np.uint8)
    n = int(all_[:4].view(np.int32)[0])
    width = 4 if n >= LARGE else 5
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = all_[4 : 4 + n * width].reshape(width, n).T
    high = np.flatnonzero(np.unpackbits(all_[4 + n * width :], count=n + (1 << 48 - 8 * width))) - np.arange(n)
    return low.view("<i8").ravel() | high << np.int64(8 * width)


def small(df: DataFrame) -> DataFrame:
    """df marked to be broadcast if it is short enough."""
    return F.broadcast(df) if df.limit(SENT_KEYS + 1).count() <= SENT_KEYS else df


def _sets_of(df: DataFrame, needs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(part, a, b, codes): the sets of the needed (key, part), from the document that stands for each key.

    Where they go is sent to the scan of documents while it is short; beyond, the sets are joined with it by shuffling.
    """
    spark = df.sparkSession
    wanted = needs.join(reps, "key").select("key", "part", F.col("rep").alias("doc_id"))
    first = wanted.limit(SENT_KEYS + 1).toArrow()
    few = first.num_rows <= SENT_KEYS
    if few:
        key, part, rep = (first.column(c).to_numpy() for c in ("key", "part", "doc_id"))
        order = np.argsort(key, kind="stable")
        sent = spark.sparkContext.broadcast((key[order], part[order], rep[order], np.unique(rep)))
        picked = df
    else:
        sent = None
        picked = df.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    names = ["part", "a", "b", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if sent is not None:
                known, to, rep, ids = sent.value
                own = b.column(0).to_numpy(zero_copy_only=False)
                b = b.filter(pa.array(ids[np.minimum(np.searchsorted(ids, own), len(ids) - 1)] == own if len(ids) else np.zeros(len(own), np.bool_)))
            for i, j, _, codes, owner in _batch(b.column(1), n, None):
                key, size = _keys(codes, owner, j - i)
                edge = np.concatenate([[0], np.cumsum(size)])
                at = np.flatnonzero(size)
                parts = np.zeros(len(at), np.int32)
                if sent is not None:
                    low = np.searchsorted(known, key[at])
                    times = np.searchsorted(known, key[at], side="right") - low
                    entry = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    at = np.repeat(at, times)
                    same = rep[entry] == b.column(0).slice(i, j - i).to_numpy()[at]
                    at, parts = at[same], to[entry[same]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(key[at]), pa.nulls(len(at), pa.int64()), pa.array([_packed(codes[edge[x] : edge[x + 1]]) for x in at], pa.binary())], names)

    own = picked.mapInArrow(lean(run), "part int, a long, b long, codes binary")
    return own if few else own.drop("part").join(needs.withColumnRenamed("key", "a"), "a").select(*names)


def placed_pairs(pairs: DataFrame, parts: int) -> DataFrame:
    """(part, a, b): where each pair of keys is verified, so that a record is sent to few parts however many partners it has."""
    ends = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hub = ends.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("hub"))
    hub = small(written(hub, "jaccard-hubs"))
    grouped = (pairs.join(hub.withColumnRenamed("key", "a").withColumnRenamed("hub", "ha"), "a")
               .join(hub.withColumnRenamed("key", "b").withColumnRenamed("hub", "hb"), "b")
               .select("a", "b", F.least("ha", "hb").alias("g")))
    split = grouped.groupBy("g").agg(F.ceil(F.count("*") / GROUP_PAIRS).alias("splits"))
    split = small(written(split.where("splits > 1"), "jaccard-splits"))
    return written(grouped.join(split, "g", "left").withColumn("splits", F.coalesce("splits", F.lit(1))).select(F.pmod(F.xxhash64("g", F.pmod(F.hash("a"), F.col("splits"))), F.lit(parts)).cast("int").alias("part"), "a", "b"), "jaccard-placed")


class _Links:
    """The links of one task's sets, and the sets that chains of links join."""

    def __init__(self, keys: np.ndarray, members: dict[int, int]) -> None:
        self.keys, self.links = keys, np.zeros(len(keys), np.int64)
        n = np.array([members[k] for k in keys.tolist()], np.int64)
        self.members, self.shared = np.abs(n), n < 0
        self.label, self.of = np.arange(len(keys)), {}

    def add(self, k: int, partners: np.ndarray) -> np.ndarray:
        """Links k with its partners; gives those of them that a document has beside another set, if k is such too."""
        x, y = int(np.searchsorted(self.keys, k)), np.searchsorted(self.keys, partners)
        self.links[x] += self.members[y].sum()
        self.links[y] += self.members[x]
        labels = np.unique(np.append(self.label[y], self.label[x])).tolist()
        if len(labels) > 1:
            own = sorted((self.of.pop(m, [m]) for m in labels), key=len)
            root = self.label[own[-1][0]]
            for less in own[:-1]:
                self.label[less] = root
                own[-1] += less
            self.of[int(root)] = own[-1]
        return partners[self.shared[y]] if self.shared[x] else partners[:0]

    def rows(self) -> pa.RecordBatch:
        use = self.links > 0
        return pa.RecordBatch.from_arrays([pa.array(c[use]) for c in (self.keys, self.keys[self.label], self.links)], ["a", "b", "links"])


def _verify(docs: DataFrame, scanned: DataFrame, pairs: DataFrame, reps: DataFrame, t: float, n: int, parts: int, members: DataFrame | None = None) -> DataFrame:
    """(a, b, overlap, size_a, size_b) of the pairs that reach the threshold, each verified once.

    With members, the number of documents of each key, less than 0 if one of them has another set too: (a, b, links),
    for each task and key the linked documents and a key that stands for all that are connected, and rows without links
    for the pairs of two keys whose number is less than 0.
    """
    placed = placed_pairs(pairs, parts)
    near = written(_near(placed, scanned, reps, t, parts), "jaccard-near")
    done(placed)
    needs = near.select("part", F.explode(F.array("a", "b")).alias("key")).distinct()
    rows = _sets_of(docs, needs, reps, n).unionByName(near.select("part", "a", "b", F.lit(None).cast("binary").alias("codes")))
    counted = members is not None
    if counted:
        rows = rows.unionByName(needs.join(members, "key").select("part", F.col("key").alias("a"), F.col("n").alias("b"), F.lit(b"").alias("codes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        found: list[tuple] = []
        number: dict[int, int] = {}
        links = None

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = pc.fill_null(pc.equal(pc.binary_length(b.column("codes")), 0), False)
                number.update(zip(b.column("a").filter(own).to_pylist(), b.column("b").filter(own).to_pylist()))
                yield b.filter(pc.invert(own))

        for k, partners in by_first(seen() if counted else batches, sets, lambda c: _unpacked(c.as_buffer())):
            own = sets[k]
            near = np.array([len(sets[int(p)]) for p in partners])
            flat = np.concatenate([sets[int(p)] for p in partners])
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat((own[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(near)[:-1]]))
            good = both >= t * (len(own) + near - both) - 1e-9
            if good.any() and counted:
                links = links or _Links(np.sort(np.array(list(sets), np.int64)), number)
                shared = links.add(k, partners[good])
                if len(shared):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shared), k)), pa.array(shared), pa.nulls(len(shared), pa.int64())], ["a", "b", "links"])
            elif good.any():
                found.append((np.full(int(good.sum()), k), partners[good], both[good], np.full(int(good.sum()), len(own)), near[good]))
        if links is not None:
            yield links.rows()
        if found:
            cols = [np.concatenate(c).astype(np.int64) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "overlap", "size_a", "size_b"])

    return moved(rows, parts).mapInArrow(lean(run), "a long, b long, links long" if counted else "a long, b long, overlap long, size_a long, size_b long")


def by_first(batches: Iterator[pa.RecordBatch], sets: dict[int, np.ndarray], read) -> Iterator[tuple[int, np.ndarray]]:
    """Fills sets from the rows (part, key, null, codes) and gives each first key of the pairs (part, a, b, null) with up to 2000 partners."""
    firsts, seconds = [], []
    for x in batches:
        whole = x.column("codes").is_valid()
        own = x.filter(whole)
        for k, c in zip(own.column("a").to_pylist(), own.column("codes")):
            if k not in sets:
                sets[k] = read(c)
        rest = x.filter(pc.invert(whole))
        firsts.append(rest.column("a").to_numpy())
        seconds.append(rest.column("b").to_numpy())
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (firsts, seconds))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
    for lo, hi in zip(start, [*start[1:], len(a)]):
        for at in range(lo, hi, 2000):
            yield int(a[lo]), b[at : min(at + 2000, hi)]


def _near(placed: DataFrame, scanned: DataFrame, reps: DataFrame, t: float, parts: int) -> DataFrame:
    """(part, a, b) of the pairs whose sketches don't rule out the threshold: the suffix filter.

    The differences of counts over hash ranges, whatever they are clipped at, sum up to no more than the n-grams that
    only one of the two has.
    """
    needs = placed.select("part", F.explode(F.array("a", "b")).alias("key")).distinct().join(reps, "key")
    own = scanned.where("key IS NOT NULL").select("key", F.col("doc_id").alias("rep"), "sketch", "size")
    sent = needs.join(own, ["key", "rep"]).select("part", F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), F.concat(F.unhex(F.lpad(F.hex("size"), 8, "0")), "sketch").alias("codes"))
    rows = sent.unionByName(placed.select("part", "a", "b", F.lit(None).cast("binary").alias("codes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[int, tuple[int, dict[int, np.ndarray]]] = {}
        part = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal part
            for b in batches:
                part = b.column("part")[0] if part is None and len(b) else part  # all rows of a task have the same
                yield b

        def read_one(c: pa.Scalar) -> tuple[int, dict[int, np.ndarray]]:
            raw = c.as_buffer()
            counts = _from_sketch(raw.slice(4)).astype(np.int16)
            return int.from_bytes(raw.slice(0, 4).to_pybytes(), "big"), {len(counts): counts}

        def at(k: int, ranges: int) -> np.ndarray:
            by = sketches[k][1]
            if ranges not in by:
                by[ranges] = np.minimum(at(k, 2 * ranges).reshape(-1, 2).sum(axis=1, dtype=np.int16), 3)  # as if counted so
            return by[ranges]

        for k, partners in by_first(seen(), sketches, read_one):
            size, by = sketches[k]
            ranges = max(by)
            theirs = np.array([max(sketches[int(p)][1]) for p in partners])
            keep = np.zeros(len(partners), np.bool_)
            for m in np.unique(np.minimum(theirs, ranges)):
                those = np.flatnonzero(np.minimum(theirs, ranges) == m)
                for lo in range(0, len(those), max(1, 4_000_000 // int(m))):
                    some = those[lo : lo + max(1, 4_000_000 // int(m))]
                    near = np.array([sketches[int(p)][0] for p in partners[some]])
                    most = size + near - 2 * np.ceil(t / (1 + t) * (size + near) - 1e-9)
                    keep[some] = np.abs(np.stack([at(int(p), int(m)) for p in partners[some]]) - at(k, int(m))).sum(axis=1, dtype=np.int64) <= most
            if keep.any():
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array(np.full(n, k)), pa.array(partners[keep])], ["part", "a", "b"])

    return moved(rows, parts).mapInArrow(lean(run), "part int, a long, b long")


def records(df: DataFrame, t: float = THRESHOLD, n: int = N, counted: bool = False, balled: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, key) of all documents with a word, and the verified pairs of keys, or what they add up to. All are tables in the shared folder.

    With balled, (key, ball, d, n) too: pairs that a hub tells of aren't among the verified ones.
    """
    spark = df.sparkSession
    if not 0 < t <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    docs = no_clash(df, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = written(docs, "jaccard-documents")
    scanned = written(_scan(docs, n), "jaccard-scan")
    ids = scanned.where("key IS NOT NULL").select("doc_id", "key").distinct()
    *rarity, total = _rarity(scanned)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_WORDS)
    reps = ids.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    # the documents that stand for sets of several: sent while few, and else copies meet like others and are made distinct later
    copied = reps.where("n > 1").orderBy("key").select("key", "rep").limit(SENT_KEYS + 1).toArrow()
    known = [copied.column(c).to_numpy() if copied.num_rows <= SENT_KEYS else np.zeros(0, np.int64) for c in ("key", "rep")]
    sent = spark.sparkContext.broadcast((rarity, *known))
    shared = _shared(moved(_prefixes(docs, sent, n, t, parts), parts), t, parts)
    met = written(_pointed(moved(shared, parts), t, parts), "jaccard-met")
    balls, sent_balls = None, (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    if balled:
        balls = _balls(docs, scanned, met, reps, _several(ids), t, n, parts)
        key, ball, d = (c.to_numpy() for c in balls.select("key", "ball", "d").toArrow().columns)
        order = np.argsort(key)
        sent_balls = key[order], np.unique(ball, return_inverse=True)[1][order].astype(np.int32), d[order].astype(np.int32)
    pairs = written(_candidates(moved(met, parts), t, sent_balls), "jaccard-pairs")
    done(met)
    members = None
    if counted:
        members = reps.join(small(_several(ids).select("key").distinct()).withColumn("other", F.lit(True)), "key", "left").select("key", F.when(F.col("other"), -F.col("n")).otherwise(F.col("n")).alias("n"))
    verified = written(_verify(docs, scanned, pairs, reps.select("key", "rep"), t, n, parts, members), "jaccard-verified")
    done(pairs)
    return ids, verified, balls


def _several(ids: DataFrame) -> DataFrame:
    """(doc_id, key) of the documents that have several sets."""
    return ids.join(ids.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id"), "doc_id")


def _spokes(balls: DataFrame) -> DataFrame:
    """(a, b): each record of a ball with its hub, which it is linked with."""
    return balls.where("key <> ball").select(F.col("ball").alias("a"), F.col("key").alias("b"))


def linked(df: DataFrame, t: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, group_id, class_id, links) of all documents, each once; a doc_id with several sets has a row for each.

    ``links`` is how many documents reach the threshold, copies included: the document's rows in ``all_pairs``, which
    are counted as they are verified. ``group_id`` is the least doc_id of an equal set, ``class_id`` the least one that a
    chain of links leads to. A document without a word is its own class without links.
    """
    ids, found, balls = records(df, t, n, counted=True, balled=True)
    keys = ids.groupBy("key").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n"))
    parts = components(found.where("links IS NOT NULL AND a <> b").select("a", "b").union(_spokes(balls)))
    links = found.where("links IS NOT NULL").select(F.col("a").alias("key"), "links").union(_within(balls, t)).groupBy("key").agg(F.sum("links").alias("others"))
    keys = written(keys.join(links, "key", "left").join(parts, "key", "left").select("key", "group_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("least", "key").alias("part")), "jaccard-keys")
    least = keys.groupBy("part").agg(F.min("group_id").alias("class_id"))
    # a document isn't linked with itself by another of its sets
    pairs, several = found.where("links IS NULL").select("a", "b"), _several(ids)
    ends = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = ends.join(several.select("doc_id", F.col("key").alias("a")), "a").join(several.select("doc_id", F.col("key").alias("b")), ["doc_id", "b"]).groupBy("doc_id", F.col("a").alias("key")).agg(F.count("*").alias("self"))
    rows = ids.join(keys.join(least, "part"), "key").join(small(written(own, "jaccard-own")), ["doc_id", "key"], "left")
    rows = rows.select("doc_id", "group_id", "class_id", (F.col("links") - F.coalesce("self", F.lit(0))).alias("links"))
    rest = no_clash(df, "doc_id").select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct().join(ids.select("doc_id"), "doc_id", "left_anti")
    return rows.unionByName(rest.select("doc_id", F.col("doc_id").alias("group_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def join(df: DataFrame, t: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, other_id, jaccard): see above."""
    ids, pairs, _ = records(df, t, n)
    reps = ids.groupBy("key").agg(F.min("doc_id").alias("rep"))
    copies = ids.join(reps, "key").where("doc_id <> rep").select(F.col("rep").alias("doc_id"), F.col("doc_id").alias("other_id"), F.lit(1.0).alias("jaccard"))
    near = (pairs.join(reps.select(F.col("key").alias("a"), F.col("rep").alias("x")), "a")
            .join(reps.select(F.col("key").alias("b"), F.col("rep").alias("y")), "b")
            .select(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("other_id"),
                    F.round(F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")), 6).alias("jaccard")).where("doc_id <> other_id"))
    return copies.unionByName(near)


def all_pairs(df: DataFrame, t: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, other_id, jaccard) of all pairs of documents, each copy with each copy and with all near duplicates.

    The verified pairs of sets are joined with the ids of either set. A doc_id with several texts is compared by each of
    its sets, so a pair may have several rows. A group of m copies gives m (m - 1) / 2 rows, however large m is.
    """
    ids, pairs, _ = records(df, t, n)
    one, other = ids.withColumnRenamed("doc_id", "x"), ids.withColumnRenamed("doc_id", "y")
    copies = one.join(other, "key").where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    near = (pairs.select("a", "b", F.round(F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")), 6).alias("jaccard"))
            .join(one.withColumnRenamed("key", "a"), "a").join(other.withColumnRenamed("key", "b"), "b").where("x <> y")
            .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "jaccard"))
    return copies.unionByName(near).toDF("doc_id", "other_id", "jaccard")


def components(pairs: DataFrame) -> DataFrame:
    """(key, least): the least key of each connected part of (a, b), by label propagation with pointer jumping.

    Each round's labels are a table in the shared folder; rounds grow with the logarithm of a part's diameter.
    """
    edges = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("least")), "jaccard-labels")
    while True:
        around = edges.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("least").alias("near"))
        lower = labels.join(around, "key").select("key", "least", F.least("least", "near").alias("near"))
        jump = labels.select(F.col("key").alias("near"), F.col("least").alias("far"))
        new = written(lower.join(jump, "near", "left").select("key", F.least("near", F.coalesce("far", "near")).alias("least"), F.col("least").alias("was")), "jaccard-labels")
        if new.where("least <> was").limit(1).count() == 0:
            return new.select("key", "least")
        labels = new.select("key", "least")


def keep_one(df: DataFrame, t: float = THRESHOLD, n: int = N) -> DataFrame:
    """df with one document of each group of near duplicates: the one with the least doc_id.

    A group is a connected part of the join's pairs, exact copies included. Documents that are in no pair stay, those
    with null doc_id or without a word too. Rows that repeat both doc_id and text are one document and leave one row. A
    doc_id that has several texts goes only if it is the least of none of its groups. Documents aren't shuffled: what
    goes is a list of ids, sent to every task while it is short enough and joined by shuffling else.
    """
    ids, pairs, balls = records(df, t, n, balled=True)
    placed = ids.join(components(pairs.select("a", "b").union(_spokes(balls))), "key", "left").select("doc_id", F.coalesce("least", "key").alias("part"))
    first = placed.groupBy("part").agg(F.min("doc_id").alias("first"))
    gone = written(placed.join(first, "part").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("first")).alias("stays")).where("NOT stays").select("doc_id"), "jaccard-gone")
    often = written(no_clash(df, "doc_id").where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-often")
    left = df.join(small(gone), "doc_id", "left_anti")
    once = left.join(small(often), "doc_id", "left_anti")
    more = left.join(small(often), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(more).select(*[F.col(f"`{c}`") for c in df.columns])

"""Language-model scoring by context-tree weighting.

A byte is eight binary decisions, each with its own context tree over the bytes before it, up to ``DEPTH``. A node's
counts of zeros and ones give a Krichevsky-Trofimov estimate; its weighted probability is half that estimate and half
the product of its children's. From the weighted probabilities of the whole corpus follows each decision's mixture over
all depths, so a text's code length is a sum over its (DEPTH + 1)-grams.

1. Each task counts its bytes' (DEPTH + 1)-grams; counts are added up by the ``ROOT`` latest context bytes and kept as a
   table in the shared folder. No sample: every byte of every document is counted, and what is gathered grows with the
   input.
2. The contexts that share these bytes are a subtree of each tree, weighted apart from others. What lies nearer to the
   root is summed up by nodes of ROOT - 1 bytes, of which text has some thousands (there can't be more than 2^16 with 255
   places each), and goes to the driver and back to every task.
3. The model is one code length for each gram seen, in 2^-16 bits. It is kept by the same bytes and never sent whole
   unless it has ``SENT`` grams at most. The distinct grams of a part of the documents (a pack: what one task reads) meet
   their code lengths there; these go back in order, without the grams, to where the pack's texts are gathered, whose
   grams are looked up and summed. Small models that are sent give the same numbers.

Texts are scored by the model of the corpus that they are part of; contexts that start before a text are zero bytes.

Packs are told by the task that reads them, so a table that comes out of a shuffle is written first.

Defined results: a null text has null length and score; an empty one 0 bytes, 0 bits and null bits per byte. Whole texts
count, at any length. Repeated rows count as often as they occur and score alike. An empty table gives an empty one.
Other columns are ignored. Bytes in contexts that the model has never seen count 8 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm._common import buffers, chunks, done, lean, mix, no_clash, written

DEPTH, ROOT = 6, 3
#: Grams of a model that is sent to every task, 11 bytes each.
SENT = 2_000_000
#: Grams of chunks that a task holds, or as many as it has found so far, before it adds them up.
HELD = 1_500_000
_UNIT = 65536.0
_HALF = float(np.log(0.5))
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5."""
    x = np.asarray(x, np.float64) - 1
    a = np.full_like(x, _LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        a += c / (x + k)
    t = x + 7.5
    return 0.9189385332046727 + (x + 0.5) * np.log(t) - t + np.log(a)


_TABLE = 1 << 14
_HALVES, _WHOLES = lgamma(np.arange(_TABLE) + 0.5), lgamma(np.arange(_TABLE) + 1.0)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to n0 zeros and n1 ones."""
    n0, n1 = np.asarray(n0, np.int64), np.asarray(n1, np.int64)
    n = n0 + n1
    top = _TABLE - 1
    out = _HALVES[np.minimum(n0, top)] + _HALVES[np.minimum(n1, top)] - _WHOLES[np.minimum(n, top)] - 2 * 0.5723649429247001
    large = np.flatnonzero(n > top)
    if len(large):
        a, b = n0[large].astype(np.float64), n1[large].astype(np.float64)
        out[large] = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - 2 * 0.5723649429247001
    return out


def codes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The gram of each byte: its context, the latest byte highest, then the byte itself."""
    out = data.astype(np.int64)
    heads = offs[:-1][np.diff(offs) > 0]
    for back in range(1, DEPTH + 1):
        before = np.zeros(len(data), np.int64)
        before[back:] = data[:-back] if len(data) > back else data[:0]
        for k in range(back):  # bytes of the text before don't count
            at = heads + k
            before[at[at < len(data)]] = 0
        # a text shorter than this context ends before it; its next text's heads are cleared above
        out |= before << np.int64(8 * (DEPTH + 1 - back))
    return out


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, ascending, and their counts."""
    g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    if not len(g):
        return g, n
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[edge], np.add.reduceat(n, edge, dtype=np.int64)


def distinct(columns: Iterator[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of texts, ascending, and how often each occurs."""
    total = (np.zeros(0, np.int64), np.zeros(0, np.int32))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for col in columns:
        data, offs = buffers(col)
        for i, j in chunks(offs):
            c = codes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            c.sort()
            if not len(c):
                continue
            edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            held.append((c[edge], np.diff(np.append(edge, len(c))).astype(np.int32)))
            rows += len(edge)
            if rows > max(HELD, len(total[0])):
                total, held, rows = _add([total, *held]), [], 0
    return _add([total, *held])


def _split(g: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending grams by the part that their latest bytes go to: an order, and the parts' edges in it."""
    lead = g >> np.int64(8 * (DEPTH + 1 - ROOT))
    edge = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]])) if len(g) else np.zeros(0, np.int64)
    part = np.repeat((mix(lead[edge].astype(np.uint64)) % np.uint64(parts)).astype(np.int32), np.diff(np.append(edge, len(g))))
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def pack(g: np.ndarray) -> bytes:
    """Ascending grams as steps of one, three or seven bytes, each kind apart."""
    step = np.diff(g, prepend=0)
    kind = (step >= 1 << 8).astype(np.uint8) + (step >= 1 << 24)
    raw = step.astype("<i8").view(np.uint8).reshape(-1, 8)
    marks = np.packbits(np.stack([kind > 0, kind > 1], axis=1).ravel())
    return b"".join([np.int64(len(g)).tobytes(), marks.tobytes(), *[np.ascontiguousarray(raw[kind == k, :w].T).tobytes() for k, w in enumerate((1, 3, 7))]])


def unpack(raw: pa.Buffer) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8)
    n = int(flat[:8].view(np.int64)[0])
    at = 8 + (2 * n + 7) // 8
    kind = np.unpackbits(flat[8:at], count=2 * n).reshape(n, 2).sum(axis=1)
    step = np.zeros((n, 8), np.uint8)
    for k, w in enumerate((1, 3, 7)):
        those = np.flatnonzero(kind == k)
        step[those, :w] = flat[at : at + len(those) * w].reshape(w, len(those)).T
        at += len(those) * w
    return np.cumsum(step.view("<i8").ravel())


def _small(n: np.ndarray) -> bytes:
    """Counts, one byte each, and those of 255 and more in full behind them."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype(np.int64).tobytes()


def _from_small(raw: pa.Buffer, size: int) -> np.ndarray:
    n = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, np.int64, offset=size) if raw.size > size else 0
    return n


def _three(bits: np.ndarray) -> bytes:
    """Code lengths in 2^-16 bits, three bytes each; none reaches 256 bits."""
    fixed = np.minimum(np.rint(bits * _UNIT), 2**24 - 1).astype("<u4")
    return np.ascontiguousarray(fixed.view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def _from_three(raw: pa.Buffer) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8).reshape(3, -1)
    return flat[0] + flat[1].astype(np.uint32) * np.uint32(256) + flat[2].astype(np.uint32) * np.uint32(65536)


def counts(df: DataFrame, parts: int) -> DataFrame:
    """(part, grams, n): packed grams and their counts, one row for each task and part, added up by ``_added``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = distinct(b.column(0) for b in batches)
        order, edge = _split(g, parts)
        for p in np.flatnonzero(np.diff(edge)):
            x = order[edge[p] : edge[p + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pack(g[x])], pa.binary()), pa.array([_small(n[x])], pa.binary())], ["part", "grams", "n"])

    return df.mapInArrow(lean(run), "part int, grams binary, n binary")


def _added(df: DataFrame, parts: int) -> DataFrame:
    """One row for each part: adds up the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for k, g, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                own = by.setdefault(k, [])
                grams = unpack(g.as_buffer())
                own.append((grams, _from_small(n.as_buffer(), len(grams))))
                if len(own) > 64:  # keeps what is held near the size of the sum
                    by[k] = [_add(own)]
        for k, own in by.items():
            g, n = _add(own)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(g)], pa.binary()), pa.array([_small(n)], pa.binary())], ["part", "grams", "n"])

    return df.repartitionById(parts, F.col("part")).mapInArrow(lean(run), "part int, grams binary, n binary")


class Tree:
    """The contexts of grams with some latest bytes in common, down to ROOT - 1 bytes.

    Level d has the distinct (context of d bytes, byte), ascending, with counts and the place of each in the level above.
    The eight decisions have trees of their own, which are weighted one after the other.
    """

    def __init__(self, g: np.ndarray, n: np.ndarray):
        self.keys, self.n, self.up = {DEPTH: g}, {DEPTH: n}, {}
        for d in range(DEPTH - 1, ROOT - 2, -1):
            low = self.keys[d + 1]
            key, self.up[d + 1] = np.unique(low >> np.int64(16) << np.int64(8) | low & np.int64(255), return_inverse=True)
            self.keys[d], self.n[d] = key, np.bincount(self.up[d + 1], self.n[d + 1], len(key)).astype(np.int64)

    def decision(self, k: int) -> dict[int, tuple[np.ndarray, ...]]:
        """For each level: the node of each row, its bit, and the nodes' first row, zeros and ones."""
        out = {}
        for d, key in self.keys.items():
            head = key >> np.int64(8 - k)
            new = np.concatenate([[True], head[1:] != head[:-1]])
            node = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            bit = (key >> np.int64(7 - k) & np.int64(1)).astype(np.bool_)
            n1 = np.bincount(node, self.n[d] * bit, len(first)).astype(np.int64)
            out[d] = node, bit, first, np.add.reduceat(self.n[d], first) - n1, n1
        return out

    def weigh(self, levels: dict[int, tuple[np.ndarray, ...]]) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """The share that each node's own estimate has in its mixture, down to ROOT bytes, and the logarithm of the product of the children of level ROOT - 1's nodes."""
        share, below = {DEPTH: np.ones(len(levels[DEPTH][2]))}, None
        for d in range(DEPTH, ROOT - 1, -1):
            _, _, first, n0, n1 = levels[d]
            weighted = kt(n0, n1)
            if below is not None:
                own = weighted + _HALF
                weighted = np.logaddexp(own, below + _HALF)
                share[d] = np.exp(own - weighted)
            parent = levels[d - 1][0][self.up[d][first]]
            below = np.bincount(parent, weighted, len(levels[d - 1][2]))
        return share, below


def _places(tree: Tree, levels: dict, k: int) -> np.ndarray:
    """Context << 8 | place of the decision (1 to 255) of level ROOT - 1's nodes."""
    key = tree.keys[ROOT - 1][levels[ROOT - 1][2]]
    return key >> np.int64(8) << np.int64(8) | np.int64(1 << k) | (key & np.int64(255)) >> np.int64(8 - k)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Tree]]:
    for b in batches:
        for p, g, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            grams = unpack(g.as_buffer())
            yield p, Tree(grams, _from_small(n.as_buffer(), len(grams)))


def _roots(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near the root, a decision's probability of 0 and of 1 is a + b * what level ROOT gives: places, (a for 0, a for 1), b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tree in _trees(batches):
            for k in range(8):
                levels = tree.decision(k)
                _, _, _, n0, n1 = levels[ROOT - 1]
                yield pa.RecordBatch.from_arrays([pa.array(_places(tree, levels, k)), pa.array(n0), pa.array(n1), pa.array(tree.weigh(levels)[1])], ["place", "n0", "n1", "below"])

    rows = df.mapInArrow(lean(run), "place long, n0 long, n1 long, below double").groupBy("place").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toArrow()
    place = rows.column("place").to_numpy()
    order = np.argsort(place)
    place = place[order]
    n0, n1, below = (rows.column(c).to_numpy()[order] for c in ("n0", "n1", "below"))
    # levels ROOT - 1 up to 0; at each, nodes by (context, place)
    stack, key = [], place
    for d in range(ROOT - 1, -1, -1):
        own = kt(n0, n1) + _HALF
        weighted = np.logaddexp(own, below + _HALF)
        share = np.exp(own - weighted)
        total = n0 + n1 + 1.0
        higher, up = np.unique(key >> np.int64(16) << np.int64(8) | key & np.int64(255), return_inverse=True) if d else (key, np.arange(len(key)))
        stack.append((share, (n0 + 0.5) / total, (n1 + 0.5) / total, up))
        n0, n1, below = (np.bincount(up, v, len(higher)) for v in (n0, n1, weighted))
        key = higher
    a, b = np.zeros((2, len(key))), np.ones(len(key))
    for share, p0, p1, up in reversed(stack):
        a = np.stack([a[0][up] + b[up] * share * p0, a[1][up] + b[up] * share * p1])
        b = b[up] * (1 - share)
    return place, a, b


def train(df: DataFrame) -> DataFrame:
    """(part, parts, size, grams, bits): the corpus' model, packed by part; a table in the shared folder."""
    own, packs = _packs(df)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), packs)
    table = written(_added(counts(own.select("text"), parts), parts), "ctw-counts")
    sent = df.sparkSession.sparkContext.broadcast(_roots(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, a0, b0 = sent.value
        for p, tree in _trees(batches):
            bits = np.zeros(len(tree.keys[DEPTH]))
            for k in range(8):
                levels = tree.decision(k)
                share, _ = tree.weigh(levels)
                node = levels[ROOT - 1][0]
                at = np.searchsorted(place, _places(tree, levels, k))[node]
                one = levels[ROOT - 1][1]
                a, b = np.where(one, a0[1][at], a0[0][at]), b0[at]
                for d in range(ROOT, DEPTH + 1):
                    node, one, _, n0, n1 = levels[d]
                    up = tree.up[d]
                    own = (np.where(one, n1[node], n0[node]) + 0.5) / (n0 + n1 + 1.0)[node]
                    s = share[d][node]
                    a, b = a[up] + b[up] * s * own, b[up] * (1 - s)
                bits -= np.log2(a)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([parts], pa.int32()), pa.array([len(bits)], pa.int64()), pa.array([pack(tree.keys[DEPTH])], pa.binary()), pa.array([_three(bits)], pa.binary())],
                                             ["part", "parts", "size", "grams", "bits"])

    model = written(table.mapInArrow(lean(run), "part int, parts int, size long, grams binary, bits binary"), "ctw-model")
    done(table)
    return model


class Lookup:
    """Code lengths of grams: levels of hash tables, each twice as large as what it has to hold, so that most are found at once."""

    def __init__(self, grams: np.ndarray, bits: np.ndarray):
        self.levels = []
        mult = np.uint64(0x9E3779B97F4A7C15)
        while len(grams):
            size = max(6, int(2 * len(grams) - 1).bit_length())
            keys, values = np.full(1 << size, -1, np.int64), np.zeros(1 << size, np.uint32)
            at = (grams.view(np.uint64) * mult >> np.uint64(64 - size)).view(np.int64)
            keys[at], values[at] = grams, bits
            self.levels.append((mult, np.uint64(64 - size), keys, values))
            left = keys[at] != grams
            grams, bits = grams[left], bits[left]
            mult = np.uint64(int(mult) * 6364136223846793005 % 2**64 | 1)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        out = np.full(len(c), 8 * int(_UNIT), np.uint32)
        left = None
        for mult, shift, keys, values in self.levels:
            own = c if left is None else c[left]
            at = (own.view(np.uint64) * mult >> shift).view(np.int64)
            hit = keys[at] == own
            if left is None:
                out[hit] = values[at[hit]]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = values[at[hit]]
                left = left[~hit]
            if not len(left):
                break
        return out


def score_texts(col: pa.Array, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and code length in bits of each text."""
    data, offs = buffers(col)
    bits = np.zeros(len(offs) - 1)
    for i, j in chunks(offs):
        total = np.concatenate([[0], np.cumsum(lookup(codes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])), dtype=np.int64)])
        own = offs[i : j + 1] - offs[i]
        bits[i:j] = (total[own[1:]] - total[own[:-1]]) / _UNIT
    return np.diff(offs), bits


def _scored(ids: pa.Array, col: pa.Array, lookup: Lookup) -> pa.RecordBatch:
    n, bits = score_texts(col, lookup)
    null = col.is_null().to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64(), mask=null), pa.array(bits, mask=null), pa.array(bits / np.maximum(n, 1), mask=null | (n == 0))], ["doc_id", "n_bytes", "bits", "bits_per_byte"])


_RESULT = "doc_id long, n_bytes long, bits double, bits_per_byte double"
_lookups: dict[str, Lookup] = {}


def _packs(df: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, pack) with the number of the task that reads a row, and how many these are."""
    own = no_clash(df, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if "Exchange" in own._jdf.queryExecution().executedPlan().toString():
        own = written(own, "ctw-documents")
    own = own.withColumn("pack", F.spark_partition_id())
    return own, max(1, own._jdf.queryExecution().toRdd().getNumPartitions())


def score(df: DataFrame, model: DataFrame, sent_grams: int = SENT) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of all rows."""
    size, parts = model.agg(F.sum("size"), F.max("parts")).first()
    spark = df.sparkSession
    if (size or 0) <= sent_grams:
        table = model.select("grams", "bits").toArrow()
        grams = np.concatenate([unpack(g.as_buffer()) for g in table.column("grams")] or [np.zeros(0, np.int64)])
        sent = spark.sparkContext.broadcast((grams, np.concatenate([_from_three(g.as_buffer()) for g in table.column("bits")] or [np.zeros(0, np.uint32)])))
        own_id = uuid.uuid4().hex

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if own_id not in _lookups:  # once a worker, not once a task
                _lookups.clear()
                _lookups[own_id] = Lookup(*sent.value)
            for b in batches:
                yield _scored(b.column(0), b.column(1), _lookups[own_id])

        return no_clash(df, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(alone), _RESULT)

    own, packs = _packs(df)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: list[int] = []

        def texts() -> Iterator[pa.Array]:
            for b in batches:
                if len(b) and not number:
                    number.append(b.column(2)[0].as_py())
                yield b.column(1)

        g, _ = distinct(texts())
        order, edge = _split(g, parts)
        for p in np.flatnonzero(np.diff(edge)):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array(number, pa.int32()), pa.array([pack(g[order[edge[p] : edge[p + 1]]])], pa.binary()), pa.nulls(1, pa.binary())], ["part", "pack", "grams", "bits"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting: list[tuple[int, int, pa.Buffer]] = []

        def found(p: int, number: int, raw: pa.Buffer) -> pa.RecordBatch:
            g = unpack(raw)
            grams, bits = known.get(p, (np.zeros(0, np.int64), np.zeros(0, np.uint32)))
            out = np.full(len(g), 8 * int(_UNIT), np.uint32)
            if len(grams):
                at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                out = np.where(grams[at] == g, bits[at], out)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([p], pa.int32()), pa.array([_three(out / _UNIT)], pa.binary())], ["pack", "part", "bits"])

        for b in batches:
            for p, number, g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if number is None:
                    known[p] = unpack(g.as_buffer()), _from_three(x.as_buffer())
                elif p in known:
                    yield found(p, number, g.as_buffer())
                else:
                    waiting.append((p, number, g.as_buffer()))
        for w in waiting:
            yield found(*w)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[pa.RecordBatch] = []
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            has = b.column(3).is_valid()
            for p, x in zip(b.column(3).drop_null().to_pylist(), b.filter(has).column(4)):
                bits[p] = _from_three(x.as_buffer())
            texts.append(b.filter(pc.invert(has)).select([1, 2]))
        g, _ = distinct(t.column(1) for t in texts)
        order, edge = _split(g, parts)
        flat = np.concatenate([bits.get(p, np.zeros(0, np.uint32)) for p in range(parts)])
        if any(len(bits.get(p, ())) != edge[p + 1] - edge[p] for p in range(parts)):
            raise RuntimeError("a pack's texts changed between two reads")
        lookup = Lookup(g[order], flat)
        for t in texts:
            yield _scored(t.column(0), t.column(1), lookup)

    asked = own.mapInArrow(lean(ask), "part int, pack int, grams binary, bits binary").unionByName(model.select("part", F.lit(None).cast("int").alias("pack"), "grams", "bits"))
    answers = asked.repartitionById(parts, F.col("part")).mapInArrow(lean(answer), "pack int, part int, bits binary")
    both = own.select("pack", "doc_id", "text", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("bits")).unionByName(answers.selectExpr("pack", "cast(null as long) doc_id", "cast(null as string) text", "part", "bits"))
    return both.repartitionById(packs, F.col("pack")).mapInArrow(lean(add), _RESULT)


def query(df: DataFrame) -> DataFrame:
    """Code lengths of all documents under the model of all documents."""
    return score(df, train(df))

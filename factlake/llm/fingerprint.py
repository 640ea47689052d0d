"""Document fingerprints: bottom-k sketches of word shingle hashes.

The k smallest distinct 64-bit shingle hashes of a text. Sketches merge by keeping the k smallest of their union, so the
sketch of a whole equals the merged sketches of its parts. They estimate

* the distinct shingle count: exact below k, else ``(k - 1) / u`` with u the k-th smallest hash as a share of 2^63;
* resemblance (Jaccard): the share of the union's k smallest that both have;
* containment of a in b: ``resemblance * |a or b| / |a|`` with the counts so estimated.

``query`` sketches every document and puts near ones in classes: documents are near if their estimated resemblance is at
least ``NEAR``, whatever their sources, and a class is what chains of near documents join. Documents of equal sketches
are one group, known by its least doc_id. Candidates share one of ``BANDS`` keys, each the smallest hashes of all
shingles under ``ROWS`` permutations: a pair of resemblance 0.6 is one with 97 of 100 chances, and more alike ones more
surely. All candidates of a key are in one task, which holds each group against those that no chain has reached yet, so
a class of m groups takes some m comparisons, not m^2 / 2, and the classes are those of all pairs; ``near`` lists these.
Candidates whose rarest hashes differ can't be near and aren't compared. Documents are also held against the merged
sketch of their source, which tells a document that makes up much of its source; of a large source a document is a part
too small for any sketch of fixed size, and the estimates are 0.

Defined results: a null or empty text, or one without a word, has an empty sketch, count 0, resemblance 0 and
containment 0, and is in no class; neither is a row without doc_id. A text of fewer words than a shingle has one shingle: all its words. Texts are hashed whole. Repeated
rows each get their row and change no merged sketch. A null source is a source of its own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm import jaccard
from factlake.llm._common import buffers, chunks, distinct_per_doc, lean, lists, mix, ngrams, no_clash, words, written

K, SHINGLE = 128, 5
NEAR, BANDS, ROWS = 0.6, 8, 2
#: Sources whose sketches (1 KB each), and groups with company which, are sent to every task; beyond, Spark joins by shuffling.
SENT_SOURCES, SENT_NEAR = 20_000, 1_000_000
_SPACE = float(2**63)


def sketch_batch(col: pa.Array, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of a batch of texts: flat ascending hashes and the length of each."""
    data, offs = buffers(pc.utf8_lower(col))
    flat, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in chunks(offs):
        part = offs[i : j + 1] - offs[i]
        h, doc, _, _ = words(data[offs[i] : offs[j]], part)
        g, owner = ngrams(h, doc, j - i, n)
        g, owner = distinct_per_doc((g >> np.uint64(1)).astype(np.int64), owner)
        size = np.bincount(owner, minlength=j - i)
        rank = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
        flat.append(g[rank < k])
        counts.append(np.minimum(size, k))
    return np.concatenate(flat), np.concatenate(counts)


def sketches(df: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """(doc_id, source, sketch) of (doc_id, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, counts = sketch_batch(b.column(2), k, n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(pa.array(flat), counts)], ["doc_id", "source", "sketch"])

    return no_clash(df, "doc_id", "source", "text").mapInArrow(lean(run), "doc_id long, source string, sketch array<long>")


def merge(sketches_df: DataFrame, by: str, k: int = K) -> DataFrame:
    """(by, merged): one sketch for each value, merged within tasks first and then across them."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for b in batches:
            keys, col = b.column(0).dictionary_encode(), b.column(1)
            codes = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
            names = [*keys.dictionary.to_pylist(), None]
            flat, lengths = col.flatten().to_numpy(), np.diff(col.offsets.to_numpy())
            owner = np.repeat(codes, lengths)
            for c in np.unique(codes):
                best[names[c]] = np.unique(np.concatenate([best.get(names[c], np.zeros(0, np.int64)), flat[owner == c]]))[:k]
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array([v.tolist() for v in best.values()], pa.list_(pa.int64()))], [by, "merged"])

    schema = f"{by} string, merged array<long>"
    parts = no_clash(sketches_df, by, "sketch").withColumn(by, F.col(by).cast("string")).mapInArrow(lean(fold), schema)
    # a tree of two levels: no row gathers the sketches of more than 64 or a 64th of all tasks
    some = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("merged")))), 1, k).alias("merged")
    return parts.groupBy(by, (F.spark_partition_id() % 64).alias("branch")).agg(some).groupBy(by).agg(some)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated distinct shingles of a sketch."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / (F.element_at(s, -1).cast("double") / _SPACE))


def union(a: Column, b: Column, k: int = K) -> Column:
    """The merged sketch of two."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard of two sketches; 0 if both are empty."""
    both = union(a, b, k)
    return F.when(F.size(both) == 0, 0.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 0 for an empty a."""
    share = resemblance(a, b, k) * distinct_count(union(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.least(F.lit(1.0), share))


_rng = np.random.Generator(np.random.PCG64(41))
_ADD, _TIMES = (_rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(2))


def band_keys(g: np.ndarray, size: np.ndarray) -> np.ndarray:
    """BANDS keys of each document with a shingle, from its distinct hashes (documents in order)."""
    start = (np.cumsum(size) - size)[size > 0]
    out = np.zeros((len(start), BANDS), np.uint64)
    for r in range(BANDS * ROWS):
        h = (g + _ADD[r]) * _TIMES[r]
        h ^= h >> np.uint64(29)
        least = np.minimum.reduceat(h, start) if len(start) else h[:0]
        out[:, r // ROWS] = mix(out[:, r // ROWS] * np.uint64(0xD6E8FEB86659FD93) + least + np.uint64(r + 1))
    return (out >> np.uint64(1)).astype(np.int64)


def scan(df: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """(doc_id, source, sketch, key, bands): the key tells equal sketches; it and the bands are null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = buffers(pc.utf8_lower(b.column(2)))
            for i, j in chunks(offs):
                h, doc, _, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                g, owner = ngrams(h, doc, j - i, n)
                g, owner = distinct_per_doc((g >> np.uint64(1)).astype(np.int64), owner)
                size = np.bincount(owner, minlength=j - i)
                bands = np.zeros((j - i, BANDS), np.int64)
                bands[size > 0] = band_keys(g.view(np.uint64), size)
                use = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size) < k
                counts = np.minimum(size, k)
                total = np.zeros(int(use.sum()) + 1, np.uint64)
                np.cumsum(mix(g[use].view(np.uint64)), out=total[1:])
                edge = np.concatenate([[0], np.cumsum(counts)])
                key = (mix(total[edge[1:]] - total[edge[:-1]] ^ counts.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
                part = b.slice(i, j - i)
                keep = pa.array(np.where(size > 0, key, 0), mask=size == 0)
                all_ = lists(pa.array(bands.ravel()), np.full(j - i, BANDS))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(pa.array(g[use]), counts), keep, all_], ["doc_id", "source", "sketch", "key", "bands"])

    return no_clash(df, "doc_id", "source", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(lean(run), "doc_id long, source string, sketch array<long>, key long, bands array<long>")


def _compared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[float, float, float]:
    """Resemblance, containment of a in b and of b in a, as the columns below estimate them."""
    both = np.union1d(a, b)[:k]
    common = np.intersect1d(a, b, assume_unique=True)
    share = np.count_nonzero(common <= both[-1]) / len(both)

    def count(s: np.ndarray) -> float:
        return float(len(s)) if len(s) < k else (k - 1) / (float(s[-1]) / _SPACE)

    n = count(both)
    return share, min(1.0, share * n / count(a)), min(1.0, share * n / count(b))


def _alike(a: np.ndarray, flat: np.ndarray, edge: np.ndarray, k: int) -> np.ndarray:
    """Resemblances of a to the sketches that follow each other in flat."""
    size = np.diff(edge)
    at = np.searchsorted(a, flat)
    same = a[np.minimum(at, len(a) - 1)] == flat
    seen = np.concatenate([[0], np.cumsum(same)])
    owner = np.repeat(np.arange(len(size)), size)
    # a common hash's place in the union: those up to it on either side, common ones once
    place = np.arange(len(flat)) - edge[owner] + at + 1 - (seen[:-1] - seen[edge[owner]])
    common = seen[edge[1:]] - seen[edge[:-1]]
    return np.bincount(owner[same & (place <= k)], minlength=len(size)) / np.minimum(k, len(a) + size - common)


def _parted(own: list[np.ndarray], least: float) -> np.ndarray:
    """A label for each sketch; those of different labels aren't near.

    Near ones share ``least`` of the larger one's hashes, so one at least of as many of each one's rarest as leave fewer
    than that share; such parts are labelled alike.
    """
    size = np.array([len(x) for x in own])
    owner = np.repeat(np.arange(len(own)), size)
    _, code, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    order = np.lexsort((code, n[code], owner))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    rare = order[place <= (size - np.ceil(least * size - 1e-9).astype(np.int64))[owner]]
    rare = rare[np.lexsort((owner[rare], code[rare]))]
    same = code[rare][1:] == code[rare][:-1]
    a, b = owner[rare][:-1][same], owner[rare][1:][same]
    label = np.arange(len(own))
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _met(scanned: DataFrame, parts: int) -> DataFrame:
    """(part, bucket, key): the groups that share a band, where two at least do; buckets of the same least key have the same part."""
    # bands' keys are made with the band's number, so equal ones are of the same band; one shuffle brings each one's groups together
    bands = scanned.where("key IS NOT NULL AND doc_id IS NOT NULL").select("key", F.explode("bands").alias("bucket"))
    bands = bands.select(F.pmod("bucket", F.lit(parts)).cast("int").alias("part"), "bucket", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        bucket, key = (np.concatenate(c) for c in zip(*own)) if own else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((key, bucket))
        bucket, key = bucket[order], key[order]
        new = np.ones(len(key), np.bool_)
        new[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])
        bucket, key = bucket[new], key[new]
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(key)))
        to = np.repeat((mix(key[start].view(np.uint64)) % np.uint64(parts)).astype(np.int32), n)
        use = np.repeat(n > 1, n)
        yield pa.RecordBatch.from_arrays([pa.array(to[use]), pa.array(bucket[use]), pa.array(key[use])], ["part", "bucket", "key"])

    return jaccard.moved(bands, parts).mapInArrow(lean(run), "part int, bucket long, key long")


class _Near:
    """The sketches of one task's groups, and which of them are known to be connected."""

    def __init__(self, sketches_: list[np.ndarray], k: int, least: float) -> None:
        self.sketches, self.k, self.least, self.up = sketches_, k, least, list(range(len(sketches_)))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def of(self, x: int, others: np.ndarray) -> np.ndarray:
        own = [self.sketches[y] for y in others]
        edge = np.concatenate([[0], np.cumsum([len(s) for s in own])])
        return others[_alike(self.sketches[x], np.concatenate(own), edge, self.k) >= self.least]

    def parts(self, bucket: np.ndarray) -> list[np.ndarray]:
        """The bucket's parts of two or more that may be near each other."""
        if len(bucket) <= 16:
            return [bucket]
        label = _parted([self.sketches[x] for x in bucket], self.least)
        order = np.argsort(label, kind="stable")
        return [p for p in np.split(bucket[order], np.flatnonzero(np.diff(label[order])) + 1) if len(p) > 1]

    def connect(self, left: np.ndarray) -> None:
        """Connects all of a part that a chain of near ones joins: each is held against those that aren't reached yet."""
        todo = [int(left[0])]
        while True:
            roots = np.array([self.root(x) for x in left])
            reached = np.isin(roots, [self.root(x) for x in todo])
            todo += left[reached & ~np.isin(left, todo)].tolist()
            left = left[~reached]
            while todo and len(left):
                x = todo.pop()
                near_ = self.of(x, left)
                if len(near_):
                    for y in near_.tolist():
                        self.up[self.root(y)] = self.root(x)
                    now = np.array([self.root(y) for y in left]) == self.root(x)
                    todo += left[now].tolist()
                    left = left[~now]
            if len(left) < 2:
                return
            todo = [int(left[0])]


def _in_buckets(scanned: DataFrame, k: int, least: float, run, schema: str) -> DataFrame:
    """run(near, keys, buckets) of each part's groups: the sketches of its keys, and buckets of places among them."""
    parts = int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = written(_met(scanned, parts), "fingerprint-met")
    reps = scanned.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"))
    needs = met.select("part", "key").distinct().join(reps, "key")
    sent = scanned.where("key IS NOT NULL").withColumnRenamed("doc_id", "rep").join(jaccard.small(written(needs, "fingerprint-needs")), ["key", "rep"])
    null = F.lit(None)
    rows = sent.select("part", null.cast("long").alias("bucket"), "key", "sketch").unionByName(met.select("part", "bucket", "key", null.cast("array<long>").alias("sketch")))

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        places: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            whole = b.column("sketch").is_valid()
            own, rest = b.filter(whole), b.filter(pc.invert(whole))
            for key, s in zip(own.column("key").to_pylist(), own.column("sketch")):
                if key not in held:
                    held[key] = s.values.to_numpy()
            places.append((rest.column("bucket").to_numpy(), rest.column("key").to_numpy()))
        if held:
            keys = np.sort(np.array(list(held), np.int64))
            bucket, key = (np.concatenate(c) for c in zip(*places))
            order = np.lexsort((key, bucket))
            bucket, at = bucket[order], np.searchsorted(keys, key[order])
            near_ = _Near([held[x] for x in keys.tolist()], k, least)
            yield from run(near_, keys, np.split(at, np.flatnonzero(np.diff(bucket)) + 1))

    return jaccard.moved(rows, parts).mapInArrow(lean(all_), schema)


def near(scanned: DataFrame, k: int = K, least: float = NEAR) -> DataFrame:
    """(a, b, resemblance, a_in_b, b_in_a) of all near groups of equal sketches, by their keys; m near ones give m (m - 1) / 2 rows."""

    def run(near_: _Near, keys: np.ndarray, buckets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for bucket in buckets:
            for part in near_.parts(bucket):
                for i in range(len(part) - 1):
                    found = [(keys[part[i]], keys[y], *_compared(near_.sketches[part[i]], near_.sketches[y], k)) for y in near_.of(part[i], part[i + 1 :])]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["a", "b", "resemblance", "a_in_b", "b_in_a"])

    return _in_buckets(scanned, k, least, run, "a long, b long, resemblance double, a_in_b double, b_in_a double").distinct()


def classes(scanned: DataFrame, k: int = K, least: float = NEAR) -> DataFrame:
    """(key, least): the connected parts of ``near``, without its rows; groups that nothing is near are left out."""

    def run(near_: _Near, keys: np.ndarray, buckets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for bucket in sorted(buckets, key=len, reverse=True):
            for part in near_.parts(bucket):
                near_.connect(part)
        root = keys[[near_.root(x) for x in range(len(keys))]]
        yield pa.RecordBatch.from_arrays([pa.array(keys[root != keys]), pa.array(root[root != keys])], ["a", "b"])

    return jaccard.components(written(_in_buckets(scanned, k, least, run, "a long, b long"), "fingerprint-links"))


def query(df: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """All documents: (doc_id, source, sketch, n_distinct, source_distinct, resemblance, containment, group_id, class_id, class_size).

    ``group_id`` is the least doc_id with an equal sketch. ``class_id`` is the least doc_id that a chain of near
    documents leads to, and ``class_size`` the number of documents of that class: 1 where nothing is near, 0 for rows
    without a doc_id or a word. ``resemblance`` and ``containment`` are against the source. Documents are never shuffled
    while the list of those with company is short.
    """
    scanned = written(scan(df, k, n), "fingerprint-scan")
    known = scanned.where("key IS NOT NULL AND doc_id IS NOT NULL").select("key", "doc_id").distinct()
    placed = known.join(classes(scanned, k), "key", "left").select("key", "doc_id", F.coalesce("least", "key").alias("part"))
    sizes = placed.groupBy("part").agg(F.min("doc_id").alias("class_id"), F.count_distinct("doc_id").alias("class_size")).where("class_size > 1")
    lists_ = placed.groupBy("key", "part").agg(F.min("doc_id").alias("group_id")).join(sizes, "part").select("key", "group_id", "class_id", "class_size")
    lists_ = written(lists_, "fingerprint-lists")
    if lists_.count() <= SENT_NEAR:
        lists_ = F.broadcast(lists_)
    whole = written(merge(scanned, "source", k).withColumnRenamed("source", "of"), "fingerprint-sources")
    if whole.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES:
        whole = F.broadcast(whole)
    both = scanned.join(lists_, (scanned.key == lists_.key) & F.col("doc_id").isNotNull(), "left").join(whole, F.col("source").eqNullSafe(F.col("of")), "left")
    a, b, alone = F.col("sketch"), F.col("merged"), F.when(F.size("sketch") > 0, F.col("doc_id"))
    return both.select("doc_id", "source", "sketch", distinct_count(a, k).alias("n_distinct"), distinct_count(b, k).alias("source_distinct"), resemblance(a, b, k).alias("resemblance"), containment(a, b, k).alias("containment"),
                       F.coalesce("group_id", alone).alias("group_id"), F.coalesce("class_id", alone).alias("class_id"), F.coalesce("class_size", F.when(alone.isNotNull(), 1).otherwise(0).cast("long")).alias("class_size"))

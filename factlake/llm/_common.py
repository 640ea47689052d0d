"""Helpers shared by the operators of this subpackage: Arrow buffers, chunks, word hashes, shared storage.

Work on text runs over the UTF-8 buffer of a whole Arrow batch with numpy, not row by row. A chunk holds at most
``CHUNK`` bytes unless one document alone is longer, so memory follows the longest document, not the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and the odd base of the polynomial word hash with its inverse.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}

#: Word bytes: ASCII letters and digits, underscore and all bytes of non-ASCII characters.
IS_WORD = np.zeros(256, np.bool_)
IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is missing (a local test session) is a folder of our own used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    import tempfile

    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.gettempdir() + "/factlake-shared"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written once as a table in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # the table stands for its shuffles, whose files go as soon as it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def done(df: DataFrame) -> None:
    """Deletes the table that ``written`` gave: nothing that is still to run may read it."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        own = next((m for m in _made if m.rpartition("/")[2] == name.rpartition("/")[2]), None)
        if own:
            _made.remove(own)
            _drop(spark, own)


def _drop(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_shared(spark: SparkSession) -> None:
    """Deletes the tables that ``written`` has made in this session; call it when no DataFrame made from them is needed."""
    while _made:
        _drop(spark, _made.pop())


def small_batches(spark: SparkSession) -> None:
    """At most 2000 rows in an Arrow batch: documents are long, and a task holds several batches at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, after which the worker gives back the memory that it has freed: workers outlive their tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapped


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len+1 offsets of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1] if off and n else np.zeros(n + 1, np.int64)
    base = int(offs[0]) if n else 0
    raw = np.frombuffer(data, np.uint8)[base : int(offs[-1])] if data is not None and n else np.zeros(0, np.uint8)
    return raw, offs - base


def chunks(offs: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes, one row at least."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("p", _BASE), ("q", _BASE_INV)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            have = 1
            while have < size:
                take = min(have, size - have)
                out[have : have + take] = out[:take] * np.uint64(pow(base, have, 2**64))
                have += take
            _powers[name] = out
    return _powers["p"][:n], _powers["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the document of each word, and its first and end byte. A word never crosses documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    inside = IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offs))
    heads, tails = offs[filled], offs[filled + 1] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, q = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * p, out=total[1:])
    hashes = mix((total[end] - total[start]) * q[start])
    return hashes, np.searchsorted(offs, start, side="right") - 1, start, end


def ngrams(hashes: np.ndarray, doc: np.ndarray, docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of all word n-grams. A document of fewer than n words, but one at least, has one: all its words."""
    if not len(hashes):
        return hashes, doc
    count = np.bincount(doc, minlength=docs)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    keep = max(0, len(hashes) - n + 1)
    grams = np.zeros(keep, np.uint64)
    for k in range(n):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + keep]
    whole = doc[:keep] == doc[n - 1 : n - 1 + keep]
    grams, owner = mix(grams)[whole], doc[:keep][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            extra[has] = extra[has] * np.uint64(0xD6E8FEB86659FD93) + hashes[first[short[has]] + k]
        grams, owner = np.concatenate([grams, mix(extra ^ np.uint64(0xA5A5A5A5A5A5A5A5))]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    return grams, owner


def distinct_per_doc(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, ascending within it."""
    if not len(grams):
        return grams, owner
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.empty(len(grams), np.bool_)
    new[0] = True
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], owner[new]


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def no_clash(df: DataFrame, *names: str) -> DataFrame:
    """df with just these columns, whatever else it has. Its batches are kept small on their way to Python."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])

"""Vector retrieval: exact cosine nearest neighbours, the embedding contract, an offline embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that are sent to every task.
SENT_QUERIES = 1000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(0.0)


def knn(vectors: DataFrame, queries: DataFrame, k: int, theta: float = 0.0, identity: tuple[dict | None, dict] | None = None) -> DataFrame:
    """(qid, id, score, rank): each query's nearest vectors, exactly. Needs (id, vec) and (qid, qvec).

    Up to ``SENT_QUERIES`` queries are sent to every task, which multiplies blocks of vectors with them and keeps each
    query's best k; only these move. More queries go in slices of as many, one pass over the vectors each. A vector whose
    length is 0 or whose dimension isn't the query's has cosine 0. ``identity`` (stored, configured) is checked first.
    """
    if identity is not None:
        require_identity(*identity)
    rows = queries.select("qid", "qvec").limit(SENT_QUERIES + 1).collect()
    if len(rows) <= SENT_QUERIES:
        found = _nearest(vectors, rows, queries, k, theta)
    else:
        n = -(-queries.count() // SENT_QUERIES) * 2  # twice the slices, so that hashing overfills none
        found = None
        for part in range(n):
            own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == part).select("qid", "qvec").collect()
            one = _nearest(vectors, own, queries, k, theta)
            found = one if found is None else found.unionByName(one)
    w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(vectors: DataFrame, rows: list, queries: DataFrame, k: int, theta: float) -> DataFrame:
    """(qid, id, score): each task's best vectors of each query, with all that may tie with the last."""
    from pyspark.sql.pandas.types import to_arrow_type

    qid, key = queries.schema["qid"].dataType, vectors.schema["id"].dataType
    sent = vectors.sparkSession.sparkContext.broadcast([(r["qid"], np.asarray(r["qvec"] if r["qvec"] is not None else [], np.float64)) for r in rows])

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(qid)
        by: dict[int, list[int]] = {}
        for i, (_, v) in enumerate(sent.value):
            by.setdefault(len(v), []).append(i)
        blocks = {d: (np.array(at), unit(np.stack([sent.value[i][1] for i in at]))) for d, at in by.items()}
        best: list[list] = [[] for _ in sent.value]  # (score, id) of each query
        for b in batches:
            col = b.column(1)
            sizes = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.cumsum(sizes) - sizes
            for d, (at, q) in blocks.items():
                score = np.zeros((len(at), len(b)))
                same = np.flatnonzero(sizes == d)
                if len(same) and d:
                    score[:, same] = q @ unit(flat[start[same][:, None] + np.arange(d)]).T
                score = np.clip(score, 0, 1)
                for i, s in zip(at, score):
                    last = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -1.0
                    best[i] += [(float(s[x]), b.column(0)[int(x)].as_py()) for x in np.flatnonzero(s >= max(last, theta) - 2e-6)]
                    if len(best[i]) > 20 * k + 1000:
                        floor = sorted((s for s, _ in best[i]), reverse=True)[k - 1] - 2e-6
                        best[i] = [x for x in best[i] if x[0] >= floor]
        out = [(sent.value[i][0], x, s) for i, own in enumerate(best) for s, x in own]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], to_arrow_type(key)), pa.array([o[2] for o in out], pa.float64())], ["qid", "id", "score"])

    schema = T.StructType([T.StructField("qid", qid), T.StructField("id", key), T.StructField("score", T.DoubleType())])
    return vectors.where("vec IS NOT NULL").select("id", "vec").mapInArrow(run, schema).withColumn("score", F.round("score", 6)).where(F.col("score") >= theta)


def lookup(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of known ids."""
    return vectors.join(ids.select("id").distinct(), "id", "left_semi")


def scroll(vectors: DataFrame, after, size: int) -> DataFrame:
    """The next page of rows in the order of id: those behind ``after`` (None for the first page). The bound is pushed to the scan."""
    own = vectors if after is None else vectors.where(F.col("id") > F.lit(after))
    return own.orderBy("id").limit(size)


def require_identity(stored: dict | None, configured: dict) -> None:
    """Raises unless provider, model and dimension are those that the vectors were made with."""
    if stored is not None and {k: stored.get(k) for k in ("provider", "model", "dim")} != {k: configured.get(k) for k in ("provider", "model", "dim")}:
        raise ValueError(f"vectors were made with {stored}, not {configured}: embed them again")


def choose_provider(available: dict[str, bool], order: list[str]) -> str:
    """The first provider of the order that is available."""
    for name in order:
        if available.get(name):
            return name
    raise LookupError("no embedding provider is available")


def hashed_embedding(dim: int = 64):
    """An embedder that needs no model: signed hashing of words, of length 1. A column function, batched by Arrow."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                v = [0.0] * dim
                for w in (t or "").lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                    v[h % dim] += 1.0 if h >> 40 & 1 else -1.0
                n = sum(x * x for x in v) ** 0.5
                out.append([x / n for x in v] if n else v)
            yield pd.Series(out)

    return embed

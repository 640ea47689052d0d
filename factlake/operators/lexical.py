"""Ranked retrieval for batches of prompts: BM25 and term coverage over documents or over a kept index of them.

A batch of up to ``SENT_PROMPTS`` prompts is sent to every task as one matrix of its terms' weights. Documents stay where
they are: one pass counts how many have each term that a prompt has, a second multiplies blocks of documents with the
matrix and keeps each prompt's best few of a task, so only these are shuffled. Larger batches are joined with the
postings of their terms by shuffling; both ways give the same rows.

An index holds each document's terms with their counts, so that searches tokenise no documents. It is a table that grows
by generations: a changed or removed document adds a row, and of each document the latest row holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions import text as X
from factlake.functions.stem import index_words, stems

K1, B, MIDPOINT, STEEPNESS = 1.2, 0.75, 1.0, 1.0
POOL, K, THETA = 256, 3, 0.35
#: Prompts whose weights are sent to every task; documents that are multiplied at once.
SENT_PROMPTS, ROWS = 1000, 256
#: Bytes of documents whose words are held at once: memory follows the longest document, not the batch.
HELD = 2_000_000


def indexed(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """docs with their index terms and length."""
    terms = stems(F.col("text")) if stemmed else X.tokenize(F.col("text"))
    return docs.withColumn("terms", terms).withColumn("dl", F.size("terms"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, dl) of indexed docs."""
    return docs.select("id", "dl", F.explode("terms").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus(docs: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency, never 0 or less."""
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, 1e-6).otherwise(raw)


def bm25_term(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """A term's share of a document's BM25."""
    return idf(n, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def squash(x: Column, midpoint: float = MIDPOINT, steepness: float = STEEPNESS) -> Column:
    """Logistic map of a rank to 0..1."""
    return 1 / (1 + F.exp(-steepness * (x - midpoint)))


class _Prompts:
    """Prompts with their terms' numbers; ``weights`` are set once the documents have been counted."""

    def __init__(self, rows: list, stemmed: bool):
        self.stemmed = stemmed
        self.qids = [r["qid"] for r in rows]
        self.terms = _numbers([r["terms"] for r in rows])
        self.words = _numbers([r["words"] for r in rows]) if stemmed else self.terms
        shape = (len(rows), len(self.words))
        self.has = np.zeros(shape, np.float32)
        for i, r in enumerate(rows):
            self.has[i, [self.words[w] for w in r["words"]]] = 1
        self.asked = np.zeros((len(rows), len(self.terms)))
        for i, r in enumerate(rows):
            self.asked[i, [self.terms[w] for w in r["terms"]]] = 1
        self.avgdl, self.weights = 1.0, self.asked

    def count(self, n: float, avgdl: float, df: np.ndarray) -> None:
        raw = np.log((n - df + 0.5) / (df + 0.5))
        self.avgdl, self.weights = avgdl, self.asked * np.where(raw <= 0, 1e-6, raw)

    def known(self, tokens: list[str], numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the tokens that some prompt has."""
        return np.unique([x for w in tokens if (x := numbers.get(w)) is not None] or np.zeros(0, np.int64), return_counts=True)


def _numbers(lists: list[list[str]]) -> dict[str, int]:
    return {w: k for k, w in enumerate(dict.fromkeys(w for own in lists for w in own))}


def _held(column: pa.Array) -> Iterator[pa.Array]:
    """A column in slices of some MB, one row at least."""
    lo, most = 0, max(1, len(column))
    while lo < len(column):
        n = min(most, len(column) - lo)
        while n > 1 and column.slice(lo, n).nbytes > HELD:
            n = max(1, n // 2)
        yield column.slice(lo, n)
        lo, most = lo + n, 2 * n


def _terms(column: pa.Array, kind: str, prompts: _Prompts, said: bool = True) -> Iterator[tuple[int, tuple, tuple]]:
    """Length, and known index terms and, with ``said``, words of each document: a text, or an index row (dl, terms, tfs, words)."""
    find, none = X.PATTERN.findall, (np.zeros(0, np.int64),) * 2
    for x in (x for part in _held(column) for x in part.to_pylist()):
        if kind == "text":
            words = find(x.lower()) if x and (said or not prompts.stemmed) else []
            own = index_words(x or "") if prompts.stemmed else words
            known = prompts.known(own, prompts.terms)
            yield len(own), known, none if not said else prompts.known(words, prompts.words) if prompts.stemmed else known
        else:
            at = [(n, f) for w, f in zip(x["terms"] or [], x["tfs"] or []) if (n := prompts.terms.get(w)) is not None]
            own = tuple(np.array(v) for v in zip(*at)) if at else none
            yield x["dl"], own, prompts.known(x["words"] or [], prompts.words) if prompts.stemmed and said else own


def _asked(prompts: DataFrame, stemmed: bool) -> DataFrame:
    terms = stems(F.col("query")) if stemmed else X.query_terms(F.col("query"))
    return prompts.select("qid", F.slice(F.array_distinct(terms), 1, X.MAX_TERMS).alias("terms"), X.query_terms(F.col("query")).alias("words"))


def _scored(docs: DataFrame, rows: list, prompts: DataFrame, where: Column | None, stemmed: bool, pool: int | None) -> DataFrame:
    """(qid, id, bm25, cov) of prompts that are sent, all matches or each task's best."""
    spark = docs.sparkSession
    kind = "text" if "text" in docs.columns else "index"
    value = F.col("text") if kind == "text" else F.struct("dl", "terms", "tfs", *(["words"] if stemmed else []))
    own = _Prompts([r for r in rows if r["words"]], stemmed)
    sent = spark.sparkContext.broadcast(own)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        df, n, total = np.zeros(len(p.terms), np.int64), 0, 0
        for b in batches:
            for dl, (terms, _), _ in _terms(b.column(0), kind, p, said=False):
                df[terms] += 1
                n, total = n + 1, total + dl
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *range(len(df))], pa.int32()), pa.array([n, total, *df.tolist()], pa.int64())], ["term", "n"])

    counted = docs.select(value.alias("x")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    of = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist()))
    n = of.get(-2, 0)
    own.count(n, of.get(-1, 0) / n if n else 1.0, np.array([of.get(k, 0) for k in range(len(own.terms))], float))
    weighted = spark.sparkContext.broadcast(own)
    qid, key = prompts.schema["qid"].dataType, docs.schema["id"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = weighted.value
        sizes, weights, has = p.has.sum(axis=1), np.ascontiguousarray(p.weights.T), np.ascontiguousarray(p.has.T)
        best: list[tuple] = []
        held = 0
        for b in batches:
            step = max(16, min(ROWS, 4_000_000 // max(1, len(weights))))  # a block has 32 MB at most
            for lo in range(0, len(b), step):
                part = b.slice(lo, step)
                tf, there, dls = np.zeros((len(part), weights.shape[0])), np.zeros((len(part), has.shape[0]), np.float32), np.zeros(len(part))
                for i, (dl, (terms, n_at), (words, _)) in enumerate(_terms(part.column(1), kind, p)):
                    tf[i, terms], there[i, words], dls[i] = n_at, 1, dl
                tf *= (K1 + 1) / (tf + K1 * (1 - B + B * dls / p.avgdl)[:, None])
                bm25, hits = tf @ weights, there @ has
                doc, q = np.nonzero((hits if not p.stemmed else (tf > 0).astype(np.float32) @ (p.asked.T > 0)) > 0)
                if len(doc):
                    best.append((q, part.column(0).take(pa.array(doc)), bm25[doc, q], hits[doc, q] / sizes[q]))
                    held += len(doc)
                if pool is not None and held > 4 * pool * max(1, len(p.qids)):
                    best = [top(best)]
                    held = len(best[0][0])
        if best:
            q, ids, bm25, cov = top(best) if pool is not None else joined(best)
            for lo in range(0, len(q), 50_000):
                x = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([p.qids[k] for k in q[x]], pa_qid), ids[x], pa.array(bm25[x]), pa.array(cov[x].astype(np.float64))], ["qid", "id", "bm25", "cov"])

    def joined(parts: list[tuple]) -> tuple:
        q, ids, bm25, cov = zip(*parts)
        return np.concatenate(q), pa.concat_arrays([i.combine_chunks() if isinstance(i, pa.ChunkedArray) else i for i in ids]), np.concatenate(bm25), np.concatenate(cov)

    def top(parts: list[tuple]) -> tuple:
        """The best of each prompt, with all that may be equal to the last when rounded."""
        q, ids, bm25, cov = joined(parts)
        order = np.lexsort((-bm25, q))
        q, bm25 = q[order], bm25[order]
        start = np.searchsorted(q, np.arange(q.max() + 2))
        last = np.minimum(start[:-1] + pool, start[1:]) - 1
        floor = np.where(start[1:] > start[:-1], bm25[np.maximum(last, 0)], 0)
        keep = bm25 >= floor[q] - 2e-6
        return q[keep], ids.take(pa.array(order[keep])), bm25[keep], cov[order[keep]]

    pa_qid = _arrow(qid)
    schema = T.StructType([T.StructField("qid", qid), T.StructField("id", key), T.StructField("bm25", T.DoubleType()), T.StructField("cov", T.DoubleType())])
    found = (docs if where is None else docs.where(where)).select("id", value.alias("x")).mapInArrow(score, schema)
    return found.withColumn("bm25", F.round("bm25", 6))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def matched(docs: DataFrame, prompts: DataFrame, stemmed: bool = False, where: Column | None = None, pool: int | None = None) -> DataFrame:
    """(qid, id, bm25, cov) of each prompt (qid, query) and document that share a term.

    Documents are (id, text), or an index (id, dl, terms, tfs, words). Statistics are over all of them, ``where`` filters
    after. With a pool, documents that can't be among a prompt's so many best may be missing.
    """
    asked = _asked(prompts, stemmed)
    rows = asked.limit(SENT_PROMPTS + 1).collect()
    if len(rows) <= SENT_PROMPTS:
        return _scored(docs, rows, prompts, where, stemmed, pool)
    out = _joined(docs, asked, stemmed)
    return out if where is None else out.join(docs.where(where).select("id"), "id", "left_semi")


def _joined(docs: DataFrame, asked: DataFrame, stemmed: bool) -> DataFrame:
    """The same for any number of prompts, by joining postings."""
    each = asked.select("qid", F.explode("terms").alias("term"))
    vocabulary = each.select("term").distinct()
    if "text" in docs.columns:
        own = indexed(docs, stemmed)
        hits = own.select("id", "dl", F.explode("terms").alias("term")).join(vocabulary, "term", "left_semi")
        post = hits.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    else:
        own = docs
        post = docs.select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("id", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")).join(vocabulary, "term", "left_semi")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus(own)
    # one row of statistics
    scored = each.join(df, "term").join(post, "term").crossJoin(F.broadcast(stats))
    part = bm25_term(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avgdl"))
    out = scored.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("bm25"), F.count("*").alias("n_hit"))
    sizes = asked.select("qid", F.size("words").alias("n_terms"), F.col("words").alias("said"))
    if not stemmed:
        return out.join(sizes, "qid").select("qid", "id", "bm25", (F.col("n_hit") / F.col("n_terms")).alias("cov"))
    words = own.select("id", X.tokenize(F.col("text")).alias("have")) if "text" in docs.columns else own.select("id", F.col("words").alias("have"))
    return out.join(sizes, "qid").join(words, "id").select("qid", "id", "bm25", (F.size(F.array_intersect("said", "have")) / F.col("n_terms")).alias("cov"))


def search(docs: DataFrame, prompts: DataFrame, k: int = K, theta: float = THETA, where: Column | None = None, stemmed: bool = False, pool: int = POOL) -> DataFrame:
    """(qid, id, score, rank): a prompt's best documents, above the threshold; ``where`` filters documents after the statistics. None for k of 0 or less."""
    hits = matched(docs, prompts, stemmed, where, pool)
    best = W.partitionBy("qid").orderBy(F.desc("bm25"), "id")
    hits = hits.withColumn("p", F.row_number().over(best)).where(F.col("p") <= pool)
    score = F.round(F.col("cov") + (1 - F.col("cov")) * squash(F.col("bm25")), 6)
    hits = hits.withColumn("score", score).where(F.col("score") >= theta)
    final = W.partitionBy("qid").orderBy(F.desc("score"), "p")
    return hits.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("qid", "id", "score", "rank")


# a kept index ---------------------------------------------------------------------------------------------------------

def index_rows(docs: DataFrame, generation: int = 0, stemmed: bool = False) -> DataFrame:
    """(id, generation, gone, dl, terms, tfs, words) of documents (id, text): what an index keeps of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for part in _held(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(part)), *columns(part)], ["id", "dl", "terms", "tfs", "words"])
                lo += len(part)

    def columns(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for x in texts.to_pylist():
            words = X.PATTERN.findall(x.lower()) if x else []
            own = index_words(x or "") if stemmed else words
            count = sorted(Counter(own).items())
            rows.append((len(own), [t for t, _ in count], [n for _, n in count], list(dict.fromkeys(words)) if stemmed else None))
        return [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string())))]

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *T._parse_datatype_string("dl int, terms array<string>, tfs array<int>, words array<string>").fields])
    out = docs.select("id", "text").mapInArrow(run, schema)
    return out.select("id", F.lit(generation).alias("generation"), F.lit(False).alias("gone"), "dl", "terms", "tfs", "words")


def upkeep(index: DataFrame, changed: DataFrame | None = None, removed: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """The rows that an index (all its generations) gains by changed documents (id, text) and removed ones (id): the next generation."""
    last = index.agg(F.max("generation")).first()[0]
    now = 0 if last is None else last + 1
    out = None if changed is None else index_rows(changed, now, stemmed)
    if removed is not None:
        own = removed.select("id").distinct() if changed is None else removed.select("id").distinct().join(changed.select("id"), "id", "left_anti")
        empty = own.select("id", F.lit(now).alias("generation"), F.lit(True).alias("gone"), F.lit(0).alias("dl"), *[F.lit(None).cast(f"array<{t}>").alias(c) for c, t in (("terms", "string"), ("tfs", "int"), ("words", "string"))])
        out = empty if out is None else out.unionByName(empty)
    return out


def current(index: DataFrame) -> DataFrame:
    """The index as it holds: each document's latest row, removed documents left out. An index of one generation isn't shuffled."""
    span = index.agg(F.min("generation").alias("a"), F.max("generation").alias("b")).first()
    if span["a"] == span["b"]:
        return index.where("NOT gone").drop("generation", "gone")
    # only ids with several rows are settled by a window; what the first generation alone has passes untouched
    later = index.where(F.col("generation") > span["a"]).select("id").distinct()
    first = index.where(F.col("generation") == span["a"]).join(later, "id", "left_anti")
    w = W.partitionBy("id").orderBy(F.desc("generation"))
    newer = index.where(F.col("generation") > span["a"]).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return first.unionByName(newer).where("NOT gone").drop("generation", "gone")


def search_cold(cold: DataFrame, prompts: DataFrame) -> DataFrame:
    """(qid, id, score) of archived documents: coverage alone."""
    return matched(cold, prompts).where("cov > 0").select("qid", "id", F.round("cov", 6).alias("score"))

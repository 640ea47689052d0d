"""Language identification with a string kernel.

Kernel: the blended spectrum of byte n-grams of lengths 1 to 3, as presence: ``k(x, y)`` counts the n-grams that both
texts have, over all lengths, divided by ``sqrt(k(x, x) k(y, y))``. A Nystroem map through ``LANDMARKS`` texts turns it
into features, on which one ridge regression for each language is fitted against the rest (targets 1 and -1). Both
collapse into one matrix of weights for each n-gram of the landmarks, so a batch of texts is scored by one product of
its presence matrix with that matrix.

The classifier is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` documents of each language, and a
passage of about ``PASSAGE`` bytes of each so that short texts are learnt too. All else covers every document.

Defined results: a text that is null, or has no letter, has no language, margin 0 and isn't accepted. Otherwise the
language of the highest score is given (ties: the first by name), and the text is accepted if that score leads the next
by ``MARGIN`` of the largest score's magnitude. Whole texts are read, at any length. Repeated rows get
equal results. Languages are those of the labelled rows; with no labelled row at all nothing is accepted, and with one
language all with letters is. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factlake.llm._common import buffers, chunks, lean, no_clash, small_batches

SAMPLE, LANDMARKS, PASSAGE = 250, 240, 60
RIDGE, MARGIN = 1e-3, 0.02
#: Letters and bytes of non-ASCII characters stay, all else is a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_DOC = np.uint64(26)


def presence(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (length above 24 bits of bytes) of each document and their documents, in order."""
    n, docs = len(data), len(offs) - 1
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    b = _FOLD[data].astype(np.uint64)
    owner = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(offs)) << _DOC
    two = b[:-1] << np.uint64(8) | b[1:]
    parts = [owner | b]
    same2 = owner[:-1] == owner[1:]
    parts.append((owner[1:] | two | np.uint64(1 << 24))[same2])
    if n > 2:
        same3 = owner[:-2] == owner[2:]
        parts.append((owner[2:] | two[:-1] << np.uint64(8) | b[2:] | np.uint64(2 << 24))[same3])
    out = []
    for p in parts:  # each length apart: shorter sorts
        p = np.sort(p)
        out.append(p[np.r_[True, p[1:] != p[:-1]]] if len(p) else p)
    codes = np.concatenate(out)
    codes.sort(kind="stable")
    return (codes & np.uint64((1 << 26) - 1)).astype(np.uint32), (codes >> _DOC).astype(np.int64)


def letters(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each document has a letter."""
    total = np.concatenate([[0], np.cumsum(_FOLD[data] != 32)])
    return total[offs[1:]] > total[offs[:-1]]


class Model:
    """Languages, the landmarks' n-grams and their weights for each language."""

    def __init__(self, languages: list[str], grams: np.ndarray, weights: np.ndarray):
        self.languages, self.grams, self.weights = languages, grams, weights

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """One row of scores for each document."""
        docs = len(offs) - 1
        codes, owner = presence(data, offs)
        own = np.bincount(owner, minlength=docs)
        out = np.zeros((docs, len(self.languages)), np.float32)
        if not len(self.grams):
            return out
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        known = self.grams[at] == codes
        at, owner = at[known], owner[known]
        edge = np.searchsorted(owner, np.arange(0, docs + 128, 128))
        matrix = np.zeros((128, len(self.grams)), np.float32)
        for k, lo in enumerate(range(0, docs, 128)):
            rows, cols = owner[edge[k] : edge[k + 1]] - lo, at[edge[k] : edge[k + 1]]
            matrix[rows, cols] = 1
            hi = min(docs, lo + 128)
            out[lo:hi] = matrix[: hi - lo] @ self.weights
            matrix[rows, cols] = 0
        return out / np.sqrt(np.maximum(own, 1)).astype(np.float32)[:, None]


def fit_texts(texts: list[str], langs: list[str]) -> Model:
    """The model of labelled texts. Deterministic."""
    names = sorted(set(langs))
    order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))
    texts, langs = [texts[i].lower() for i in order], [langs[i] for i in order]
    raw = [t.encode() for t in texts]
    rng = np.random.default_rng(7)
    cut = []
    for r in raw:
        at = int(rng.integers(0, max(1, len(r) - PASSAGE)))
        cut.append(r[at : at + int(rng.integers(8, PASSAGE * 2))])
    rows, labels = raw + cut, langs + langs
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    codes, owner = presence(np.frombuffer(b"".join(rows), np.uint8), offs)
    size = np.bincount(owner, minlength=len(rows))
    # landmarks: whole texts, evenly over the languages
    each = max(1, LANDMARKS // max(1, len(names)))
    marks = np.concatenate([np.flatnonzero(np.array(langs) == n)[:: max(1, langs.count(n) // each)][:each] for n in names]) if names else np.zeros(0, int)
    marks = marks[size[marks] > 0]
    grams = np.unique(codes[np.isin(owner, marks)])
    at = np.minimum(np.searchsorted(grams, codes), max(0, len(grams) - 1))
    known = grams[at] == codes if len(grams) else np.zeros(len(codes), bool)
    x = np.zeros((len(rows), len(grams)), np.float32)
    x[owner[known], at[known]] = 1
    x /= np.sqrt(np.maximum(size, 1))[:, None]
    mark = x[marks]
    kmm = (mark @ mark.T).astype(np.float64)
    knm = (x @ mark.T).astype(np.float64)
    value, vector = np.linalg.eigh(kmm)
    keep = value > 1e-6 * max(1.0, value[-1] if len(value) else 1.0)
    root = vector[:, keep] / np.sqrt(value[keep])  # K_mm^(-1/2) on what it spans
    phi = knm @ root
    y = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0) if names else np.zeros((0, 0))
    share = np.array([labels.count(n) for n in names], float)
    alpha = np.zeros((phi.shape[1], len(names)))
    for c in range(len(names)):
        w = np.where(y[:, c] > 0, 0.5 / share[c], 0.5 / max(1.0, len(labels) - share[c]))  # either side counts half
        left = (phi * w[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1]) / 10
        alpha[:, c] = np.linalg.solve(left, (phi * w[:, None]).T @ y[:, c])
    return Model(names, grams, (mark.T @ (root @ alpha)).astype(np.float32))


def fit(df: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample of the labelled rows of (doc_id, text, lang): the least hashes of doc_id and text length.

    The sample is chosen on small columns; texts are read for the chosen rows only.
    """
    own = no_clash(df, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    mark = F.xxhash64("doc_id", F.lit("language sample"))
    # a hash below its language's bound leaves about three times the sample at most, in one pass over the texts
    bounds = own.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.when(F.col("n") > 3 * sample, F.lit(-(2.0**63)) + F.lit(2.0**64 * 3 * sample) / F.col("n")).otherwise(2.0**63).alias("bound"))
    near = own.join(F.broadcast(bounds), "lang").where(mark.cast("double") <= F.col("bound")).select("lang", "text", mark.alias("m")).distinct()
    chosen = near.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("m", "text"))).where(F.col("n") <= sample).select("lang", "text").toArrow()
    return fit_texts(chosen.column("text").to_pylist(), chosen.column("lang").to_pylist())


def identify(df: DataFrame, model: Model | None = None, keep: bool = False) -> DataFrame:
    """(doc_id, language, score, margin, accepted) of all rows; with ``keep``, df's accepted rows instead."""
    small_batches(df.sparkSession)
    model = model or fit(df)
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text") if keep else 1

    def judge(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m = sent.value
        data, offs = buffers(pc.utf8_lower(col))
        n, c = len(offs) - 1, len(m.languages)
        best, score, margin, ok = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.bool_)
        for i, j in chunks(offs, 1_000_000):
            part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            if not c:
                continue
            s = m.scores(part, own)
            rank = np.sort(s, axis=1)
            best[i:j], score[i:j] = s.argmax(axis=1), rank[:, -1]
            margin[i:j] = rank[:, -1] - rank[:, -2] if c > 1 else 1.0
            scale = np.abs(s).max(axis=1)
            ok[i:j] = letters(part, own) & (margin[i:j] >= MARGIN * np.maximum(scale, 1e-9))
        return best, score, margin, ok

    if keep:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(judge(b.column(at))[3]))

        return df.mapInArrow(lean(run), df.schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score, margin, ok = judge(b.column(1))
            names = np.array([*sent.value.languages, None], object)
            data, offs = buffers(pc.utf8_lower(b.column(1)))
            some = letters(data, offs) & (len(sent.value.languages) > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(some, names[best], None), pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(np.where(some, margin, 0.0)), pa.array(ok)],
                                             ["doc_id", "language", "score", "margin", "accepted"])

    return no_clash(df, "doc_id", "text").mapInArrow(lean(rows), "doc_id long, language string, score double, margin double, accepted boolean")

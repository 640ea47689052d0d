"""Quality classifier: support vectors on naive Bayes features.

A text's features are indicators of its word 1- and 2-grams and of 4-grams of word shapes (capitals, what follows the
word, whether it repeats the word before). Each is scaled by its class log-count ratio, and a linear model with hinge
loss is fitted by dual coordinate descent, for quality and for toxicity alike. A text is kept if it is of quality and
not toxic.

Both models are fitted on a bounded sample of at most ``SAMPLE`` labelled documents; features that fewer than
``MIN_DOCS`` of these have are left out. All documents are scored, whole.

Defined results: a null text, or one without a word, has scores 0 and is not kept. Documents without a label are scored
like others; a labelled doc_id without a document is ignored, as are null labels. Of repeated labels of a doc_id the
least counts. With labels of one class only, all texts with a word get that class. A document of both good quality and
toxic content isn't kept. Repeated rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm._common import buffers, chunks, distinct_per_doc, lean, mix, no_clash, words

SAMPLE, MIN_DOCS = 6000, 4
COST, ROUNDS, BLEND, SMOOTH, LENGTH = 1.0, 30, 1.0, 1.0, 1.0

#: Classes of the bytes that follow a word.
_KIND = np.full(256, 7, np.uint64)
for _k, _chars in enumerate((" ", "\n\r", ".", ",;:", "|", "!?", "\t'\"-()")):
    for _c in _chars:
        _KIND[ord(_c)] = _k


def features(data: np.ndarray, lower: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature hashes of each document, their documents, and each document's number of words.

    ``lower`` is data in lower case if that has as many bytes, which ``_lowered`` sees to.
    """
    docs = len(offs) - 1
    h, doc, start, end = words(lower, offs)
    count = np.bincount(doc, minlength=docs)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    same = np.zeros(len(h), np.bool_)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    padded = np.concatenate([data, np.full(2, 32, np.uint8)])
    upper = data[np.minimum(start + 1, end - 1)] != lower[np.minimum(start + 1, end - 1)]
    shape = _KIND[padded[end]] | _KIND[padded[end + 1]] << np.uint64(3) | upper.astype(np.uint64) << np.uint64(6) | same.astype(np.uint64) << np.uint64(7)
    two = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[doc[:-1] == doc[1:]]
    doc2 = doc[:-1][doc[:-1] == doc[1:]]
    four, doc4 = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) > 3:
        inside = doc[:-3] == doc[3:]
        four = mix(shape[:-3] << np.uint64(24) | shape[1:-2] << np.uint64(16) | shape[2:-1] << np.uint64(8) | shape[3:] | np.uint64(1 << 40))[inside]
        doc4 = doc[:-3][inside]
    f, owner = distinct_per_doc((np.concatenate([h, two, four]) >> np.uint64(1)).astype(np.int64), np.concatenate([doc, doc2, doc4]))
    return f, owner, count


def _lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals made small, as many as before."""
    out = data.copy()
    big = (data >= 65) & (data <= 90)
    out[big] += 32
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    accent = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[accent] += 32
    return out


def ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Log-count ratio of each feature between the classes 1 and -1."""
    p, q = np.full(size, SMOOTH), np.full(size, SMOOTH)
    for r, label in zip(rows, y):
        (p if label > 0 else q)[r] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the linear hinge-loss model, by dual coordinate descent; the last one is the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + w[size]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                w[size] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weight of each feature and bias, for labels of 0 and 1."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return np.zeros(size), float(y[0]) if len(y) else -1.0
    r = ratios(rows, y, size)
    # features are divided by a power of the text's length, so that long texts aren't much louder than short ones
    values = [r[x] / max(1e-9, (r[x] ** 2).sum() ** (LENGTH / 2)) for x in rows]
    share = (y > 0).mean()
    cost = np.where(y > 0, COST * 0.5 / share, COST * 0.5 / (1 - share)) * 10
    w = descend(rows, values, y, size, cost)
    flat = np.abs(w[:size]).mean()
    return r * (BLEND * w[:size] + (1 - BLEND) * flat), float(w[size])


class Model:
    """Known features, ascending, with the weights of both models and the ratios' squares for the texts' lengths."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, squares: np.ndarray, bias: np.ndarray):
        self.known, self.weights, self.squares, self.bias = known, weights, squares, bias

    def scores(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (documents x 2) and number of words."""
        docs = len(offs) - 1
        f, owner, count = features(data, _lowered(data), offs)
        out = np.tile(self.bias, (docs, 1))
        if len(f) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, f), len(self.known) - 1)
            hit = self.known[at] == f
            at, owner = at[hit], owner[hit]
            for c in range(2):
                length = np.bincount(owner, self.squares[at, c], docs) ** (LENGTH / 2)
                out[:, c] += np.bincount(owner, self.weights[at, c], docs) / np.maximum(length, 1e-9)
        return out, count


def fit_texts(texts: list[str], quality: list[int], toxic: list[int]) -> Model:
    """Both models of labelled texts. Deterministic."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], quality[i], toxic[i]))
    raw = [texts[i].encode() for i in order]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    flat, owners = [], []
    for i, j in chunks(offs):
        part = data[offs[i] : offs[j]]
        f, owner, _ = features(part, _lowered(part), offs[i : j + 1] - offs[i])
        flat.append(f)
        owners.append(owner + i)
    f = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    known, n = np.unique(f, return_counts=True)
    known = known[n >= min(MIN_DOCS, max(1, len(raw) // 4))]
    at = np.minimum(np.searchsorted(known, f), max(0, len(known) - 1))
    hit = known[at] == f if len(known) else np.zeros(len(f), np.bool_)
    rows = np.split(at[hit], np.searchsorted(owner[hit], np.arange(1, len(raw)))) if raw else []
    weights, squares, bias = np.zeros((len(known), 2)), np.ones((len(known), 2)), np.zeros(2)
    for c, label in enumerate((quality, toxic)):
        own = np.array([label[i] for i in order])
        weights[:, c], bias[c] = fit_rows(rows, own, len(known))
        if len(set((own > 0).tolist())) == 2:
            squares[:, c] = ratios(rows, np.where(own > 0, 1.0, -1.0), len(known)) ** 2
    return Model(known, weights, squares, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled documents: those whose doc_id has the least hash.

    Only the chosen labels, a bounded number, are sent to the scan of documents.
    """
    own = no_clash(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    mark = F.xxhash64("doc_id", F.lit("quality sample"))
    n = own.count()
    bound = int(-(2**63) + 2**64 * min(1.0, 3 * sample / max(1, n) + 1e-12))
    if bound < 2**63 - 1:
        own = own.where(mark <= F.lit(bound))
    chosen = own.groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("x")).select("doc_id", "x.quality", "x.toxic").orderBy(F.xxhash64("doc_id", F.lit("quality sample")), "doc_id").limit(sample)
    rows = no_clash(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "quality", "toxic").toArrow()
    return fit_texts(rows.column("text").to_pylist(), rows.column("quality").to_pylist(), rows.column("toxic").to_pylist())


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, quality_score, toxic_score, keep) of all documents: one narrow pass."""
    model = model or fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = buffers(b.column(1))
            out, n = np.zeros((len(b), 2)), np.zeros(len(b), np.int64)
            for i, j in chunks(offs):
                out[i:j], n[i:j] = sent.value.scores(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            out[n == 0] = 0
            keep = (n > 0) & (out[:, 0] >= 0) & (out[:, 1] < 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(keep)], ["doc_id", "quality_score", "toxic_score", "keep"])

    return no_clash(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, quality_score double, toxic_score double, keep boolean")

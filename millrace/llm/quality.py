"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Terms of a text are its words, hashed to a few hundred, its pairs of byte
classes, letters folded to a few classes of bytes, and how often it repeats
its own words, next to each other, within windows of 400 words (the mean over
all windows of the text) and over the whole text.  All are taken over the
whole text.  Term shares, square-rooted and weighted by inverse document
frequency, are projected on the leading singular vectors of a sample of
labelled texts (latent semantic analysis).  The sample's vectors and labels
are broadcast; every document's cosine with every one of them is computed in
blocks, exactly, and the nearest ``neighbours`` vote with their similarity.

The sample is bounded by ``sample`` rows: those of smallest xxhash64(doc_id)
among the training labels (crc32 of the id, modulo 4, not 2), so the model and
what is broadcast have a fixed size at every scale.  Ids, languages, sources
and labels are no inputs of a score.

Null, empty and blank texts have no terms; their score is the sample's share
of label 1.  Labels that are null or lack a document are unused; of repeated
label rows of one id the smallest label counts, and of texts that share a
labelled id the one of least terms, so reruns learn the same.  Without any
training label all scores are 0.5.  Repeated rows and rows of a null doc_id
are rows of their own; an empty table gives an empty result; all columns of
the input are passed on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 6000
DIMENSIONS = 48
NEIGHBOURS = 15
THRESHOLD = 0.7
BLOCK = 2048
WINDOW = 400

# byte classes: single classes for marks, a few for letters
_CLASS = np.zeros(256, np.int16)
for _lo, _hi, _c in ((65, 91, 1), (97, 123, 2), (48, 58, 3), (128, 256, 4), (0, 32, 5)):
    _CLASS[_lo:_hi] = _c
for _c, _mark in enumerate(b" \n.,!?;:'\"|*#$%&@()[]{}<>/\\+-=_~^`", 6):
    _CLASS[_mark] = _c
N_CLASSES = int(_CLASS.max()) + 1
_REPEATS = 24
N_WORDS = 64  # hashed words
WORD_WEIGHT = 0.25
N_TERMS = N_WORDS + N_CLASSES * N_CLASSES + 2 * _REPEATS


def held_out():
    """Whether a document's label is withheld from learning, as a column."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def freshness(words: np.ndarray) -> float:
    """The share of distinct words in a window, as the mean over all consecutive windows; the last one ends with the text."""
    n = len(words)
    if n <= WINDOW:
        return len(np.unique(words)) / n
    full = n // WINDOW
    rows = words[: full * WINDOW].reshape(full, WINDOW)
    if n % WINDOW:
        rows = np.concatenate([rows, words[None, n - WINDOW :]])
    rows = np.sort(rows, axis=1)
    return float(((rows[:, 1:] != rows[:, :-1]).sum(1) + 1).mean()) / WINDOW


def terms(texts) -> np.ndarray:
    """Square roots of term shares, a row per text."""
    raw, at = common.column_bytes(texts)
    n = len(at) - 1
    out = np.zeros((n, N_TERMS), np.float32)
    if not len(raw):
        return out
    cls = _CLASS[raw]
    pairs = cls[:-1] * N_CLASSES + cls[1:]
    words, w_at = common.word_hashes(raw, at)
    hashed = (words % np.uint64(N_WORDS)).astype(np.int64)
    n_pairs = N_WORDS + N_CLASSES * N_CLASSES
    for i in range(n):
        a, z = at[i], at[i + 1]
        if z - a > 1:
            out[i, N_WORDS:n_pairs] = np.bincount(pairs[a : z - 1], minlength=N_CLASSES * N_CLASSES) / (z - a - 1)
        w = words[w_at[i] : w_at[i + 1]]
        if len(w):
            out[i, :N_WORDS] = np.bincount(hashed[w_at[i] : w_at[i + 1]], minlength=N_WORDS) * (WORD_WEIGHT / len(w))
        if len(w) > 1:
            same = float((w[1:] == w[:-1]).mean())
            fresh = freshness(w)
            many = len(np.unique(w)) / len(w) ** 0.75
            out[i, n_pairs + min(_REPEATS - 1, int(same * _REPEATS))] = 0.2
            out[i, n_pairs + _REPEATS + min(_REPEATS - 1, int(min(fresh, many) * _REPEATS))] = 0.2
    return np.sqrt(out, out=out)


def leading_axes(gram: np.ndarray, k: int, rounds: int = 40) -> np.ndarray:
    """The k leading eigenvectors of a symmetric matrix by subspace iteration, which needs little more room than the matrix."""
    q = np.random.default_rng(2).standard_normal((len(gram), min(len(gram), k + 16)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(gram @ q)
    _, turn = np.linalg.eigh(q.T @ gram @ q)
    return q @ turn[:, ::-1][:, :k]


class Model:
    """What is broadcast: a projection, unit vectors of the sample and their labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        used = (x > 0).sum(0)
        self.idf = np.log((1 + len(x)) / (1 + used)).astype(np.float32) + np.float32(0.1)
        x = x * self.idf
        self.project = leading_axes((x.T @ x).astype(np.float64), dimensions).astype(np.float32)
        self.vectors, self.labels, self.k = self.embed(x, False), labels.astype(np.float32), min(neighbours, len(labels))
        self.prior = float(labels.mean())

    def embed(self, x: np.ndarray, weigh: bool = True) -> np.ndarray:
        y = (x * self.idf if weigh else x) @ self.project
        size = np.linalg.norm(y, axis=1, keepdims=True)
        return np.divide(y, size, out=np.zeros_like(y), where=size > 0)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        y = self.embed(x)
        for a in range(0, len(y), BLOCK):
            near = y[a : a + BLOCK] @ self.vectors.T
            best = np.argpartition(near, -self.k, axis=1)[:, -self.k :]
            sim = np.take_along_axis(near, best, 1).clip(0) ** 4
            votes = sim.sum(1)
            some = votes > 1e-9
            out[a : a + BLOCK][some] = ((sim * self.labels[best]).sum(1)[some] / votes[some]).clip(0, 1)
        out[~(x > 0).any(1)] = self.prior
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` labelled texts outside the held-out fold."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # at most `sample` rows of two numbers, so the broadcast has a fixed bound
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches):
        import pyarrow as pa

        for b in common.small(batches):
            x = terms(b.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "quality": b.column("quality").cast(pa.int32()), "x": pa.array([r.tobytes() for r in x], pa.binary()),
            })

    found = rows.mapInArrow(run, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("t"))
    got = found.select("doc_id", "t.quality", "t.x").toPandas().sort_values("doc_id")
    if not len(got):
        return None
    labels, x = got.quality.to_numpy(), np.empty((len(got), N_TERMS), np.float32)
    for row, terms_ in zip(x, got.x):
        row[:] = np.frombuffer(terms_, np.float16)
    del got
    return Model(x, labels)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns of ``docs`` with score and predicted behind them, which replace columns of those names, in one map stage."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])

    def run(batches):
        for b in common.small(batches):
            m = shared.value
            s = m.score(terms(b.column("text"))) if m is not None else np.full(b.num_rows, 0.5)
            cols = [b.column(n) for n in own]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*own, *names]
            )

    schema = docs.select("*", F.lit(0.0).cast("double").alias(names[0]), F.lit(0).cast("int").alias(names[1])).schema
    return docs.mapInArrow(run, schema)

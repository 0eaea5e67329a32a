"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch is the k smallest distinct 48-bit shingle hashes of a text, written
as 12 hex digits each, ascending.  Sketches merge across parts of a document
or groups of documents (the k smallest of the union) and estimate
resemblance, containment and the number of distinct shingles.  A text with
fewer than five words has its word sequence as its one shingle.

Null, empty and blank texts have the empty sketch; two empty sketches are
alike (1.0), an empty and another are not (0.0).  Equal texts have equal
sketches.  Repeated rows and ids are rows of their own, in the order of
(doc_id, text hash); null ids come first.  The only document of a table is its
own next one.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 128
BITS = 48
DIGITS = BITS // 4


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of sorted distinct 64-bit hashes."""
    return np.unique(hashes[: 2 * k] >> np.uint64(64 - BITS))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of what two sketches stand for."""
    return np.union1d(a, b)[:k]


def encode(sketch: np.ndarray) -> str:
    raw = sketch.astype(">u8").tobytes().hex()
    return "".join(raw[i + 16 - DIGITS : i + 16] for i in range(0, len(raw), 16))


def decode(text: str) -> np.ndarray:
    return np.array([int(text[i : i + DIGITS], 16) for i in range(0, len(text), DIGITS)], np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the Jaccard similarity; exact when both sets have under k shingles together."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def sketches(texts, k: int = K) -> list[np.ndarray]:
    """Sketches of an Arrow array of texts."""
    h, at = common.shingle_hashes(*common.word_hashes(*common.column_bytes(texts)))
    return [bottom_k(h[a:z], k) for a, z in zip(at[:-1], at[1:])]


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint and the estimated number of distinct shingles, in one map stage."""
    import pyarrow as pa

    def run(batches):
        for b in common.small(batches):
            found = sketches(b.column("text"), k)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "fingerprint": pa.array(map(encode, found), pa.string()),
                "n_distinct": pa.array([distinct_count(x, k) for x in found], pa.float64()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string, n_distinct double")


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, near_contained double, n_distinct double"
)


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over (doc_id, text) batches in ascending order, each partition followed by the first row after it.

    Rows go to ranges of doc_id of about equal size by quantiles; the first
    row of a range is also sent, marked, to the range before it, so that
    neighbours meet without an order over the whole table in one task.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n_bytes, n = docs.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    parts = max(1, min(common.partitions_for(spark, n_bytes or 0), n // 8 or 1))
    cuts = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = np.unique(np.array(cuts, np.int64)) if len(cuts) else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        ids = ids.fillna(np.iinfo(np.int64).min).astype(np.int64)
        return pd.Series(np.searchsorted(cuts, ids, side="right").astype(np.int32))

    keyed = docs.withColumn("b", bucket("doc_id")).withColumn("tie", F.xxhash64("text"))
    # one row per range: as many as there are partitions
    low = F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), "tie")).alias("low")
    firsts = sorted((r.b, r.low.i, r.low.tie) for r in docs.select("doc_id", F.xxhash64("text").alias("tie")).withColumn("b", bucket("doc_id")).groupBy("b").agg(low).collect())
    if not firsts:
        return spark.createDataFrame([], schema)
    sent = [(i, tie, firsts[k - 1][0]) for k, (_, i, tie) in enumerate(firsts)]
    back = F.broadcast(spark.createDataFrame(sent, "i long, t long, back int"))  # one row per partition
    both = keyed.join(back, (F.coalesce(keyed.doc_id, F.lit(-(2**63))) == back.i) & keyed.tie.eqNullSafe(back.t), "left")
    marked = F.array(F.struct(F.col("b").alias("to"), F.lit(0).alias("mark")), F.struct(F.col("back").alias("to"), F.lit(1).alias("mark")))
    both = both.select("doc_id", "text", "tie", F.inline(F.filter(marked, lambda x: x["to"].isNotNull())))
    both = both.repartitionById(firsts[-1][0] + 1, F.col("to")).sortWithinPartitions("mark", "doc_id", "tie")
    return both.select("doc_id", "text", "mark").mapInArrow(run, schema)


def neighbours(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's sketch, that of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 4) code points replaced by as
    many first code points, or all, of the next document.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        held = None  # (doc_id, text, sketch) that waits for the next document
        for b in common.small(batches):
            ids, texts, marks = (b.column(c).to_pylist() for c in ("doc_id", "text", "mark"))
            found = sketches(b.column("text"), k)
            rows, edits, nexts = [], [], []
            for i, text, mark, own in zip(ids, texts, marks, found):
                text = text or ""
                if held is not None and not (mark and held[3]):
                    cut = len(held[1]) // 4
                    rows.append(held)
                    edits.append(held[1][: len(held[1]) - cut] + text[:cut])
                    nexts.append(own)
                held = (i, text, own, mark)
            if not rows:
                continue
            edited = sketches(pa.array(edits, pa.string()), k)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                "n_chars": pa.array([len(r[1]) for r in rows], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                "fingerprint": pa.array([encode(r[2]) for r in rows], pa.string()),
                "edited_fingerprint": pa.array(map(encode, edited), pa.string()),
                "near_edited": pa.array([resemblance(r[2], e, k) for r, e in zip(rows, edited)], pa.float64()),
                "near_next": pa.array([resemblance(r[2], x, k) for r, x in zip(rows, nexts)], pa.float64()),
                "near_contained": pa.array([containment(r[2], e, k) for r, e in zip(rows, edited)], pa.float64()),
                "n_distinct": pa.array([distinct_count(r[2], k) for r in rows], pa.float64()),
            })

    return with_next(docs, run, OUT)

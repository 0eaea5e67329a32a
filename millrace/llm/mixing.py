"""Mixing sources to target weights.

The words of a source, its documents in a pseudorandom order, are cut into
blocks of a fixed number of words.  Output shards of a fixed number of slots
draw how many blocks each source gives: multinomial counts with the targets as
weights, each shard with a generator of its own.  Where a source's draws
exceed what its target asks for, the slots beyond, which lie in its last
shards, go to the sources that lack as many, so the mix as a whole meets the
targets.  The k-th slot of a source takes block pi(k), where pi is a
pseudorandom permutation of the source's block indices, another one for each
pass; slots and blocks meet in an equi-join on (source, index).

A document with null, empty or blank text has size 0, is never taken and
appears with ``taken`` 0.  A null source is a source of its own, the last.
Repeated rows and repeated doc_ids are documents of their own; rows that are
equal in all columns are told apart by a number only.  An empty table gives an
empty result.  Of the columns, doc_id, text and source count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 16
BUCKET_DOCS = 1000


def water_fill(sizes: list[int], weights: list[float], most: float = MAX_PASSES) -> list[float]:
    """Targets that share ``sum(sizes)`` by weight, none above ``most`` times its size.

    What a source cannot take is shared again by weight among those that are
    below their limit.  A source of size 0 has target 0.
    """
    left, open_, out = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes)
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n), chosen by ``key``; all elementwise.

    Four Feistel rounds on the next power of four, walked until the value is
    below n.
    """
    half = np.ones(len(n), np.uint64)
    half = np.maximum(half, np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (common.mix64(right + k * np.uint64(4) + np.uint64(r + 1)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_counts(shard: int, total: int, share: list[float], shard_slots: int, seed: int) -> np.ndarray:
    """How many of a shard's slots each source gets: a multinomial draw, a full shard but for the last one."""
    return np.random.default_rng([seed, shard]).multinomial(min(shard_slots, total - shard * shard_slots), share)


def corrected(first: np.ndarray, count: np.ndarray, k: np.ndarray, drawn: np.ndarray, slots: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, source, first slot, count) of runs of slots as drawn, those beyond a source's number given to sources that lack some.

    ``first``, ``count`` and ``k`` describe runs of the sources' slots,
    ``drawn`` and ``slots`` are what each source has drawn and is to have.
    """
    beyond, lack = np.maximum(drawn - slots, 0), np.maximum(slots - drawn, 0)
    begin = np.cumsum(beyond) - beyond  # places of each source's surplus among all of it
    ends = np.cumsum(lack)
    out = []
    for row, (f, n, s) in enumerate(zip(first.tolist(), count.tolist(), k.tolist())):
        own = min(n, max(0, int(slots[s]) - f))
        if own:
            out.append((row, s, f, own))
        at, end = int(begin[s]) + f + own - int(slots[s]), int(begin[s]) + f + n - int(slots[s])
        while own < n and at < end:
            other = int(np.searchsorted(ends, at, side="right"))
            z = min(end, int(ends[other]))
            out.append((row, other, int(drawn[other]) + at - int(ends[other] - lack[other]), z - at))
            at = z
    return out


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_passes: int = MAX_PASSES,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 9,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: doc_id, source, size, source_size, target, taken.
    pieces: what the output shards hold: shard, slot, pass, doc_id, the row (a
    and b, a hash of its columns, and row_key, which tells equal rows apart),
    start and words (a range of the document's words).
    """
    spark = docs.sparkSession
    a, b = common.row_hashes(docs)
    size = F.coalesce(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD_RE)), F.lit(0)).cast("long")
    # equal rows are one row with a number, however many there are
    rows = docs.select("doc_id", "source", size.alias("size"), a.alias("a"), b.alias("b")).groupBy("a", "b")
    rows = rows.agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("copies"))
    rows = common.materialize(rows)
    words = F.col("size") * F.col("copies")
    # sources are few next to documents; the list is what the weights are given for
    by_source = sorted(
        ((r.source, r.n, r.docs) for r in rows.groupBy("source").agg(F.sum(words).alias("n"), F.count("*").alias("docs")).collect()),
        key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]),
    )
    sizes = [int(n) for _, n, _ in by_source]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], max_passes)
    # every pass has the same blocks, the last of a source may be short
    blocks = [-(-n // block_words) for n in sizes]
    slots = np.array([min(max_passes * b, round(t / (n / b))) if b else 0 for n, b, t in zip(sizes, blocks, targets)], np.int64)
    info = spark.createDataFrame(
        [(i, s, n, t, b) for i, ((s, n, _), t, b) in enumerate(zip(by_source, targets, blocks))],
        "k int, source string, source_size long, target double, blocks long",
    )
    # words before each document within its source, in the order of a hash: sums of small buckets, then within them
    n_buckets = max(1, sum(n for _, _, n in by_source) // BUCKET_DOCS)
    keyed = rows.join(info, rows.source.eqNullSafe(info.source)).drop(info.source)
    keyed = keyed.withColumn("at", F.xxhash64(F.lit(seed), "a", "b")).withColumn("bucket", F.pmod("at", F.lit(n_buckets)))
    sums = common.running(keyed.groupBy("k", "bucket").agg(F.sum(words).alias("n")), ["k"], "bucket", "n", "before").drop("n")
    inner = Window.partitionBy("k", "bucket").orderBy("at", "a", "b").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum(words).over(inner), F.lit(0))).join(sums, ["k", "bucket"])
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    placed = placed.select("k", "doc_id", "source", "size", "source_size", "target", "blocks", "a", "b", (F.col("before") + F.col("inner")).alias("at"), copy)
    placed = placed.withColumn("row_key", F.col("at") + F.col("size") * F.col("copy")).drop("at")
    placed = common.materialize(placed)
    common.discard(rows)
    w = F.lit(block_words)
    parts = placed.where("size > 0").select(
        "k", "doc_id", "a", "b", "row_key", "size",
        F.explode(F.sequence(F.expr(f"row_key div {block_words}"), F.expr(f"(row_key + size - 1) div {block_words}"))).alias("index"),
    )
    parts = parts.withColumn("start", F.greatest(F.lit(0), F.col("index") * w - F.col("row_key")))
    parts = parts.withColumn("words", F.least("size", (F.col("index") + 1) * w - F.col("row_key")) - F.col("start"))
    taken_slots, drawn = _slots(spark, slots, np.array(blocks, np.int64), shard_slots, seed)
    pieces = common.materialize(
        parts.join(taken_slots.hint("merge"), ["k", "index"]).select("shard", "k", "slot", "pass", "doc_id", "a", "b", "row_key", "start", "words")
    )
    common.discard(drawn)
    taken = pieces.groupBy("k", "row_key").agg(F.sum("words").alias("taken"))
    whole = placed.join(taken.withColumn("some", F.lit(True)), ["k", "row_key"], "left")
    out = whole.select(
        "doc_id", "source", "size", F.col("source_size").cast("long"), "target",
        F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"),
    )
    return out, pieces


def _slots(spark, slots: np.ndarray, blocks: np.ndarray, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """shard, k, slot, pass and index (of the block) of every slot of the mix, and a table to discard once they are used."""
    total = int(slots.sum())
    share = (slots / max(1, total)).tolist()
    n_shards = -(-total // shard_slots)

    def draw(frames):
        for f in frames:
            for shard in f.id:
                got = shard_counts(int(shard), total, share, shard_slots, seed)
                some = np.flatnonzero(got)
                yield pd.DataFrame({"shard": np.full(len(some), shard), "k": some.astype(np.int32), "count": got[some]})

    drawn = common.materialize(spark.range(n_shards).mapInPandas(draw, "shard long, k int, count long"))
    totals = np.zeros(len(slots), np.int64)
    for r in drawn.groupBy("k").agg(F.sum("count").alias("n")).collect():  # a row for each source
        totals[r.k] = r.n
    runs = common.running(drawn, ["k"], "shard", "count", "first")
    # cut long runs so that no task makes more than a few thousand slots a row
    runs = runs.select("*", F.explode(F.sequence(F.lit(0), F.expr("(count - 1) div 4096"))).alias("cut"))
    runs = runs.select("shard", "k", (F.col("first") + F.col("cut") * 4096).alias("first"), F.least(F.lit(4096), F.col("count") - F.col("cut") * 4096).alias("count"))
    runs = runs.repartition(common.partitions_for(spark, 8.0 * total), "shard", "k", "first")

    def fill(frames):
        for f in frames:
            first, count, k = (f[c].to_numpy(np.int64) for c in ("first", "count", "k"))
            shards = f["shard"].to_numpy(np.int64)
            for row, s, at, n in corrected(first, count, k, totals, slots):
                slot = np.arange(at, at + n)
                rep = slot // blocks[s]
                key = np.full(n, seed, np.int64) * 1_000_003 + s * 1009 + rep
                yield pd.DataFrame({
                    "shard": shards[row], "k": np.int32(s), "slot": slot, "pass": rep.astype(np.int32),
                    "index": permute(slot - rep * blocks[s], np.full(n, blocks[s]), key),
                })

    return runs.mapInPandas(fill, "shard long, k int, slot long, pass int, index long"), drawn


def mixed_documents(docs: DataFrame, pieces: DataFrame, length_column: str | None = None) -> DataFrame:
    """The mix as documents with the columns of ``docs``, one row per document that is taken.

    The text holds the taken words, pass after pass, a line break between
    passes; a pass that takes the whole document has its text as it was.
    ``length_column``, if given, gets the text's new length.
    """
    import pyarrow as pa

    spans = (
        pieces.groupBy("a", "b", "row_key", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("spans"))
        .groupBy("a", "b", "row_key").agg(F.sort_array(F.collect_list(F.struct("pass", "spans"))).alias("passes"))
    )
    # columns go by number, so that no name of the input clashes; of equal rows one stands for all
    names = docs.columns
    a, b = common.row_hashes(docs)
    joined = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], a.alias("a"), b.alias("b")).dropDuplicates(["a", "b"])
    joined = joined.join(spans.hint("merge"), ["a", "b"]).drop("a", "b", "row_key")
    body = f"c{names.index('text')}"

    def cut(batches):
        import re

        word = re.compile(common.WORD_RE)
        for b in batches:
            texts = []
            for text, passes in zip(b.column(body).to_pylist(), b.column("passes").to_pylist()):
                marks = [m.span() for m in word.finditer(text)]
                got = []
                for p in passes:
                    runs = []
                    for s in p["spans"]:
                        if s["start"] + s["words"] > len(marks):
                            raise ValueError("these pieces are of other documents")
                        if runs and runs[-1][1] == s["start"]:
                            runs[-1][1] += s["words"]
                        else:
                            runs.append([s["start"], s["start"] + s["words"]])
                    if runs == [[0, len(marks)]]:
                        got.append(text)
                    else:
                        got += [text[marks[a][0] : marks[z - 1][1]] for a, z in runs]
                texts.append("\n".join(got))
            cols = [b.column(f"c{i}") for i in range(len(names))]
            for i, name in enumerate(names):
                if name == "text":
                    cols[i] = pa.array(texts, pa.string())
                elif name == length_column:
                    cols[i] = pa.array([len(t) for t in texts], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(cut, docs.schema)

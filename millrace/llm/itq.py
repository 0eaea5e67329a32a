"""Embedding near-dedup: iterative quantisation and multi-index Hamming tables.

Unit vectors are centred, and a rotation of their principal axes is learnt on
a bounded sample so that the signs of the rotated coordinates are balanced
codes that lose least (Gong and Lazebnik's iterative quantisation).  A code is
cut into substrings, one for each table; two codes meet in a table if their
substrings differ in at most two bits, which is the same as sharing a string
within one bit of both.  Pairs that meet and whose whole codes are near are
compared by cosine, in double precision, on the original vectors.

The length of substrings grows with the logarithm of the number of vectors,
so that buckets stay small, and the number of tables follows from it so that a
pair at the threshold t is still found with a probability of ``recall``.
Centring leaves a pair's distance, sqrt(2 - 2 t), but not its angle: about a
mean from which the vectors lie at r, it is acos(1 - (1 - t) / r**2), and a
bit parts the pair with that angle's share of a half circle.

Tables are split into cells by the leading bits of their substrings.  Codes
are dealt to cells first; what comes back is which vectors have a candidate in
which cell.  Only then vectors are sent, once for each such cell, and
compared there.  Large cells are split into blocks that meet in pairs.  Every
pair is compared in one place only, the first table and string that it shares,
so links are counted where they are found and no pair leaves its task.

Equal vectors are joined as one, with their number.  Vectors that are null,
empty, zero or hold null or non-finite components link with nothing, and
vectors of different lengths do not link (each length has codes of its own;
a table of embeddings has one or a few).  Labels are ignored, as are other
columns.  Repeated rows count as vectors of their own; a null vec_id links
like any other, but never names a component.  An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.9
SAMPLE = 20_000
ROUNDS = 30
RECALL = 0.98
PART_ROWS = 20_000
CELL_ROWS = 100_000  # codes in a cell; of larger ones all vectors are sent
GROUP = 64  # of larger groups with a string in common all vectors are sent
MAX_PARTS = 1 << 15
PAIRS = 1 << 20


def shape(n: int, dimensions: int, threshold: float = THRESHOLD, recall: float = RECALL, spread: float = 1.0) -> tuple[int, int, int]:
    """(bits of a substring, tables, greatest Hamming distance of whole codes) for n vectors at the squared distance ``spread`` from their mean."""
    bits = max(4, min(16 + max(0, math.ceil(math.log2(max(n, 1) / 2**17))), 30, max(4, dimensions // 4)))
    # chance that a hyperplane parts the pair; half of it is that of unrelated vectors
    p = min(0.4, math.acos(max(-1.0, 1 - (1 - threshold) / max(spread, 1e-9))) / math.pi)
    meet = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    while meet < 0.05 and bits > 4:  # vectors that all lie near one another: shorter strings, not hundreds of tables
        bits -= 1
        meet = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    tables = max(4, math.ceil(math.log(1 - recall) / math.log(1 - meet)))
    whole = bits * tables
    return bits, tables, math.ceil(whole * p + 5 * math.sqrt(whole * p * (1 - p)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    big = np.abs(x).max(1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Codes:
    """What is broadcast: a mean and a projection; more bits than dimensions take further learnt rotations."""

    def __init__(self, x: np.ndarray, bits: int, tables: int, rounds: int = ROUNDS, seed: int = 10):
        rng, d = np.random.default_rng(seed), x.shape[1]
        self.bits, self.tables, self.mean = bits, tables, x.mean(0)
        x = x - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        v, out = x @ axes[:, ::-1], []
        while sum(o.shape[1] for o in out) < bits * tables:
            r, _ = np.linalg.qr(rng.standard_normal((d, d)))
            for _ in range(rounds):
                b = np.where(v @ r >= 0, 1.0, -1.0)
                s, _, t = np.linalg.svd(b.T @ v)
                r = (s @ t).T
            out.append(axes[:, ::-1] @ r)
        self.projection = np.concatenate(out, axis=1)[:, : bits * tables]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit vectors as one unsigned integer for each table."""
        signs = ((x - self.mean) @ self.projection >= 0).reshape(len(x), self.tables, self.bits)
        return (signs.astype(np.uint32) << np.arange(self.bits, dtype=np.uint32)).sum(2, dtype=np.uint32)


def spread_of(x: np.ndarray) -> float:
    """Squared distance of unit vectors from their mean, that of the nearest tenth."""
    return float(np.quantile(((x - x.mean(0)) ** 2).sum(1), 0.1)) if len(x) > 1 else 1.0


def _usable(column: str):
    v = F.col(column)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    """Vectors of one length, without nulls, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _placed(codes: Codes, lead: int):
    """Map stage: a row for each cell in which a vector has strings."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            code = codes.of(unit(_matrix(b.column("vector"))))
            top = code >> np.uint32(codes.bits - lead)
            to = np.stack([top, *(top ^ np.uint32(1 << k) for k in range(lead))], 2).astype(np.int64)
            to += (np.arange(codes.tables) << lead)[None, :, None]
            row = pa.array(np.repeat(np.arange(len(code)), to[0].size))
            packed = pa.array([c.tobytes() for c in code], pa.binary()).take(row)
            yield pa.RecordBatch.from_arrays([pa.array(to.reshape(-1)), b.column("id").take(row), packed], names=["to", "id", "code"])

    return run


class Cell:
    """The strings of a cell's vectors, and the pairs that meet here first."""

    def __init__(self, codes: np.ndarray, to: int, bits: int, lead: int, near: int):
        self.codes, self.table, self.near = codes, to >> lead, near
        self.mine = codes[:, self.table]
        key = np.stack([self.mine, *(self.mine ^ np.uint32(1 << k) for k in range(bits))], 1)
        here = (key >> np.uint32(bits - lead)) == (to & ((1 << lead) - 1))
        who = np.repeat(np.arange(len(codes)), bits + 1).reshape(key.shape)[here]
        key = key[here]
        order = np.argsort(key, kind="stable")
        self.key, self.who = key[order], who[order]
        self.first = np.searchsorted(self.key, self.key)
        self.end = np.searchsorted(self.key, self.key, side="right")

    def pairs(self, only: np.ndarray | None = None):
        """Pairs (x, y) of near codes, some at a time; ``only``: of these strings."""
        at = np.arange(len(self.key)) if only is None else np.flatnonzero(only)
        n = self.end[at] - at - 1
        total = np.cumsum(n)
        a = 0
        while a < len(at):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
            size = n[a:z]
            left = np.repeat(at[a:z], size)
            right = left + 1 + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            a = z
            if not len(left):
                continue
            x, y, k = self.who[left], self.who[right], self.key[left]
            sx, sy = self.mine[x], self.mine[y]
            diff = sx ^ sy
            low = diff & (~diff + np.uint32(1))
            # the string that stands for the pair: with two bits between them, the lesser of the two in the middle
            ok = k == np.where(diff == low, np.minimum(sx, sy), np.minimum(sx ^ low, sy ^ low))
            x, y = x[ok], y[ok]
            apart = np.bitwise_count(self.codes[x] ^ self.codes[y])
            ok = apart.sum(1) <= self.near
            if self.table:
                ok &= (apart[:, : self.table] > 2).all(1)
            yield x[ok], y[ok]


def _partners(bits: int, lead: int, near: int):
    """Cell stage: the vectors of a cell that have a candidate there, or may have."""

    def run(batches):
        import pyarrow as pa

        def told(to, ids):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), to)), pa.array(ids, pa.int64())], names=["to", "id"])

        def finish(to, ids, codes):
            ids = np.array(ids, np.int64)
            cell = Cell(np.frombuffer(b"".join(codes), np.uint32).reshape(len(ids), -1), to, bits, lead, near)
            many = cell.end - cell.first > GROUP
            some = np.zeros(len(ids), bool)
            some[cell.who[many]] = True
            for x, y in cell.pairs(~many):
                some[x] = some[y] = True
            return told(to, ids[some])

        now, ids, codes, over = None, [], [], False
        for b in batches:
            for to, id_, code in zip(b.column("to").to_pylist(), b.column("id").to_pylist(), b.column("code")):
                if to != now:
                    if ids:
                        yield told(now, ids) if over else finish(now, ids, codes)
                    now, ids, codes, over = to, [], [], False
                ids.append(id_)
                if not over:
                    codes.append(code.as_py())
                if len(ids) >= CELL_ROWS:
                    yield told(now, ids)
                    ids, codes, over = [], [], True
        if ids:
            yield told(now, ids) if over else finish(now, ids, codes)

    return run


def _compared(codes: Codes, lead: int, near: int, threshold: float):
    """Cell stage: links counted for each vector, and links that join trees."""

    def compare(to, bi, bj, held):
        from .jaccard import Forest

        ids, copies, block = (np.array([r[i] for r in held], np.int64) for i in (0, 1, 3))
        vectors = unit(np.array([r[2] for r in held], np.float64))
        cell = Cell(codes.of(vectors), to, codes.bits, lead, near)
        counts, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for x, y in cell.pairs():
            if bi != bj:
                ok = block[x] != block[y]
                x, y = x[ok], y[ok]
            for p in range(0, len(x), 1 << 15):
                i, j = x[p : p + (1 << 15)], y[p : p + (1 << 15)]
                ok = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= threshold
                i, j = i[ok], j[ok]
                np.add.at(counts, i, copies[j])
                np.add.at(counts, j, copies[i])
                for u, v in set(zip(i.tolist(), j.tolist())):
                    forest.link(u, v)
        return ids, counts, forest.edges

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

        def finish():
            ids, counts, edges = compare(*now, held)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(counts[some])], schema=schema)
            if edges:
                u, v = (ids[list(e)] for e in zip(*edges))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], schema=schema)

        now, held = None, []
        for b in batches:
            places = zip(*(b.column(c).to_pylist() for c in ("to", "bi", "bj")))
            for place, id_, copies, vector, block in zip(places, b.column("id").to_pylist(), b.column("copies").to_pylist(), _matrix(b.column("vector")), b.column("b").to_pylist()):
                if place != now:
                    if held:
                        yield from finish()
                    now, held = place, []
                held.append((id_, copies, vector, block))
        if held:
            yield from finish()

    return run


def links_of(classes: DataFrame, n: int, dimensions: int, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Rows (u, null, links counted) and (u, v, null) of links; classes has id, copies and vector of one length."""
    # at most `sample` vectors come to the driver; written first, as a sorted limit that is collected would send more
    chosen = common.materialize(classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector"))
    x = unit(np.array(chosen.toPandas().vector.tolist(), np.float64))
    common.discard(chosen)
    bits, tables, near = shape(n, dimensions, threshold, spread=spread_of(x))
    codes = Codes(x, bits, tables)
    # a vector is in a cell of its own and, for each leading bit, in one beside it
    lead = next((k for k in range(1, bits - 1) if n * (1 + k) / 2**k <= CELL_ROWS), bits - 1)
    parts = min(max(MAX_PARTS, common.partitions_for(classes.sparkSession, 0)), max(common.partitions_for(classes.sparkSession, 0), tables << lead))
    placed = common.materialize(classes.select("id", "vector").mapInArrow(_placed(codes, lead), "to long, id long, code binary"))
    # cells with more than a bounded share of all rows are told apart beforehand: at most 100 000 of them
    most = max(CELL_ROWS, placed.count() // 100_000)
    hot = F.broadcast(placed.groupBy("to").count().where(F.col("count") > most).select("to", F.lit(True).alias("hot")))
    marked = placed.join(hot, "to", "left")
    cells = marked.where("hot is null").select("to", "id", "code").repartition(parts, "to").sortWithinPartitions("to")
    members = cells.mapInArrow(_partners(bits, lead, near), "to long, id long").union(marked.where("hot").select("to", "id"))
    members = common.materialize(members)
    common.discard(placed)
    size = members.groupBy("to").agg(F.count("*").alias("rows"))
    size = size.select("to", "rows", F.expr(f"rows div {PART_ROWS} + 1").cast("int").alias("blocks"))
    split = common.met(members, size, ["to"], members.count()).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("b", k).alias("bi"), F.greatest("b", k).alias("bj")))
    split = split.select("to", "id", "b", F.inline(others)).join(classes.select("id", "copies", "vector"), "id")
    split = split.repartition(parts, "to", "bi", "bj").sortWithinPartitions("to", "bi", "bj")
    found = common.materialize(split.mapInArrow(_compared(codes, lead, near, threshold), "u long, v long, n long"))
    common.discard(members)
    return found


def _named(links: DataFrame, names: DataFrame, end: str, n: int) -> DataFrame:
    """``links`` with one end (an id) replaced by its node; hubs are split."""
    degree = links.groupBy(end).agg(F.count("*").alias("rows"))
    known = degree.join(names.select(F.col("id").alias(end), "node"), end)
    return common.met(links, known, [end], n).drop(end).withColumnRenamed("node", end)


def dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    usable = _usable("embedding")
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    keyed = vectors.select(
        "vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("vector"),
        F.when(usable, F.xxhash64("embedding")).alias("a"), F.when(usable, F.xxhash64(F.lit(1), "embedding")).alias("b"),
    )
    classes = keyed.where("a is not null").groupBy("a", "b").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("rep"), F.first("vector").alias("vector")
    )
    classes = common.materialize(classes.withColumn("id", F.col("a")).withColumn("length", F.size("vector")))
    # as many rows as there are lengths of vectors
    lengths = sorted((r.length, r.n) for r in classes.groupBy("length").agg(F.count("*").alias("n")).collect())
    tables = [links_of(classes.where(F.col("length") == length), n, length, threshold) for length, n in lengths if n > 1]
    found = reduce(DataFrame.union, tables, spark.createDataFrame([], "u long, v long, n long"))
    counted = found.where("n is not null").groupBy("u").agg(F.sum("n").alias("links"))
    named = common.materialize(classes.select("a", "b", "id", "copies", "rep").join(counted, F.col("id") == F.col("u"), "left").drop("u"))
    # a class without any id of its own still joins others, under a number that no vector has
    key = named.select("id", F.coalesce("rep", F.col("id")).alias("node"))
    edges = found.where("v is not null").select("u", "v")
    n_edges = edges.count()
    edges = _named(_named(edges, key, "u", n_edges), key, "v", n_edges)
    parts = common.connected_components(edges)
    known = named.join(parts, F.coalesce("rep", "id") == F.col("node"), "left").drop("node", "id").withColumn("rows", F.col("copies"))
    known = common.materialize(known)
    common.discard(classes, named, parts, *tables)
    component = F.coalesce("component_id", "rep", "vec_id")
    mine = common.met(keyed.where("a is not null").select("vec_id", "a", "b"), known, ["a", "b"], vectors.count()).select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), component.cast("long").alias("component_id")
    )
    others = keyed.where("a is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    rows = mine.union(others)
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

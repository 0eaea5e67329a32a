"""N-gram Jaccard join: a metric-space join over sets of word shingles.

Jaccard distance, 1 - |A and B| / |A or B|, is a metric.  Unrelated texts are
all at distance 1, so pivots drawn at random separate nothing; the first level
takes pivots where texts meet.  Shingles are ordered by rising document
frequency (over all documents).  Two sets of Jaccard t or more share one of
the first n - ceil(t n) + 1 shingles of each; the pivot of a shingle is the
least set that has it there, and every other such set joins the pivot's
region.  Any two linked sets therefore meet in a region.

In a region the distances to the pivot are computed.  Sets within r = 1 - t of
it are linked to it, and so are of one component with each other.  What
remains are the outer sets: by the triangle inequality they can only be linked
to outer sets or to those inner sets whose distance to the pivot lies within r
of an outer one's, the boundary, which is replicated.  These rest regions are
joined recursively: Voronoi cells of further pivots, each with the sets whose
distance to its pivot exceeds that to their nearest pivot by 2 r at most, down
to small cells that are compared exactly.

Large regions are salted (each salt has a copy of the pivot), rest regions
over a bound are joined block by block, so no group has to fit in one task and
nothing is capped.  Joins on shingles, pivots and sets split hot keys.  Equal
sets are joined as one, and a shingle that several documents of a map task's
chunk have is sent to be counted once, with their number.  What is counted or
compared comes from shingles that at least two documents have; the others only
matter by their number.

Null and empty texts have no shingles and no links.  Texts of one to four
words have their word sequence as one shingle.  A null doc_id has links to
nothing and a null component.  Rows that share a doc_id are one node.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5
NUM, DEN = 75, 100  # links: DEN * |A and B| >= NUM * |A or B|
BUCKET_BYTES = 8 << 20
CHUNK_SHINGLES = 2 << 20
MAX_PARTS = 1 << 15  # of a shuffle; beyond that a task has several buckets, one after the other
SALT_ROWS = 1000
REST_ROWS = 200
LEAF = 64


def linked(inter, a, b):
    """Whether sets of sizes a and b with an intersection of inter are linked."""
    return DEN * inter >= NUM * (a + b - inter)


# -- sets ---------------------------------------------------------------------
#
# Rows carry many shingles each.  A section is a run of entries (chunk, shingle,
# number, level) in the order of their chunks; a body has two: shingles that one
# document of a chunk has (number: which one), and those that several have
# (number: how many).


def _section(chunk: np.ndarray, h: np.ndarray, x: np.ndarray, level: np.ndarray | None = None) -> bytes:
    names, counts = np.unique(chunk, return_counts=True)
    planes = np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(len(x), 4).T)
    head = np.array([len(h), len(names), level is not None], np.int64)
    return b"".join([head.tobytes(), names.astype(np.int64).tobytes(), counts.astype(np.int64).tobytes(), h.tobytes(), planes.tobytes(), level.tobytes() if level is not None else b""])


def _sections(body: bytes) -> list[tuple[np.ndarray, ...]]:
    """(chunk, shingle, number, level) of both sections."""
    at, out = 0, []
    for _ in range(2):
        n, k, levels = np.frombuffer(body, np.int64, 3, at).tolist()
        names, counts = np.frombuffer(body, np.int64, 2 * k, at + 24).reshape(2, k)
        at += 24 + 16 * k
        h = np.frombuffer(body, np.uint64, n, at)
        x = np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * n, at + 8 * n).reshape(4, n).T).view(np.uint32).ravel()
        at += 12 * n
        level = np.frombuffer(body, np.uint8, n, at) if levels else np.zeros(0, np.uint8)
        at += len(level)
        out.append((np.repeat(names, counts), h, x, level))
    return out


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    kinds = (np.int64, np.uint64, np.uint32, np.uint8)
    return tuple(np.concatenate([np.zeros(0, t), *x]) for t, x in zip(kinds, zip(*parts))) if parts else tuple(np.zeros(0, t) for t in kinds)


def _split(by: list[np.ndarray]):
    """For each value of the keys ``by`` of both sections: (value, their entries)."""
    order = [np.argsort(k, kind="stable") for k in by]
    values = np.unique(np.concatenate(by))
    edges = [(np.searchsorted(k[o], values), np.searchsorted(k[o], values, side="right")) for k, o in zip(by, order)]
    for i, v in enumerate(values.tolist()):
        yield v, [o[a[i] : z[i]] for o, (a, z) in zip(order, edges)]


ROWS = "to int, key long, kind int, body binary"


def _emit(rows):
    """Rows (to, key, kind, body) as batches of some megabytes."""
    import pyarrow as pa

    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["to", "key", "kind", "body"]
        )

    for r in rows:
        held.append(r)
        size += len(r[3])
        if size >= 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _taken(batches):
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("to", "key", "kind")), (x.as_py() for x in b.column("body")))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _sub(h: np.ndarray, subs: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(subs) >> np.uint64(32)).astype(np.int64)


def _shingled(parts: int):
    """Map stage: shingles by hash bucket (kind 1), and each chunk's documents (kind 0)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()

        def flush(chunk, ids, hashes, sizes):
            h, n = np.concatenate(hashes), np.concatenate(sizes)
            at = np.r_[0, np.cumsum(n)]
            s1, s2 = (np.r_[np.uint64(0), np.cumsum(common.mix64(h ^ np.uint64(c)))] for c in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47))
            s1, s2 = s1[at[1:]] - s1[at[:-1]], s2[at[1:]] - s2[at[:-1]]
            doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            # a shingle of several documents of the chunk travels once, with their number
            order = np.argsort(h)
            sorted_ = h[order]
            first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]][: len(h)])
            counts = np.diff(np.r_[first, len(h)])
            several = counts > 1
            single = np.zeros(len(h), bool)
            single[order[first[~several]]] = True
            shared = sorted_[first[several]]
            docs = pa.concat_arrays(ids).fill_null(common.NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.bincount(doc[~single], minlength=len(n))
            head = [np.array([len(docs), (~single).sum()], np.int64), docs, n.astype(np.int64), s1, s2, own.astype(np.int64), h[~single]]
            yield int(pid % parts), chunk, 0, b"".join(x.tobytes() for x in head)
            entries = [(h[single], doc[single]), (shared, counts[several])]
            for to, rows in _split([_part(x, parts) for x, _ in entries]):
                body = [_section(np.full(len(r), chunk), x[r], y[r]) for r, (x, y) in zip(rows, entries)]
                yield to, 0, 1, b"".join(body)

        def rows():
            seq, ids, hashes, sizes, held = 0, [], [], [], 0
            for b in common.small(batches):
                h, at = common.shingle_hashes(*common.word_hashes(*common.column_bytes(b.column("text"))), WIDTH)
                ids.append(b.column("doc_id").cast(pa.int64()))
                hashes.append(h)
                sizes.append(np.diff(at))
                held += len(h)
                if held >= CHUNK_SHINGLES:
                    yield from flush((pid << 20) + seq, ids, hashes, sizes)
                    seq, ids, hashes, sizes, held = seq + 1, [], [], [], 0
            if ids:
                yield from flush((pid << 20) + seq, ids, hashes, sizes)

        yield from _emit(rows())

    return run


def _regrouped(keys):
    """For a task with several groups: the entries of many rows, a row for each group; ``keys`` gives an entry's group."""

    def run(batches):
        def rows():
            held, size = [], 0

            def flush():
                both = [_joined([x[i] for x in held]) for i in range(2)]
                for key, own in _split([keys(*c) for c in both]):
                    body = []
                    for r, (chunk, h, x, level) in zip(own, both):
                        r = r[np.argsort(chunk[r], kind="stable")]
                        body.append(_section(chunk[r], h[r], x[r], level[r] if len(level) else None))
                    yield 0, key, 1, b"".join(body)

            for row in _taken(batches):
                if row[2] == 0:
                    yield row
                    continue
                held.append(_sections(row[3]))
                size += len(row[3])
                if size >= 32 << 20:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        yield from _emit(rows())

    return run


def _frequent(parts: int, bundled: bool):
    """Bucket stage: sends each chunk its shingles of two or more documents, with the log of their frequency.

    A row answers one chunk, or, ``bundled``, all chunks of a task.
    """

    def run(batches):
        def answers(held):
            single, shared = (_joined([x[i] for x in held]) for i in range(2))
            h, weight = np.concatenate([single[1], shared[1]]), np.concatenate([np.ones(len(single[1]), np.int64), shared[2].astype(np.int64)])
            order = np.argsort(h)
            sorted_ = h[order]
            first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]][: len(h)])
            if not len(first):
                return
            total = np.add.reduceat(weight[order], first)
            level = np.empty(len(h), np.uint8)
            level[order] = np.repeat(np.frexp(total.astype(np.float64))[1].astype(np.uint8), np.diff(np.r_[first, len(h)]))  # 1: one document
            del order, sorted_, h, weight
            keep = np.flatnonzero(level[: len(single[0])] > 1)
            entries = [(*(c[keep] for c in single[:3]), level[keep]), (*shared[:3], level[len(single[0]) :])]
            to = [(e[0] >> 20) % parts for e in entries]
            for key, own in _split(to if bundled else [e[0] for e in entries]):
                body = []
                for r, (chunk, h, x, v) in zip(own, entries):
                    r = r[np.argsort(chunk[r], kind="stable")] if bundled else r
                    body.append(_section(chunk[r], h[r], x[r], v[r]))
                yield int(key if bundled else (key >> 20) % parts), int(key), 1, b"".join(body)

        def rows():
            now, held = None, []
            for to, key, kind, body in _taken(batches):
                if kind == 0:
                    yield to, key, kind, body
                    continue
                if key != now and held:
                    yield from answers(held)
                    held = []
                now = key
                held.append(_sections(body))
            if held:
                yield from answers(held)

        yield from _emit(rows())

    return run


SETS = "doc_id long, n long, s1 long, s2 long, prefix array<long>, rare binary"


def _prefixes(batches):
    """Chunk stage: each document's size, digest, and, if it may have a partner, its prefix and its frequent shingles."""
    import pyarrow as pa

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("rare", pa.binary()),
    ])

    def finish(head, bodies):
        m, k = np.frombuffer(head, np.int64, 2).tolist()
        ids, n, s1, s2, own = np.frombuffer(head, np.int64, 5 * m, 16).reshape(5, m)
        (_, h, doc, level), shared = (_joined([x[i] for x in bodies]) for i in range(2))
        if k:  # shingles of several documents of the chunk: their levels came once
            order = np.argsort(shared[1])
            pairs = np.frombuffer(head, np.uint64, k, 16 + 40 * m)
            h, doc = np.concatenate([h, pairs]), np.concatenate([doc, np.repeat(np.arange(m, dtype=np.uint32), own)])
            level = np.concatenate([level, shared[3][order][np.searchsorted(shared[1][order], pairs)]])
        often = np.bincount(doc, minlength=m)
        wanted = n - -(-NUM * n // DEN) + 1 - (n - often)  # what of the prefix remains after unique shingles
        wanted[(n == 0) | (ids == common.NULL_ID)] = 0
        use = (wanted > 0)[doc]
        h, doc, level = h[use], doc[use], level[use]
        order = np.lexsort((h, level, doc))
        h, doc = h[order], doc[order]
        at = np.searchsorted(doc, np.arange(m + 1))
        prefix, rare = [None] * m, [None] * m
        for i in np.flatnonzero(wanted > 0):
            mine = h[at[i] : at[i + 1]]
            prefix[i] = mine[: wanted[i]].view(np.int64)
            rare[i] = np.sort(mine).tobytes()
        for a in range(0, m, 1000):
            z = min(m, a + 1000)
            cols = (ids[a:z], n[a:z], s1[a:z], s2[a:z], prefix[a:z], rare[a:z])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, schema.types)], schema=schema)

    now, head, bodies = None, None, []
    for _, key, kind, body in _taken(batches):
        if key != now:
            if now is not None:
                yield from finish(head, bodies)
            now, head, bodies = key, None, []
        if kind == 0:
            head = body
        else:
            bodies.append(_sections(body))
    if now is not None:
        yield from finish(head, bodies)


def sets_of(docs: DataFrame) -> DataFrame:
    """One row per document: size and digest of its shingle set; prefix and frequent shingles where it may have a partner.

    The number of shuffle partitions is bounded; where buckets outnumber them,
    a task regroups its rows and takes one bucket, or one chunk, after the other.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    buckets = common.partitions_for(spark, common.text_bytes(docs), BUCKET_BYTES)
    parts = min(buckets, max(MAX_PARTS, common.partitions_for(spark, 0)))
    subs = -(-buckets // parts)
    rows = docs.mapInArrow(_shingled(parts), ROWS).repartitionById(parts, F.col("to"))
    if subs > 1:
        rows = rows.mapInArrow(_regrouped(lambda chunk, h, x, level: _sub(h, subs)), ROWS).sortWithinPartitions("key")
    rows = rows.mapInArrow(_frequent(parts, subs > 1), ROWS).repartitionById(parts, F.col("to"))
    if subs > 1:
        rows = rows.mapInArrow(_regrouped(lambda chunk, h, x, level: chunk), ROWS)
    return common.materialize(rows.sortWithinPartitions("key").mapInArrow(_prefixes, SETS))


# -- regions ------------------------------------------------------------------


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _to_pivot(batches):
    """Distances of a region's sets to its pivot, whose row comes first."""
    import pyarrow as pa

    now, pivot, size = None, None, 0
    for b in batches:
        out = []
        for p, salt, x, n, rare in zip(*(b.column(c).to_pylist() for c in ("p", "salt", "x", "n", "rare"))):
            own = np.frombuffer(rare, np.uint64)
            if (p, salt) != now:
                if x != p:
                    raise ValueError("a region's pivot is missing")
                now, pivot, size = (p, salt), own, n
            elif x != p:
                inter = overlap(pivot, own)
                out.append((p, x, n, 1 - inter / (n + size - inter), linked(inter, n, size)))
        if out:
            cols = list(zip(*out))
            types = (pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["p", "x", "n", "d", "inner"])


class Forest:
    """Union-find over the sets of one cell; keeps only links that join two trees."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def join_region(sets: list[np.ndarray], sizes: np.ndarray, outer: np.ndarray, forest: Forest, of: np.ndarray | None = None, depth: int = 0) -> None:
    """Link all pairs with at least one outer set, by Voronoi cells until they are small."""
    of = np.arange(len(sets)) if of is None else of
    if len(of) < 2 or not outer[of].any():
        return

    def counts(rows: np.ndarray, against: list[int]) -> np.ndarray:
        """Intersections of some sets (rows of ``of``) with all of ``of``."""
        values, member = np.concatenate([sets[i] for i in of]), np.repeat(np.arange(len(of)), [len(sets[i]) for i in of])
        out = np.zeros((len(against), len(of)), np.int64)
        order = np.argsort(values, kind="stable")
        values, member = values[order], member[order]
        for k, i in enumerate(against):
            lo, hi = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], side="right")
            n = hi - lo
            if n.sum():
                flat = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
                out[k] = np.bincount(member[flat], minlength=len(of))
        return out

    if len(of) > LEAF and depth < 8:
        pivots = of[np.linspace(0, len(of) - 1, 8).astype(int)]
        inter = counts(pivots, list(pivots))
        d = 1 - inter / (sizes[pivots][:, None] + sizes[of][None, :] - inter)
        reach = d <= d.min(0) + 2 * (1 - NUM / DEN) + 1e-12
        home = d.argmin(0)
        if max(reach.sum(1)) <= 0.8 * len(of):
            for c in range(len(pivots)):
                if (home == c).any():
                    join_region(sets, sizes, outer, forest, of[reach[c]], depth + 1)
            return
    for i in of[outer[of]]:  # exact, a set against all others of the cell
        inter = counts(of, [i])[0] if len(of) <= LEAF else None
        if inter is None:
            break
        for j in np.flatnonzero(linked(inter, sizes[i], sizes[of])):
            if of[j] != i:
                forest.link(int(i), int(of[j]))
    else:
        return
    rows = [int(i) for i in of[outer[of]]]
    for a in range(0, len(rows), 256):
        got = counts(of, rows[a : a + 256])
        for k, i in enumerate(rows[a : a + 256]):
            for j in np.flatnonzero(linked(got[k], sizes[i], sizes[of])):
                if of[j] != i:
                    forest.link(i, int(of[j]))


def _rest(batches):
    """Links within the rest regions of a partition, whose rows lie together."""
    import pyarrow as pa

    def finish(rows):
        seen, sets, sizes, outer, names = {}, [], [], [], []
        for x, n, rare, out in rows:
            if x in seen:
                outer[seen[x]] |= out
                continue
            seen[x] = len(names)
            names.append(x)
            sets.append(np.frombuffer(rare, np.uint64))
            sizes.append(n)
            outer.append(out)
        forest = Forest(len(names))
        join_region(sets, np.array(sizes, np.int64), np.array(outer, bool), forest)
        if forest.edges:
            u, v = zip(*forest.edges)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in e], pa.binary()) for e in (u, v)], names=["u", "v"])

    now, rows = None, []
    for b in batches:
        for p, bi, bj, x, n, rare, out in zip(*(b.column(c).to_pylist() for c in ("p", "bi", "bj", "x", "n", "rare", "outer"))):
            if (p, bi, bj) != now:
                if rows:
                    yield from finish(rows)
                now, rows = (p, bi, bj), []
            rows.append((x, n, rare, out))
    if rows:
        yield from finish(rows)


def _name(rep: str) -> Column:
    """What a set is called: its least document and half of its digest, 16 bytes."""
    return F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in (rep, "s1")])


def _rep(name: str) -> Column:
    """The least document of a set, from its name."""
    return F.conv(F.hex(F.substring(name, 1, 8)), 16, -10).cast("long")


def links_of(sets: DataFrame) -> DataFrame:
    """Links (u, v) between distinct shingle sets, by their least documents, that make up the same components as all links do."""
    spark = sets.sparkSession
    r = 1 - NUM / DEN
    # one row for each distinct set that may have a partner
    own = sets.where("prefix is not null").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "prefix", "rare")).alias("x"))
    own = common.materialize(own.select(_name("x.doc_id").alias("x"), "n", "x.prefix", "x.rare"))
    postings = own.select("x", F.explode("prefix").alias("t"))
    n_postings = own.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    lists = postings.groupBy("t").agg(F.min("x").alias("p"), F.max("x").alias("last"), F.count("*").alias("rows")).where("p <> last").drop("last")
    pairs = common.materialize(common.met(postings, lists, ["t"], n_postings).where("x <> p").select("p", "x").distinct())
    size = pairs.groupBy("p").agg(F.count("*").alias("rows"))
    salts = common.materialize(size.select("p", "rows", F.expr(f"rows div {SALT_ROWS} + 1").cast("int").alias("salts")))
    data = own.select("x", "n", "rare")
    members = common.met(pairs, salts, ["p"], n_postings).select("p", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"), "x").join(data, "x")
    pivots = salts.select("p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("p").alias("x")).join(data, "x")
    columns = ("p", "salt", "x", "n", "rare")
    parts = common.partitions_for(spark, 0)
    region = members.select(*columns).union(pivots.select(*columns)).repartition(parts, "p", "salt")
    region = region.sortWithinPartitions("p", "salt", F.col("x") != F.col("p"))
    near = common.materialize(region.mapInArrow(_to_pivot, "p binary, x binary, n long, d double, inner boolean"))
    inner = near.where("inner").select(F.col("p").alias("u"), F.col("x").alias("v"))
    # what a region has left: outer sets, and the inner ones that the triangle inequality leaves as partners
    least = near.groupBy("p").agg(F.min(F.when(~F.col("inner"), F.col("d"))).alias("least"), F.count("*").alias("rows")).where("least is not null")
    rest = common.met(near, least, ["p"], n_postings).where((~F.col("inner")) | (F.col("d") >= F.col("least") - r - 1e-12))
    rest = common.materialize(rest.select("p", "x", (~F.col("inner")).alias("outer")))
    tall = rest.groupBy("p").agg(F.count("*").alias("rows")).where("rows > 1")
    tall = tall.select("p", "rows", F.expr(f"rows div {REST_ROWS} + 1").cast("int").alias("blocks"))
    placed = common.met(rest, tall, ["p"], n_postings).withColumn("b", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    # block pairs (i, j), i <= j: every two members meet in one task
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("b", k).alias("bi"), F.greatest("b", k).alias("bj")))
    placed = placed.select("p", "x", "outer", "blocks", F.inline(others)).join(data, "x")
    # the block pairs of a region go to one task after another, where a hash would put some together
    to = F.pmod(F.xxhash64("p") + F.col("bi") * F.col("blocks") + F.col("bj"), F.lit(parts)).cast("int")
    placed = placed.repartitionById(parts, to).sortWithinPartitions("p", "bi", "bj", "x")
    found = placed.select("p", "bi", "bj", "x", "n", "rare", "outer").mapInArrow(_rest, "u binary, v binary")
    links = common.materialize(inner.union(found).select(_rep("u").alias("u"), _rep("v").alias("v")).distinct())
    common.discard(own, pairs, salts, near, rest)
    return links


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    sets = sets_of(docs)
    links = links_of(sets)
    # the least document stands for all of its set
    digest = ["s1", "s2", "n"]
    real = (F.col("n") > 0) & (F.col("doc_id") != common.NULL_ID)
    full = sets.where(real).select("doc_id", *digest)
    named = common.materialize(full.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    # a doc_id of several sets links them
    several = full.groupBy("doc_id").agg(F.min(F.struct(*digest)).alias("lo"), F.max(F.struct(*digest)).alias("hi"))
    several = common.materialize(several.where("lo <> hi").select("doc_id"))  # mostly empty, which the plan can see
    same = full.join(several, "doc_id").distinct().join(named.drop("rows"), digest).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    parts = common.connected_components(links.union(same))
    found = named.join(parts, named.rep == parts.node, "left").select(*digest, F.coalesce("component_id", "rep").alias("component_id"), "rows")
    found = common.materialize(found)
    total = sets.count()
    common.discard(links, named, several, parts)
    mine = common.met(full, found, digest, total).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    ids = F.when(F.col("doc_id") != common.NULL_ID, F.col("doc_id"))
    others = sets.where(~real).select(ids.alias("doc_id"), F.col("n").alias("n_shingles"), ids.alias("component_id"))
    out = common.materialize(mine.union(others))
    common.discard(sets, found)
    return out

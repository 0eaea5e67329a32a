"""Helpers shared by the operators of this subpackage.

Shared storage, identity of rows, joins that split hot keys, vectorised word
handling and connected components.  Nothing here keeps state between queries.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the word definition ``[^\\x20\\x09-\\x0D]+``.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Least input bytes for which a stage gets a partition of its own.
PART_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a temporary
    folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        else:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = "file://" + folder
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


#: Makes Spark delete the shuffle files of a write as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs no more than the tasks that
    ran since the last written table.  The write's own shuffles are deleted
    when it has ended.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later plan reads."""
    for df in dfs:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._millrace_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(spark: SparkSession, n_bytes: float, part_bytes: int | None = None) -> int:
    """Partitions of about ``part_bytes``, by default the session's advisory size; never under the session's own number."""
    if part_bytes is None:
        advised = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m").strip().lower().removesuffix("b")
        unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(advised[-1:], 0)
        part_bytes = max(PART_BYTES, int(float(advised.rstrip("kmgt")) * 2**unit))
    own = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return int(max(own, -(-n_bytes // part_bytes), 1))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


#: The id that stands for a null one; it comes first.
NULL_ID = -(2**63)


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` (columns doc_id, text and others) with id, ta and tb, which tell apart rows whose id or text differs.

    id is the doc_id (NULL_ID for null).  The tags are a 128-bit hash of the text where rows share an id but not the
    text, and 0 elsewhere, so that they cost nothing in most tables.
    """
    rows = docs.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID)))
    a, b = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    tags = rows.select("id", a.alias("a"), b.alias("b"))
    shared = tags.groupBy("id").agg(F.min("a").alias("a1"), F.max("a").alias("a2"), F.min("b").alias("b1"), F.max("b").alias("b2"))
    # written, so that the plan knows its size: mostly it is empty, and broadcast if small
    shared = materialize(shared.where("a1 <> a2 or b1 <> b2").select("id", F.lit(True).alias("shared")))
    rows = rows.join(shared, "id", "left")
    return rows.withColumn("ta", F.when(F.col("shared"), a).otherwise(F.lit(0))).withColumn("tb", F.when(F.col("shared"), b).otherwise(F.lit(0))).drop("shared")


def met(big: DataFrame, small: DataFrame, keys: list[str], total: int, rows: str = "rows") -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row for each of the keys and, in ``rows``, how many rows of ``big`` have it.

    Keys with more than a bounded share of the ``total`` rows are salted, so
    that no task gets all of one.  At most 100 000 keys can have that many;
    they are broadcast.
    """
    most = max(64, -(-total // 100_000))
    salts = F.floor(F.col(rows) / most).cast("int")
    hot = F.broadcast(small.where(F.col(rows) > most).select(*keys, salts.alias("salts")))
    others = [c for c in big.columns if c not in keys]
    big = big.join(hot, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*(others or keys)), F.col("salts") + 1), F.lit(0)).cast("int")).drop("salts")
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col(rows) > most, salts).otherwise(0)))).drop(rows)
    return big.join(small.hint("merge"), [*keys, "salt"]).drop("salt")


def running(df: DataFrame, by: list[str], at: str, value: str, out: str, group: int = 1024) -> DataFrame:
    """``df`` (one row for each of ``by`` and ``at``, a small whole number) with the sum of ``value`` before it, in the order of ``at``.

    Sums of groups of ``at`` first, then within each, so that no task gets all rows of one key.
    """
    df = df.withColumn("__g", F.expr(f"`{at}` div {group}"))
    coarse = df.groupBy(*by, "__g").agg(F.sum(value).alias("__n"))
    coarse = coarse.withColumn("__b", F.sum("__n").over(Window.partitionBy(*by).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)))
    inner = F.sum(value).over(Window.partitionBy(*by, "__g").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__i", inner).join(coarse.drop("__n"), [*by, "__g"])
    return df.withColumn(out, F.coalesce("__b", F.lit(0)) + F.coalesce("__i", F.lit(0))).drop("__g", "__b", "__i")


def row_hashes(df: DataFrame) -> tuple:
    """A 128-bit hash of a whole row (but maps, which have none), as two columns."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    cols += [c.isNull() for c in cols]
    return F.xxhash64(F.lit(0), *cols), F.xxhash64(F.lit(1), *cols)


# -- words and shingles of many texts at once ---------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_KNOWN_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64; those of a small batch are kept for the next one."""
    known = _KNOWN_POWERS.get(base)
    if known is not None and len(known) >= n:
        return known[:n]
    out = np.empty(n, np.uint64)
    out[:1] = 1
    filled, step = min(n, 1), base
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * np.uint64(step)
        filled += take
        step = step * step % (1 << 64)
    if n <= 1 << 19:  # 4 MB
        _KNOWN_POWERS[base] = out
    return out


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def small(batches, column: str = "text", most: int = 1 << 20):
    """Batches cut so that a text column has about ``most`` bytes in each, or one row."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        at = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(at, (at[a - 1] if a else 0) + most, side="right")))
            yield b.slice(a, z - a)
            a = z


def prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s, inverse powers): (s[z] - s[a]) * inverse[a] is a hash of raw[a:z] wherever it stands."""
    value = _BYTE[raw]
    value *= _powers(_BASE, len(raw))
    s = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value, out=s[1:])
    return s, _powers(_INV, len(raw))


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts lying one behind another.

    Returns (hashes, offsets): text i has the hashes ``offsets[i]:offsets[i+1]``.
    A word's hash depends on its bytes only, not on its place.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < at[1:]]
    begins[edges] |= solid[edges]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[edges[1:] - 1] |= solid[edges[1:] - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    value = _BYTE[_LOWER[raw] if lower else raw]
    value *= _powers(_BASE, n)
    np.cumsum(value, out=value)
    total = value[last - 1]
    total[first > 0] -= value[first[first > 0] - 1]
    total *= _powers(_INV, n)[first]
    total += (last - first).astype(np.uint64)
    return mix64(total), np.searchsorted(first, at).astype(np.int64)


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each text as sorted 64-bit hashes.

    A text with 1 to ``width - 1`` words has its whole word sequence as one
    shingle; a text without words has none.  Returns (hashes, offsets).
    """
    counts = np.diff(at)
    texts = len(counts)
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    owner = np.repeat(np.arange(texts), counts)
    out, whose = [], []
    if n >= width:
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h = mix64(h * np.uint64(0xFF51AFD7ED558CCD) + words[k : n - width + 1 + k] + np.uint64(1))
        full = owner[: n - width + 1] == owner[width - 1 :]
        out.append(h[full])
        whose.append(owner[: n - width + 1][full])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        h = counts[short].astype(np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            h[has] = mix64(h[has] * np.uint64(0xC4CEB9FE1A85EC53) + words[at[short[has]] + k] + np.uint64(2))
        out.append(h)
        whose.append(short)
    h, whose = np.concatenate(out), np.concatenate(whose)
    order = np.lexsort((h, whose)) if texts > 1 else np.argsort(h)
    h, whose = h[order], whose[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])
    h, whose = h[new], whose[new]
    return h, np.searchsorted(whose, np.arange(texts + 1)).astype(np.int64)


# -- connected components -----------------------------------------------------


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component_id) for the nodes of ``edges`` (columns ``u``, ``v``), a written table.

    component_id is the smallest node reachable.  Alternating large-star and
    small-star rounds (Kiveris et al., 2014): every round is a partial minimum
    per node and an equi-join that splits hubs, and its edges go to a shared
    table, so no group is gathered in one place and lineage stays short.  The
    number of rounds grows with the logarithm of the longest chain.
    """

    def lowest(pairs: DataFrame, value: Column) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select("u", value.alias("m"), "rows")

    def written(edges: DataFrame) -> tuple[DataFrame, tuple]:
        """A table of the distinct edges, their number and a 128-bit digest of them."""
        out = materialize(edges.where("u <> v").distinct())
        return out, tuple(out.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())

    now, known = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    for _ in range(max_rounds):
        # a round is over when its edges are stars that no step changes
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = met(both, lowest(both, F.least("u", "m")), ["u"], 2 * known[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = met(large, lowest(large, F.col("m")), ["u"], 2 * known[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        before, told = now, known
        now, known = written(small)
        discard(before)
        if known == told:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(tops)
    out._millrace_path = now._millrace_path  # for discard
    return out
